import math
from collections import Counter

import numpy as np
import pyarrow as pa

from emberline.llm import lm
from emberline.llm import textkernel as K
from emberline.llm.scratch import Scratch
from emberline.llm.seating import draw, stirling

from .helpers import docs, prose, words


def scores(spark, train, texts):
    model = lm.fit(docs(spark, train).select("text"), Scratch(spark, "lm"))
    return model, {r.doc_id: r for r in lm.score(docs(spark, texts), model, ["doc_id"]).collect()}


def test_counts_and_base_are_exact(spark):
    train = [prose(i, 60) for i in range(40)] + [None, "", "Solo"]
    texts = [*train[:5], "never seen words here", None, "", prose(99, 80), prose(1, 60) + " " + prose(77, 3)]
    model, got = scores(spark, train, texts)
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert (model.tokens, model.types) == (n, v)
    for i, t in enumerate(texts):
        each = [c[w] for w in words(t)] + [len(train)]
        r = got[i]
        assert (r.n_tokens, r.n_known) == (len(each), sum(x > 0 for x in each))
        assert math.isclose(r.base_score, sum(math.log10((x + 1) / (n + 1 * (v + 1))) for x in each), rel_tol=1e-9)
        assert r.score < 0


def test_probabilities_of_a_context_sum_to_one(spark):
    train = [prose(i, 50) for i in range(30)]
    model = lm.fit(docs(spark, train).select("text"), Scratch(spark, "lm"))
    rows = model.words.toPandas()
    sheet = lm.Sheet(*lm._unpack(pa.array(rows["packed"].tolist(), pa.binary())), model.back)
    parent = model.contexts.parent
    dense = np.hstack([sheet.classes, model.back[lm.CLASSES :] + sheet.classes[:, parent]])
    dense[sheet.owner, sheet.r] = sheet.p
    new = np.concatenate([model.new, model.back[lm.CLASSES :] + model.new[parent]])
    total = (10 ** (dense - model.scale)).sum(0) + 10 ** (new - model.scale)
    assert np.allclose(total, 1, atol=1e-4), total
    assert np.allclose(10**model.scale, 1, atol=0.1)


def test_contexts_help_on_two_manners_of_writing(spark):
    a, b = [f"aa{i}" for i in range(40)], [f"bb{i}" for i in range(40)]
    r = np.random.default_rng(1)
    texts = [" ".join(x for k in r.integers(0, 40, 60) for x in ((" the" if m is a else " der").strip(), m[k])) for m in (a, b) * 60]
    _, got = scores(spark, texts[:100], texts[100:])
    assert all(r.score > r.base_score for r in got.values())


def test_the_word_before_tells(spark):
    r = np.random.default_rng(3)
    pairs = [(f"u{i}", f"v{i}") for i in range(30)]
    texts = [" ".join(x for k in r.integers(0, 30, 40) for x in pairs[k]) for _ in range(80)]
    mixed = " ".join(x for k in range(30) for x in (f"u{k}", f"v{(k + 7) % 30}"))
    right = " ".join(x for k in range(30) for x in (f"u{k}", f"v{k}"))
    _, got = scores(spark, texts, [right, mixed])
    assert math.isclose(got[0].base_score, got[1].base_score) and got[0].score > got[1].score + 30


def test_scores_do_not_depend_on_partitions(spark):
    train = [prose(i % 40, 60) for i in range(90)]
    out = []
    for parts in (2, 7):
        table = docs(spark, train).repartition(parts)
        model = lm.fit(table.select("text"), Scratch(spark, "lm"))
        out.append({r.doc_id: r.score for r in lm.score(table, model, ["doc_id"]).collect()})
    assert all(math.isclose(out[0][i], out[1][i], rel_tol=1e-9) for i in out[0])


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    long = prose(5, 150_000)
    rows = [(7, "a b c", "x"), (7, "a b c", "x"), (None, long, None)]
    table = spark.createDataFrame(rows, "score long, text string, block string")
    model = lm.fit(table.select("text"), Scratch(spark, "lm"))
    out = lm.score(table, model, ["score", "block", "text"])
    got = sorted(out.collect(), key=lambda r: r.n_tokens)
    assert out.columns == ["score", "block", "text", "n_tokens", "n_known", "base_score", "score_", "perplexity"]
    assert [r.n_tokens for r in got] == [4, 4, 150_001] and got[0] == got[1] and got[2].text == long and got[2].score is None


def test_a_plain_model_gives_the_same_probabilities(spark):
    """Seats of one bucket, table by table, against sums by dictionaries."""
    train = [prose(i % 9, 25) for i in range(30)]
    model = lm.fit(docs(spark, train).select("text"), Scratch(spark, "lm"))
    rows = model.words.toPandas()
    sheet = lm.Sheet(*lm._unpack(pa.array(rows["packed"].tolist(), pa.binary())), model.back)
    place = {h: i for i, h in enumerate(rows["h"])}
    cells = {(int(o), int(r)): p for o, r, p in zip(sheet.owner, sheet.r, sheet.p)}
    anchors = {int(h): i for i, h in enumerate(model.contexts.anchors.view(np.int64))}
    texts = [*train[:6], "never seen", "", prose(3, 10) + " new " + prose(4, 10)]
    got = {r.doc_id: r.score for r in lm.score(docs(spark, texts), model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        data, offsets = K.flat(pa.array([text]))
        h = lm.tokens(data, offsets)[0].view(np.int64).tolist()
        want, last = 0.0, 0
        for j, x in enumerate(h):
            before = anchors.get(h[j - 1]) if j else None
            at = place.get(x)
            last = int(model.contexts.classes[before]) if before is not None else last
            p = model.new[last] if at is None else sheet.classes[at, last]
            r = last
            if before is not None:
                r = lm.CLASSES + before
                p = cells.get((at, r), model.back[r] + p)
            want += p - model.scale[r]
        assert math.isclose(got[i], want, rel_tol=1e-6), (i, got[i], want)


def test_no_training_text_and_no_text(spark):
    _, got = scores(spark, [], ["a b", None])
    assert [got[i].n_known for i in (0, 1)] == [0, 0] and got[0].score == 0
    _, got = scores(spark, ["a"], [])
    assert got == {}


def test_seating_draws_have_the_right_shares():
    d, theta, c, p0, n = 0.5, 1.0, 4, 0.3, 200_000
    s = np.exp(stirling(d)[c, 1 : c + 1])
    a = theta
    want = np.array([np.prod([a + d * k for k in range(t)]) * p0**t * s[t - 1] for t in range(1, c + 1)])
    got = np.bincount(draw(np.full(n, c), np.full(n, p0), np.zeros(n), d, theta, np.random.default_rng(0)), minlength=c + 1)[1:] / n
    assert np.allclose(got, want / want.sum(), atol=0.01)
    # Beyond the customers that are drawn at once, the mean stays near the exact one.
    c = 80
    log = np.array([np.sum(np.log(theta + d * np.arange(t))) + t * np.log(p0) for t in range(1, c + 1)]) + stirling(d, c)[c, 1 : c + 1]
    share = np.exp(log - log.max())
    exact = (share / share.sum() * np.arange(1, c + 1)).sum()
    got = draw(np.full(5000, c), np.full(5000, p0), np.zeros(5000), d, theta, np.random.default_rng(0)).mean()
    assert abs(got - exact) < 0.1 * exact


def test_answers_come_back_by_block():
    r = np.random.default_rng(2)
    rows, batches = [], []
    for _ in range(3):
        m = 40
        size = r.integers(0, 4, m)
        owner = np.repeat(np.arange(m), size)
        block, h, n = r.integers(0, 5, m), r.integers(-(2**62), 2**62, m), r.integers(1, 2**40, m)
        root, cell, p = r.normal(size=m).astype("f4"), r.integers(0, 262, len(owner)), r.normal(size=len(owner)).astype("f4")
        packed = lm._pack(root, owner, cell, p)
        asked = [sorted(set(r.integers(lm.CLASSES, 262, 3).tolist() + cell[owner == i][:1].tolist())) for i in range(m)]
        wanted = pa.array([np.array(x, "<u2").tobytes() for x in asked], pa.binary())
        batches.append(pa.RecordBatch.from_arrays([pa.array(block), pa.array(h), pa.array(n), packed, wanted], ["block", "h", "n", "packed", "wanted"]))
        used = np.array([c < lm.CLASSES or c in asked[o] for o, c in zip(owner, cell)], bool)
        packed = lm._pack(root, owner[used], cell[used], p[used])
        rows += [(int(block[i]), int(h[i]), int(n[i]), packed[i].as_py()) for i in range(m)]
    got = []
    for batch in lm._gathered(iter(batches)):
        for b, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
            h, n, root, size, cell, p = lm._expand(blob)
            packed = lm._pack(root, np.repeat(np.arange(len(size)), size), cell, p)
            got += [(b, int(h[i]), int(n[i]), packed[i].as_py()) for i in range(len(h))]
    assert sorted(got) == sorted(rows)
