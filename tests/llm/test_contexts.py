"""Every word before is a context, not the most frequent ones alone."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

from emberline.llm import lm
from emberline.llm import textkernel as K
from emberline.llm.scratch import Scratch

from .helpers import docs


def corpus(seed=3):
    """Texts with more than ANCHORS frequent words, and rarer words u that are always followed by their v."""
    r = np.random.default_rng(seed)
    return [" ".join([*(f"w{i}" for i in r.permutation(300)), *(x for i in r.permutation(40)[:20] for x in (f"u{i}", f"v{i}"))]) for _ in range(12)]


def test_a_word_beyond_the_most_frequent_ones_tells_what_follows(spark):
    model = lm.fit(docs(spark, corpus()).select("text"), Scratch(spark, "lm"))
    right = " ".join(x for i in range(40) for x in (f"u{i}", f"v{i}"))
    mixed = " ".join(x for i in range(40) for x in (f"u{i}", f"v{(i + 7) % 40}"))
    got = {r.doc_id: r for r in lm.score(docs(spark, [right, mixed]), model, ["doc_id"]).collect()}
    assert math.isclose(got[0].base_score, got[1].base_score)
    assert got[0].score > got[1].score + 30


def plain(model, contexts):
    """Restaurants of other words by dictionaries: pairs' customers and tables, each restaurant's sums."""
    n, t, kinds = defaultdict(dict), {}, {}
    rows = model.sheets.collect()
    for row in rows:
        if not row.pairs:
            q, tables = lm._unzip(lm._TABLES, bytes(row.blob))
            t |= dict(zip(q.tolist(), (tables / model.samples).tolist()))
    for row in rows:
        if row.pairs:
            k, c, size, h, count = lm._unzip(lm._PAIRS, bytes(row.blob))
            kinds |= dict(zip(k.tolist(), c.tolist()))
            for name, word, c in zip(np.repeat(k, size).tolist(), h.tolist(), count.tolist()):
                q = int(lm._names(np.array([name], np.uint64), np.array([word], np.uint64))[0])
                assert (q in t) == (c > 1) and word not in n[name]
                n[name][word] = (c, t.get(q, 1.0))
    return n, kinds


def test_a_plain_model_gives_the_same_probabilities_for_all_words_before(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 4000)
    train = [*corpus(), "", "alone", "u1 v1 u1"]
    model = lm.fit(docs(spark, train).repartition(5).select("text"), Scratch(spark, "lm"))
    assert model.bits > 2
    contexts = model.contexts
    n, kinds = plain(model, contexts)
    want, votes = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: [0] * lm.CLASSES)
    for text in train:
        h, first = lm.tokens(*K.flat(pa.array([text])))
        r = contexts.of(h, first)
        for j in range(1, len(h)):
            if h[j - 1] not in contexts.anchors:
                at, k = contexts.others(h, first, r)
                k = int(k[at.tolist().index(j)])
                want[k][int(h[j])] += 1
                votes[k][int(r[j])] += 1
    assert {k: {h: c for h, (c, _) in x.items()} for k, x in n.items()} == want and len(want) > 60
    assert kinds == {k: max(range(lm.CLASSES), key=lambda c: (x[c], -c)) for k, x in votes.items()}

    rows = model.words.toPandas()
    sheet = lm.Sheet(*lm._unpack(pa.array(rows["packed"].tolist(), pa.binary())), model.back)
    place = {h: i for i, h in enumerate(rows["h"].to_numpy().view(np.uint64).tolist())}
    cells = {(int(o), int(r)): p for o, r, p in zip(sheet.owner, sheet.r, sheet.p)}
    texts = [*train, "never v1 u1 never v2", "u2 v2 w5 u3 v9"]
    got = {r.doc_id: r.score for r in lm.score(docs(spark, texts).repartition(3), model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        h, first = lm.tokens(*K.flat(pa.array([text])))
        r = contexts.of(h, first)
        names = dict(zip(*(x.tolist() for x in contexts.others(h, first, r))))
        total = 0.0
        for j, (x, c) in enumerate(zip(h.tolist(), r.tolist())):
            c = kinds.get(names.get(j), c)
            kind = c if c < lm.CLASSES else int(contexts.parent[c - lm.CLASSES])
            p = model.new[kind] if x not in place else sheet.classes[place[x], kind]
            if c >= lm.CLASSES:
                p = cells.get((place.get(x), c), model.back[c] + p)
            p = 10 ** (p - model.scale[c])
            if j in names:
                own = n.get(names[j], {})
                customers, tables = sum(a for a, _ in own.values()), sum(b for _, b in own.values())
                mine = own.get(x, (0, 0))
                p = (mine[0] - model.d_other * mine[1] + (lm.THETA + model.d_other * tables) * p) / (customers + lm.THETA)
            total += math.log10(p)
        assert math.isclose(got[i], total, rel_tol=1e-5), (i, got[i], total)


def test_scores_with_many_slices_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 4000)
    out = []
    for parts in (2, 7):
        table = docs(spark, corpus()).repartition(parts)
        model = lm.fit(table.select("text"), Scratch(spark, "lm"))
        out.append({r.doc_id: r.score for r in lm.score(table, model, ["doc_id"]).collect()})
    assert all(math.isclose(out[0][i], out[1][i], rel_tol=1e-6) for i in out[0])
