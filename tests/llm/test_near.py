import random
from collections import defaultdict

from emberline.llm import links, minhash, paragraphs
from emberline.llm.scratch import Scratch

from .helpers import components, docs, edited, prose, shingles, words


def jaccard(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def check_documents(spark, texts, percent=85):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), percent).collect()}
    sets = [shingles(t) for t in texts]
    want = components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j], percent)])
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), i


def family(seed, n, copies, edits):
    """Copies of a text, each with its own edits: some pairs are linked, some are just under the threshold."""
    r = random.Random(seed)
    base = prose(seed, n)
    return [edited(base, r.sample(range(n), k), f"w{seed}x{i}") for i, k in enumerate(r.choices(range(edits), k=copies))]


def test_links_are_those_of_brute_force(spark):
    texts = [None, "", " \n", "one", "One ", "a b c", "a b c d", "a b c d e", "A b\tc d e"]
    for k in range(6):
        texts += family(k, 60 + 40 * k, 25, 6)
    texts += [prose(100 + k, 30) for k in range(30)] + texts[20:24]
    check_documents(spark, texts)


def test_a_large_group_of_near_copies(spark):
    check_documents(spark, family(7, 150, 200, 8) + [prose(1, 5000)])


def test_repeated_ids_nulls_and_empty_tables(spark):
    t = prose(1, 50)
    rows = [(5, t), (5, t), (None, t), (7, t), (None, None), (8, prose(2, 50)), (8, prose(3, 50))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == sorted([(5, 5, True), (5, 5, True), (-1, 5, False), (7, 5, False), (-1, -1, True), (8, 8, True), (8, 8, True)])
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)] + [(r.randint(300, 360), r.randint(300, 360)) for _ in range(50)]
    got = {x.node: x.root for x in links.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in components(nodes, [e for e in edges if e[0] != e[1]]).items()}


def test_the_estimate_is_near_the_similarity(spark):
    import numpy as np

    r = np.random.default_rng(0)
    common, own = r.integers(0, 2**63, 700).astype(np.uint64), r.integers(0, 2**63, (2, 150)).astype(np.uint64)
    flat = np.concatenate([common, own[0], common, own[1]])
    k = minhash.BANDS * minhash.ROWS
    s = minhash.sketch(minhash.minima(flat, np.array([0, 850, 1700]), k)).tolist()
    got = spark.createDataFrame([(s[0], s[1])], "x array<long>, y array<long>").select(links.agreement("x", "y", k).alias("j")).first()["j"]
    assert abs(got - 0.7) < 0.2


def plain_paragraphs(rows, percent=80, least=20):
    found = [(d, k, tuple(words(line))) for d, t in sorted(set(rows), key=lambda r: r[0]) for k, line in enumerate((t or "").split("\n")) if len(words(line)) >= least]
    sets = {w: shingles(" ".join(w)) for _, _, w in found}
    nodes = sorted(sets)
    root = components(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if jaccard(sets[a], sets[b], percent)])
    by = defaultdict(list)
    for d, k, w in found:
        by[root[w]].append((d, k))
    repeated, removed = defaultdict(int), defaultdict(int)
    for places in by.values():
        if len(places) > 1:
            for n, (d, _) in enumerate(sorted(places)):
                repeated[d] += 1
                removed[d] += n > 0
    return repeated, removed


def test_paragraphs_are_those_of_brute_force(spark):
    r = random.Random(5)
    shared = [prose(k, 55) for k in range(4)] + [edited(prose(0, 55), [3], "zz"), prose(9, 19)]
    texts = []
    for i in range(60):
        lines = [prose(1000 + 10 * i + j, r.choice([5, 25, 60])) for j in range(4)] + r.sample(shared, r.randint(0, 3))
        r.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", shared[0] + "\n" + shared[0], "É " + shared[1]]
    table = docs(spark, texts)
    repeated, removed = plain_paragraphs(list(enumerate(texts)))
    got = {x.doc_id: x for x in paragraphs.duplicates(table).collect()}
    assert len(got) == len(texts)
    assert all((got[i].n_repeated, got[i].n_removed) == (repeated[i], removed[i]) for i in range(len(texts)))
    left = {x.doc_id: x for x in paragraphs.remove(table).collect()}
    assert set(left) == set(got) and left[60].text is None
    after = paragraphs.duplicates(paragraphs.remove(table)).agg({"n_removed": "sum"}).first()[0]
    assert after == 0
    clean = [i for i in range(60) if not removed[i]]
    assert all(left[i].text == texts[i] and left[i].source == f"s{i % 3}" for i in clean)


def test_repeated_rows_keep_their_text_and_tables_may_be_empty(spark):
    t = prose(1, 40)
    rows = [(1, t), (1, t), (None, t), (2, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.n_removed) for x in paragraphs.duplicates(table).collect())
    assert got == [(-1, 0), (1, 1), (1, 1), (2, 0)]
    assert paragraphs.duplicates(docs(spark, [])).count() == 0
    assert paragraphs.remove(docs(spark, [])).count() == 0
