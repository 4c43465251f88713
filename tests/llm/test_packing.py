import random

from emberline.llm import packing

from .helpers import docs


def plain_best_fit(items, capacity):
    bins, out = [], []
    for order, size, source, cluster in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(capacity - b["used"], k) for k, b in enumerate(bins) if b["used"] + size <= capacity and not (source is not None and source in b["s"]) and not (cluster is not None and cluster in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"used": 0, "s": set(), "c": set()})
            k = len(bins) - 1
        out.append((order, k, bins[k]["used"]))
        bins[k]["used"] += size
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
    return out


def test_it_is_best_fit():
    for seed in range(20):
        r = random.Random(seed)
        items = [(i, r.randint(1, 50), r.choice([None, 0, 0, 0, 1, 2, 3]), r.choice([None, 5, 6, 7, 8])) for i in range(120)]
        assert packing.best_fit(items, 100) == plain_best_fit(items, 100)


def test_all_is_packed_once_within_capacity_and_without_conflicts(spark):
    rows = [(i, i * 37 % 900 + 1 if i % 9 else (None if i % 2 else 0), None if i % 13 == 0 else "hot" if i % 3 else f"s{i % 7}", i % 40) for i in range(500)] + [(3, 112, "s3", 3)] * 3
    table = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long")
    out = packing.pack(table, 300, 64).toPandas()
    source = {r[0]: r[2] for r in rows}
    cluster = {r[0]: r[3] for r in rows}
    placed = out[out.bin_id.notna()]
    assert placed.length.sum() == sum(r[1] or 0 for r in rows)
    for _, g in placed.groupby("bin_id"):
        g = g.sort_values("bin_offset")
        assert g.length.sum() <= 300
        assert (g.bin_offset.astype(int).tolist()) == [0, *g.length.cumsum().tolist()[:-1]]
        known = [source[d] for d in g.doc_id if source[d]]
        assert len(known) == len(set(known))
        assert len({cluster[d] for d in g.doc_id}) == len(g)
    assert len(out[out.bin_id.isna()]) == sum(not r[1] for r in rows)


def test_empty_table_and_texts(spark):
    assert packing.pack(packing.word_lengths(docs(spark, [])), 10).count() == 0
    got = {r.doc_id: r.length for r in packing.word_lengths(docs(spark, [None, "", " \t", "a b", "A  b\n"])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_null_ids_keep_the_others_whole(spark):
    ids = [None, 2**60 + 1, 2**60 + 3, None]
    table = spark.createDataFrame([(d, n, None, None) for d, n in zip(ids, (5, 5, None, 5))], "doc_id long, length long, source string, cluster long")
    got = packing.pack(table, 20).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == sorted(ids, key=lambda x: (x is not None, x))
    assert {(r.doc_id, r.bin_offset) for r in got} == {(None, 0), (None, 5), (2**60 + 1, 10), (2**60 + 3, None)}


def test_shards_share_their_emptiest_bins(spark):
    r = random.Random(4)
    rows = [(i, r.randint(30, 70), f"s{i % 400}", None) for i in range(2000)] + [(5000, 1000, "s1", None)]
    table = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long")
    out = packing.pack(table, 100, 100).toPandas()
    assert sorted(zip(out.doc_id, out.piece)) == sorted([(i, 0) for i in range(2000)] + [(5000, k) for k in range(10)])
    assert out.groupby("bin_id").length.sum().max() <= 100
    alone = max(b for _, b, _ in plain_best_fit([(i, n, s, None) for i, n, s, _ in rows[:2000]], 100)) + 11
    assert out.bin_id.nunique() <= 1.03 * alone
