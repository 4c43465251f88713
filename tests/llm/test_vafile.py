import math
import random

from pyspark.sql import functions as F

from emberline.llm import vafile


def brute(rows, k):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in kept:
        if i % 50 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = set()
    for q, v in asked.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


def search(spark, rows, k=5):
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" if rows and len(rows[0]) == 3 else "vec_id long, embedding array<float>")
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(t, F.col("vec_id") % 50 == 0, k).collect()}


def test_it_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 37)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 3)
    r = random.Random(1)
    f = lambda: r.choice([0.25, -0.5, 1.0, r.gauss(0, 1)])
    rows = [(i, [round(f() * 64) / 64 for _ in range(6)]) for i in range(400)]
    rows += [(401, None), (402, [1.0, None] * 3), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, []), (100, rows[7][1]), (500, [1.0, 2.0]), (550, [3.0, 4.0])]
    rows += [(600 + i, rows[5][1]) for i in range(30)]
    assert search(spark, rows) == brute(rows, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e5, -2e6]), (1, [2.5e6, 1e6]), (2, [-3e7, 5e6]), (3, [3e7, 4e6])]
    assert search(spark, rows, 2) == brute(rows, 2)
    assert len(search(spark, [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [0.0, 0.0])], 2)) == 2


def test_empty_and_few(spark):
    assert search(spark, []) == set()
    assert search(spark, [(0, [1.0])]) == set()
    assert search(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 256 * 512)}
