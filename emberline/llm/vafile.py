"""Exact top-k inner products with vector-approximation files.

Every component is an integer; its cell is the integer without its low bits, as
many as leave seven bits and a sign. The approximation file is a table of blocks
of cells, one byte a component. It is scanned block by block against blocks of
queries: a cell's corners bound each vector's inner product from below and above,
and what cannot reach a query's kth lower bound is dropped, first within a task,
then over all tasks. Exact vectors are read for the survivors only, those of the
highest upper bounds first; of the others only those whose upper bound reaches
the kth exact score so far.

Defined results: null vectors and those with null or non-finite components take
no part; vectors of different length have no inner product, so only equal
lengths are compared; rows that repeat a vec_id are candidates of their own,
but of queries with one vec_id only one is asked, the smallest by its
components; ties go to the smaller vec_id; a null vec_id takes no part; an empty
table gives an empty one; other columns are not read. Scores beyond 64 bits are
held at the limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.links import BROADCAST_BYTES, bounded
from emberline.llm.scratch import Scratch

BLOCK, QUERY_BLOCK = 2048, 512
#: Candidates that a task holds for a block of queries before it drops those under the bounds.
HELD = 2_000_000
_LIMIT = float(2**53)


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component; null for a vector that takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # A component of 2 ** 62 or more is held there: its scores are at the limits anyway.
    wide = F.lit(float(2**62))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & good, F.transform(vector, lambda x: F.floor(F.greatest(-wide, F.least(wide, x.cast("double") * F.lit(float(factor))))).cast("long")))


def low_bits(v: np.ndarray) -> int:
    """How many low bits to leave out so that all cells fit in a signed byte."""
    most = int(max(v.max(initial=0), -int(v.min(initial=0)) - 1))
    return max(0, most.bit_length() - 7)


def bounds(q: np.ndarray, cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of each query with the vectors of each cell."""
    corner, width = cells.astype(float) * float(1 << bits), float((1 << bits) - 1)
    qf = q.astype(float)
    if np.abs(qf).max(initial=0) * (np.abs(corner).max(initial=0) + width) * cells.shape[1] >= _LIMIT:
        shape = (len(q), len(cells))
        return np.full(shape, -np.inf), np.full(shape, np.inf)
    at = qf @ corner.T
    return at + width * np.minimum(qf, 0).sum(1)[:, None], at + width * np.maximum(qf, 0).sum(1)[:, None]


def _packed(batches):
    """Blocks of cells of a task's vectors, by dimension."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for k in range(0, len(rows), BLOCK):
                part = batch.take(pa.array(rows[k : k + BLOCK]))
                v = part.column("v").flatten().to_numpy().reshape(-1, dim)
                bits = low_bits(v)
                lists = [pa.array([part.column(c).to_numpy()], pa.list_(pa.int64())) for c in ("uid", "vec_id")]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([bits], pa.int32()), *lists, pa.array([(v >> bits).astype(np.int8).tobytes()], pa.binary())], ["dim", "bits", "uids", "ids", "cells"])


class _Kept:
    """A block of queries in one task: the k best lower bounds so far, and the candidates that reach the kth."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.floor, self.parts, self.size = ids, k, np.full((len(ids), k), -np.inf), [], 0

    def add(self, low: np.ndarray, up: np.ndarray, uids: np.ndarray) -> None:
        best = np.concatenate([self.floor, low], axis=1)
        self.floor = -np.partition(-best, self.k - 1, axis=1)[:, : self.k]
        i, j = np.nonzero(up >= self.floor.min(1)[:, None])
        self.parts.append((i, uids[j], low[i, j], up[i, j]))
        self.size += len(i)
        if self.size > HELD:
            self.parts = [self.rows()]
            self.size = len(self.parts[0][0])

    def rows(self) -> tuple[np.ndarray, ...]:
        i, uid, low, up = (np.concatenate(x) for x in zip(*self.parts))
        keep = up >= self.floor.min(1)[i]
        return i[keep], uid[keep], low[keep], up[keep]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products for the rows of ``vectors`` where ``queries`` holds."""
    scratch = Scratch(vectors.sparkSession, "vafile")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), factor).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where("v is not null and vec_id is not null")
    exact = scratch.write(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.size("v").alias("dim"), "v", "asked"), "exact")
    cells = scratch.write(exact.select("uid", "vec_id", "dim", "v").mapInArrow(_packed, "dim int, bits int, uids array<long>, ids array<long>, cells binary"), "cells")
    asked = scratch.write(exact.where("asked").groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id"), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("q").cast("long")), F.lit(0)).alias("values")).first()
    blocks = max(1, -(-size["n"] // QUERY_BLOCK))
    dealt = asked.select("query_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("qb"))
    packed = dealt.groupBy("dim", "qb").agg(F.collect_list("query_id").alias("q_ids"), F.flatten(F.collect_list("q")).alias("q_flat"))
    packed = scratch.write(packed, "queries")
    if size["values"] * 8 <= BROADCAST_BYTES:
        met = cells.join(F.broadcast(packed), "dim")
    else:  # each block of cells goes to each block of queries
        met = cells.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, ["dim", "qb"])

    def scan(batches):
        kept: dict[tuple[int, int], _Kept] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                dim, qb, bits = (batch.column(c)[r].as_py() for c in ("dim", "qb", "bits"))
                ids, q = batch.column("q_ids")[r].values.to_numpy(), batch.column("q_flat")[r].values.to_numpy().reshape(-1, dim)
                uids, own = (batch.column(c)[r].values.to_numpy() for c in ("uids", "ids"))
                low, up = bounds(q, np.frombuffer(batch.column("cells")[r].as_buffer(), np.int8).reshape(-1, dim), bits)
                same = ids[:, None] == own[None, :]
                low[same] = -np.inf
                up[same] = np.nan  # a query is no candidate of its own
                kept.setdefault((dim, qb), _Kept(ids, k)).add(low, up, uids)
        for found in kept.values():
            i, uid, low, up = found.rows()
            yield pa.RecordBatch.from_arrays([pa.array(found.ids[i]), pa.array(uid), pa.array(low), pa.array(up)], ["query_id", "uid", "low", "up"])

    near = scratch.write(met.select("dim", "qb", "bits", "q_ids", "q_flat", "uids", "ids", "cells").mapInArrow(scan, "query_id long, uid long, low double, up double"), "near")
    by_low, by_up = (Window.partitionBy("query_id").orderBy(F.desc(c), "uid") for c in ("low", "up"))
    # The kth lower bound of all, or none if there are fewer.
    floor = near.withColumn("n", F.row_number().over(by_low)).where(F.col("n") == k).select("query_id", F.col("low").alias("floor"))
    left = near.join(bounded(scratch.write(floor, "floor")), "query_id", "left").where(F.col("floor").isNull() | (F.col("up") >= F.col("floor")))
    left = scratch.write(left.withColumn("n", F.row_number().over(by_up)).select("query_id", "uid", "up", "n"), "survivors")

    def products(batches):
        for batch in batches:
            scores = []
            for a, b in zip(batch.column("v"), batch.column("q")):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                if np.abs(x.astype(float)).max() * np.abs(y.astype(float)).max() * len(x) < _LIMIT:
                    scores.append(int(x @ y))
                else:
                    scores.append(max(-(2**63), min(2**63 - 1, sum(int(s) * int(t) for s, t in zip(x.tolist(), y.tolist())))))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.select("query_id", "uid").join(exact.select("uid", "vec_id", "v"), "uid").join(asked, "query_id")
        return both.select("query_id", "vec_id", "v", "q").mapInArrow(products, "query_id long, vec_id long, score long")

    first = scratch.write(scored(left.where(F.col("n") <= 2 * k)), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    later = left.where(F.col("n") > 2 * k).join(bounded(scratch.write(kth, "kth")), "query_id", "left").where(F.col("kth").isNull() | (F.col("up") >= F.col("kth")))
    found = first.unionByName(scored(later))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
