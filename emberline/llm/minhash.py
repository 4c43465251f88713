"""MinHash near-duplicate documents by b-bit signatures.

The minima of K hash functions over a document's 5-word shingles are cut into
bands of ROWS for candidates; of each minimum two bits are kept, packed into
four longs, from which the similarity of candidates is estimated by bit counts.
Those under the threshold by five standard deviations are dropped, the others
are confirmed on the full sets of 64-bit shingle hashes.

With 20 bands of 4 rows, a pair of similarity 0.85 meets in no band with
probability 4e-7, one of 0.8 with 3e-5.

Defined results: documents without words are linked with nothing; those with
fewer than five words have one shingle, the whole sequence; rows that repeat a
text are one class whatever their doc_id; a null doc_id never names a component
unless no row of the component has another.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkernel as K
from emberline.llm.links import PARITY_LONGS, agreement, bounded, link
from emberline.llm.scratch import Scratch

BANDS, ROWS = 20, 4
_seeds = np.random.Generator(np.random.PCG64(8))
MULTIPLIERS = _seeds.integers(0, 2**31, 128, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _seeds.integers(0, 2**32, 128, dtype=np.int64).astype(np.uint32)


def minima(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k minima of each set, a row for each; sets must not be empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, k), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(k):
            v = x * MULTIPLIERS[j]
            v += OFFSETS[j]
            v ^= v >> np.uint32(16)
            out[:, j] = np.minimum.reduceat(v, at[:-1])
    return out


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row; bands of different place have different keys."""
    sets, k = mins.shape
    grouped = mins.reshape(sets, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (sets, k // rows)).copy()
    for r in range(rows):
        key = K.mix(key ^ grouped[:, :, r])
    return key.view(np.int64)


def sketch(mins: np.ndarray) -> np.ndarray:
    """Two low bits of up to 128 minima as four longs: low bits, then second bits."""
    sets, k = mins.shape
    planes = np.zeros((sets, 2, 128), np.uint8)
    planes[:, 0, :k] = mins & 1
    planes[:, 1, :k] = (mins >> 1) & 1
    return np.packbits(planes, axis=2, bitorder="little").reshape(sets, 32).view(np.int64)


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each run, and where each run of them starts."""
    parts = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    starts = np.zeros(len(at), np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return (np.concatenate(parts) if parts else hashes[:0]), starts


def _rows(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.int64()))


def _set_keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two longs that identify each set."""
    raw = b"".join(hashlib.blake2b(sets[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(at) - 1))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's identity), bands, sketch; null where there are no words."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in K.blocks(batch.column("text")):
                sets, at = _distinct(*K.shingles(*K.words(data, offsets), size))
                n = np.diff(at)
                some = n > 0
                keys, mins = np.zeros((len(n), 2), np.int64), np.zeros((len(n), BANDS * ROWS), np.uint32)
                if some.any():
                    inner = np.append(at[:-1][some], at[-1])
                    keys[some], mins[some] = _set_keys(sets, inner), minima(sets, inner, BANDS * ROWS)
                keyed = [pa.array(keys[:, i], mask=~some) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*K.take(batch, first, len(n), ["doc_id"]), pa.array(n, pa.int64()), *keyed, _rows(band_keys(mins, ROWS)), _rows(sketch(mins))], ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.released(run), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """k1, k2 and the packed set of each document with words."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in K.blocks(batch.column("text")):
                sets, at = _distinct(*K.shingles(*K.words(data, offsets), size))
                some = np.diff(at) > 0
                inner = np.append(at[:-1][some], at[-1])
                keys = _set_keys(sets, inner) if some.any() else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([sets[inner[i] : inner[i + 1]].tobytes() for i in range(len(inner) - 1)], pa.binary())], ["k1", "k2", "set"])

    return docs.select("text").mapInArrow(K.released(run), "k1 long, k2 long, set binary")


def unpacked(sets: DataFrame) -> DataFrame:
    """node, n (its set's size) and a row for each token of packed sets (node, set)."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in K.blocks(batch.column("set")):
                n = np.diff(offsets) // 8
                nodes = K.take(batch, first, len(n), ["node"])[0].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, n)), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["node", "n", "token"])

    return sets.mapInArrow(K.released(run), "node long, n long, token long")


def odd_cells(tokens: np.ndarray, at: np.ndarray, longs: int = PARITY_LONGS) -> np.ndarray:
    """For each set of distinct tokens, the parities of its numbers in hash cells, packed into ``longs`` longs."""
    bits = 64 * longs
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    cells = owner * bits + ((tokens >> np.uint64(7)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(cells, minlength=(len(at) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(at) - 1, bits), axis=1).view(np.int64).reshape(len(at) - 1, longs)


def parities(sets: DataFrame) -> DataFrame:
    """node and the parities of its tokens' numbers in each of 64 * PARITY_LONGS hash cells."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in K.blocks(batch.column("set")):
                odd = odd_cells(np.frombuffer(data.tobytes(), np.uint64), offsets // 8)
                yield pa.RecordBatch.from_arrays([*K.take(batch, first, len(odd), ["node"]), _rows(odd)], ["node", "odd"])

    return sets.mapInArrow(K.released(run), "node long, odd array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on packed sorted sets (node, set)."""

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y"))
                if len(x) > len(y):
                    x, y = y, x
                both = 0
                if 100 * len(x) >= percent * len(y):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(K.released(run), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Documents with 100 * intersection >= percent * union of their shingle sets
    are linked; component_id is the smallest doc_id that links reach.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    table = scratch.write(signatures(docs, size), "signatures")
    # The class of equal sets: a row's own number names it.
    numbered = table.where("k1 is not null").withColumn("uid", F.monotonically_increasing_id())
    classes = scratch.write(numbered.groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("doc_id")), "classes")
    one = numbered.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "bands", "sketch")
    one = scratch.write(one, "one")
    bands = one.select("node", F.explode("bands").alias("bucket"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node and packed set, made again from the texts of one document of each class."""
        need = scratch.write(nodes.join(classes, "node"), "need")
        rows = need.count()
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        chosen = texts.join(bounded(need.select("doc_id"), rows), "doc_id", "left_semi")
        if not need.where("doc_id is null").isEmpty():
            chosen = chosen.union(texts.where("doc_id is null"))
        return _sets(chosen, size).join(bounded(need.select("node", "k1", "k2"), rows), ["k1", "k2"]).dropDuplicates(["node"]).select("node", "set")

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return overlaps(pairs, sets, percent)

    def tokens(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        return unpacked(sets), parities(sets)

    # The estimate may be five standard deviations under the limit.
    k, chance = BANDS * ROWS, percent / 100 * 0.75 + 0.25
    least = percent / 100 - 5 * math.sqrt(chance * (1 - chance) / k) / 0.75
    labels, _ = link(bands, one.select("node", "sketch"), lambda a, b: agreement(a, b, k) >= least, percent, sets_of, verify, tokens, scratch)

    rooted = classes.join(labels, "node", "left").select("k1", "k2", "doc_id", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("k1", "k2", "component_id")
    named = scratch.write(named, "named")
    out = table.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
