"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Pieces are dealt to shards of bounded size by their number, so a hot source or
cluster loads no shard. A shard packs its pieces longest first. Its bins are
kept in the order of their residual; from the first that is large enough the
successors are searched until one holds neither the piece's source nor its
duplicate cluster, by bitmaps over the shard's sources and repeated clusters.
The pieces of a shard's emptiest bins are then dealt anew with those of the
other shards, a quarter of the rows at most, until one shard holds what is left:
so pieces of all shards meet, and no task packs more than a shard. A document
longer than a bin gives pieces that fill bins alone, and a last piece that is
packed like the others.

Defined results: a length that is null or not positive gives one row with no
bin; a null source or cluster conflicts with nothing; repeated rows are packed
one by one, and as they share their cluster, into different bins; documents of
one length are taken by doc_id, nulls first; a very long document gives as many
rows as it fills bins; an empty table gives an empty one; other columns than the
four are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.scratch import Scratch

SHARD_ROWS = 8192
SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long"


def best_fit(items: list[tuple[int, int, int | None, int | None]], capacity: int) -> list[tuple[int, int, int]]:
    """Bin and offset of each item (order, size, source, cluster), sizes from 1 to ``capacity``; gives (order, bin, offset).

    Longest first; ties in the order given.
    """
    sources: dict[int, int] = {}
    seen: dict[int, int] = {}
    for _, _, _, cluster in items:
        if cluster is not None:
            seen[cluster] = seen.get(cluster, 0) + 1
    bits = {c: k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    open_bins: list[tuple[int, int]] = []  # (residual, bin)
    source_maps: list[int] = []
    cluster_maps: list[int] = []
    out = []
    for order, size, source, cluster in sorted(items, key=lambda x: (-x[1], x[0])):
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 1 << bits[cluster] if cluster in bits else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (source_maps[b] & s or cluster_maps[b] & c):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
            source_maps[b] |= s
            cluster_maps[b] |= c
        else:
            residual, b = capacity, len(source_maps)
            source_maps.append(s)
            cluster_maps.append(c)
        out.append((order, b, capacity - residual))
        if residual > size:
            insort(open_bins, (residual - size, b))
    return out


_FIELDS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("open", pa.bool_())])


def _packed(capacity: int, base: int, reopen: bool):
    """Packs one shard's pieces; those of its emptiest bins are ``open``, at most a quarter, if ``reopen``."""

    def run(shard: pa.Table) -> pa.Table:
        keys = ["doc_id", "piece", "length", "source", "cluster"]
        rows = shard.sort_by([(c, "ascending") for c in keys]).select([*keys, "start", "shard"]).to_pylist()
        if not rows:
            return _FIELDS.empty_table()
        first = (base + rows[0]["shard"]) << 32
        source_of: dict[str, int] = {}
        items = []
        for k, r in enumerate(rows):
            source = None if r["source"] is None else source_of.setdefault(r["source"], len(source_of))
            items.append((k, r["length"], source, r["cluster"]))
        # Null doc_ids come first, also among pieces of one length.
        order = sorted(range(len(rows)), key=lambda k: (rows[k]["doc_id"] is not None, k))
        rank = {k: i for i, k in enumerate(order)}
        placed = best_fit([(rank[k], n, s, c) for k, n, s, c in items], capacity)
        used: dict[int, int] = {}
        held: dict[int, int] = {}
        for i, b, _ in placed:
            used[b] = used.get(b, 0) + rows[order[i]]["length"]
            held[b] = held.get(b, 0) + 1
        again, room = set(), len(rows) // 4 if reopen else 0
        for b in sorted(used, key=lambda b: (used[b], b)):
            if used[b] == capacity or held[b] > room:
                break
            again.add(b)
            room -= held[b]
        for i, b, offset in placed:
            rows[order[i]] |= {"open": b in again, "bin_id": first + b, "bin_offset": offset}
        return pa.Table.from_pylist(rows, _FIELDS)

    return run


def pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows of SCHEMA for ``docs`` (doc_id, length, source, cluster).

    A piece covers ``length`` tokens of its document from ``start``, and stands
    at ``bin_offset`` of bin ``bin_id``.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("length").cast("long").alias("length"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"))
    size = F.lit(capacity).cast("long")
    whole = F.coalesce(F.floor(F.col("length") / size), F.lit(0)).cast("int")
    last = F.when(F.col("length") > 0, whole - F.when(F.col("length") % size == 0, 1).otherwise(0)).otherwise(0)
    pieces = narrow.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece") * size
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.when(F.col("length") > 0, F.least(size, F.col("length") - start)).otherwise(F.lit(0)).cast("long").alias("length"), "source", "cluster", F.monotonically_increasing_id().alias("uid"))
    pieces = scratch.write(pieces, "pieces")
    fixed = ["doc_id", "piece", "start", "length"]
    # Full pieces have a bin each, with a negative number; those of no length have none.
    alone = pieces.where(f"length in (0, {capacity})").select(*fixed, F.when(F.col("length") > 0, -1 - F.col("uid")).alias("bin_id"), F.when(F.col("length") > 0, F.lit(0)).cast("long").alias("bin_offset"))
    done, rest, base = [alone], pieces.where(f"length not in (0, {capacity})"), 0
    fields = f"{SCHEMA}, source string, cluster long, open boolean"
    while rows := rest.count():
        shards = -(-rows // shard_rows)
        dealt = rest.select(*fixed, "source", "cluster", F.pmod(F.xxhash64("uid", F.lit(base)), F.lit(shards)).alias("shard"))
        level = scratch.write(dealt.groupBy("shard").applyInArrow(_packed(capacity, base, shards > 1), fields), "level")
        done.append(level.where("not open").select(*fixed, "bin_id", "bin_offset"))
        rest, base = level.where("open").withColumn("uid", F.monotonically_increasing_id()), base + shards
    return reduce(DataFrame.union, done)


def word_lengths(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """doc_id, length (words and one end; 0 without words), source, and a cluster of texts equal but for case and white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cluster = F.when(words > 0, F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))))
    return docs.select("doc_id", F.when(words > 0, words + 1).otherwise(F.lit(0)).alias("length"), "source", cluster.alias("cluster"))
