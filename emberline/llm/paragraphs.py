"""Substring deduplication by paragraph MinHash banding.

A paragraph is a line of at least LEAST_WORDS words. With BANDS bands of ROWS
minima, two paragraphs of similarity 0.8 meet in a bucket with probability
0.995, equal ones always. Colliding paragraphs are verified by the exact Jaccard
similarity of their 5-word shingles, components of the links are the classes,
and of each class every occurrence but the first (by document and line) goes.

Paragraphs with the same words are one node, named by a 64-bit hash of them, so
that copies cost no comparisons.

Besides, every run of PASSAGE words that stands in an earlier place is a
repeated passage, however its lines are broken and whatever stands around it.
Each such run names a seed, the least hash of its runs of SEED words, which is a
min-hash of the run that its copies share whatever their place; only runs whose
seed is in two places are looked at, so equal runs always meet. A text equal to
another document's is one passage and costs no runs.

Defined results: null and empty texts have no paragraph; rows equal in doc_id
and text are one document, so that each keeps its text; a null doc_id comes
before all others; of places in one document the first stays; very long texts
are searched whole; an empty table gives an empty one; extra columns stay as
they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkernel as K
from emberline.llm.links import bounded, bounded_lists, close_sets, link, parity_distance
from emberline.llm.minhash import _distinct, _rows, band_keys, minima, odd_cells, overlaps, parities, unpacked
from emberline.llm.scratch import Scratch, fresh

LEAST_WORDS, BANDS, ROWS, SKETCH_LONGS = 20, 10, 4, 4
PASSAGE, SEED = 50, 10
_NEWLINE = 10


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of a block (each ends after its line break or with its text), and each line's text."""
    ends = np.flatnonzero(data == _NEWLINE) + 1
    cuts = np.unique(np.concatenate([ends, offsets]))
    return cuts, np.searchsorted(offsets, cuts[:-1], "right") - 1


def _long_lines(data: np.ndarray, offsets: np.ndarray, least: int):
    """Word hashes and, for lines with enough words: text, number in the text, first and last byte, and first word."""
    cuts, owner = _lines(data, offsets)
    if len(cuts) < 2:
        return None
    hashes, first = K.words(data, cuts)
    count = np.diff(first)
    keep = np.flatnonzero(count >= least)
    if not len(keep):
        return None
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return hashes, first, count, keep, owner[keep], number[keep], cuts[keep], cuts[keep + 1]


def _sets_of(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the kept lines with their starts, and the hash of each line's word sequence."""
    at = np.concatenate([[0], np.cumsum(count[keep])])
    words = hashes[np.repeat(first[keep] - at[:-1], count[keep]) + np.arange(int(at[-1]))]
    shingles, starts = K.shingles(words, at)
    with np.errstate(over="ignore"):
        place = np.arange(len(words)) - np.repeat(at[:-1], count[keep])
        terms = words * K.mix(place.astype(np.uint64) + np.uint64(77))
        node = K.mix(np.add.reduceat(terms, at[:-1]) + count[keep].astype(np.uint64))
    return shingles, starts, node


def _marks(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 40-bit marks of each line's shingles, and where each line's start; lines of a block fit in 24 bits."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    key = np.sort((owner << np.uint64(40)) | (shingles >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & np.uint64((1 << 40) - 1), np.searchsorted(key >> np.uint64(40), np.arange(len(starts), dtype=np.uint64))


def units(docs: DataFrame, least: int) -> DataFrame:
    """A row for each paragraph: doc_id, th (hash of the text), line, first and last byte, words, node, bands, sketch."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in K.blocks(batch.column("text")):
                got = _long_lines(data, offsets, least)
                if got is None:
                    continue
                hashes, first, count, keep, owner, number, begin, end = got
                shingles, starts, node = _sets_of(hashes, first, count, keep)
                mins = minima(shingles, starts, BANDS * ROWS)
                tokens, token_at = _marks(shingles, starts)
                sketches = np.column_stack([np.diff(token_at), odd_cells(tokens, token_at, SKETCH_LONGS)])
                ids = pa.array(row + owner)
                base = offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(ids), batch.column("th").take(ids), pa.array(number, pa.int32()), pa.array(begin - base), pa.array(end - base), pa.array(count[keep]), pa.array(node.view(np.int64)), _rows(band_keys(mins, ROWS)), _rows(sketches)],
                    ["doc_id", "th", "line", "first", "last", "words", "node", "bands", "sketch"],
                )

    return _keyed(docs).mapInArrow(K.released(run), "doc_id long, th long, line int, first long, last long, words long, node long, bands array<long>, sketch array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def _paragraph_sets(docs: DataFrame, least: int) -> DataFrame:
    """node and packed set of each paragraph."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in K.blocks(batch.column("text")):
                got = _long_lines(data, offsets, least)
                if got is None:
                    continue
                hashes, first, count, keep, *_ = got
                shingles, starts, node = _sets_of(hashes, first, count, keep)
                sets, at = _distinct(shingles, starts)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)], pa.binary())], ["node", "set"])

    return docs.select("text").mapInArrow(K.released(run), "node long, set binary")


def repeats(docs: DataFrame, percent: int = 80, least: int = LEAST_WORDS) -> DataFrame:
    """Occurrences of paragraphs in classes of two or more, written.

    They have doc_id, th, line, first, last, root (their class), keeper (the
    class's first document), kept.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    table = scratch.write(units(docs, least), "units")
    bands = table.select("node", F.explode("bands").alias("bucket"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        return _paragraph_sets(docs, least).join(bounded(nodes.select("node")), "node", "left_semi").dropDuplicates(["node"])

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return overlaps(pairs, sets, percent)

    def tokens(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        return unpacked(sets), parities(sets)

    # A sketch is the set's size and its parities, which bound the similarity from above.
    def near(a: str, b: str) -> Column:
        return close_sets(F.col(a)[0], F.col(b)[0], parity_distance(F.col(a), F.col(b), 1, SKETCH_LONGS), percent)

    labels, _ = link(bands, table.select("node", "sketch"), near, percent, sets_of, verify, tokens, scratch)
    places = table.select("doc_id", "th", "line", "first", "last", "node")
    rooted = scratch.write(places.join(bounded(labels), "node", "left").select("doc_id", "th", "line", "first", "last", F.coalesce("root", "node").alias("root")), "rooted")
    scratch.drop(table, labels)
    place = F.struct("doc_id", "th", "line")
    # Rows that repeat a document have the same places. Written first, so that the rows of a large class can be split.
    heads = rooted.groupBy("root").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head <> tail").select("root", "head")
    heads = scratch.write(heads, "heads")
    out = rooted.join(bounded(heads), "root").select("doc_id", "th", "line", "first", "last", "root", F.col("head.doc_id").alias("keeper"), place.eqNullSafe(F.col("head")).alias("kept"))
    out = scratch.write(out, "occurrences")
    scratch.drop(rooted, heads)
    return out


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, starts and ends, each text's first word and number of runs of PASSAGE words."""
    starts, ends, first = K.word_spans(data, offsets)
    return K.span_hashes(K.LOWER[data], starts, ends), starts, ends, first, np.maximum(np.diff(first) - PASSAGE + 1, 0)


def _seeds(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The seed of each run of PASSAGE words."""
    least, at = K.shingles(hashes, first, SEED)
    done, span = 1, PASSAGE - SEED + 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    begin = np.concatenate([[0], np.cumsum(count)])
    return least[np.repeat(at[:-1] - begin[:-1], count) + np.arange(int(begin[-1]))]


def _span(first: np.ndarray, last: np.ndarray) -> pa.Array:
    """First and last byte of a text in one number; texts are shorter than 2 ** 31 bytes."""
    return pa.array((first << 32) | last)


def _seed_rows(docs: DataFrame) -> DataFrame:
    """th, seed, at (first run << 32 | runs) of adjacent runs of one seed, and whether the text has the seed again.

    A row without seed for each text of PASSAGE words or more has its doc_id and the span of its words.
    """

    def run(batches):
        for batch in batches:
            for row, data, offsets in K.blocks(batch.column("text")):
                hashes, starts, ends, first, count = _runs(data, offsets)
                keep = np.flatnonzero(count)
                if not len(keep):
                    continue
                seed, owner = _seeds(hashes, first, count), np.repeat(np.arange(len(count)), count)
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
                cut = np.flatnonzero(new)
                size, text, seed = np.diff(np.append(cut, len(new))), owner[cut], seed[cut]
                _, which, times = np.unique(seed ^ K.mix(text.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
                number = cut - np.searchsorted(owner, text)
                again = (times[which] > 1) | (size > PASSAGE - SEED + 1)
                th = batch.column("th")
                yield pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), th.take(pa.array(row + text)), pa.array(seed.view(np.int64)), pa.array((number << 32) | size), pa.array(again)], SEEDS)
                ids = pa.array(row + keep)
                whole = _span(starts[first[keep]] - offsets[keep], ends[first[keep + 1] - 1] - offsets[keep])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(ids), th.take(ids), pa.nulls(len(keep), pa.int64()), whole, pa.nulls(len(keep), pa.bool_())], SEEDS)

    return _keyed(docs).mapInArrow(K.released(run), "doc_id long, th long, seed long, at long, again boolean")


SEEDS = ["doc_id", "th", "seed", "at", "again"]


def _run_rows(texts: DataFrame) -> DataFrame:
    """uid, span and hash of the runs that ``at`` names, and whether the text holds the run before, without overlap."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in K.blocks(batch.column("text")):
                hashes, starts, ends, first, count = _runs(data, offsets)
                if not count.any():
                    continue
                named = batch.column("at").slice(row, len(count))
                at, owner = named.flatten().to_numpy(), np.repeat(np.arange(len(count)), named.value_lengths().to_numpy())
                size = at & 0xFFFFFFFF
                number = np.repeat((at >> 32) - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                owner = np.repeat(owner, size)
                passages, begin = K.shingles(hashes, first, PASSAGE)
                word, hashed = first[owner] + number, passages[begin[owner] + number]
                _, group = np.unique(hashed ^ K.mix(owner.astype(np.uint64) + np.uint64(1)), return_inverse=True)
                head = np.full(int(group.max(initial=-1)) + 1, len(hashes), np.int64)
                np.minimum.at(head, group, word)
                span = _span(starts[word] - offsets[owner], ends[word + PASSAGE - 1] - offsets[owner])
                yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(row + owner)), span, pa.array(hashed.view(np.int64)), pa.array(word >= head[group] + PASSAGE)], ["uid", "span", "run", "later"])

    return texts.select("uid", "text", "at").mapInArrow(K.released(run), "uid long, span long, run long, later boolean")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch as one."""
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


_SPANS = "array<struct<first:long,last:long>>"


def _merged_spans(rows: DataFrame) -> DataFrame:
    """``passages`` and ``shared``, lists of packed spans, as merged spans."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in batches:
            for name in ("passages", "shared"):
                at = batch.schema.get_field_index(name)
                spans = [[{"first": a, "last": z} for a, z in merged([(x >> 32, x & 0xFFFFFFFF) for x in sorted(packed)])] for packed in batch.column(at).to_pylist()]
                batch = batch.set_column(at, name, pa.array(spans, kind))
            yield batch

    return rows.mapInArrow(run, f"doc_id long, th long, passages {_SPANS}, shared {_SPANS}, holders array<long>")


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, th, passages (spans of words that stand in an earlier place), shared (those of which a later place has a copy) and holders (documents of the earlier places), written."""
    scratch = Scratch(docs.sparkSession, "passages")
    seeds = scratch.write(_seed_rows(docs), "seeds")
    # A null doc_id is the first of all.
    whole = seeds.where("seed is null").select("doc_id", "th", "at", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    seeds_only = seeds.where("seed is not null")
    owners = scratch.write(whole.groupBy("th", "at").agg(F.min("d").alias("owner"), F.max("d").alias("other")), "owners")
    copied = scratch.write(owners.where("owner <> other").select("th", "at", "owner"), "copied")
    many = seeds_only.groupBy("seed").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.max("again").alias("again")).where("a <> b or again").select("seed")
    many = scratch.write(many, "many")
    # Copies of a text have the same seeds; its owner alone gives runs. Numbers follow the owners, so the first place has the least.
    named = seeds_only.join(many, "seed", "left_semi").groupBy("th").agg(F.collect_set("at").alias("at"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.join(owners.groupBy("th").agg(F.min("owner").alias("owner")), "th").repartitionByRange(parts, "owner", "th").sortWithinPartitions("owner", "th")
    named = scratch.write(ordered.select(F.monotonically_increasing_id().alias("uid"), "owner", F.col("th").alias("_t"), "at"), "named")
    copies = whole.join(bounded(copied), ["th", "at"])
    copies = copies.select("doc_id", "th", "at", F.when(F.col("d") > F.col("owner"), F.col("owner")).alias("owner"))
    copies = scratch.write(copies.groupBy("doc_id", "th").agg(F.min("at").alias("at"), F.min("owner").alias("owner")), "copies")
    scratch.drop(seeds, many, owners, copied)
    keyed = _keyed(docs)
    texts = keyed.join(bounded_lists(named, "at"), (F.coalesce(keyed["doc_id"], F.lit(-(1 << 63))) == F.col("owner")) & (keyed["th"] == F.col("_t")))
    runs = scratch.write(_run_rows(texts), "runs")
    heads = runs.groupBy("run").agg(F.min("uid").alias("head"), F.max("uid").alias("tail"), F.max("later").alias("again")).where("head <> tail or again").select("run", "head")
    heads = scratch.write(heads, "heads")
    found = runs.join(heads, "run").select("uid", "span", "head", (F.col("later") | (F.col("uid") > F.col("head"))).alias("gone"))
    lists = [F.collect_set(F.when(F.col("gone"), F.col("span"))), F.collect_set(F.when(~F.col("gone"), F.col("span"))), F.collect_set(F.when(F.col("gone"), F.col("head")))]
    by_text = scratch.write(found.groupBy("uid").agg(*[x.alias(n) for x, n in zip(lists, ("gone", "stays", "heads"))]), "by-text")
    scratch.drop(runs, heads)
    ids = named.select("uid", F.when(F.col("owner") > -(1 << 63), F.col("owner")).alias("doc_id"), F.col("_t").alias("th"))
    holders = by_text.select("uid", F.explode("heads").alias("head")).join(bounded(ids.select(F.col("uid").alias("head"), "doc_id")), "head").groupBy("uid").agg(F.collect_set("doc_id").alias("holders"))
    none = F.array().cast("array<long>")
    own = ids.join(by_text, "uid").join(holders, "uid", "left").select("doc_id", "th", F.col("gone").alias("passages"), F.col("stays").alias("shared"), F.coalesce("holders", none).alias("holders"))
    # The owner of a text with copies shares all of it; the others have it from there.
    gone = F.col("owner").isNotNull()
    equal = copies.select("doc_id", "th", F.when(gone, F.array("at")).otherwise(none).alias("passages"), F.when(~gone, F.array("at")).otherwise(none).alias("shared"), F.when(gone & (F.col("owner") > -(1 << 63)), F.array("owner")).otherwise(none).alias("holders"))
    rows = own.unionByName(equal).groupBy("doc_id", "th").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("passages", "shared", "holders")])
    out = scratch.write(_merged_spans(rows), "passages")
    scratch.drop(named, copies, by_text)
    return out


def duplicates(docs: DataFrame, percent: int = 80, least: int = LEAST_WORDS) -> DataFrame:
    """For each row of ``docs``: doc_id, whether it repeats or is repeated, numbers of places, keepers and spans of the removed.

    ``n_repeated`` and ``n_removed`` are paragraphs in a class and those that go;
    ``n_passages`` and ``n_shared`` are passages that go and passages kept of
    which others have copies. ``keepers`` are the documents that hold the kept
    copies, of passages too; ``classes`` name the components of all repeated
    paragraphs; ``spans`` (of removed paragraphs) and ``passages`` are bytes of
    the text. Documents share nothing with others if all numbers are 0.
    """
    found = repeats(docs, percent, least)
    gone = ~F.col("kept")
    by_doc = found.groupBy("doc_id", "th").agg(
        F.size(F.collect_set("line")).alias("n_repeated"),
        F.array_sort(F.collect_set(F.when(gone, F.col("keeper")))).alias("keepers"),
        F.array_sort(F.collect_set("root")).alias("classes"),
        F.array_sort(F.collect_set(F.when(gone, F.struct("first", "last")))).alias("spans"),
    )
    rows = _keyed(docs).select("doc_id", "th")
    for other in (by_doc, passages(docs)):
        renamed = other.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
        rows = rows.join(renamed, rows["doc_id"].eqNullSafe(renamed["_d"]) & (rows["th"] == renamed["_t"]), "left").drop("_d", "_t")
    empty = {"keepers": "array<long>", "holders": "array<long>", "classes": "array<long>", "spans": _SPANS, "passages": _SPANS, "shared": _SPANS}
    rows = rows.select("doc_id", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"), *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in empty.items()])
    sizes = {"n_removed": "spans", "n_passages": "passages", "n_shared": "shared"}
    rows = rows.select("*", *[F.size(c).cast("long").alias(n) for n, c in sizes.items()])
    repeated = (F.col("n_repeated") > 0) | (F.col("n_passages") > 0) | (F.col("n_shared") > 0)
    return rows.select("doc_id", repeated.alias("repeated"), "n_repeated", *sizes, F.array_sort(F.array_union("keepers", "holders")).alias("keepers"), "classes", "spans", "passages")


def _after(raw: bytes, first: int, last: int) -> int:
    """Where a removed passage ends with the blanks after it, and with its line break if it began its line."""
    while last < len(raw) and raw[last] != _NEWLINE and K.SEPARATOR[raw[last]]:
        last += 1
    return last + (last < len(raw) and raw[last] == _NEWLINE and (not first or raw[first - 1] == _NEWLINE))


def remove(docs: DataFrame, percent: int = 80, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the removed paragraphs and repeated passages cut out of ``text``; all rows and other columns stay."""
    found = repeats(docs, percent, least)
    d, t, th, gone = (fresh(docs, x) for x in ("_d", "_t", "_th", "_spans"))
    lines = found.where(~F.col("kept")).select("doc_id", "th", "first", "last", F.lit(False).alias("inner"))
    inner = passages(docs).select("doc_id", "th", F.inline("passages"), F.lit(True).alias("inner"))
    spans = lines.unionByName(inner).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("first", "last", "inner"))).alias(gone)).withColumnsRenamed({"doc_id": d, "th": t})
    spans = bounded_lists(Scratch(docs.sparkSession, "spans").write(spans, "spans"), gone, 32)
    names = docs.columns
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(spans, keyed["doc_id"].cast("long").eqNullSafe(spans[d]) & (keyed[th] == spans[t]), "left").drop(d, t, th)

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, spans_ in enumerate(batch.column(gone).to_pylist()):
                if spans_:
                    raw, last, parts = texts[i].encode(), 0, []
                    for begin, end in merged([(x["first"], _after(raw, x["first"], x["last"]) if x["inner"] else x["last"]) for x in spans_]):
                        parts.append(raw[last:begin])
                        last = end
                    texts[i] = b"".join([*parts, raw[last:]]).decode()
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(names)

    return joined.select(*names, gone).mapInArrow(K.released(cut), docs.schema)
