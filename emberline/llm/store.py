"""Content-addressed store of token ids.

Every text is encoded whole and gets an end id. A rolling hash over the last
``WINDOW`` ids cuts the id stream of a document into chunks whose borders
depend only on nearby ids, so shared passages give shared chunks. A store is a
folder of two Parquet tables:

``chunks``   hash (16 bytes), n and ids (little-endian) of each distinct chunk;
             further rows, without ids, say where else a chunk stands
``recipes``  one row for each document in ascending doc_id order: segment, place,
             doc_id, offset in the segment, hashes and lengths of its chunks and
             the root of a Merkle tree over them; a row for each LEAVES documents
             of a segment, with place -2, -3 and so on, holds the root over those,
             and a last one, with place -1, its number of ids and the root over
             these roots
``manifest`` one row: the root over all segments and the number of ids

A document is rebuilt from its recipe; hashes, lengths and all roots are verified.

Defined results: null texts count as empty and hold the end id only; rows with
a null doc_id come first; rows that repeat a doc_id are documents of their own,
in an arbitrary but fixed order; very long texts are encoded whole; a store of an
empty table has no document; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm import textkernel as K

WINDOW, CUT_BITS, LEAST, MOST = 8, 9, 64, 4096
MEMO = 1_000_000
#: Documents under one node of a segment's tree.
LEAVES = 1024
_RING = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 1 << 16, dtype=np.int64).astype(np.uint64)
_UNSAFE = re.compile(r" \s|\0")
#: Marks that stand next to others, after a space, or at a line's end with more white space: pieces aren't cut at marks then.
_MARKS = re.compile(r"(?:[^\w\s]|_){2}| [.,]|\s\n|\n[^\S ]")
# Kinds of bytes, for a test of whole blocks: marks, white space, and what only the patterns above can judge.
_MARK, _WHITE, _ODD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_WHITE[[32, *range(9, 14)]] = True
_ODD[[0, *range(1, 9), *range(14, 32), 127]] = True
_ODD[192:] = True
_ODD[0xC3] = False  # letters of Western languages, but for two signs


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts of a block that surely can be cut at spaces, points, commas and line ends."""
    bad = _ODD[data]
    if len(data) > 1:
        here, after = data[:-1], data[1:]
        white, mark = _WHITE[data], _MARK[data]
        pairs = (mark[:-1] & mark[1:]) | ((here == 32) & (white[1:] | (after == 46) | (after == 44))) | (white[:-1] & (after == 10)) | ((here == 10) & white[1:] & (after != 32))
        # Multiplication and division signs are no letters.
        pairs |= (here == 0xC3) & ((after == 0x97) | (after == 0xB7))
        bad[:-1] |= pairs
    at = np.flatnonzero(bad)
    return np.searchsorted(at, offsets[1:]) == np.searchsorted(at, offsets[:-1])


_encoders: dict[str, "Encoder"] = {}


def encoder_of(path: str) -> "Encoder":
    """The worker's encoder; what it remembers serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Whole texts to ids; pieces that start at a single space are encoded once and remembered.

    A space before a character that is no white space always starts a new
    pre-token of a byte-level BPE, so pieces can be encoded apart; so can single
    points, commas and line ends, where no other mark or white space is next to
    them. Texts in which white space follows a space are encoded in one call.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.memo: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        # An added token is found in one piece only if marks stand together in it and no white space belongs to it.
        added = [x for x in made.get("added_tokens") or [] if x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) or not re.search(r"[^\w\s]{2}", x["content"])]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.cuts = made["model"]["type"] == "BPE" and plain and not made.get("normalizer") and not added
        self.pieces: dict[bytes, bytes] = {}
        # A byte-level vocabulary writes each byte as one printable character: its own, or one of those from 256.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.shown = {b: chr(256 + k) for k, b in enumerate(others)}

    def _word(self, piece: str) -> bytes:
        """Ids of letters, with or without a space before them: one pre-token."""
        tokens = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
        return array("H" if self.width == 2 else "I", [t.id for t in tokens]).tobytes()

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("H" if self.width == 2 else "I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a block; the pieces of plain texts are looked up all at once."""
        plain = plain_texts(data, offsets) if self.cuts else np.zeros(len(offsets) - 1, bool)
        out: list[bytes] = [b""] * len(plain)
        sure, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        for i, ids in zip(sure.tolist(), self._plain(data, offsets, plain)):
            out[i] = ids
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in others.tolist()]
        for i, ids in zip(others.tolist(), self.encode(texts) if texts else []):
            out[i] = ids
        return out

    def _plain(self, data: np.ndarray, offsets: np.ndarray, plain: np.ndarray) -> list[bytes]:
        if not plain.all():
            size = np.diff(offsets)
            data = data[np.repeat(plain, size)]
            offsets = np.concatenate([[0], np.cumsum(size[plain])])
        if not len(data):
            return [b""] * (len(offsets) - 1)
        alone = (data == 46) | (data == 44) | (data == 10)
        start = alone | (data == 32)
        start[1:] |= alone[:-1]
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(start), len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        raw, cuts = K.flat(coded.dictionary)
        raw, cuts = raw.tobytes(), cuts.tolist()
        names = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        known = self.pieces
        ids = list(map(known.get, names))
        new, rest = [x for x, got in zip(names, ids) if got is None], []
        # All are shown at once; no piece but a line end has one, and it is not of letters.
        shown = b"\n".join(x if x != b"\n" else b" " for x in new).decode("latin-1").translate(self.shown).split(self.shown[10])
        tokenize, kind = self.tokenizer.model.tokenize, "H" if self.width == 2 else "I"
        for x, text, word in zip(new, map(bytes.decode, new), shown):
            if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                known[x] = array(kind, [t.id for t in tokenize(word)]).tobytes()
            else:
                rest.append((x, text))
        for k in range(0, len(rest), 4096):
            known.update(zip((x for x, _ in rest[k : k + 4096]), self._raw([t for _, t in rest[k : k + 4096]])))
        ids = [got or known[x] for x, got in zip(names, ids)] if new else ids
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        flat, first = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        # A block has fewer ids than 2 ** 31: it has fewer bytes.
        at_id = np.arange(int(ends[-1]), dtype=np.int32)
        at_id += np.repeat((first[which] - ends + n).astype(np.int32), n)
        stream = flat[at_id].tobytes()
        cuts = np.append(0, ends)[np.searchsorted(at, offsets)] * self.width
        return [stream[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str], plain: np.ndarray | None = None) -> list[bytes]:
        """The ids of each text as little-endian integers of ``width`` bytes; ``plain`` texts need no test."""
        split: list[list[str] | None] = []
        for i, t in enumerate(texts):
            sure = plain is not None and plain[i]
            if not self.cuts or (not sure and _UNSAFE.search(t)):
                split.append(None)
                continue
            marks = not sure and _MARKS.search(t)
            t = t.replace(" ", "\0 ")
            if not marks:
                t = t.replace(".", "\0.\0").replace(",", "\0,\0").replace("\n", "\0\n\0")
            split.append(t.split("\0"))
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = list(set(chain.from_iterable(p for p in split if p is not None)).difference(memo))
        rest = []
        for p in new:
            if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                memo[p] = self._word(p)
            else:
                rest.append(p)
        for k in range(0, len(rest), 4096):
            memo.update(zip(rest[k : k + 4096], self._raw(rest[k : k + 4096])))
        whole = iter(self._raw([t for t, pieces in zip(texts, split) if pieces is None]))
        return [next(whole) if pieces is None else b"".join(map(memo.__getitem__, pieces)) for pieces in split]


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    v = _RING[ids.astype(np.int64) & 0xFFFF]
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h[k:] += v[: n - k] << np.uint64(k * 5)
    marks = np.flatnonzero((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, last = [], 0
    for m in marks.tolist():
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    out.append(n)
    return out


class Merkle:
    """A binary hash tree over leaves that come one by one; holds one node for each level."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node, level = hashlib.blake2b(b"\0" + leaf, digest_size=16).digest(), 0
        while self.stack and self.stack[-1][0] == level:
            node, level = hashlib.blake2b(b"\1" + self.stack.pop()[1] + node, digest_size=16).digest(), level + 1
        self.stack.append((level, node))

    def root(self) -> bytes:
        if not self.stack:
            return hashlib.blake2b(b"", digest_size=16).digest()
        node = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            node = hashlib.blake2b(b"\1" + left + node, digest_size=16).digest()
        return node


def merkle(leaves: list[bytes]) -> bytes:
    if len(leaves) == 1:
        return hashlib.blake2b(b"\0" + leaves[0], digest_size=16).digest()
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


_CARRY: list[list[list[int]]] = []


def _carry_tables() -> list[list[list[int]]]:
    """For each k and byte place, what a CRC-32 becomes over 2 ** k zero bytes."""
    if not _CARRY:

        def times(m: list[int], v: int) -> int:
            out = 0
            for row in m:
                if v & 1:
                    out ^= row
                v >>= 1
            return out

        step = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
        for _ in range(3):
            step = [times(step, x) for x in step]
        for _ in range(40):
            _CARRY.append([[times(step, v << (8 * b)) for v in range(256)] for b in range(4)])
            step = [times(step, x) for x in step]
    return _CARRY


def crc_join(first: int, second: int, size: int) -> int:
    """The CRC-32 of a string whose two parts have these, the second being ``size`` bytes long."""
    for k, (a, b, c, d) in enumerate(_carry_tables()):
        if size >> k & 1:
            first = a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24]
        elif not size >> k:
            break
    return first ^ second


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text) into a store at ``root``.

    Payloads are shuffled once, by chunk hash, and at most one copy of each from
    a task; a copy that a task has sent before goes without its payload, dealt
    by document, so a chunk that is in very many documents loads no task.
    """
    spark = docs.sparkSession

    def encode(batches):
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        sent: set[bytes] = set()
        for batch in batches:
            keys, column = batch.column("doc_id"), batch.column("text")
            for first, data, offsets in K.blocks(column, 1 << 22):
                doc, place, n, digest, ids = [], [], [], [], []
                for i, raw in enumerate(encoder.block(data, offsets)):
                    raw += end
                    last = 0
                    for p, c in enumerate(cut_points(np.frombuffer(raw, encoder.kind))):
                        part = raw[last * encoder.width : c * encoder.width]
                        h = hashlib.blake2b(part, digest_size=16).digest()
                        doc.append(first + i), place.append(p), n.append(c - last), digest.append(h)
                        if h in sent:
                            ids.append(None)
                        else:
                            ids.append(part)
                            if len(sent) >= MEMO:
                                sent.clear()
                            sent.add(h)
                        last = c
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc, pa.int64())), pa.array(place, pa.int32()), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(ids, pa.binary())], ["doc_id", "place", "n", "hash", "ids"])

    def first_copies(batches):
        last = None
        for batch in batches:
            keep, ids = [], batch.column("ids")
            for h, full in zip(batch.column("hash").to_pylist(), ids.is_valid().to_pylist()):
                keep.append(full and h != last)
                last = h if full else last
            left = pc.if_else(pa.array(keep, pa.bool_()), ids, pa.scalar(None, ids.type))
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", left)

    def recipes(batches):
        segment, place, offset, tree, block, number = TaskContext.get().partitionId(), 0, 0, Merkle(), Merkle(), 0

        def closed():
            top = block.root()
            tree.add(top)
            return _batch([(segment, -2 - number, None, 0, 0, [], [], top)], RECIPES)

        for batch in batches:
            out = []
            for doc_id, hashes, sizes in zip(batch.column("doc_id").to_pylist(), *_lists(batch.column("parts"), "hash", "n")):
                n, top = sum(sizes), merkle(hashes)
                block.add(top)
                out.append((segment, place, doc_id, offset, n, hashes, sizes, top))
                place, offset = place + 1, offset + n
                if place % LEAVES == 0:
                    yield closed()
                    block, number = Merkle(), number + 1
            yield _batch(out, RECIPES)
        if place % LEAVES:
            yield closed()
        if place:
            yield _batch([(segment, -1, None, 0, offset, [], [], tree.root())], RECIPES)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, place int, n int, hash binary, ids binary")
    # The row number of a document's first piece is its key.
    pieces = pieces.withColumn("key", F.monotonically_increasing_id() - F.col("place"))
    dealt = pieces.repartition(parts, F.when(F.col("ids").isNull(), F.xxhash64("key", "place")).otherwise(F.xxhash64("hash"))).sortWithinPartitions("hash")
    dealt.mapInArrow(first_copies, "doc_id long, place int, n int, hash binary, ids binary, key long").write.option("compression", "zstd").parquet(f"{root}/chunks")
    by_doc = spark.read.parquet(f"{root}/chunks").groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "hash", "n"))).alias("parts"))
    ordered = by_doc.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    ordered.mapInArrow(recipes, ", ".join(f"{k} {v}" for k, v in RECIPES.items())).write.option("compression", "zstd").parquet(f"{root}/recipes")
    segments = starts(spark, root).orderBy("segment").collect()  # one row for each task
    top = [(merkle([bytes(r["segment_root"]) for r in segments]), sum(r["segment_tokens"] for r in segments))]
    spark.createDataFrame(top, "root binary, n_tokens long").coalesce(1).write.parquet(f"{root}/manifest")


RECIPES = {"segment": "int", "place": "long", "doc_id": "long", "offset": "long", "n_tokens": "long", "hashes": "array<binary>", "lengths": "array<int>", "root": "binary"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}


def _batch(rows: list[tuple], fields: dict[str, str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, fields.values())], list(fields))


def _lists(parts: pa.Array, *fields: str) -> list[list[list]]:
    """For each field of a column of lists of structs, the values by row."""
    ends = np.cumsum(np.append(0, parts.value_lengths().to_numpy(zero_copy_only=False))).tolist()
    flat = [parts.flatten().field(f).to_pylist() for f in fields]
    return [[x[a:b] for a, b in zip(ends[:-1], ends[1:])] for x in flat]


def starts(spark: SparkSession, root: str) -> DataFrame:
    """segment, first id of the segment, root: from the manifest rows, one for each segment of the recipes."""
    whole = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{root}/recipes").where("place = -1").select("segment", F.coalesce(F.sum("n_tokens").over(whole), F.lit(0)).alias("first"), F.col("n_tokens").alias("segment_tokens"), F.col("root").alias("segment_root"))


def _located(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """Each piece of each recipe with columns of the verified chunk that it names."""
    recipes = spark.read.parquet(f"{root}/recipes").where("place >= 0")
    pieces = recipes.select("segment", "place", F.posexplode("hashes").alias("at", "hash"))
    return pieces.join(_verified(spark, root).select("hash", *columns), "hash")


def _verified(spark: SparkSession, root: str) -> DataFrame:
    """The stored chunks; one whose ids don't have its hash stops the read."""

    def check(batches):
        for batch in batches:
            crcs, widths = [], []
            for h, n, raw in zip(batch.column("hash").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                if hashlib.blake2b(raw, digest_size=16).digest() != h or len(raw) not in (2 * n, 4 * n):
                    raise ValueError(f"chunk {h.hex()} does not hold what was written")
                width = len(raw) // n
                crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
                widths.append(width)
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("n"), pa.array(crcs, pa.int64()), pa.array(widths, pa.int32()), batch.column("ids")], ["hash", "n", "crc", "width", "ids"])

    return spark.read.parquet(f"{root}/chunks").where("ids is not null").select("hash", "n", "ids").mapInArrow(check, "hash binary, n int, crc long, width int, ids binary")


def _held(spark: SparkSession, root: str) -> DataFrame:
    """segment and whether the roots of its documents give those of its nodes, and these the segment's root; checks the manifest's."""
    table = spark.read.parquet(f"{root}/recipes").select("segment", "place", "root")
    segments = starts(spark, root).orderBy("segment").select("segment_root").collect()
    if merkle([bytes(r[0]) for r in segments]) != bytes(spark.read.parquet(f"{root}/manifest").first()["root"]):
        raise ValueError("the manifest does not hold the segments that were written")

    def tops(batches):
        for batch in batches:
            roots = [merkle([x["root"] for x in part]) for part in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("node"), pa.array(roots, pa.binary())], ["segment", "node", "top"])

    def over(rows: DataFrame, node) -> DataFrame:
        groups = rows.groupBy("segment", node.alias("node")).agg(F.sort_array(F.collect_list(F.struct("at", "root"))).alias("parts"))
        return groups.mapInArrow(tops, "segment int, node long, top binary")

    documents = table.where("place >= 0").select("segment", F.col("place").alias("at"), "root")
    nodes = table.where("place < -1").select("segment", (-2 - F.col("place")).alias("at"), "root")
    found = over(documents, F.floor(F.col("at") / LEAVES).cast("long"))
    whole = over(nodes, F.lit(0).cast("long")).select("segment", F.lit(-1).cast("long").alias("node"), "top")
    stored = table.where("place < 0").select("segment", F.when(F.col("place") == -1, F.lit(-1)).otherwise(-2 - F.col("place")).cast("long").alias("node"), "root")
    same = stored.join(found.union(whole), ["segment", "node"], "full").select("segment", F.coalesce(F.col("top") == F.col("root"), F.lit(False)).alias("same"))
    return same.groupBy("segment").agg(F.min("same").alias("held"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, n_chunks, and whether its recipe and all roots above hold.

    The checksum of a document is joined from those of its chunks' stored ids,
    so payloads aren't shuffled.
    """
    fields = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids_crc32": "long", "n_chunks": "long", "verified": "boolean"}

    def join(batches):
        for batch in batches:
            out = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root", "held")], *_lists(batch.column("parts"), "hash", "n", "crc"))
            for doc_id, start, tokens, root, held, hashes, sizes, crcs in rows:
                crc = crcs[0] if crcs else 0
                for size, next_crc in zip(sizes[1:], crcs[1:]):
                    crc = crc_join(crc, next_crc, 4 * size)
                n = sum(sizes)
                out.append((doc_id, start, n, crc, len(sizes), held and n == tokens and merkle(hashes) == root))
            yield _batch(out, fields)

    parts = _located(spark, root, ["n", "crc"]).groupBy("segment", "place").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "n", "crc"))).alias("parts"))
    recipes = spark.read.parquet(f"{root}/recipes").where("place >= 0").select("segment", "place", "doc_id", "offset", "n_tokens", "root")
    # One row for each segment.
    tops = F.broadcast(starts(spark, root).join(_held(spark, root), "segment"))
    rows = recipes.join(parts, ["segment", "place"]).join(tops, "segment")
    return rows.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "root", "held", "parts").mapInArrow(join, ", ".join(f"{k} {v}" for k, v in fields.items()))


def read(spark: SparkSession, root: str) -> DataFrame:
    """Rebuilds documents: doc_id, start, ids array<int>."""

    def build(batches):
        for batch in batches:
            ids = [[v for x in parts for v in np.frombuffer(x["ids"], f"<u{x['width']}").tolist()] for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    parts = _located(spark, root, ["width", "ids"]).groupBy("segment", "place").agg(F.sort_array(F.collect_list(F.struct("at", "width", "ids"))).alias("parts"))
    rows = spark.read.parquet(f"{root}/recipes").where("place >= 0").select("segment", "place", "doc_id", "offset")
    rows = rows.join(parts, ["segment", "place"]).join(F.broadcast(starts(spark, root)), "segment")
    return rows.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "parts").mapInArrow(build, "doc_id long, start long, ids array<long>")
