"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are a text's words and one end. There are three levels of restaurants under
the uniform distribution over the V training types and one unknown type: the one
that all share; one for each class of manners of writing, whose parent is the
shared one; and one for each word before. Anchors are the most frequent words,
clustered by which anchors follow them; an anchor's restaurant has the anchor's
class as its parent. Every other word's has the class that most tokens after it are
in (ties: the first), which is that of the last anchor before them (class 0 before
any). A text's first token sits in class 0 itself, and one after a word that no
training token follows in the class that it is in.

Seatings are drawn by Gibbs sweeps (see seating): the tables of each word after
each anchor given its class, then those of its classes given the shared restaurant,
then the word's tables in that one. After the burn-in, each sweep gives predictive
probabilities, which are averaged. Draws are seeded by buckets of words, so they
depend on the counts alone and not on how tables are cut or tasks repeated.

Counts cover all training tokens, grow with the corpus and stay distributed: a
block of documents asks for the words and pairs that it holds, each once, and gets
counts and probabilities. What goes to all tasks has a fixed size: anchors, classes
and a few totals of their restaurants. Restaurants of other words are dealt to
slices by their names. Their pairs that were met once have one table whatever is
drawn, so they are customers of the class at once and stay out of the draws; while
those of a repeated pair are drawn, the other repeated pairs of its restaurant count
with the mean number of tables that all such pairs had in the pass before.

Defined results: null texts are empty and have the end only; without a training
text every token has the uniform probability over the unknown type, 1; repeated
rows count and are scored one by one; words of equal count become anchors in the
order of their hashes; a text of any length is scored whole; kept columns may have
any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkernel as K
from emberline.llm.scratch import Scratch, fresh
from emberline.llm.seating import discount, draw

BLOCK = 14_000_000
THETA = 1.0
ANCHORS, CLASSES = 256, 6
END = np.uint64(0xE2D0E2D0E2D0E2D1)


class Contexts:
    """Anchors (sorted hashes of words) with their classes from 1; class 0 is before any anchor.

    Restaurants are numbered: classes first, then anchors from CLASSES on.
    """

    def __init__(self, anchors: np.ndarray, classes: np.ndarray):
        self.anchors, self.classes = anchors, classes
        self.size = CLASSES + len(anchors)
        #: The class that is the parent of each anchor's restaurant.
        self.parent = classes.astype(np.int64)
        #: The same, then those of the restaurants of other words, which are numbered size + class.
        self.under = np.concatenate([self.parent, np.arange(CLASSES)])

    def of(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The restaurant of each token; ``first`` are the tokens' starts by text."""
        n = len(hashes)
        if not n or not len(self.anchors):
            return np.zeros(n, np.int64)
        at = np.searchsorted(self.anchors, hashes)
        at[at == len(self.anchors)] = 0
        last = np.maximum.accumulate(np.where(self.anchors[at] == hashes, np.arange(n), -1))
        before = np.concatenate([[-1], last[:-1]])
        inside = before >= np.repeat(first[:-1], np.diff(first))
        anchor = at[np.maximum(before, 0)]
        return np.where(inside, np.where(before == np.arange(n) - 1, CLASSES + anchor, self.classes[anchor]), 0)


    def others(self, hashes: np.ndarray, first: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens after a word that is no anchor, and the names of their restaurants."""
        mine = r < CLASSES
        mine[first[:-1]] = False
        at = np.flatnonzero(mine)
        return at, K.mix(hashes[at - 1])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, ends included, and where each text's start."""
    words, first = K.words(data, offsets)
    out = np.insert(words, first[1:], END)
    return out, first + np.arange(len(first))


def fit_contexts(texts: DataFrame) -> Contexts:
    """Learns anchors and classes from the counts of all texts."""
    none = Contexts(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = texts.select("text").mapInArrow(_counted(none), "h long, c short, n long").where(F.col("h") != int(END.view(np.int64)))
    top = counts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").limit(ANCHORS).toPandas()
    anchors = np.sort(top["h"].to_numpy(np.int64).view(np.uint64))
    if not len(anchors):
        return Contexts(anchors, np.zeros(0, np.int64))

    def follows(batches):
        pairs = np.zeros((len(anchors), len(anchors)), np.int64)
        for batch in batches:
            for _, data, offsets in K.blocks(batch.column("text")):
                h, first = K.words(data, offsets)
                at = np.searchsorted(anchors, h)
                at[at == len(anchors)] = 0
                where = np.flatnonzero(anchors[at] == h)
                owner = np.searchsorted(first, where, "right")
                same = owner[:-1] == owner[1:]
                np.add.at(pairs, (at[where[:-1]][same], at[where[1:]][same]), 1)
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(pairs[i, j])], ["i", "j", "n"])

    got = texts.select("text").mapInArrow(follows, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros((len(anchors), len(anchors)))
    pairs[got["i"], got["j"]] = got["n"]
    return Contexts(anchors, 1 + cluster(pairs + pairs.T, CLASSES - 1))


def cluster(pairs: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """Groups of rows with like neighbours: k-means on square roots of shares, from rows far from each other."""
    x = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    centres = x[[int(pairs.sum(1).argmax())]]
    while len(centres) < min(k, len(x)):
        gap = ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1) * np.sqrt(pairs.sum(1))
        centres = np.vstack([centres, x[int(gap.argmax())]])
    out = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        if (new == out).all():
            break
        out = new
        centres = np.vstack([x[out == c].mean(0) if (out == c).any() else centres[c] for c in range(len(centres))])
    return out


class Model:
    """Totals and the table of words (h, n, packed).

    ``packed`` has log10 P of the word in the shared restaurant and in those that
    had it; ``new`` is an unknown word's log10 P in the classes, ``back`` the log10
    probability that a restaurant asks its parent, ``scale`` the log10 of what a
    restaurant's probabilities sum to before they are scaled. ``sheets`` (slice,
    pairs, blob) has the pairs of other words' restaurants and, where ``pairs`` is
    false, the tables of those met more than once, summed over ``samples`` seatings.
    """

    def __init__(self, contexts: Contexts, words: DataFrame, tokens: int, types: int, new: np.ndarray, back: np.ndarray, scale: np.ndarray, sheets: DataFrame | None, bits: int, d_other: float, samples: int = 1, tables: tuple[DataFrame, ...] = ()):
        self.contexts, self.words, self.tokens, self.types, self.new, self.back, self.scale = contexts, words, tokens, types, new, back, scale
        self.sheets, self.bits, self.d_other, self.samples = sheets, bits, d_other, samples
        #: Written tables of ``sheets``, then that of ``words``.
        self.tables = tables


def _merged(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of n by (h, c)."""
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    return (h[starts], c[starts], np.add.reduceat(n, starts)) if len(starts) else (h, c, n)


def _rows(names: list[str], *columns: np.ndarray):
    for k in range(0, len(columns[0]), 100_000):
        part = [x[k : k + 100_000] for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in part], names)


def _counted(contexts: Contexts):
    """Numbers of tokens by word and restaurant over a task's texts; parts are given out as they grow."""

    def run(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for _, data, offsets in K.blocks(batch.column("text")):
                h, first = tokens(data, offsets)
                r = contexts.of(h, first)
                parts.append(_merged(h, r.astype(np.int16), np.ones(len(h), np.int64)))
                if sum(len(x[0]) for x in parts) > 1_500_000:
                    parts = [_merged(*(np.concatenate(x) for x in zip(*parts)))]
                    if len(parts[0][0]) > 1_000_000:
                        yield from _rows(["h", "c", "n"], *parts.pop())
        if parts:
            yield from _rows(["h", "c", "n"], *_merged(*(np.concatenate(x) for x in zip(*parts))))

    return K.released(run)


#: The first bits of a pair's name are those of its restaurant's, so that both are in one slice.
_HIGH = np.uint64(0xFFFF << 48)
SLICE = 4_000_000


def _names(k: np.ndarray, h: np.ndarray, c: np.ndarray | int = 0) -> np.ndarray:
    """Names of pairs of restaurant and word, or of those in a class."""
    with np.errstate(over="ignore"):
        return (k & _HIGH) | (K.mix(k + h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F) * np.asarray(c, np.uint64)) & ~_HIGH)


def _slice(names: np.ndarray, bits: int) -> np.ndarray:
    return ((names >> np.uint64(48)) >> np.uint64(16 - bits)).astype(np.int32)


#: Columns of blobs. Of a slice: restaurants (name, class, number of pairs), their pairs (word, n); questions: restaurants, pairs; their answers; tables: pair, number.
_PAIRS, _ASKS, _TELLS, _TABLES = ("<u8", "u1", "<i4", "<u8", "<i8"), ("+<u8", "+<u8"), ("<f4", "u1", "<f4"), ("<u8", "<i8")
#: Of a block: its distinct words, anchors' cells by word that it asks for, their restaurants; tokens by text and each token's word.
_BLOCK = ("+<u8", "<i4", "<u2", "<i8", "|<i4")
#: Of a bucket's cells: word, restaurant, n; word, class, n, restaurant's name, its pairs met once, more than once.
_NEAR, _FAR = ("<u8", "<i2", "<i8"), ("<u8", "u1", "<i8", "<u8", "<i4", "<i4")
#: Of its seats: what stays (words, cells by word; cells' restaurants, n; names, pairs met once and more than once), what is drawn (t, tables, top, drawn, seen).
_FIXED, _DRAWN = ("<u8", "<i4", "<i2", "<i8", "<u8", "<i4", "<i4"), ("<i8", "<i8", "<i8", "<f8", "<i8")
#: The class of a restaurant that no training token sat in.
_NONE = 255


def _zip(types: tuple[str, ...], *columns: np.ndarray) -> bytes:
    """Columns as one compressed value; those of types with a bar are kept byte by byte, those with a plus, which ascend, so by their gaps."""

    def raw_of(x: np.ndarray, t: str) -> bytes:
        if t[0] not in "+|":
            return x.astype(t).tobytes()
        x = np.ascontiguousarray(x, t[1:])
        x = np.concatenate([x[:1], x[1:] - x[:-1]]) if t[0] == "+" else x
        return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()

    raw = b"".join(raw_of(x, t) for x, t in zip(columns, types))
    return np.array([len(raw), *map(len, columns)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unzip(types: tuple[str, ...], blob: bytes) -> list[np.ndarray]:
    at = 8 * (len(types) + 1)
    length, *sizes = np.frombuffer(blob[:at], "<i8").tolist()
    raw, out, at = pa.decompress(blob[at:], length, "zstd", asbytes=True) if length else b"", [], 0
    for t, n in zip(types, sizes):
        if t[0] in "+|":
            kind = np.dtype(t[1:])
            x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).reshape(-1).view(kind)
            out.append(np.cumsum(x, dtype=kind) if t[0] == "+" else x)
        else:
            out.append(np.frombuffer(raw, t, n, at))
        at += out[-1].nbytes
    return out


def _zip_pairs(k: np.ndarray, c: np.ndarray, h: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in ascending order of their restaurants (and classes)."""
    starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
    return _zip(_PAIRS, k[starts], c[starts], np.diff(np.append(starts, len(k))), h, n)


def _cuts(slices: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, first, end) of each slice in an ascending list."""
    edges = [*np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]])).tolist(), len(slices)] if len(slices) else [0]
    return [(int(slices[i]), i, j) for i, j in zip(edges, edges[1:])]


def _blob_rows(near: bool, parts: list[tuple[int, bytes]]):
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([near] * len(parts)), pa.array([x[0] for x in parts], pa.int32()), pa.array([x[1] for x in parts], pa.binary())], ["near", "slice", "blob"])


def _dealt(near: bool, types: tuple[str, ...], bits: int, h: np.ndarray, *columns: np.ndarray):
    """Cells in ascending order of their words, as blobs by bucket."""
    yield from _blob_rows(near, [(part, _zip(types, *(x[i:j] for x in (h, *columns)))) for part, i, j in _cuts(_slice(h, bits))])


def _paired(contexts: Contexts, bits: int, word_bits: int):
    """Over a task's texts, as blobs: by slice, pairs after other words than anchors with their numbers by class; by bucket, numbers of all other tokens by word and restaurant."""

    def merged(q: np.ndarray, k: np.ndarray, c: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(q)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(q[order]) != 0])) if len(q) else order
        first = order[starts]
        return q[first], k[first], c[first], h[first], np.add.reduceat(n[order], starts) if len(q) else n

    def out(q: np.ndarray, k: np.ndarray, c: np.ndarray, h: np.ndarray, n: np.ndarray):
        order = np.lexsort((c, k))
        k, c, h, n = k[order], c[order], h[order], n[order]
        yield from _blob_rows(False, [(part, _zip_pairs(k[i:j], c[i:j], h[i:j], n[i:j])) for part, i, j in _cuts(_slice(k, bits))])

    def near(parts):
        yield from _dealt(True, _NEAR, word_bits, *_merged(*(np.concatenate(x) for x in zip(*parts))))

    def run(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        cells: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for _, data, offsets in K.blocks(batch.column("text")):
                h, first = tokens(data, offsets)
                r = contexts.of(h, first)
                at, k = contexts.others(h, first, r)
                parts.append((_names(k, h[at], r[at]), k, r[at].astype(np.uint8), h[at], np.ones(len(at), np.int64)))
                mine = np.ones(len(h), bool)
                mine[at] = False
                h, r = h[mine], r[mine]
                cells.append(_merged(h, r.astype(np.int16), np.ones(len(h), np.int64)))
                if sum(len(x[0]) for x in parts) > 1_500_000:
                    parts = [merged(*(np.concatenate(x) for x in zip(*parts)))]
                    if len(parts[0][0]) > 1_000_000:
                        yield from out(*parts.pop())
                if sum(len(x[0]) for x in cells) > 1_500_000:
                    cells = [_merged(*(np.concatenate(x) for x in zip(*cells)))]
                    if len(cells[0][0]) > 1_000_000:
                        yield from near(cells)
                        cells = []
        if parts:
            yield from out(*merged(*(np.concatenate(x) for x in zip(*parts))))
        if cells:
            yield from near(cells)

    return K.released(run)


def _whole(key, table):
    """A slice's pairs summed over all tasks and classes, each restaurant's class, and how many pairs were met once and twice."""
    parts = []
    for blob in table.column("blob"):
        k, c, size, h, n = _unzip(_PAIRS, blob.as_py())
        parts.append((np.repeat(k, size), np.repeat(c, size), h, n))
    k, c, h, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, k))
    k, c, h, n = k[order], c[order], h[order], n[order]
    owner = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
    c = np.bincount(owner * CLASSES + c, n, (owner[-1] + 1) * CLASSES).reshape(-1, CLASSES).argmax(1).astype(np.uint8)[owner]
    starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
    n = np.add.reduceat(n, starts)
    blob = pa.array([_zip_pairs(k[starts], c[starts], h[starts], n)], pa.binary())
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "blob": blob, "once": [int((n == 1).sum())], "twice": [int((n == 2).sum())]})


def _cells(word_bits: int):
    """Cells that slices give to buckets of words, as blobs: pairs met once, as customers of the class; of those met more than once also the restaurant's name and its pairs met once and more than once."""

    def out(once, often):
        yield from _dealt(True, _NEAR, word_bits, *_merged(*(np.concatenate(x) for x in zip(*once))))
        h, *columns = (np.concatenate(x) for x in zip(*often))
        order = np.argsort(h)
        yield from _dealt(False, _FAR, word_bits, h[order], *(x[order] for x in columns))

    def run(batches):
        once, often = [], []
        for batch in batches:
            for blob in batch.column("blob"):
                k, c, size, h, n = _unzip(_PAIRS, blob.as_py())
                owner = np.repeat(np.arange(len(k)), size)
                one = n == 1
                once.append(_merged(h[one], c[owner[one]].astype(np.int16), n[one]))
                m = np.bincount(owner[~one], minlength=len(k))
                owner = owner[~one]
                often.append((h[~one], c[owner], n[~one], k[owner], (size - m)[owner], m[owner]))
                if sum(len(x[0]) for x in once + often) > 1_000_000:
                    yield from out(once, often)
                    once, often = [], []
        if once:
            yield from out(once, often)

    return K.released(run)


class Totals:
    """Customers and tables of the shared restaurant, the classes' and the anchors'; of other words' the discount and the mean tables of a repeated pair."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, shared_tables: float, types: int, d: np.ndarray, d_shared: float, d_other: float, mean: float):
        self.customers, self.tables, self.shared_tables, self.types, self.d, self.d_shared = customers, tables, shared_tables, types, d, d_shared
        self.d_other, self.mean = d_other, mean

    def shared(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """P of words with c customers at t tables in the shared restaurant."""
        everyone = self.tables[:CLASSES].sum() + THETA
        return (np.maximum(c - self.d_shared * t, 0) + (THETA + self.d_shared * self.shared_tables) / (self.types + 1)) / everyone

    def weights(self) -> np.ndarray:
        """By restaurant, the probability of asking its parent."""
        return (THETA + self.d * self.tables) / (self.customers + THETA)


class Seats:
    """A bucket of words with their cells (owner: the word's place, r: restaurant, n: tokens) and tables.

    Cells of other words' restaurants have its name k, its pairs met once (s) and more
    than once (m), and the sum of their tables over what was predicted (seen).
    """

    def __init__(self, contexts: Contexts, h: np.ndarray, owner: np.ndarray, r: np.ndarray, n: np.ndarray, t: np.ndarray, tables: np.ndarray, top: np.ndarray, drawn: np.ndarray, k: np.ndarray, s: np.ndarray, m: np.ndarray, seen: np.ndarray):
        self.contexts, self.h, self.owner, self.r, self.n, self.t, self.tables, self.top, self.drawn = contexts, h, owner, r, n, t, tables, top, drawn
        self.k, self.s, self.m, self.seen = k, s, m, seen
        self.leaf = np.flatnonzero(r >= CLASSES)
        self.near, self.far = np.flatnonzero(r[self.leaf] < contexts.size), np.flatnonzero(r[self.leaf] >= contexts.size)
        self.at = (owner[self.leaf], contexts.under[r[self.leaf] - CLASSES])
        self.direct = np.zeros((len(h), CLASSES), np.int64)
        mine = np.flatnonzero(r < CLASSES)
        self.direct[owner[mine], r[mine]] = n[mine]

    @staticmethod
    def first(contexts: Contexts, h: np.ndarray, owner: np.ndarray, r: np.ndarray, n: np.ndarray, k: np.ndarray, s: np.ndarray, m: np.ndarray) -> Seats:
        """Everybody who eats the same in a restaurant at one table."""
        out = Seats(contexts, h, owner, r, n, np.ones(len(n), np.int64), np.zeros((len(h), CLASSES), np.int64), np.ones(len(h), np.int64), np.zeros(0), k, s, m, np.zeros(len(k), np.int64))
        out.tables = (out.customers() > 0).astype(np.int64)
        return out

    def customers(self) -> np.ndarray:
        """Customers of the classes, by word: tokens of their own and the tables of the restaurants under them."""
        return self.direct + np.bincount(self.at[0] * CLASSES + self.at[1], self.t[self.leaf], self.direct.size).astype(np.int64).reshape(self.direct.shape)

    def _classes(self, m: np.ndarray, totals: Totals) -> np.ndarray:
        """P of the words in the classes."""
        root = totals.shared(self.tables.sum(1), self.top)
        own = np.maximum(m - totals.d[:CLASSES] * self.tables, 0) / (totals.customers[:CLASSES] + THETA)
        return own + totals.weights()[:CLASSES] * root[:, None]

    def sweep(self, totals: Totals, rng: np.random.Generator) -> None:
        """Draws all tables anew, from the anchors' restaurants to the shared one."""
        p = self._classes(self.customers(), totals)[self.at]
        leaf = self.leaf[self.near]
        self.t[leaf] = draw(self.n[leaf], p[self.near], np.maximum(totals.tables[self.r[leaf]] - self.t[leaf], 0), float(totals.d[-1]), THETA, rng)
        leaf = self.leaf[self.far]
        self.t[leaf] = draw(self.n[leaf], p[self.far], self.s + (self.m - 1) * totals.mean, totals.d_other, THETA, rng)
        m = self.customers()
        cells = np.nonzero(m)
        p0 = totals.shared(self.tables.sum(1), self.top)
        others = np.maximum(totals.tables[cells[1]] - self.tables[cells], 0)
        self.tables = np.zeros_like(m)
        self.tables[cells] = draw(m[cells], p0[cells[0]], others, float(totals.d[0]), THETA, rng)
        c = self.tables.sum(1)
        self.top = draw(c, np.full(len(c), 1 / (totals.types + 1)), np.maximum(totals.shared_tables - self.top, 0), totals.d_shared, THETA, rng)

    def predict(self, totals: Totals) -> None:
        """Adds P by these seatings to what earlier ones gave: in the shared restaurant, the classes, the anchors' restaurants by cell."""
        leaf = self.leaf[self.near]
        r, n = self.r[leaf], self.n[leaf]
        p = self._classes(self.customers(), totals)
        own = np.maximum(n - totals.d[r] * self.t[leaf], 0) / (totals.customers[r] + THETA)
        now = np.concatenate([totals.shared(self.tables.sum(1), self.top), p.reshape(-1), own + totals.weights()[r] * p[self.at][self.near]])
        self.drawn = self.drawn + now if len(self.drawn) else now
        self.seen = self.seen + self.t[self.leaf[self.far]]

    def sums(self) -> dict[str, np.ndarray]:
        """Customers and tables by restaurant, tables in the shared one, how many cells have one customer or two, and tables and number of other words' cells."""
        size, m = self.contexts.size, self.customers()
        leaf, far = self.leaf[self.near], self.leaf[self.far]
        r, n = self.r[leaf], self.n[leaf]
        customers = np.bincount(r, n, size)
        tables = np.bincount(r, self.t[leaf], size)
        customers[:CLASSES], tables[:CLASSES] = m.sum(0), self.tables.sum(0)
        c = self.tables.sum(1)
        ones = [(x == v).sum() for x in (n, m, c) for v in (1, 2)]
        return {"customers": customers, "tables": tables, "rest": np.array([self.top.sum(), len(self.h), self.n.sum(), *ones, self.t[far].sum(), len(far)], float)}


#: Bytes of training text for a bucket of words (some 30,000 cells); buckets grow in number with the corpus, not in size.
BUCKET = 2_000_000
_BUCKET = "b int, fixed binary, drawn binary, sums binary"


def _row(bucket: int, s: Seats, fixed: bytes | None = None) -> pa.RecordBatch:
    """A bucket as blobs, and its sums, which are read without the others."""
    if fixed is None:
        fixed = _zip(_FIXED, s.h, np.bincount(s.owner, minlength=len(s.h)), s.r, s.n, s.k, s.s, s.m)
    drawn = _zip(_DRAWN, s.t, s.tables.reshape(-1), s.top, s.drawn, s.seen)
    sums = np.concatenate([*s.sums().values()]).astype("<f8").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (fixed, drawn, sums))], ["b", "fixed", "drawn", "sums"])


def _buckets(contexts: Contexts, batches):
    """The buckets of a task, one at a time, with the blob of what stays."""
    for batch in batches:
        for i in range(batch.num_rows):
            fixed = batch.column("fixed")[i].as_py()
            h, size, r, n, *far = _unzip(_FIXED, fixed)
            t, tables, top, drawn, seen = (x.copy() for x in _unzip(_DRAWN, batch.column("drawn")[i].as_py()))
            yield batch.column("b")[i].as_py(), fixed, Seats(contexts, h, np.repeat(np.arange(len(h)), size), r.astype(np.int64), n, t, tables.reshape(-1, CLASSES), top, drawn, *far, seen)


def _totals(state: DataFrame, contexts: Contexts) -> dict[str, np.ndarray]:
    """The sums of all buckets; a table of fixed size."""
    cuts = [contexts.size, 2 * contexts.size]

    def run(batches):
        total = np.zeros(cuts[1] + 11)
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_py(), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    got = state.select("sums").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(cuts[1] + 11)
    out[got["i"]] = got["v"]
    return dict(zip(("customers", "tables", "rest"), np.split(out, cuts)))


def fit(texts: DataFrame, scratch: Scratch, passes: int = 3, sweeps: int = 2, samples: int = 2, seed: int = 4) -> Model:
    """Learns from all rows of ``texts`` (text).

    ``passes`` over the table of words draw seatings, in ``sweeps`` each by the
    totals of the pass before. After the burn-in, ``samples`` passes end with
    seatings whose probabilities, by their own totals, are averaged.
    """
    contexts = fit_contexts(texts)
    texts = texts.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, word_bits = (min(16, (size // x).bit_length()) for x in (SLICE, BUCKET))
    dealt = "near boolean, slice int, blob binary"
    counted = scratch.write(texts.mapInArrow(_paired(contexts, bits, word_bits), dealt), "counted")
    pairs = counted.where("not near").select("slice", "blob").groupBy("slice").applyInArrow(_whole, "slice int, blob binary, once long, twice long")
    pairs = scratch.write(pairs, "pairs")
    met = pairs.agg(F.sum("once"), F.sum("twice")).first()

    def gather(key, table):
        parts: dict[bool, list] = {True: [[np.zeros(0, t) for t in _NEAR]], False: [[np.zeros(0, t) for t in _FAR]]}
        for kind, blob in zip(table.column("near").to_pylist(), table.column("blob")):
            parts[kind].append(_unzip(_NEAR if kind else _FAR, blob.as_py()))
        h, r, n = _merged(*(np.concatenate(x) for x in zip(*parts[True])))
        far_h, c, far_n, *far = (np.concatenate(x) for x in zip(*parts[False]))
        h, n, name = np.concatenate([h, far_h]), np.concatenate([n, far_n]), np.concatenate([np.zeros(len(h), np.uint64), far[0]])
        r = np.concatenate([r.astype(np.int64), contexts.size + c.astype(np.int64)])
        order = np.lexsort((name, r, h))
        words = h[order]
        new = np.concatenate([[True], words[1:] != words[:-1]])
        words, owner = words[new], np.cumsum(new) - 1
        last = order[r[order] >= contexts.size] - (len(h) - len(far_h))
        s = Seats.first(contexts, words, owner, r[order], n[order], *(x[last] for x in far))
        return pa.Table.from_batches([_row(key[0].as_py(), s)])

    cells = counted.where("near").union(pairs.select("blob").mapInArrow(_cells(word_bits), dealt))
    state = scratch.write(cells.groupBy("slice").applyInArrow(gather, _BUCKET), "seats")
    scratch.drop(counted)
    sums = _totals(state, contexts)
    types, tokens_seen = int(sums["rest"][1]), int(sums["rest"][2])
    if not types:
        none = state.selectExpr("cast(b as bigint) as h", "cast(0 as bigint) as n", "cast('' as binary) as packed")
        return Model(contexts, none, 0, 0, np.zeros(CLASSES), np.zeros(contexts.size), np.zeros(contexts.size), None, 0, 0.5)
    after, kind, word = (discount(once=sums["rest"][k], twice=sums["rest"][k + 1]) for k in (3, 5, 7))
    d = np.where(np.arange(contexts.size) < CLASSES, kind, after)
    other = discount(once=met[0] or 0, twice=met[1] or 0)
    weights, unknown = [], []
    for p in range(passes + 1):
        totals = Totals(sums["customers"], sums["tables"], float(sums["rest"][0]), types, d, word, other, float(sums["rest"][9] / max(sums["rest"][10], 1)))
        counted = p > passes - samples
        if counted:
            weights.append(totals.weights())
            unknown.append(weights[-1][:CLASSES] * totals.shared(np.zeros(1), np.zeros(1))[0])

        def seat(batches, totals=totals, p=p, counted=counted):
            for b, fixed, s in _buckets(contexts, batches):
                if counted:
                    s.predict(totals)
                rng = np.random.Generator(np.random.PCG64([seed, p, b]))
                for _ in range(sweeps):
                    s.sweep(totals, rng)
                yield _row(b, s, fixed)

        def average(batches, totals=totals):
            for _, _, s in _buckets(contexts, batches):
                s.predict(totals)
                root, classes, leaf = np.split(np.log10(s.drawn / samples), [len(s.h), len(s.h) * (CLASSES + 1)])
                at = np.nonzero(s.customers())
                near = s.leaf[s.near]
                owner, r = np.concatenate([at[0], s.owner[near]]), np.concatenate([at[1], s.r[near]])
                packed = _pack(root, owner, r, np.concatenate([classes.reshape(-1, CLASSES)[at], leaf]))
                n = np.bincount(s.owner, s.n, len(s.h)).astype(np.int64)
                for k in range(0, len(n), 20_000):
                    part = slice(k, k + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(s.h[part].view(np.int64)), pa.array(n[part]), packed[part]], ["h", "n", "packed"])

        def seats(batches):
            parts: list[tuple[np.ndarray, np.ndarray]] = []

            def out():
                q, t = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(q)
                q, t = q[order], t[order]
                found = _cuts(_slice(q, bits))
                blobs = [_zip(_TABLES, q[i:j], t[i:j]) for _, i, j in found]
                return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])

            for _, _, s in _buckets(contexts, batches):
                far = s.leaf[s.far]
                parts.append((_names(s.k.view(np.uint64), s.h[s.owner[far]]), s.seen + s.t[far]))
                if sum(len(x[0]) for x in parts) > 1_000_000:
                    yield out()
                    parts.clear()
            if parts:
                yield out()

        if p == passes:
            tables = scratch.write(state.mapInArrow(K.released(seats), "slice int, blob binary"), "tables")
            words = scratch.write(state.mapInArrow(K.released(average), "h long, n long, packed binary"), "words")
            scratch.drop(state)
            break
        seated = scratch.write(state.mapInArrow(K.released(seat), _BUCKET), "seats")
        scratch.drop(state)
        state = seated
        sums = _totals(state, contexts)

    sheets = pairs.selectExpr("slice", "true as pairs", "blob").union(tables.selectExpr("slice", "false as pairs", "blob"))
    back, new = np.log10(np.mean(weights, 0)), np.log10(np.mean(unknown, 0))
    # Averages of what is handed on to parents are taken factor by factor, so each restaurant's probabilities are scaled to sum to 1.
    got = words.select("packed").mapInArrow(_masses(contexts, back), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    mass = np.zeros(contexts.size)
    mass[got["i"]] = got["v"]
    mass[:CLASSES] += 10**new
    mass[CLASSES:] += 10 ** back[CLASSES:] * mass[contexts.parent]
    return Model(contexts, words, tokens_seen, types, new, back, np.log10(mass), sheets, bits, other, samples, (pairs, tables, words))


_ENTRY = np.dtype([("r", "<u2"), ("p", "<f4")])


def _pack(root: np.ndarray, owner: np.ndarray, r: np.ndarray, p: np.ndarray) -> pa.Array:
    """A binary value for each word: its log10 P in the shared restaurant, then (restaurant, log10 P) of each cell."""
    order = np.lexsort((r, owner))
    entries = np.zeros(len(owner), _ENTRY)
    entries["r"], entries["p"] = r[order], p[order]
    ends = np.concatenate([[0], np.cumsum(4 + _ENTRY.itemsize * np.bincount(owner, minlength=len(root)))])
    raw = np.zeros(int(ends[-1]), np.uint8)
    head = ends[:-1, None] + np.arange(4)[None, :]
    body = np.ones(len(raw), bool)
    body[head] = False
    raw[head] = root.astype("<f4").view(np.uint8).reshape(-1, 4)
    raw[body] = entries.view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(root), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def _unpack(packed: pa.Array) -> tuple[np.ndarray, ...]:
    """log10 P in the shared restaurant and number of cells of each word, then restaurant and log10 P of all cells."""
    raw, offsets = K.flat(packed)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    head = offsets[:-1, None] + np.arange(4)[None, :]
    body = np.ones(len(raw), bool)
    body[head] = False
    entries = raw[body].view(_ENTRY)
    return raw[head].reshape(-1).view("<f4"), (np.diff(offsets) - 4) // _ENTRY.itemsize, entries["r"], entries["p"]


class Sheet:
    """Unpacked words: log10 P by class before scaling, and the cells of anchors' restaurants (owner, r, p)."""

    def __init__(self, root: np.ndarray, size: np.ndarray, r: np.ndarray, p: np.ndarray, back: np.ndarray):
        owner, r, p = np.repeat(np.arange(len(size)), size), r.astype(np.int64), p.astype(float)
        self.classes = root.astype(float)[:, None] + back[:CLASSES]
        mine = r < CLASSES
        self.classes[owner[mine], r[mine]] = p[mine]
        self.owner, self.r, self.p = owner[~mine], r[~mine], p[~mine]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and the place of each value among them."""
    order = np.argsort(x)
    ahead = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ahead[1:] != ahead[:-1]
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ahead[new], at


#: Answers that a task holds before it gives them out by block.
ANSWERS = 400_000
_COLUMNS = ("<i8", "<i8", "<f4", "<u2", "<u2", "<f4")


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of answers (h, n, root, size, r, p), one after the other and compressed."""
    raw = b"".join(x.astype(t).tobytes() for x, t in zip(columns, _COLUMNS))
    head = np.array([len(raw), len(columns[0]), len(columns[4])], "<i8").tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True)


def _expand(blob: bytes) -> list[np.ndarray]:
    length, words, cells = np.frombuffer(blob[:24], "<i8").tolist()
    raw, out = pa.decompress(blob[24:], length, "zstd", asbytes=True), []
    at = 0
    for t, n in zip(_COLUMNS, (words, words, words, words, cells, cells)):
        out.append(np.frombuffer(raw, t, n, at))
        at += out[-1].nbytes
    return out


def _gathered(batches):
    """Answers of a task by block: many rows of (block, h, n, packed, wanted) become one of (block, blob).

    Of the anchors' restaurants a block gets those cells that it asked for.
    """

    def out(parts):
        block, h, n, root, size, r, p = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(block, kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        sizes = size[order]
        ends = np.cumsum(sizes)
        cells = np.repeat(starts[order] - (ends - sizes), sizes) + np.arange(len(r))
        block, h, n, root, size, r, p = block[order], h[order], n[order], root[order], sizes, r[cells], p[cells]
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() + [len(block)]
        edge = np.concatenate([[0], ends])
        blobs = [_squeeze([x[i:j] for x in (h, n, root, size)] + [x[edge[i] : edge[j]] for x in (r, p)]) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(blobs, pa.binary())], ["block", "blob"])

    parts = []
    for batch in batches:
        if not batch.num_rows:
            continue
        root, size, r, p = _unpack(batch.column("packed"))
        owner = np.repeat(np.arange(len(size)), size)
        raw, offsets = K.flat(batch.column("wanted"))
        asker = np.repeat(np.arange(len(size)), np.diff(offsets) // 2)
        wanted = np.ascontiguousarray(raw[offsets[0] : offsets[-1]]).view("<u2").astype(np.int64)
        used = (r < CLASSES) | np.isin(owner << 16 | r, asker << 16 | wanted)
        parts.append((*(batch.column(c).to_numpy() for c in ("block", "h", "n")), root, np.bincount(owner[used], minlength=len(size)), r[used], p[used]))
        if sum(len(x[0]) for x in parts) >= ANSWERS:
            yield out(parts)
            parts = []
    if parts:
        yield out(parts)


def _told(d: float, samples: int):
    """Answers of a slice: by restaurant its class and the probability that it asks that, by pair what it has beyond that; the mean of the tables tells both."""

    def run(key, left, right):
        k, back, c, q, own = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0)
        kinds, blobs = right.column("pairs").to_pylist(), right.column("blob")
        found = [_unzip(_PAIRS, blobs[i].as_py()) for i, kind in enumerate(kinds) if kind]
        if found and left.num_rows:
            k, c, size, h, n = found[0]
            owner = np.repeat(np.arange(len(k)), size)
            q = _names(k[owner], h)
            order = np.argsort(q)
            q, owner, n, t = q[order], owner[order], n[order], np.ones(len(q))
            for i, kind in enumerate(kinds):
                if not kind:
                    pair, tables = _unzip(_TABLES, blobs[i].as_py())
                    t[np.searchsorted(q, pair)] = tables / samples
            customers = np.bincount(owner, n, len(k)) + THETA
            back = (THETA + d * np.bincount(owner, t, len(k))) / customers
            own = np.maximum(n - d * t, 0) / customers[owner]

        def looked_up(names, values, wanted, missing):
            if not len(names):
                return np.full(len(wanted), missing)
            at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
            return np.where(names[at] == wanted, values[at], missing)

        out = []
        for blob in left.column("blob"):
            ks, qs = _unzip(_ASKS, blob.as_py())
            out.append(_zip(_TELLS, looked_up(k, back, ks, 1.0), looked_up(k, c, ks, _NONE), looked_up(q, own, qs, 0.0)))
        K.release()
        return pa.table({"block": left.column("block"), "slice": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

    return run


def _unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order; np.unique of long arrays hashes them, which takes longer than to sort them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _masses(contexts: Contexts, back: np.ndarray):
    """Sums of P over words: all of a class; of an anchor's restaurant what its cells have beyond their parent's part."""

    def run(batches):
        total = np.zeros(contexts.size)
        for batch in batches:
            s = Sheet(*_unpack(batch.column("packed")), back)
            total[:CLASSES] += (10**s.classes).sum(0)
            parent = s.classes[s.owner, contexts.parent[s.r - CLASSES]]
            total += np.bincount(s.r, 10**s.p - 10 ** (back[s.r] + parent), contexts.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(contexts.size)), pa.array(total)], ["i", "v"])

    return run


#: What rows about a block are: its tokens, answers for its words; from 0 on, a slice's answers.
_TOKENS, _WORDS = -2, -1
#: Parts of slices that are asked, and of blocks that are scored, one after the other, so that less is shuffled at once.
ROUNDS = 3
#: Tokens of a block that are scored at once, if they are of several texts.
CHUNK = 500_000


def score(docs: DataFrame, model: Model, keep: list[str], spend: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, base_score, score and perplexity of each row of ``docs``.

    Documents are dealt to blocks of about BLOCK bytes, which are written once, so
    that a repeated task can't deal them otherwise, as places among their distinct
    words and pairs; each asks the model for those, and is scored where the answers
    come together with it. A result whose name a kept column has gets an underscore.
    With ``spend`` the model's tables are dropped when they have answered.
    """
    kept = docs.select(*keep)
    text = fresh(kept, "text")
    number_of, row_of, blob_of = fixed = [fresh(kept, name) for name in ("block", "row", "blob")]
    results = [fresh(kept, name) for name in ("n_tokens", "n_known", "base_score", "score")]
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    contexts, total, types, new, back, scale = model.contexts, model.tokens, model.types, model.new, model.back, model.scale
    paired, bits = model.sheets is not None, model.bits

    def dealt(batches):
        pid, number, size = TaskContext.get().partitionId() << 24, 0, 0
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows: list[list[pa.Array]] = []
        kinds: list[pa.DataType] = []

        def out():
            h, n, done = np.concatenate(hashes), np.concatenate(counts), 0
            hashes.clear()
            counts.clear()
            for part in rows:
                m = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.array([pid | number] * m, pa.int64()), pa.array(np.arange(done, done + m), pa.int32()), pa.nulls(m, pa.binary()), *part], [*fixed, *keep])
                done += m
            rows.clear()
            r = contexts.of(h, np.concatenate([[0], np.cumsum(n)]))
            words, word = _distinct(h)
            cells = _unique((word.astype(np.int64) * contexts.size + r)[r >= CLASSES])
            blob = _zip(_BLOCK, words, np.bincount(cells // contexts.size, minlength=len(words)), cells % contexts.size, n, word)
            yield pa.RecordBatch.from_arrays([pa.array([pid | number], pa.int64()), pa.nulls(1, pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, t) for t in kinds)], [*fixed, *keep])

        for batch in batches:
            kinds = [batch.schema.field(name).type for name in keep]
            for first, data, offsets in K.blocks(batch.column(text)):
                if size and size + len(data) > BLOCK:
                    yield from out()
                    number, size = number + 1, 0
                h, at = tokens(data, offsets)
                hashes.append(h)
                counts.append(np.diff(at))
                rows.append([pa.concat_arrays([x]) for x in K.take(batch, first, len(offsets) - 1, keep)])
                size += len(data) + 64 * len(counts[-1])
        if counts:
            yield from out()

    def questions(batches):
        for batch in batches:
            for b, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                h, size, r, _, _ = _unzip(_BLOCK, blob.as_py())
                ends = np.concatenate([[0], np.cumsum(2 * size)]).astype(np.int32)
                wanted = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(r))])
                whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(size), b)), pa.array(h.view(np.int64)), wanted], ["block", "h", "wanted"])
                for k in range(0, len(size), 100_000):
                    yield whole.slice(k, 100_000)

    rounds = min(ROUNDS, 2**bits)

    def pairs_of(part: int):
        """Questions of blocks to the slices of a round."""

        def run(batches):
            for batch in batches:
                for b, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                    words, _, _, n, word = _unzip(_BLOCK, blob.as_py())
                    h, first = words[word], np.concatenate([[0], np.cumsum(n)])
                    where, k = contexts.others(h, first, contexts.of(h, first))
                    mine = _slice(k, bits) % rounds == part
                    where, k = where[mine], k[mine]
                    q, k = _unique(_names(k, h[where])), _unique(k)
                    found = [(x, _zip(_ASKS, k[i:j], q[y:z])) for (x, i, j), (_, y, z) in zip(_cuts(_slice(k, bits)), _cuts(_slice(q, bits)))]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([b] * len(found), pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["slice", "block", "blob"])

        return K.released(run)

    parents = np.concatenate([np.arange(CLASSES), contexts.parent])
    ask = np.where(np.arange(contexts.size) < CLASSES, 0, back)
    floor = math.log10(total + types + 1)
    out_names = [*keep, *results]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs, slices = right.column("blob"), right.column("slice").to_numpy()
        words, _, _, n, word = _unzip(_BLOCK, blobs[int(np.flatnonzero(slices == _TOKENS)[0])].as_py())
        parts = [_expand(blobs[i].as_py()) for i in np.flatnonzero(slices == _WORDS).tolist()]
        h, count, *cells = (np.concatenate(x) for x in zip(_expand(_squeeze([np.zeros(0)] * 6)), *parts))
        sheet = Sheet(*cells, back)
        # By word; those that no training text has are unknown.
        at = np.searchsorted(words, h.view(np.uint64))
        count_of, classes = np.zeros(len(words), np.int64), np.repeat(new[None, :], len(words), 0)
        count_of[at], classes[at] = count, sheet.classes
        cell = at[sheet.owner] * contexts.size + sheet.r
        by_cell = np.argsort(cell)
        cell, cell_p = np.append(cell[by_cell], -1), np.append(sheet.p[by_cell], 0.0)

        def log_p(pos, r):
            """log10 P of words by their place in restaurants: a cell's own, else by way of the parent."""
            own = classes[pos, parents[r]] + ask[r]
            leaf = np.flatnonzero(r >= CLASSES)
            wanted = pos[leaf].astype(np.int64) * contexts.size + r[leaf]
            at = np.searchsorted(cell[:-1], wanted)
            hit = cell[at] == wanted
            own[leaf[hit]] = cell_p[at[hit]]
            return own - scale[r]

        told = [_unzip(_TELLS, blobs[i].as_py()) for i in np.argsort(slices, kind="stable").tolist() if slices[i] >= 0]
        asks, kinds, has = (np.concatenate(x) for x in zip([np.zeros(0), np.zeros(0, np.uint8), np.zeros(0)], *told))
        first = np.concatenate([[0], np.cumsum(n)])
        restaurant, pair, pairs, before = np.zeros(len(words), np.int64), [], [], []
        if paired:
            h = words[word]
            where, k = contexts.others(h, first, contexts.of(h, first))
            pairs, pair = _distinct(_names(k, h[where]))
            mine = np.zeros(len(words), bool)
            mine[word[where - 1]] = True
            before = np.flatnonzero(mine)
            restaurant[before[np.argsort(K.mix(words[before]))]] = np.arange(len(before))
        if (len(asks), len(has)) != (len(before), len(pairs)):
            raise ValueError(f"a block asked for {len(before)} restaurants and {len(pairs)} pairs and was told {len(asks)} and {len(has)}")

        base = np.log10(count_of + 1.0) - floor
        sums: list[list[np.ndarray]] = []
        i = done = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(first, first[i] + CHUNK, "right")) - 1)
            at, w = first[i : j + 1] - first[i], word[first[i] : first[j]]
            h = words[w]
            r = contexts.of(h, at)
            p = log_p(w, r)
            if paired:
                where, _ = contexts.others(h, at, r)
                mine = restaurant[w[where - 1]]
                under = log_p(w[where], np.where(kinds[mine] == _NONE, r[where], kinds[mine]).astype(np.int64))
                p[where] = np.log10(has[pair[done : done + len(where)]] + asks[mine] * 10**under)
                done += len(where)
            sums.append([np.add.reduceat(x, at[:-1]) for x in ((count_of[w] > 0).astype(np.int64), base[w], p)])
            i = j
        left = left.sort_by(row_of)
        columns = [pa.array(x) for x in (n, *(np.concatenate(x) for x in zip(*sums)))]
        K.release()
        return pa.table([*(left.column(name) for name in keep), *columns], out_names)

    source = docs.select(*keep, F.col("text").alias(text))
    scratch = Scratch(docs.sparkSession, "lm-blocks")
    blocks = scratch.write(source.mapInArrow(K.released(dealt), f"`{number_of}` long, `{row_of}` int, `{blob_of}` binary, {spec}"), "blocks")
    blobs = blocks.where(F.col(row_of).isNull()).select(F.col(number_of).alias("block"), F.col(blob_of).alias("blob"))
    rows = blocks.where(F.col(row_of).isNotNull()).select(number_of, row_of, *keep)
    told = []
    for part in range(rounds if paired else 0):
        mine = blobs.mapInArrow(pairs_of(part), "slice int, block long, blob binary").groupBy("slice")
        mine = mine.cogroup(model.sheets.where(F.col("slice") % rounds == part).groupBy("slice"))
        told.append(scratch.write(mine.applyInArrow(_told(model.d_other, model.samples), "block long, slice int, blob binary"), "told"))
    if spend:
        scratch.drop(*model.tables[:2])
    asked = blobs.mapInArrow(K.released(questions), "block long, h long, wanted binary")
    answers = asked.join(model.words, "h").select("block", "h", "n", "packed", "wanted").mapInArrow(K.released(_gathered), "block long, blob binary")
    told.append(scratch.write(answers, "answers"))
    if spend:
        scratch.drop(*model.tables[2:])
    right = told[-1].selectExpr("block", f"{_WORDS} as slice", "blob").union(blobs.selectExpr("block", f"{_TOKENS} as slice", "blob"))
    for x in told[:-1]:
        right = right.union(x)
    types_of = ", ".join(f"`{n}` {t}" for n, t in zip(results, ("long", "long", "double", "double")))

    def scores(part: int) -> DataFrame:
        left, have = (x.where(F.pmod(F.hash(name), F.lit(rounds)) == part) if rounds > 1 else x for x, name in ((rows, number_of), (right, "block")))
        return left.groupBy(number_of).cogroup(have.groupBy("block")).applyInArrow(scored, f"{spec}, {types_of}")

    out = scores(0)
    if rounds > 1:
        parts = [scratch.write(scores(part), "scores") for part in range(rounds)]
        scratch.drop(blocks, *told)
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
    return out.withColumn(fresh(kept, "perplexity"), F.pow(F.lit(10.0), -F.col(results[3]) / F.col(results[0])))
