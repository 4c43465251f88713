"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are folded: A-Z to lower case, runs of other ASCII than letters
and digits to one blank. An item of m characters is in a text if a part of it
is within e = floor(m * errors) edits of the item. Such a part shares at least
m - q + 1 - q * e q-grams with the item, on diagonals that lie within e of each
other. Shared q-grams are counted in diagonal bands that overlap by half, each
wide enough for all those diagonals; a band that reaches the bound gives a
region, and a banded alignment decides.

Items with fewer than ``exact_under`` folded characters have no bound; they are
found where their words stand exactly. Documents that hold only such items of
fewer than ``least_chars`` characters, which clean texts hold as well, are kept
by ``clean``.

Defined results: null items and those without a letter or digit are in no text;
null and empty texts hold nothing; repeated items each count, also with one
item_id or a null one; repeated rows each get a row; of overlapping places of
one item each end counts once; very long texts are searched whole; an empty
table gives an empty one, and with no item nothing is found; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import textkernel as K
from emberline.llm.scratch import fresh

Q = 12
#: Bytes of items in one index, which goes to all tasks; more items are searched in further passes.
INDEX_BYTES = 8_000_000
_FOLD = K.LOWER.copy()
_FOLD[:128] = [c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in K.LOWER[:128]]
_BITS = 22


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of a block, where each stood, and the offsets of the texts in them."""
    b = _FOLD[data]
    keep = b != 32
    if len(b):
        keep[1:] |= b[:-1] != 32
        keep[0] = True
        cuts = offsets[:-1][offsets[:-1] < len(b)]
        keep[cuts] = True
    at = np.flatnonzero(keep)
    return b[at], at, np.searchsorted(at, offsets)


def grams(folded: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place, Q - 1 fewer than bytes."""
    if len(folded) < Q:
        return np.zeros(0, np.uint64)
    g = folded.astype(np.uint64)
    g = g[:-1] | (g[1:] << np.uint64(8))
    g = g[:-2] | (g[2:] << np.uint64(16))
    with np.errstate(over="ignore"):
        h = (g[:-8] | (g[4:-4] << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + g[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def align(item: np.ndarray, text: np.ndarray, e: int, low: int | None = None, high: int | None = None, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the part of ``text`` nearest to the whole ``item``, if within ``e`` edits.

    Row by row over the characters of the item, each with the diagonals (place
    in the text less place in the item) from ``low`` to ``high`` only; all that
    the text has, if not given. The part begins anywhere, or at 0 if ``anchored``.
    """
    n, m, far = len(text), len(item), len(item) + len(text) + 1
    low, high = -m if low is None else low, n if high is None else high
    steps = np.arange(high - low + 1)
    padded = np.zeros(m + n + high - low + 2, np.int64) - 1
    padded[max(0, -low) : max(0, -low) + n] = text
    lead = max(0, -low)
    place = low + steps
    row = np.where((place < 0) | (place > n), far, place if anchored else 0)
    for i, c in enumerate(item, 1):
        new = row + (padded[lead + i - 1 + low : lead + i + high] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        place = i + low + steps
        outside = (place < 0) | (place > n)
        new[place == 0] = i
        new[outside] = far
        row = np.minimum.accumulate(new - steps) + steps
        row[outside] = far
        if row.min() > e:
            return None
    best = int(row.argmin())
    return (int(row[best]), m + low + best) if row[best] <= e else None


def _order(hit: tuple) -> tuple:
    """Hits by item, a null one first, and place."""
    return (hit[0] is not None, hit[0] or 0, *hit[1:])


class Index:
    """The q-grams of folded items, with a bit table before the exact lookup."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float, exact_under: int):
        self.ids, self.texts, self.edits, self.bounds = [], [], [], []
        codes, owners, places = [], [], []
        self.short: list[tuple[int | None, bytes]] = []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            folded, _, _ = fold(raw, np.array([0, len(raw)]))
            folded = np.frombuffer(folded.tobytes().strip(), np.uint8)
            m = len(folded)
            e = int(m * errors)
            if m < exact_under or m - Q + 1 - Q * e < 1:
                if m:
                    self.short.append((item_id, folded.tobytes()))
                continue
            g = grams(folded)
            codes.append(g), owners.append(np.full(len(g), len(self.ids))), places.append(np.arange(len(g)))
            self.ids.append(item_id), self.texts.append(folded), self.edits.append(e), self.bounds.append(m - Q + 1 - Q * e)
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.owner = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.codes >> np.uint64(64 - _BITS)] = True
        self.width = np.array([2 * (e + 1) for e in self.edits], np.int64)
        self.bound = np.array(self.bounds, np.int64)
        #: Diagonals are counted from this, so that none is negative.
        self.origin = max([len(x) for x in self.texts], default=0) + 1

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """For each text of a block its hits: item_id, first and last + 1 character, distance."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        folded, at, cuts = fold(data, offsets)

        def add(d: int, item_id: int | None, begin: int, end: int, distance: int) -> None:
            base = int(offsets[d])
            lead = (data[base : int(at[end - 1]) + 1] & 0xC0) != 0x80
            out[d].append((item_id, int(lead[: int(at[begin]) - base].sum()), int(lead.sum()), distance))

        if self.short:
            for d in range(len(out)):
                words = b" " + folded[cuts[d] : cuts[d + 1]].tobytes() + b" "
                for item_id, text in self.short:
                    place = words.find(b" " + text + b" ")
                    while place >= 0:
                        add(d, item_id, int(cuts[d]) + place, int(cuts[d]) + place + len(text), 0)
                        place = words.find(b" " + text + b" ", place + 1)
        g = grams(folded)
        if not len(self.codes) or not len(g):
            for hits in out:
                hits.sort(key=_order)
            return out
        near = np.flatnonzero(self.table[g >> np.uint64(64 - _BITS)])
        found = np.searchsorted(self.codes, g[near])
        found[found == len(self.codes)] = 0
        same = self.codes[found] == g[near]
        near, found = near[same], found[same]
        # A q-gram must not run over the end of its text.
        doc = np.searchsorted(cuts, near, "right") - 1
        inside = near + Q <= cuts[doc + 1]
        near, found = near[inside], found[inside]
        n = self.count[found]
        place = np.repeat(self.first[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        item, diagonal = self.owner[place], np.repeat(near, n) - self.place[place] + self.origin
        w = self.width[item]
        half = w // 2
        bands = np.concatenate([2 * (diagonal // w), 2 * ((diagonal + half) // w) + 1])
        keys, counts = np.unique((np.concatenate([item, item]) << np.int64(34)) | bands, return_counts=True)
        items = keys >> np.int64(34)
        good = counts >= self.bound[items]
        seen: set[tuple[int, int, int]] = set()
        for k, b in zip(items[good].tolist(), (keys[good] & ((1 << 34) - 1)).tolist()):
            width, e, m = int(self.width[k]), self.edits[k], len(self.texts[k])
            low = (b >> 1) * width - (width // 2 if b & 1 else 0) - self.origin
            # The band may touch two texts of the block.
            first = max(0, int(np.searchsorted(cuts, max(0, low), "right")) - 1)
            last = int(np.searchsorted(cuts, min(len(folded), low + width + m + e), "left"))
            for d in range(first, min(last, len(out))):
                start, stop = max(int(cuts[d]), low - e), min(int(cuts[d + 1]), low + width + m + e)
                if stop - start < m - e:
                    continue
                part = folded[start:stop]
                raw, needle = part.tobytes(), self.texts[k].tobytes()
                exact, places = raw.find(needle), []
                while exact >= 0:
                    places.append((start + exact, start + exact + m, 0))
                    exact = raw.find(needle, exact + 1)
                if not places:
                    got = align(self.texts[k], part, e, low - e - start, low + width + e - start)
                    if got is None:
                        continue
                    end = start + got[1]
                    back = align(self.texts[k][::-1], folded[max(start, end - m - e) : end][::-1], e, -e, e, True)
                    places = [(end - back[1] if back else max(start, end - m), end, got[0])]
                for begin, end, distance in places:
                    if (k, d, end) not in seen:
                        seen.add((k, d, end))
                        add(d, self.ids[k], begin, end, distance)
        for hits in out:
            hits.sort(key=_order)
        return out


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = 0.05, least_chars: int = 16) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``least_chars`` folded characters or more, with all their columns, whatever those are called."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return find(whole, _telling(benchmark, least_chars), ["row"], errors).where("n_hits = 0").select("row.*")


def _telling(benchmark: DataFrame, least_chars: int) -> DataFrame:
    folded = F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return benchmark.where(F.octet_length(folded) >= least_chars)


_HIT = pa.struct([("item_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("distance", pa.int64())])
_HITS = T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in _HIT]))


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], errors: float = 0.05, exact_under: int = 32) -> DataFrame:
    """``keep`` columns with n_hits, item_ids and hits (item_id, first, last, distance) of each row of ``docs``.

    A new column whose name ``keep`` has gets an underscore more.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-size // INDEX_BYTES))
    source = docs.select(F.struct(*keep).alias("row"), F.col("text"))
    row = source.schema["row"]

    def one_pass(p: int, source: DataFrame) -> DataFrame:
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).select(F.col("item_id").cast("long"), "text")
        items = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        columns = ["row"] if p == passes - 1 else ["row", "text"]

        def run(batches):
            index = Index(items, errors, exact_under)
            for batch in batches:
                hits = []
                for _, data, offsets in K.blocks(batch.column("text")):
                    hits.extend(index.find(data, offsets))
                rows = [[dict(zip(("item_id", "first", "last", "distance"), h)) for h in x] for x in hits]
                if p:
                    rows = [sorted((*(b or []), *r), key=lambda h: _order(tuple(h.values()))) for b, r in zip(batch.column("hits").to_pylist(), rows)]
                yield pa.RecordBatch.from_arrays([*K.take(batch, 0, batch.num_rows, columns), pa.array(rows, pa.list_(_HIT))], [*columns, "hits"])

        kinds = [row, T.StructField("text", T.StringType())][: len(columns)]
        return source.mapInArrow(K.released(run), T.StructType([*kinds, T.StructField("hits", _HITS)]))

    for p in range(passes):
        source = one_pass(p, source)
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    new = {"n_hits": F.size("hits").cast("long"), "item_ids": ids, "hits": F.col("hits")}
    kept = docs.select(*keep)
    return source.select(*[F.col("row").getField(c).alias(c) for c in kept.columns], *[x.alias(fresh(kept, n)) for n, x in new.items()])
