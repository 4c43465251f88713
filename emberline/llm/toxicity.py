"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon is learned: whole words and word beginnings that stand in toxic
training texts far more often than in clean ones. Features are densities and
strengths of lexicon hits, their nearness to second-person words, capitals,
punctuation and signs of obfuscation. The training
texts are dealt to FOLDS parts, and a part gets features from the lexicon of the
others, so that the trees see lexicon hits as they will be on new texts;
calibration uses margins from outside each part as well.

Defined results: null and empty texts have features 0 and get the score that
the model gives those; without a labelled training row, or with one class only,
every score is that class's share (0 without any row). Rows that repeat are
scored one by one, and all count as labelled rows; a label without a doc_id or
value is not read; a null doc_id has no label and is scored; very long texts
are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkernel as K
from emberline.llm.boosting import Isotonic, Trees
from emberline.llm.scratch import Scratch

#: Second-person words of the usual web languages.
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch sie tu te ti tus usted ustedes vosotros vous votre vos toi ton ta tes".split())
_LEET = str.maketrans("013457@$!*", "oleastasi_")
_EDGE = ".,;:!?\"'()[]{}<>|&*#~`_-=+/\\…«»“”‘’¿¡"
_ODD = re.compile(r"[A-Za-z][0-9@$!*#%][A-Za-z]")
_REPEAT = re.compile(r"([A-Za-z])\1\1")
PREFIXES = (4, 5, 6)
LIMITS = (2.5, 4.0)
MAX_TERMS = 20_000
MEMO = 100_000
FOLDS = 4

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1  # capitals
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[33]] = 4  # !
_CLASS[[63]] = 5  # ?
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (33, 63)]] = 6
_CLASS[128:] = 7
N_FEATURES = 20


def terms(word: str) -> list[str]:
    """The word and its beginnings, as keys of the lexicon."""
    return [word, *[f"{word[:n]}\0" for n in PREFIXES if len(word) > n]]


def _tokens(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def _counted(wanted: frozenset | None):
    """Counts, by fold, of the texts with each term: of all terms of toxic texts, or of ``wanted`` ones in clean texts."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for fold, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist()):
                found = {t for w in set(_tokens(text or "")) for t in terms(w)}
                total.update((fold, t) for t in (found if wanted is None else found & wanted))
        keys = list(total)
        for k in range(0, len(keys), 20_000):
            part = keys[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.string()), pa.array([total[x] for x in part], pa.int64())], ["fold", "term", "n"])

    return run


def _lexicon(counts: pd.DataFrame, sizes: tuple[int, int]) -> dict[str, float]:
    """Log odds of the terms that mark toxic texts; the strongest MAX_TERMS."""
    bad, good = counts["bad"].to_numpy(float), counts["good"].to_numpy(float)
    odds = np.log((bad + 0.5) / (sizes[0] + 1)) - np.log((good + 0.5) / (sizes[1] + 1))
    keep = np.flatnonzero((odds > LIMITS[0]) & (bad >= 2) & (bad >= 3 * good))
    keep = keep[np.argsort(-(odds[keep] * np.sqrt(bad[keep])), kind="stable")[:MAX_TERMS]]
    names = counts["term"].to_numpy()
    return {names[i]: float(odds[i]) for i in keep}


class Features:
    """Dense features of whole texts for one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def strength(self, word: str) -> float:
        """The largest log odds of the word's terms, 0 without any."""
        got = self.memo.get(word)
        if got is None:
            lexicon = self.lexicon
            got = max([lexicon.get(t, 0.0) for t in terms(word)])
            if not word.isalpha():
                plain = word.translate(_LEET).replace("_", "")
                if plain != word and plain:
                    got = max([got, *[lexicon.get(t, 0.0) for t in terms(plain)]])
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def of(self, text: str, data: np.ndarray) -> np.ndarray:
        out = np.zeros(N_FEATURES)
        if not text:
            return out
        tokens = _tokens(text)
        n = max(1, len(tokens))
        kinds = np.bincount(_CLASS[data], minlength=8)
        chars = max(1, int(kinds[1] + kinds[2] + kinds[7]))
        counts = Counter(tokens)
        strength = self.strength
        hits = {w: s for w in counts if (s := strength(w)) > 0}
        out[0] = math.log1p(n)
        if hits:
            number = sum(counts[w] for w in hits)
            sure = [w for w, s in hits.items() if s > LIMITS[1]]
            out[1], out[2] = 1000 * number / n, 1000 * sum(counts[w] for w in sure) / n
            out[3], out[4], out[5] = len(hits), len(sure), max(hits.values())
            out[6] = sum(hits.values())
            out[7] = sum(hits[w] * counts[w] for w in hits) / n
            out[8], out[9] = number, len({w[:4] for w in hits})
            at = [i for i, w in enumerate(tokens) if w in hits]
            near = sum(any(t in SECOND_PERSON for t in tokens[max(0, i - 3) : i + 4]) for i in at)
            out[10], out[11] = near / len(at), near
        out[12] = sum(counts[w] for w in SECOND_PERSON if w in counts) / n
        out[13], out[14], out[15] = kinds[1] / chars, 100 * kinds[4] / n, 100 * kinds[5] / n
        out[16], out[17] = kinds[6] / n, 100 * kinds[3] / n
        out[18], out[19] = 100 * len(_ODD.findall(text)) / n, 100 * len(_REPEAT.findall(text)) / n
        return out

    def matrix(self, column: pa.Array) -> np.ndarray:
        rows = []
        for first, data, offsets in K.blocks(column):
            for i, text in enumerate(column.slice(first, len(offsets) - 1).to_pylist()):
                rows.append(self.of(text or "", data[offsets[i] : offsets[i + 1]]))
        return np.array(rows).reshape(-1, N_FEATURES)


class Model:
    """Lexicon, trees and calibration; ``score`` gives probabilities of an Arrow text column."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, calibration: Isotonic | None, share: float):
        self.features, self.trees, self.calibration, self.share = Features(lexicon), trees, calibration, share

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None or not len(column):
            return np.full(len(column), self.share)
        return self.calibration.apply(self.trees.margin(self.features.matrix(column)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model:
    """Learns from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) covers.

    ``max_rows`` bounds the labelled sample: about half as many rows of each
    class, drawn by a hash, whose ids are sent to the tasks; all of a sampled
    text is used. Several labels of a document count as toxic if one does. The
    driver gets the sample's features, and the terms that stand in at least two
    (and in one of 500) of its toxic texts.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {int(r["toxic"]): r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, None, None, float(next(iter(sizes), 0)))
    clean_step, toxic_step = (max(1, -(-2 * sizes.get(k, 0) // max_rows)) for k in (0, 1))
    step = F.when(F.col("toxic") == 1, F.lit(toxic_step)).otherwise(F.lit(clean_step)).cast("long")
    scratch = Scratch(docs.sparkSession, "toxicity")
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), step) == 0)
    fold = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    sample = scratch.write(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", fold.alias("fold")), "sample")
    of = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_rows = sum(n for (_, t), n in of.items() if t == 1)
    if toxic_rows in (0, sum(of.values())):
        return Model({}, None, None, float(toxic_rows > 0))

    def by_fold(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
        counts = rows.mapInArrow(K.released(_counted(wanted)), "fold int, term string, n long")
        return counts.groupBy("term").agg(*[F.sum(F.when(F.col("fold") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in range(FOLDS)])

    total = sum((F.col(f"n{h}") for h in range(1, FOLDS)), F.col("n0"))
    bad = by_fold(sample.where("toxic = 1"), None).where(total >= max(2, toxic_rows // 500)).toPandas()
    good = by_fold(sample.where("toxic = 0"), frozenset(bad["term"])).toPandas()
    got = bad.merge(good, on="term", how="left", suffixes=("_bad", "_good")).fillna(0).sort_values("term", ignore_index=True)

    def lexicon(*folds: int) -> dict[str, float]:
        part = got[["term"]].assign(bad=sum(got[f"n{h}_bad"] for h in folds), good=sum(got[f"n{h}_good"] for h in folds))
        return _lexicon(part, tuple(sum(of.get((h, t), 0) for h in folds) for t in (1, 0)))

    crossed = [lexicon(*[h for h in range(FOLDS) if h != k]) for k in range(FOLDS)]

    def features(batches):
        makers = [Features(x) for x in crossed]
        for batch in batches:
            folds = np.array(batch.column("fold").to_pylist(), int)
            x = np.zeros((batch.num_rows, N_FEATURES))
            for h in range(FOLDS):
                rows = np.flatnonzero(folds == h)
                if len(rows):
                    x[rows] = makers[h].matrix(batch.column("text").take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("toxic"), batch.column("fold")], ["x", "toxic", "fold"])

    rows = sample.mapInArrow(K.released(features), "x array<double>, toxic int, fold int").toPandas().sort_values(["fold", "toxic", "x"], key=lambda c: c.map(str) if c.name == "x" else c)
    x, y, fold = np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float), rows["fold"].to_numpy()
    keep = _weights(y, clean_step, toxic_step)
    margins = np.zeros(len(y))
    for h in range(FOLDS):
        other = fold != h
        if other.all():
            continue
        if len(set(y[other].tolist())) < 2:
            margins[:] = Trees().fit(x, y).margin(x)
            break
        margins[~other] = Trees().fit(x[other], y[other]).margin(x[~other])
    calibration = Isotonic().fit(margins, y, keep)
    return Model(lexicon(*range(FOLDS)), Trees().fit(x, y), calibration, float(y.mean()))


def _weights(y: np.ndarray, clean_step: int, toxic_step: int) -> np.ndarray:
    """How many rows a sampled row stands for, so that calibration has the classes' true shares."""
    return np.where(y > 0, float(toxic_step), float(clean_step))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for batch in batches:
            s = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*K.take(batch, 0, batch.num_rows, keep), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], [*keep, "score", "predicted"])

    columns = [F.col(c) for c in keep] + ([] if "text" in keep else [F.col("text")])
    return docs.select(*columns).mapInArrow(K.released(run), f"{fields}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` under the threshold, with all their columns, whatever those are called."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score(whole, model, ["row"], threshold).where("predicted = 0").select("row.*")
