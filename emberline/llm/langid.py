"""Language identification by multilingual mixture inference.

Each language is a smoothed distribution over byte trigrams (hashed to a fixed
number of cells), counted over training texts. A document is a mixture of
languages: expectation-maximisation estimates the proportions from the trigram
likelihoods, and the set of languages is the one with the best penalised
likelihood (half a log of the effective sample size for each further language).

Defined results: null texts and texts without a letter get ``und`` with score
0; with no training row at all every text is ``und``. Columns of the input
other than ``text``, ``lang`` and the keys are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkernel as K

CELLS = 1 << 14
EFFECTIVE = 3.0  # overlapping trigrams carry about a third of their number of independent observations
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLD = K.LOWER.copy()
_FOLD[:128] = [c if 97 <= c <= 122 else 32 for c in K.LOWER[:128]]


def _cells(data: np.ndarray) -> np.ndarray:
    """The cell of the trigram that starts at each byte but the last two."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = _FOLD[data].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _count_cells(batches):
    """Counts of cells by language over all rows of a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, data, offsets in K.blocks(batch.column("text")):
            for i in range(len(offsets) - 1):
                c = _cells(data[offsets[i] : offsets[i + 1]])
                if len(c):
                    into = total.setdefault(langs[first + i], np.zeros(CELLS, np.int64))
                    into += np.bincount(c, minlength=CELLS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "cell", "n"])


def fit(train: DataFrame, rows_per_lang: int = 4000) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by cell.

    ``rows_per_lang`` bounds the labelled sample: a language with more rows is
    thinned by a hash of its text, so that about that many whole texts remain.
    What comes to the driver is one number for each language and cell.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, CELLS), np.float32)
    step = F.lit(1)
    for lang, n in sorted(sizes.items()):
        if n > rows_per_lang:
            step = F.when(F.col("lang") == lang, F.lit(-(-n // rows_per_lang))).otherwise(step)
    sample = train.where(F.pmod(F.xxhash64("text"), step.cast("long")) == 0).select("lang", "text")
    got = sample.mapInArrow(_count_cells, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    counts = np.full((len(langs), CELLS), 0.5)
    if len(got):
        counts[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), got["cell"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _mixture(logp: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """EM: proportions of the columns of ``logp`` for cells seen ``n`` times, and the log likelihood."""
    top = logp.max(1, keepdims=True)
    like = np.exp(logp - top)
    w = np.full(logp.shape[1], 1 / logp.shape[1])
    base, last = float((n * top[:, 0]).sum()), -np.inf
    for _ in range(rounds):
        joint = like * w
        total = joint.sum(1)
        now = float((n * np.log(total)).sum())
        w = (n[:, None] * joint / total[:, None]).sum(0) / n.sum()
        if now - last < 1e-3:
            break
        last = now
    return w, base + now


def infer(data: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Proportions by language of one text, and the chosen languages, the largest share first."""
    cells = _cells(data)
    langs = len(logp)
    if not len(cells):
        cells = np.zeros(1, np.int64)
    counts = np.bincount(cells, minlength=CELLS)
    at = np.flatnonzero(counts)
    n, model = counts[at] / EFFECTIVE, np.ascontiguousarray(logp[:, at].T)
    single = n @ model
    best = [int(single.argmax())]
    score = float(single[best[0]])
    shares = np.zeros(langs)
    shares[best[0]] = 1.0
    penalty = 0.5 * np.log(max(n.sum(), 2.0)) + 2.0
    # The upper bound of any mixture's likelihood takes the best language for each cell.
    while len(best) < langs and float(n @ model.max(1)) - score > penalty:
        w_all, _ = _mixture(model, n, 4)
        rest = sorted((x for x in range(langs) if x not in best), key=lambda x: -w_all[x])[:2]
        tries = []
        for x in rest:
            w, like = _mixture(model[:, [*best, x]], n)
            tries.append((like, x, w))
        like, x, w = max(tries, key=lambda t: t[0])
        if like - score <= penalty or w[-1] < 0.02:
            break
        best, score = [*best, x], like
        shares[:] = 0
        shares[best] = w
    best.sort(key=lambda x: -shares[x])
    if len(best) == 1:  # the posterior among single languages says how sure the choice is
        p = np.exp(single - single.max())
        shares = p / p.sum()
    return shares, best


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: list[str], lang_col: str = "lang_pred") -> DataFrame:
    """``keep`` columns with the largest language, its share as ``score``, all chosen ``langs`` and their ``shares``.

    The model has one row of fixed length for each language; it goes to the tasks with the function.
    """
    schema = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def score(batches):
        for batch in batches:
            column = batch.column("text")
            out: list[tuple] = []
            for first, data, offsets in K.blocks(column):
                for i in range(len(offsets) - 1):
                    text = data[offsets[i] : offsets[i + 1]]
                    if not langs or not (_LETTER[text].any() or (len(text) and text.max() >= 128 and any(c.isalpha() for c in column[first + i].as_py()))):
                        out.append(("und", 0.0, [], []))
                        continue
                    shares, best = infer(text, logp)
                    out.append((langs[best[0]], float(min(1.0, max(0.0, shares[best[0]]))), [langs[x] for x in best], [float(shares[x]) for x in best]))
            cols = [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())))] if out else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*K.take(batch, 0, batch.num_rows, keep), *cols], [*keep, lang_col, "score", "langs", "shares"])

    return docs.select(*keep, "text").mapInArrow(score, f"{fields}, {lang_col} string, score double, langs array<string>, shares array<double>")
