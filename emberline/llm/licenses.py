"""License scan with ordered signature rules, in DataFrame functions only.

A text that holds none of a few short keywords is passed by with one regex
test. Of the others the words are joined by single spaces, each rule whose own
keyword is there is matched with all its places, and overlapping detections are
resolved: one that lies within another of higher priority, or within a longer
one of the same priority, is dropped. The base phrases are always kept. Long
texts are scanned in windows that overlap by more than the longest match, so the
cost follows the length whatever the number of detections.

Defined results: null and empty texts have no words and no detection; rows are
neither merged nor dropped, also if they repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.license_rules import gate, rules

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GATE = gate(_GAP)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(joined: Column) -> Column:
    """All matches of all rules whose keyword is there: label, priority, first and last character."""
    table = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("regex"), F.array(*[F.lit(k) for k in c.split("|")]).alias("keywords"), F.lit(d).alias("priority")) for a, b, c, d in rules()])

    def places(rule: Column) -> Column:
        before = F.transform(F.split(joined, rule["regex"], -1), F.length)
        sizes = F.transform(F.regexp_extract_all(joined, rule["regex"], F.lit(0)), F.length)
        # Sums of what stands before a match and of the matches so far give its place.
        sums = F.aggregate(
            F.arrays_zip(before.alias("b"), sizes.alias("s")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,priority:int,first:int,last:int>>").alias("out")),
            lambda acc, x: F.when(x["s"].isNull(), acc).otherwise(F.struct((acc["at"] + x["b"] + x["s"]).alias("at"), F.array_append(acc["out"], F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), (acc["at"] + x["b"]).alias("first"), (acc["at"] + x["b"] + x["s"] - 1).alias("last"))).alias("out"))),
        )
        return sums["out"]

    return F.flatten(F.transform(F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(joined, k)) & F.regexp(joined, r["regex"])), places))


def _beaten(x: Column, by: Column) -> Column:
    """x lies within ``by``, which has a higher priority, or the same and is longer, or comes first by label."""
    inside = (by["first"] <= x["first"]) & (by["last"] >= x["last"])
    longer = by["last"] - by["first"] > x["last"] - x["first"]
    same = (by["first"] == x["first"]) & (by["last"] == x["last"])
    return inside & ((by["priority"] > x["priority"]) | ((by["priority"] == x["priority"]) & (longer | (same & (by["label"] < x["label"])))))


#: Characters of a window and of its overlap on each side; no rule matches that many.
WINDOW, OVERLAP = 20_000, 1_000
_KIND = "array<struct<label:string,priority:int,first:int,last:int>>"


def _resolved(joined: Column) -> Column:
    """Detections of the whole text that no other beats, each from the window in which it begins."""

    def window(start: Column) -> Column:
        base = F.greatest(start - OVERLAP, F.lit(0))
        return F.struct(start.alias("start"), base.alias("base"), _detections(F.substr(joined, base + 1, F.lit(WINDOW + 2 * OVERLAP))).alias("found"))

    def kept(w: Column) -> Column:
        own = F.filter(w["found"], lambda x: (x["first"] + w["base"] >= w["start"]) & (x["first"] + w["base"] < w["start"] + WINDOW) & ~F.exists(w["found"], lambda y: _beaten(x, y)))
        return F.transform(own, lambda x: F.struct(x["label"].alias("label"), x["priority"].alias("priority"), (x["first"] + w["base"]).alias("first"), (x["last"] + w["base"]).alias("last")))

    # What is found in a window is a variable of the second step, so it is made once.
    starts = F.sequence(F.lit(0), F.greatest(F.length(joined) - 1, F.lit(0)), F.lit(WINDOW))
    return F.flatten(F.transform(F.transform(starts, window), kept))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, the base phrases' places and labels, all labels, detections and a score (0 to 1)."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    joined = F.when(lower.rlike(_GATE), F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _GAP, " ")), F.lit(" ")))
    out = docs.select(*keep, F.regexp_count(lower, F.lit(_WORD)).cast("long").alias("n_words"), joined.alias("_joined"))
    j = F.col("_joined")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        here = F.contains(j, F.lit(f" {phrase} "))
        pieces = F.split(j, f"(?<= ){phrase}(?= )", -1)
        inner = phrase.count(" ")
        counts.append(F.coalesce(F.when(here, F.size(pieces) - 1), F.lit(0)))
        firsts.append(F.when(here, _blanks(F.get(pieces, F.lit(0))) - 1))
        lasts.append(F.when(here, _blanks(j) - _blanks(F.element_at(pieces, -1)) - inner - 1))
        labels.append(F.when(here, F.lit(label)))
    found = F.when(j.isNotNull(), _resolved(j))
    out = out.select(
        *keep,
        "n_words",
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("_base"),
        F.coalesce(found, F.array().cast(_KIND)).alias("detections"),
    )
    return out.select(
        *keep,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda x: x["label"])))), ",").alias("labels"),
        F.greatest(F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.aggregate("detections", F.lit(0.0), lambda a, x: F.greatest(a, F.least(F.lit(1.0), x["priority"] / F.lit(60.0))))).alias("score"),
        F.size("detections").alias("n_detections"),
        "detections",
    )
