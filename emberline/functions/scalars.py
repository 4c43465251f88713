"""Column functions of the alert and topology domain; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions import constants as C


def lookup(column: Column, table: dict, other) -> Column:
    """The table's value for the column's, ``other`` where there is none."""
    out = F.lit(other)
    for key, value in reversed(table.items()):
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def alert_bucket(alert_type: Column) -> Column:
    """The first bucket of which a substring is in the folded alert type."""
    folded = F.regexp_replace(F.lower(alert_type), "[- ]", "_")
    out = F.lit("other")
    for bucket, parts in reversed(C.ALERT_BUCKETS.items()):
        out = F.when(folded.rlike("|".join(parts)), F.lit(bucket)).otherwise(out)
    return out


def temporal_score(span: Column) -> Column:
    return F.when(span <= 15, 1.0).when(span <= 30, 0.85).when(span <= 60, 0.65).otherwise(0.40)


def hop_score(hops: Column) -> Column:
    return F.when(hops == 1, 1.0).when(hops == 2, 0.85).when(hops == 3, 0.65).when(hops == 4, 0.45).otherwise(0.0)


def _in_order(items: Column, wanted: tuple[str, ...]) -> Column:
    """Whether ``wanted`` is a subsequence of an array: each item is looked for after the first place of the one before."""
    at = F.array_position(items, wanted[0])
    if len(wanted) == 1:
        return at > 0
    rest = F.slice(items, at.cast("int") + 1, F.size(items))
    return F.when(at > 0, _in_order(rest, wanted[1:])).when(at == 0, False)


def pattern_matches(buckets: Column) -> Column:
    """How many propagation sequences are subsequences of an array of buckets, in one pass over it for each sequence."""
    return reduce(lambda a, b: a + b, [_in_order(buckets, p).cast("int") for p in C.PROPAGATION])


def sequence_score(matches: Column) -> Column:
    return F.when(matches == 0, 0.20).otherwise(F.least(F.lit(1.0), 0.55 + 0.15 * matches))


def weighted(dims: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of dimensions, held between 0 and 1."""
    total = reduce(lambda a, b: a + b, [F.lit(w) * dims[k] for k, w in weights.items()])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def unit_hash(text: Column) -> Column:
    """The first 32 bits of an MD5 as a share of their range."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def present(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def point_to_box(x: Column, y: Column, box: dict[str, Column]) -> Column:
    """Distance of a point to a box, 0 inside."""
    dx = F.greatest(box["x1"] - x, F.lit(0.0), x - box["x2"])
    dy = F.greatest(box["y1"] - y, F.lit(0.0), y - box["y2"])
    return F.sqrt(dx * dx + dy * dy)


def windows(text: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Character windows of a text; a window that adds nothing to the one before is left out."""
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda x: (x == 0) | (x + overlap < n))
    return F.when(n > 0, F.transform(starts, lambda x: F.substr(text, x + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sections(markdown: Column) -> Column:
    """Parts of a markdown body that start at second-level headings."""
    return F.split(markdown, r"(?m)^##\s+")


def clean_label(text: Column) -> Column:
    """A recognised label: upper case, plain characters, 32 at most."""
    return F.substring(F.regexp_replace(F.upper(F.trim(text)), r"[^A-Z0-9\-_/.]", ""), 1, 32)


def devices(text: Column) -> Column:
    """Device-like tokens of a text."""
    return F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}(?:-[A-Z0-9]+){1,4}\b"), F.lit(0))


def addresses(text: Column) -> Column:
    """IPv4-like tokens of a text."""
    return F.regexp_extract_all(text, F.lit(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), F.lit(0))


def half_even(column: Column, digits: int = 4) -> Column:
    return F.round(column, digits)
