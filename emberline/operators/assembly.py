"""Geometry, records and result assembly as column functions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import constants as C
from emberline.functions.scalars import lookup, present


def type_key(raw: Column, keys: list[str]) -> Column:
    """A vocabulary's key: the lower-cased type itself, else the first key that it contains, else unknown."""
    low = F.lower(raw)
    inside = F.lit("unknown")
    for k in reversed(keys):
        inside = F.when(F.contains(low, F.lit(k)), k).otherwise(inside)
    return F.when(low.isin(keys), low).otherwise(inside)


def segment(x1: Column, y1: Column, x2: Column, y2: Column, diagonal: float) -> dict[str, Column]:
    """Length, angle (0 to 180) and confidence of a line segment; long ones and those near an axis are surer."""
    length = F.hypot(x2 - x1, y2 - y1)
    angle = F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))
    share = F.least(length / F.lit(diagonal), F.lit(1.0))
    base = 0.30 + 0.55 * share
    off_axis = F.pmod(angle, F.lit(90.0))
    sure = F.when((off_axis < 8) | (off_axis > 82), F.least(base + 0.05, F.lit(0.92))).otherwise(base)
    return {"length": length, "angle": angle, "confidence": sure}


def clamped(box: Column, kind: Column, width: int, height: int) -> Column:
    """A box of four numbers (corners, or corner and size if ``kind`` is xywh) as sorted corners within the image; null if under two pixels."""
    a, b, c, d = (F.get(box, F.lit(i)) for i in range(4))
    x2, y2 = F.when(F.lower(kind) == "xywh", a + c).otherwise(c), F.when(F.lower(kind) == "xywh", b + d).otherwise(d)
    held = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), v.cast("int")))
    x, y = (held(F.least(a, x2), width), held(F.greatest(a, x2), width)), (held(F.least(b, y2), height), held(F.greatest(b, y2), height))
    return F.when((x[1] - x[0] >= 2) & (y[1] - y[0] >= 2), F.array(x[0], y[0], x[1], y[1]))


def near_box(x: Column, y: Column, boxes: Column, margin: int = 15) -> Column:
    """Whether a point is within ``margin`` of one of an array of boxes (x1, y1, x2, y2)."""
    return F.exists(boxes, lambda b: x.between(b["x1"] - margin, b["x2"] + margin) & y.between(b["y1"] - margin, b["y2"] + margin))


def nearest_centre(x: Column, y: Column, boxes: Column, under: float = 60.0) -> Column:
    """The id of the box (id, x1, y1, x2, y2) whose centre is nearest, strictly nearer than ``under``; the first of equals."""
    far = F.transform(boxes, lambda b, i: F.struct(F.hypot((b["x1"] + b["x2"]) / 2 - x, (b["y1"] + b["y2"]) / 2 - y).alias("d"), i.alias("i"), b["id"].alias("id")))
    best = F.array_min(far)
    return F.when(best["d"] < under, best["id"])


def evidence_source(detector: Column) -> Column:
    """Where a detection comes from."""
    has = lambda s: F.contains(detector, F.lit(s))
    return F.when(has("Verified Annotation"), "verified_metadata").when(has("Live RF-DETR") | (detector == "LIVE_RFDETR_INFERENCE"), "live_detector").when(has("RF-DETR") | has("Trained"), "trained_detector").otherwise("inferred")


def confidence_text(value: Column, detector: Column) -> Column:
    """A confidence as text, empty for verified metadata and where there is none."""
    return F.when(F.contains(detector, F.lit("Verified Annotation")) | value.isNull(), "").otherwise(F.round(value, 3).cast("string"))


def first_wins(tables: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """All rows of the tables, of each key the first: by table, then by ``order``."""
    ranked = reduce(DataFrame.unionByName, [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
    w = Window.partitionBy(*keys).orderBy("_table", order)
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_table")


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are nodes."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
    return edges


def public_event(role: Column, roles: list[str]) -> Column:
    """The role, which must be one of ``roles``."""
    return F.when(role.isin(roles), role).otherwise(F.raise_error(F.concat(F.lit("unknown correlation role: "), F.coalesce(role, F.lit("null")))))


def class_report(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support of each label that stands in either column."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(actual).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col(actual) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    n = sides.groupBy("label").agg(F.sum("a").alias("support"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    share = lambda x: F.coalesce(F.col("hit") / F.nullif(F.col(x), F.lit(0)), F.lit(0.0))
    precision, recall = share("p"), share("support")
    return n.select("label", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), "support")


def scalar(value: Column, listed: bool) -> Column:
    """Metadata as a plain value: lists as JSON, nothing as empty text."""
    return F.coalesce(F.to_json(value) if listed else value.cast("string"), F.lit(""))


def query_text(parts: list[Column]) -> Column:
    """The non-empty parts of a search query, joined in their order."""
    return F.concat_ws("; ", *[F.nullif(p, F.lit("")) for p in parts])


def listed(prefix: str, values: Column, most: int) -> Column:
    """A part of a query: the first values after a prefix, or null without any."""
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(values, 1, most), ", ")))


def answer_json(text: Column) -> Column:
    """The outermost JSON object of a model's answer, without thoughts, fences and commas before a closing bracket."""
    plain = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    cut = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.nullif(F.regexp_replace(cut, r",\s*([}\]])", "$1"), F.lit(""))


def run_id(*columns: str) -> Column:
    """A content-addressed id: twelve digits of the hash of the columns as JSON, keys in order."""
    return F.substring(F.sha1(F.to_json(F.struct(*sorted(columns))).cast("binary")), 1, 12)


def repo_path(raw: Column, root: str) -> Column:
    """A path with forward slashes, under ``root`` unless it is absolute."""
    p = F.replace(raw, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def approval_risk(plan: Column, diagrams: Column, confidence: Column) -> Column:
    """Risk of a remediation plan: risky verbs, how many diagrams it touches, how sure the cause is."""
    risky = F.lower(plan).rlike("shutdown|restart|failover|disable|terminate|reboot|isolate")
    return F.when(risky | (diagrams >= 3) | (confidence >= 0.85), "high").when((diagrams >= 2) | (confidence >= 0.6), "medium").otherwise("low")


def plan_quality(live: Column, runbooks: Column, steps: Column, adapter: Column) -> Column:
    """Points of a remediation plan, 100 at most."""
    return F.least(F.lit(100), F.when(live, 40).otherwise(15) + F.least(runbooks * 10, F.lit(30)) + F.least(steps * 4, F.lit(20)) + F.when(adapter, 10).otherwise(0))


def root_kind(known: Column, root: Column, usual: Column) -> Column:
    """Kind of a root cause: the node's own, else by the name's parts, else the most usual."""
    low = F.lower(root)
    by_name = F.when(low.rlike("fw|firewall"), "firewall").when(low.rlike("rtr|router|wan"), "router").when(low.rlike("lb|load_balancer|load balancer"), "load_balancer").when(low.rlike("db|database"), "database").when(low.rlike("dns"), "dns").when(low.rlike("srv|server|app"), "server")
    return F.coalesce(F.nullif(known, F.lit("")), by_name, usual, F.lit(""))


def normalised_result(predicted: Column, root: Column, confidence: Column, scores: Column, impacted: Column, candidate_diagrams: Column) -> dict[str, Column]:
    """Root, confidence and impacted diagrams of a result of either schema."""
    own = F.coalesce(impacted, F.array().cast("array<string>"))
    return {
        "root_cause": F.coalesce(present(predicted, root), F.lit("")),
        "confidence": F.coalesce(confidence, F.get(scores, F.lit(0)), F.lit(0.0)),
        "impacted": F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.filter(F.slice(candidate_diagrams, 1, 10), lambda x: x.isNotNull() & (x != "")))),
    }


#: Classes (with their times) that are broadcast.
CLASSES = 10_000


def correlate(alerts: DataFrame, case: str, threshold: float = 0.62) -> DataFrame:
    """``alerts`` (case, ordinal, t, diagram_id, kind, severity, near) with ``root``: its cluster, named by the least ordinal.

    Alerts that differ in time only are at 0.62 or more to each other, so they
    are one class; two classes are linked if their nearest times are. The classes
    of a case are few (diagrams x kinds x severities x nearness), and their times
    are whole minutes, so a case costs no pairs of alerts.
    """
    from emberline.operators.graph import components, cut

    terms = ["diagram_id", "kind", "severity", "near"]
    top = alerts.groupBy(case).agg(F.greatest(F.max("t"), F.lit(1)).alias("t_max"))
    moments = cut(alerts.groupBy(case, *terms, "t").agg(F.min("ordinal").alias("o")).join(top, case).withColumn("cls", F.md5(F.concat_ws("|", F.col(case).cast("string"), *[F.col(c).cast("string") for c in terms]))))
    classes = cut(moments.groupBy(case, "cls", "t_max", *terms).agg(F.array_sort(F.collect_set("t")).alias("times")))
    a, b = classes.drop("times").alias("a"), classes.drop("times").alias("b")
    base = similarity_terms("a", "b")
    pairs = a.join(b, (F.col(f"a.{case}") == F.col(f"b.{case}")) & (F.col("a.cls") < F.col("b.cls"))).where(base + 0.25 >= threshold)
    pairs = pairs.select(F.col("a.cls").alias("source"), F.col("b.cls").alias("target"), "a.t_max", base.alias("base"))
    # Pairs are small and dear, so their tasks are counted, not sized by bytes.
    pairs = pairs.repartition(4 * alerts.sparkSession.sparkContext.defaultParallelism, "source", "target")
    small = classes.count() <= CLASSES
    for side, end in (("a", "source"), ("b", "target")):
        times = classes.select(F.col("cls").alias(end), F.struct("times").alias(side))
        pairs = pairs.join(F.broadcast(times) if small else times, end)
    # The least gap: none if they share a time, else between neighbours of the merged times that differ in side.
    merged = F.sort_array(F.concat(F.transform("a.times", lambda x: x.cast("long") * 2), F.transform("b.times", lambda x: x.cast("long") * 2 + 1)))
    near = F.zip_with(F.slice(merged, F.lit(1), F.size(merged) - 1), F.slice(merged, F.lit(2), F.size(merged) - 1), lambda x, y: F.when(x.bitwiseXOR(y).bitwiseAND(1) == 1, F.shiftright(y, 1) - F.shiftright(x, 1)))
    gap = F.when(F.arrays_overlap("a.times", "b.times"), F.lit(0).cast("long")).otherwise(F.array_min(near))
    timed = F.col("base") + 0.25 * F.greatest(F.lit(0.0), 1 - 3 * gap / F.col("t_max"))
    linked = F.when(F.col("base") >= threshold, True).otherwise(F.round(timed, 4) >= threshold)
    edges = pairs.where(linked).select("source", "target")
    labels = components(edges)
    named = moments.join(labels.select(F.col("node").alias("cls"), F.col("root").alias("_r")), "cls", "left").withColumn("_r", F.coalesce("_r", "cls"))
    roots = named.groupBy("_r").agg(F.min("o").alias("root"))
    member = named.join(roots, "_r").select(case, *terms, "t", "root")
    return alerts.join(member, [case, *terms, "t"])


#: Kinds in the order of their index, and those next to each other.
KIND_INDEX = ["firewall", "router", "switch", "server", "compute", "database", "load_balancer", "gateway", "storage", "wan", "cloud", "service", "dns", "network", "unknown"]
ADJACENT = [("firewall", "router"), ("router", "wan"), ("router", "switch"), ("switch", "server"), ("server", "load_balancer"), ("load_balancer", "database"), ("server", "storage"), ("gateway", "service")]


def kind_fit(a: Column, b: Column) -> Column:
    """1 for one kind, 0.75 for kinds next to each other, else by how far apart they are in the index."""
    place = {k: i / 14.0 for i, k in enumerate(KIND_INDEX)}
    next_to = reduce(lambda x, y: x | y, [((a == p) & (b == q)) | ((a == q) & (b == p)) for p, q in ADJACENT])
    return F.when(a == b, 1.0).when(next_to, 0.75).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.abs(lookup(a, place, 1.0) - lookup(b, place, 1.0))))


def similarity_terms(a: str, b: str, case: bool = True) -> Column:
    """Similarity of two alerts of one case without their times: diagram, severity, nearness to the root, kind."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    level = lambda f: lookup(f("severity"), C.SEVERITY_CORRELATION, 0.25)
    severity = F.greatest(F.lit(0.0), 1 - 2 * F.abs(level(x) - level(y)))
    domain = F.when(x("diagram_id") == y("diagram_id"), 1.0).otherwise(0.0)
    return (0.22 if case else 0.0) + 0.20 * domain + 0.15 * severity + 0.10 * (x("near") + y("near")) / 2 + 0.08 * kind_fit(x("kind"), y("kind"))


def timed_similarity(a: str, b: str) -> Column:
    """Similarity of two alerts of one case (t, t_max and what ``similarity_terms`` reads)."""
    return similarity_terms(a, b) + 0.25 * F.greatest(F.lit(0.0), 1 - 3 * F.abs(F.col(f"{a}.t") - F.col(f"{b}.t")) / F.col(f"{a}.t_max"))


def mean_similarity(members: DataFrame, key: str) -> DataFrame:
    """``key`` and the mean similarity over all pairs of its members (t, t_max, diagram_id, kind, severity, near); 0.75 for one alone.

    From counts: each term of the similarity is a sum over pairs of values, and
    closeness in time is a sum over a window of times. No pairs are made.
    """
    pairs = lambda n: n * (n - 1) / 2
    size = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("near"))
    diagrams = members.groupBy(key, "diagram_id").agg(F.count(F.lit(1)).alias("m")).groupBy(key).agg(F.sum(pairs(F.col("m"))).alias("diagrams"))

    def table(column: str, fit) -> DataFrame:
        n = members.groupBy(key, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("m"))
        a, b = n.alias("a"), n.alias("b")
        both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.v") <= F.col("b.v")))
        many = F.when(F.col("a.v") == F.col("b.v"), pairs(F.col("a.m"))).otherwise(F.col("a.m") * F.col("b.m"))
        return both.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum(many * fit(F.col("a.v"), F.col("b.v"))).alias(column))

    level = lambda c: lookup(c, C.SEVERITY_CORRELATION, 0.25)
    severities = table("severity", lambda a, b: F.greatest(F.lit(0.0), 1 - 2 * F.abs(level(a) - level(b))))
    kinds = table("kind", kind_fit)
    # Minutes are whole, so a case's distinct times are few; of pairs within a third of the longest time the gaps count.
    times = members.groupBy(key, "t", "t_max").agg(F.count(F.lit(1)).alias("m"))
    a, b = times.alias("a"), times.alias("b")
    near = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.t") <= F.col("b.t")) & (3 * (F.col("b.t") - F.col("a.t")) < F.col("a.t_max")))
    many = F.when(F.col("a.t") == F.col("b.t"), pairs(F.col("a.m"))).otherwise(F.col("a.m") * F.col("b.m"))
    closeness = near.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum(many * (1 - 3 * (F.col("b.t") - F.col("a.t")) / F.col("a.t_max"))).alias("close"))
    j = size.join(diagrams, key).join(severities, key).join(kinds, key).join(closeness, key)
    total = 0.22 * pairs(F.col("n")) + 0.20 * F.col("diagrams") + 0.15 * F.col("severity") + 0.08 * F.col("kind") + 0.25 * F.col("close") + 0.05 * (F.col("n") - 1) * F.col("near")
    return j.select(key, "n", F.when(F.col("n") > 1, total / F.when(F.col("n") > 1, pairs(F.col("n")))).otherwise(0.75).alias("score"))
