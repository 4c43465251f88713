"""Queries over geometry, records, graph merges and assembled results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import constants as C
from emberline.functions.scalars import lookup
from emberline.operators import assembly as R
from emberline.operators import graph as G
from emberline.operators.graph import cut
from emberline.plans.correlation import ORACLE_SQL as _CORRELATION
from emberline.plans.correlation import correlation_roles
from emberline.sources import adapters as A
from emberline.sources.adapters import with_sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _words(df, column: str, values: list[str]):
    """The value that a number picks."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def _pick(column: str, values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({column} % {len(values)} + 1 AS INTEGER))"


# Geometry: a line of an order is a segment or a box of an image, its supplier.
_SEG = "seg AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_suppkey AS image, CAST(l_partkey % 800 AS INTEGER) AS x1, CAST(l_suppkey % 600 AS INTEGER) AS y1, CAST(l_orderkey % 800 AS INTEGER) AS x2, CAST((l_linenumber * 97 + l_partkey) % 600 AS INTEGER) AS y2 FROM lineitem)"


def _segments(spark, d):
    c = F.col
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_suppkey").alias("image"), (c("l_partkey") % 800).cast("int").alias("x1"), (c("l_suppkey") % 600).cast("int").alias("y1"), (c("l_orderkey") % 800).cast("int").alias("x2"), ((c("l_linenumber") * 97 + c("l_partkey")) % 600).cast("int").alias("y2"))


_LEN = "sqrt((x2 - x1)::DOUBLE * (x2 - x1) + (y2 - y1)::DOUBLE * (y2 - y1))"


@query("segment_geometry", f"WITH {_SEG}, g AS (SELECT *, {_LEN} AS len, (degrees(atan2((y2 - y1)::DOUBLE, (x2 - x1)::DOUBLE)) + 180) % 180 AS ang FROM seg), k AS (SELECT *, 0.3::DOUBLE + 0.55::DOUBLE * least(len / 1000, 1) AS base FROM g WHERE len >= 40) SELECT l_orderkey, l_linenumber, round(len, 1) AS length, round(ang, 1) AS angle, round(CASE WHEN ang % 90 < 8 OR ang % 90 > 82 THEN least(base + 0.05, 0.92) ELSE base END, 3) AS confidence, CAST(row_number() OVER (PARTITION BY image ORDER BY round(len, 1) DESC, l_orderkey, l_linenumber, x1, y1, x2, y2) AS INTEGER) AS place FROM k")
def segment_geometry(spark, d):
    g = R.segment(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 1000.0)
    longest = Window.partitionBy("image").orderBy(F.desc("length"), "l_orderkey", "l_linenumber", "x1", "y1", "x2", "y2")
    out = _segments(spark, d).where(g["length"] >= 40).select("image", "x1", "y1", "x2", "y2", "l_orderkey", "l_linenumber", F.round(g["length"], 1).alias("length"), F.round(g["angle"], 1).alias("angle"), F.round(g["confidence"], 3).alias("confidence"))
    return out.withColumn("place", F.row_number().over(longest)).drop("image", "x1", "y1", "x2", "y2")


@query("clamped_boxes", "WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS wh, (l_partkey % 900 - 50)::DOUBLE AS a, (l_suppkey % 700 - 50)::DOUBLE AS b, (l_orderkey % 500)::DOUBLE AS c, (l_orderkey % 700)::DOUBLE AS d FROM lineitem), k AS (SELECT *, CASE WHEN wh THEN a + c ELSE c END AS c2, CASE WHEN wh THEN b + d ELSE d END AS d2 FROM b), h AS (SELECT *, greatest(0, least(799, trunc(least(a, c2))))::INTEGER AS x1, greatest(0, least(599, trunc(least(b, d2))))::INTEGER AS y1, greatest(0, least(799, trunc(greatest(a, c2))))::INTEGER AS x2, greatest(0, least(599, trunc(greatest(b, d2))))::INTEGER AS y2 FROM k) SELECT l_orderkey, l_linenumber, CASE WHEN x2 - x1 >= 2 AND y2 - y1 >= 2 THEN x1 || ',' || y1 || ',' || x2 || ',' || y2 END AS box FROM h")
def clamped_boxes(spark, d):
    c = F.col
    box = F.array(*[x.cast("double") for x in (c("l_partkey") % 900 - 50, c("l_suppkey") % 700 - 50, c("l_orderkey") % 500, c("l_orderkey") % 700)])
    kind = F.when(c("l_linenumber") % 2 == 0, "XYWH").otherwise("xyxy")
    held = R.clamped(box, kind, 800, 600)
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(held.isNotNull(), F.array_join(held.cast("array<string>"), ",")).alias("box"))


_BOXES = "bx AS (SELECT s_suppkey AS image, i, (s_suppkey * 37 + i * 190) % 760 AS x1, (s_suppkey * 53 + i * 140) % 560 AS y1 FROM supplier, range(4) t(i))"


def _boxes(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image"), F.posexplode(F.sequence(F.lit(0), F.lit(3))).alias("_p", "i"))
    s = s.select("image", "i", ((F.col("image") * 37 + F.col("i") * 190) % 760).alias("x1"), ((F.col("image") * 53 + F.col("i") * 140) % 560).alias("y1"))
    return s.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("id"), "x1", "y1", (F.col("x1") + 60).alias("x2"), (F.col("y1") + 40).alias("y2")))).alias("boxes"))


@query("segments_near_boxes", f"WITH {_SEG}, {_BOXES} SELECT l_orderkey, l_linenumber FROM seg WHERE 0.3 + 0.55 * least({_LEN} / 1000, 1) >= 0.35 AND EXISTS (SELECT 1 FROM bx WHERE bx.image = seg.image AND ((seg.x1 BETWEEN bx.x1 - 15 AND bx.x1 + 75 AND seg.y1 BETWEEN bx.y1 - 15 AND bx.y1 + 55) OR (seg.x2 BETWEEN bx.x1 - 15 AND bx.x1 + 75 AND seg.y2 BETWEEN bx.y1 - 15 AND bx.y1 + 55)))")
def segments_near_boxes(spark, d):
    s = _segments(spark, d).join(_boxes(spark, d), "image")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    sure = 0.3 + 0.55 * F.least(length / 1000, F.lit(1.0)) >= 0.35
    return s.where(sure & (R.near_box(F.col("x1"), F.col("y1"), F.col("boxes")) | R.near_box(F.col("x2"), F.col("y2"), F.col("boxes")))).select("l_orderkey", "l_linenumber")


@query("nearest_centre", f"WITH {_SEG}, {_BOXES}, p AS (SELECT rid, l_orderkey, l_linenumber, i, sqrt((bx.x1 + 30 - seg.x1)::DOUBLE ** 2 + (bx.y1 + 20 - seg.y1)::DOUBLE ** 2) AS dist FROM seg JOIN bx USING (image)), m AS (SELECT rid, l_orderkey, l_linenumber, min(dist) AS dist, min_by(i, (dist, i)) AS i FROM p GROUP BY ALL) SELECT l_orderkey, l_linenumber, CASE WHEN dist < 60 THEN i::INTEGER END AS box FROM m")
def nearest_centre(spark, d):
    s = _segments(spark, d).join(_boxes(spark, d), "image")
    return s.select("l_orderkey", "l_linenumber", R.nearest_centre(F.col("x1"), F.col("y1"), F.col("boxes")).alias("box"))


_DETECTORS = ["Verified Annotation V3", "Live RF-DETR", "LIVE_RFDETR_INFERENCE", "RF-DETR v3", "Trained model", "manual entry"]


@query("evidence_sources", f"WITH s AS (SELECT o_orderkey, {_pick('o_orderkey', _DETECTORS)} AS det, CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 1000) / 1000.0::DOUBLE END AS conf FROM orders) SELECT o_orderkey, CASE WHEN det LIKE '%Verified Annotation%' THEN 'verified_metadata' WHEN det LIKE '%Live RF-DETR%' OR det = 'LIVE_RFDETR_INFERENCE' THEN 'live_detector' WHEN det LIKE '%RF-DETR%' OR det LIKE '%Trained%' THEN 'trained_detector' ELSE 'inferred' END AS evidence_source, CASE WHEN det LIKE '%Verified Annotation%' OR conf IS NULL THEN '' ELSE CAST(round(conf, 3) AS VARCHAR) END AS confidence FROM s")
def evidence_sources(spark, d):
    o = A.table(spark, d, "orders")
    det, conf = _words(o, "o_orderkey", _DETECTORS), F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 1000) / F.lit(1000.0))
    return o.select("o_orderkey", R.evidence_source(det).alias("evidence_source"), R.confidence_text(conf, det).alias("confidence"))


@query("device_rows", with_sql("nodes alerts", ", u AS (SELECT 0 AS o, node_id, kind AS device_type, diagram_id AS zone, '[' || (length(node_id) * 10) || ', ' || (length(kind) * 10) || ']' AS bbox, 'verified_metadata' AS evidence_source FROM nodes WHERE node_id NOT LIKE '%7' UNION ALL SELECT 1, node, 'unknown', min(diagram_id), '', 'live_detector' FROM alerts GROUP BY node) SELECT node_id, device_type, zone, bbox, CASE WHEN bbox = '' THEN '' ELSE CAST(length(node_id) * 10 AS VARCHAR) END AS x1, evidence_source FROM u QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY o) = 1"))
def device_rows(spark, d):
    n = A.nodes(spark, d).where("node_id not like '%7'")
    box = F.array(F.length("node_id") * 10, F.length("kind") * 10)
    known = n.select("node_id", F.col("kind").alias("device_type"), F.col("diagram_id").alias("zone"), box.cast("string").alias("bbox"), F.element_at(box, 1).cast("string").alias("x1"), F.lit("verified_metadata").alias("evidence_source"))
    seen = A.alerts(spark, d).groupBy(F.col("node").alias("node_id")).agg(F.min("diagram_id").alias("zone"))
    seen = seen.select("node_id", F.lit("unknown").alias("device_type"), "zone", F.lit("").alias("bbox"), F.lit("").alias("x1"), F.lit("live_detector").alias("evidence_source"))
    return R.first_wins([known, seen], ["node_id"], "zone")


@query("edges_with_both_ends", with_sql("nodes edges", ", e AS (SELECT source, CASE WHEN ordinal % 5 = 0 THEN 'X-' || target ELSE target END AS target FROM edges) SELECT source, target FROM e WHERE source IN (SELECT node_id FROM nodes) AND target IN (SELECT node_id FROM nodes)"))
def edges_with_both_ends(spark, d):
    e = A.edges(spark, d).select("source", F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("X-"), "target")).otherwise(F.col("target")).alias("target"))
    return R.with_both_ends(e, A.nodes(spark, d)).select("source", "target")


_KINDS = ["connected_to", "routes_to", "", "cross_diagram_link"]


@query("typed_edges", with_sql("edges cross_edges", f", p AS (SELECT source, target, {_pick('ordinal', _KINDS)} AS k, 0 AS tab, ordinal AS o FROM edges UNION ALL SELECT source, target, 'cross_diagram', 1, n_lines FROM cross_edges) SELECT source, target, CASE WHEN tab = 1 OR k LIKE '%cross_diagram%' THEN 'cross_diagram' WHEN k IN ('connected_to', 'routes_to') THEN k ELSE 'local' END AS edge_type FROM p WHERE source <> '' AND target <> '' AND source <> target QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY tab, o) = 1"))
def typed_edges(spark, d):
    kind = _words(None, "ordinal", _KINDS)
    own = A.edges(spark, d).select("source", "target", F.when(F.contains(kind, F.lit("cross_diagram")), "cross_diagram").when(kind.isin("connected_to", "routes_to"), kind).otherwise("local").alias("edge_type"), F.col("ordinal").alias("o"))
    cross = A.cross_edges(spark, d).select("source", "target", F.lit("cross_diagram").alias("edge_type"), F.col("n_lines").alias("o"))
    proper = "source <> '' and target <> '' and source <> target"
    return R.first_wins([own.where(proper), cross.where(proper)], ["source", "target"], "o").drop("o")


@query("merged_context", with_sql("nodes alerts", ", s AS (SELECT DISTINCT node AS node_id FROM alerts UNION SELECT 'L-' || user_id FROM events WHERE user_id < 50) SELECT node_id, 'global' AS origin FROM nodes WHERE diagram_id <> 'D4' UNION ALL SELECT node_id, 'scenario' FROM s WHERE node_id NOT IN (SELECT node_id FROM nodes WHERE diagram_id <> 'D4')"))
def merged_context(spark, d):
    known = A.nodes(spark, d).where("diagram_id <> 'D4'").select("node_id", F.lit("global").alias("origin"))
    more = A.alerts(spark, d).select(F.col("node").alias("node_id")).union(A.table(spark, d, "events").where("user_id < 50").select(F.concat(F.lit("L-"), F.col("user_id").cast("string")))).distinct()
    return known.unionByName(more.join(known, "node_id", "left_anti").withColumn("origin", F.lit("scenario")))


_LOCAL = "WITH v AS (SELECT 'P-' || (l_partkey % 300) AS node_id, 'D' || (l_suppkey % 5) AS diagram_id FROM lineitem GROUP BY ALL), x AS (SELECT 'P-' || (p_partkey % 300) AS source, 'P-' || ((p_partkey + p_size) % 320) AS target FROM part WHERE p_size % 9 = 0)"


def _local_graphs(spark, d):
    v = A.table(spark, d, "lineitem").select(F.concat(F.lit("P-"), (F.col("l_partkey") % 300).cast("string")).alias("node_id"), F.concat(F.lit("D"), (F.col("l_suppkey") % 5).cast("string")).alias("diagram_id")).distinct()
    x = A.table(spark, d, "part").where("p_size % 9 = 0").select(F.concat(F.lit("P-"), (F.col("p_partkey") % 300).cast("string")).alias("source"), F.concat(F.lit("P-"), ((F.col("p_partkey") + F.col("p_size")) % 320).cast("string")).alias("target"))
    return v, x


@query("enterprise_union_flags", _LOCAL + ", h AS (SELECT node_id FROM v GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT source AS node_id FROM x UNION SELECT target FROM x) SELECT node_id, diagram_id, node_id IN (SELECT node_id FROM h) AS shared, node_id IN (SELECT node_id FROM b) AS bridge FROM v QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY diagram_id) = 1")
def enterprise_union_flags(spark, d):
    v, x = _local_graphs(spark, d)
    shared = v.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("node_id", F.lit(True).alias("shared"))
    bridge = x.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("bridge", F.lit(True))
    first = R.first_wins([v], ["node_id"], "diagram_id")
    return first.join(shared, "node_id", "left").join(bridge, "node_id", "left").na.fill(False, ["shared", "bridge"])


@query("prefixed_union", _LOCAL + " SELECT diagram_id || '__' || node_id AS global_id, node_id, diagram_id FROM v")
def prefixed_union(spark, d):
    v, _ = _local_graphs(spark, d)
    return v.select(F.concat("diagram_id", F.lit("__"), "node_id").alias("global_id"), "node_id", "diagram_id")


@query("unmatched_ids", with_sql("alerts nodes", ", a AS (SELECT node AS id FROM alerts UNION SELECT 'A-' || user_id FROM events WHERE event_id % 3 = 0 UNION SELECT c_mktsegment FROM customer) SELECT id FROM a WHERE id <> '' AND id NOT IN (SELECT node_id FROM nodes) AND id NOT IN (SELECT 'A-' || s_suppkey FROM supplier)"))
def unmatched_ids(spark, d):
    e = A.table(spark, d, "events").where("event_id % 3 = 0").select(F.concat(F.lit("A-"), F.col("user_id").cast("string")).alias("id"))
    every = A.alerts(spark, d).select(F.col("node").alias("id")).union(e).union(A.table(spark, d, "customer").select("c_mktsegment")).where("id <> ''").distinct()
    known = A.nodes(spark, d).select(F.col("node_id").alias("id")).union(A.table(spark, d, "supplier").select(F.concat(F.lit("A-"), F.col("s_suppkey").cast("string"))))
    return every.join(known, "id", "left_anti")


_VOCABULARY = list(C.NODE_PRIORITY)
_RAW = "CASE length(node_id) % 3 WHEN 0 THEN upper(kind) WHEN 1 THEN 'Core-' || kind || '-x' ELSE 'printer' END"


@query("normalised_types", with_sql("nodes", f", r AS (SELECT node_id, lower({_RAW}) AS raw FROM nodes) SELECT node_id, CASE " + "WHEN raw IN (" + ", ".join(f"'{k}'" for k in _VOCABULARY) + ") THEN raw " + " ".join(f"WHEN contains(raw, '{k}') THEN '{k}'" for k in _VOCABULARY) + " ELSE 'unknown' END AS kind FROM r"))
def normalised_types(spark, d):
    raw = F.when(F.length("node_id") % 3 == 0, F.upper("kind")).when(F.length("node_id") % 3 == 1, F.concat(F.lit("Core-"), "kind", F.lit("-x"))).otherwise("printer")
    return A.nodes(spark, d).select("node_id", R.type_key(raw, _VOCABULARY).alias("kind"))


@query("time_labels", with_sql("alerts", "SELECT ordinal, printf('T+%02dm', t) AS label FROM alerts"))
def time_labels(spark, d):
    return A.alerts(spark, d).select("ordinal", F.format_string("T+%02dm", "t").alias("label"))


@query("scalar_metadata", "SELECT doc_id, coalesce(CAST(nullif(source, 'src1') AS VARCHAR), '') AS source, '[\"' || lang || '\",\"' || source || '\"]' AS tags FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def scalar_metadata(spark, d):
    docs = A.table(spark, d, "documents").where("lang is not null and source is not null")
    return docs.select("doc_id", R.scalar(F.nullif("source", F.lit("src1")), False).alias("source"), R.scalar(F.array("lang", "source"), True).alias("tags"))


_FIRST_TYPES = ", f AS (SELECT case_id, diagram_id, alert_type, min(ordinal) AS o FROM alerts GROUP BY ALL), ty AS (SELECT case_id, diagram_id, list(alert_type ORDER BY o) AS types FROM f GROUP BY ALL), sv AS (SELECT case_id, diagram_id, list(DISTINCT severity) AS s FROM alerts GROUP BY ALL), sw AS (SELECT case_id, diagram_id, list_filter(['critical', 'high', 'medium', 'low', 'info'], lambda x: list_contains(s, x)) AS severities FROM sv)"


@query("kb_query_text", with_sql("alerts", _FIRST_TYPES + " SELECT case_id, diagram_id, concat_ws('; ', CASE WHEN diagram_id <> 'D0' THEN 'root cause node: ' || diagram_id || '-root' END, 'topology diagram: ' || diagram_id, 'alert types: ' || array_to_string(types[1:3], ', '), 'severity: ' || array_to_string(severities[1:2], ', ')) AS query FROM ty JOIN sw USING (case_id, diagram_id)"))
def kb_query_text(spark, d):
    al = A.alerts(spark, d)
    first = al.groupBy("case_id", "diagram_id", "alert_type").agg(F.min("ordinal").alias("o"))
    types = first.groupBy("case_id", "diagram_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "alert_type"))), lambda x: x["alert_type"]).alias("types"))
    levels = al.groupBy("case_id", "diagram_id").agg(F.collect_set("severity").alias("s"))
    order = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")])
    severities = F.filter(order, lambda x: F.array_contains("s", x))
    root = F.when(F.col("diagram_id") != "D0", F.concat(F.lit("root cause node: "), "diagram_id", F.lit("-root")))
    text = R.query_text([root, F.concat(F.lit("topology diagram: "), "diagram_id"), R.listed("alert types: ", F.col("types"), 3), R.listed("severity: ", severities, 2)])
    return types.join(levels, ["case_id", "diagram_id"]).select("case_id", "diagram_id", text.alias("query"))


_ANSWERS = ["<think>a { b</think>```json\n{\"k\": 1,}\n```", "sure: {\"a\": [1, 2,], \"b\": {\"c\": 3}} done", "no object here", "```\n{\"x\": \"y\"}\n```"]


@query("answer_json", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"k\": 1}' WHEN 1 THEN '{\"a\": [1, 2], \"b\": {\"c\": 3}}' WHEN 3 THEN '{\"x\": \"y\"}' END AS answer FROM events")
def answer_json(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", R.answer_json(_words(e, "event_id", _ANSWERS)).alias("answer"))


@query("run_ids", "SELECT event_id, substr(sha1('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}'), 1, 12) AS run_id FROM events")
def run_ids(spark, d):
    return A.table(spark, d, "events").select("event_id", R.run_id("user_id", "event_type", "event_id").alias("run_id"))


@query("repo_paths", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/data/p/' || page_id ELSE '/repo/lib/x/' || page_id END AS path FROM pages")
def repo_paths(spark, d):
    p = A.table(spark, d, "pages")
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data\\p\\"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("lib\\x\\"), F.col("page_id").cast("string")))
    return p.select("page_id", R.repo_path(raw, "/repo/").alias("path"))


@query("class_report", "WITH r AS (SELECT l_returnflag AS a, CASE WHEN l_linenumber % 4 = 0 THEN 'N' WHEN l_partkey % 11 = 0 THEN 'Z' ELSE l_returnflag END AS p FROM lineitem), l AS (SELECT a AS label FROM r UNION SELECT p FROM r), n AS (SELECT label, (SELECT count(*) FROM r WHERE a = label) AS support, (SELECT count(*) FROM r WHERE p = label) AS np, (SELECT count(*) FROM r WHERE a = label AND p = label) AS hit FROM l), k AS (SELECT label, support, CASE WHEN np = 0 THEN 0 ELSE hit / np END::DOUBLE AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END::DOUBLE AS re FROM n) SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, support FROM k")
def class_report(spark, d):
    p = F.when(F.col("l_linenumber") % 4 == 0, "N").when(F.col("l_partkey") % 11 == 0, "Z").otherwise(F.col("l_returnflag"))
    r = R.class_report(A.table(spark, d, "lineitem").select("l_returnflag", p.alias("p")), "l_returnflag", "p")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("reward_report", "WITH r AS (SELECT (o_orderkey % 100) / 100.0::DOUBLE AS c, (o_custkey % 100) / 100.0::DOUBLE AS j FROM orders) SELECT count(*) AS records, round(avg(c), 4) AS average_chosen, round(avg(j), 4) AS average_rejected, count(*) FILTER (WHERE c > j) AS positive_margins FROM r")
def reward_report(spark, d):
    c, j = (F.col("o_orderkey") % 100) / F.lit(100.0), (F.col("o_custkey") % 100) / F.lit(100.0)
    return A.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg(c), 4).alias("average_chosen"), F.round(F.avg(j), 4).alias("average_rejected"), F.count_if(c > j).alias("positive_margins"))


_BOOKS = ["NET-RTR-001", "SEC-FW-001", "APP-LB-001", "ENT-XDIAG-001", ""]
_PREFIX = ["NET", "SEC", "APP"]


@query("runbook_chain", f"WITH e AS (SELECT doc_id % 40 AS incident, doc_id, {_pick('doc_id // 40', _BOOKS)} AS rb, source FROM documents), g AS (SELECT incident, rb, min(doc_id) AS o, string_agg('RB-' || doc_id, ',' ORDER BY doc_id) AS evidence_ids, string_agg(source, ',' ORDER BY doc_id) FILTER (WHERE source <> '') AS sections FROM e WHERE rb <> '' GROUP BY ALL), k AS (SELECT *, CASE WHEN rb = 'ENT-XDIAG-001' THEN 2 WHEN starts_with(rb, {_pick('incident', _PREFIX)}) THEN 0 ELSE 1 END AS tier FROM g WHERE rb <> 'ENT-XDIAG-001' OR incident % 4 >= 2) SELECT incident, rb AS runbook_id, CAST(row_number() OVER (PARTITION BY incident ORDER BY tier, o) AS INTEGER) AS place, evidence_ids, coalesce(sections, '') AS sections FROM k")
def runbook_chain(spark, d):
    docs = A.table(spark, d, "documents").select((F.col("doc_id") % 40).alias("incident"), "doc_id", F.floor(F.col("doc_id") / 40).alias("_k"), "source")
    e = docs.withColumn("rb", _words(docs, "_k", _BOOKS)).where("rb <> ''")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "source")))
    g = e.groupBy("incident", "rb").agg(F.min("doc_id").alias("o"), parts.alias("parts"))
    cross = F.col("rb") == "ENT-XDIAG-001"
    tier = F.when(cross, 2).when(F.startswith(F.col("rb"), _words(g, "incident", _PREFIX)), 0).otherwise(1)
    w = Window.partitionBy("incident").orderBy(tier, "o")
    kept = g.where(~cross | (F.col("incident") % 4 >= 2))
    ids = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("RB-"), p["doc_id"].cast("string"))), ",")
    sections = F.array_join(F.transform(F.filter("parts", lambda p: p["source"] != ""), lambda p: p["source"]), ",")
    return kept.select("incident", F.col("rb").alias("runbook_id"), F.row_number().over(w).alias("place"), ids.alias("evidence_ids"), sections.alias("sections"))


@query("first_seen_groups", with_sql("alerts nodes", ", j AS (SELECT a.*, kind FROM alerts a JOIN nodes ON node = node_id), c AS (SELECT case_id, diagram_id, kind, count(*) AS n FROM j GROUP BY ALL), m AS (SELECT case_id, diagram_id, kind FROM c QUALIFY row_number() OVER (PARTITION BY case_id, diagram_id ORDER BY n DESC, kind) = 1), g AS (SELECT case_id, diagram_id, min(ordinal) AS first, count(*) AS n_alerts FROM j GROUP BY ALL) SELECT case_id, diagram_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY first) AS INTEGER) AS place, n_alerts, upper(kind[1]) || substr(kind, 2) || ' Incident' AS title FROM g JOIN m USING (case_id, diagram_id)"))
def first_seen_groups(spark, d):
    j = A.alerts(spark, d).join(A.nodes(spark, d).select(F.col("node_id").alias("node"), "kind"), "node")
    c = j.groupBy("case_id", "diagram_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    g = c.groupBy("case_id", "diagram_id").agg(F.min("first").alias("first"), F.sum("n").alias("n_alerts"), F.max_by(F.struct("kind"), F.struct("n", F.transform(F.split("kind", ""), lambda x: -F.ascii(x)))).alias("k"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind")))[0]["kind"].alias("kind"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("first"))
    return g.select("case_id", "diagram_id", place.alias("place"), "n_alerts", F.concat(F.upper(F.substring("kind", 1, 1)), F.substring("kind", 2, 100), F.lit(" Incident")).alias("title"))


@query("enterprise_title", with_sql("alerts", "SELECT case_id, CASE WHEN bool_or(severity = 'critical') THEN 'Critical' ELSE 'High' END AS severity, 'Cross-diagram enterprise incident — ' || count(DISTINCT diagram_id) || ' diagram' || CASE WHEN count(DISTINCT diagram_id) <> 1 THEN 's' ELSE '' END || ' affected' AS title FROM alerts GROUP BY ALL"))
def enterprise_title(spark, d):
    n = F.count_distinct("diagram_id")
    return A.alerts(spark, d).groupBy("case_id").agg(F.when(F.bool_or(F.col("severity") == "critical"), "Critical").otherwise("High").alias("severity"), F.concat(F.lit("Cross-diagram enterprise incident — "), n.cast("string"), F.lit(" diagram"), F.when(n != 1, "s").otherwise(""), F.lit(" affected")).alias("title"))


@query("scenario_order", with_sql("alerts", ", s AS (SELECT case_id, min(ordinal) AS o, bool_or(severity = 'critical') AS flagged FROM alerts GROUP BY ALL) SELECT case_id, flagged FROM s ORDER BY flagged DESC, o LIMIT 5"))
def scenario_order(spark, d):
    s = A.alerts(spark, d).groupBy("case_id").agg(F.min("ordinal").alias("o"), F.bool_or(F.col("severity") == "critical").alias("flagged"))
    return s.orderBy(F.desc("flagged"), "o").limit(5).drop("o")


@query("scenario_pack", with_sql("alerts", ", s AS (SELECT case_id, min(ordinal) AS o FROM alerts GROUP BY ALL), p AS (SELECT * FROM (VALUES ('2024-01-04', 0), ('2099-01-01', 1)) v(case_id, k)), a AS (SELECT case_id, 0 AS tier, k AS o FROM p WHERE case_id IN (SELECT case_id FROM s)), f AS (SELECT case_id, 1, o FROM s WHERE case_id NOT IN (SELECT case_id FROM p) AND (SELECT count(*) FROM a) < 2) SELECT case_id, CAST(tier AS INTEGER) AS tier FROM (SELECT * FROM a UNION ALL SELECT * FROM f) ORDER BY tier, o LIMIT 5"))
def scenario_pack(spark, d):
    """A fixed pack of cases, filled up with others if fewer than two of it are there."""
    s = A.alerts(spark, d).groupBy("case_id").agg(F.min("ordinal").alias("o"))
    pack = spark.createDataFrame([("2024-01-04", 0), ("2099-01-01", 1)], "case_id string, k long")
    own = s.join(F.broadcast(pack), "case_id").select("case_id", F.lit(0).alias("tier"), F.col("k").alias("o"))
    few = own.agg((F.count(F.lit(1)) < 2).alias("few"))
    fill = s.join(F.broadcast(pack), "case_id", "left_anti").crossJoin(F.broadcast(few)).where("few").select("case_id", F.lit(1).alias("tier"), "o")
    return own.unionByName(fill).orderBy("tier", "o").limit(5).drop("o")


_RANKS = f", s AS (SELECT case_id, node, sum({'CASE severity ' + ' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in C.SEVERITY_SCORE.items()) + ' ELSE 0 END'})::DOUBLE AS a, count(*)::DOUBLE AS b, min(ordinal) AS o FROM alerts GROUP BY ALL)"


def _scores(spark, d):
    return A.alerts(spark, d).groupBy("case_id", "node").agg(F.sum(lookup(F.col("severity"), C.SEVERITY_SCORE, 0.0)).alias("a"), F.count(F.lit(1)).cast("double").alias("b"), F.min("ordinal").alias("o"))


@query("model_comparison", with_sql("alerts", _RANKS + ", h AS (SELECT case_id, list(node ORDER BY round(a, 6) DESC, o) AS n, list(round(a, 6) ORDER BY round(a, 6) DESC, o) AS v FROM s GROUP BY ALL), g AS (SELECT case_id, list(node ORDER BY b DESC, o) AS n, list(b ORDER BY b DESC, o) AS v FROM s GROUP BY ALL), t AS (SELECT case_id, min_by(node, ordinal) AS truth FROM alerts GROUP BY ALL) SELECT case_id, h.n[1] AS heuristic, g.n[1] AS model, h.n[1] = truth AS heuristic_right, g.n[1] = truth AS model_right, round(g.v[1] - g.v[2], 6) AS margin, CASE WHEN g.v[2] IS NULL THEN 'MEDIUM' WHEN g.v[1] - g.v[2] >= 5 THEN 'HIGH' WHEN g.v[1] - g.v[2] >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, g.n[1] = truth AND h.n[1] <> truth AS improved FROM h JOIN g USING (case_id) JOIN t USING (case_id)"))
def model_comparison(spark, d):
    s = _scores(spark, d)

    def top(column: str, name: str):
        w = Window.partitionBy("case_id").orderBy(F.desc(column), "o")
        ranked = s.withColumn(column, F.round(column, 6)).withColumn("r", F.row_number().over(w)).where("r <= 2")
        return ranked.groupBy("case_id").agg(F.max(F.when(F.col("r") == 1, F.col("node"))).alias(name), F.max(F.when(F.col("r") == 1, F.col(column))).alias(f"{name}_1"), F.max(F.when(F.col("r") == 2, F.col(column))).alias(f"{name}_2"))

    truth = A.alerts(spark, d).groupBy("case_id").agg(F.min_by("node", "ordinal").alias("truth"))
    j = top("a", "heuristic").join(top("b", "model"), "case_id").join(truth, "case_id")
    h, m = F.col("heuristic") == F.col("truth"), F.col("model") == F.col("truth")
    margin = F.col("model_1") - F.col("model_2")
    label = F.when(margin.isNull(), "MEDIUM").when(margin >= 5, "HIGH").when(margin >= 2, "MEDIUM").otherwise("LOW")
    return j.select("case_id", "heuristic", "model", h.alias("heuristic_right"), m.alias("model_right"), F.round(margin, 6).alias("margin"), label.alias("confidence"), (m & ~h).alias("improved"))


@query("eligible_rules", with_sql("alerts", ", p AS (SELECT case_id, list(DISTINCT diagram_id) AS present FROM alerts WHERE ordinal % 3 = 0 GROUP BY ALL), r AS (SELECT * FROM (VALUES ('wan', ['D0', 'D1']), ('core', ['D2']), ('none', ['D9'])) v(rule, required)) SELECT case_id, rule FROM p, r WHERE len(list_filter(required, lambda x: NOT list_contains(present, x))) = 0 AND case_id IN (SELECT case_id FROM alerts WHERE severity = 'critical')"))
def eligible_rules(spark, d):
    """Rules (three rows) whose diagrams a case has all of, if it has a candidate."""
    al = A.alerts(spark, d)
    present = al.where("ordinal % 3 = 0").groupBy("case_id").agg(F.collect_set("diagram_id").alias("present"))
    rules = spark.createDataFrame([("wan", ["D0", "D1"]), ("core", ["D2"]), ("none", ["D9"])], "rule string, required array<string>")
    fit = present.join(F.broadcast(rules), F.size(F.array_except("required", "present")) == 0)
    return fit.join(al.where("severity = 'critical'").select("case_id"), "case_id", "left_semi").select("case_id", "rule")


@query("slim_tables", with_sql("nodes edges", "SELECT 'node' AS part, node_id AS id, CASE WHEN diagram_id <> 'D0' THEN 0.96 ELSE 0.88 END::DOUBLE AS confidence, CASE WHEN diagram_id <> 'D0' THEN 'V3 annotation' ELSE 'V3 local graph' END AS source FROM nodes UNION ALL SELECT 'edge', source || '>' || target, CASE WHEN ordinal % 2 = 0 THEN 0.91 ELSE 0.78 END::DOUBLE, 'connected_to' FROM edges"))
def slim_tables(spark, d):
    boxed = F.col("diagram_id") != "D0"
    n = A.nodes(spark, d).select(F.lit("node").alias("part"), F.col("node_id").alias("id"), F.when(boxed, 0.96).otherwise(0.88).alias("confidence"), F.when(boxed, "V3 annotation").otherwise("V3 local graph").alias("source"))
    e = A.edges(spark, d).select(F.lit("edge").alias("part"), F.concat("source", F.lit(">"), "target").alias("id"), F.when(F.col("ordinal") % 2 == 0, 0.91).otherwise(0.78).alias("confidence"), F.lit("connected_to").alias("source"))
    return n.unionByName(e)


_ROLES = ("cluster_seed", "propagation_signal", "peer_signal", "noise_candidate")


@query("public_events", "SELECT ordinal AS event_id, node, alert_type, severity, t AS time_offset_min, diagram_id, role AS correlation_role FROM (" + _CORRELATION["correlation_roles"] + ") r JOIN (WITH " + A.SQL["alerts"] + " SELECT * FROM alerts) a USING (ordinal)")
def public_events(spark, d):
    r = correlation_roles(spark, d).select("ordinal", R.public_event(F.col("role"), list(_ROLES)).alias("correlation_role"))
    a = A.alerts(spark, d).select("ordinal", "node", "alert_type", "severity", F.col("t").alias("time_offset_min"), F.col("diagram_id").alias("d"))
    return a.join(r, "ordinal").select(F.col("ordinal").alias("event_id"), "node", "alert_type", "severity", "time_offset_min", F.col("d").alias("diagram_id"), "correlation_role")


_PLANS = ["restart the node", "check cables", "Isolate segment", "review logs", "call vendor"]


@query("approval_risk", f"WITH p AS (SELECT o_orderkey, {_pick('o_orderkey', _PLANS)} AS plan, o_custkey % 4 AS n, (o_orderkey % 97) / 100.0::DOUBLE AS c FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 2) OR n >= 3 OR c >= 0.85 THEN 'high' WHEN n >= 2 OR c >= 0.6 THEN 'medium' ELSE 'low' END AS risk FROM p")
def approval_risk(spark, d):
    o = A.table(spark, d, "orders")
    return o.select("o_orderkey", R.approval_risk(_words(o, "o_orderkey", _PLANS), F.col("o_custkey") % 4, (F.col("o_orderkey") % 97) / F.lit(100.0)).alias("risk"))


@query("plan_quality", "SELECT o_orderkey, CAST(least(100, CASE WHEN o_orderkey % 2 = 0 THEN 40 ELSE 15 END + least(o_custkey % 5 * 10, 30) + least(o_custkey % 9 * 4, 20) + CASE WHEN o_custkey % 2 = 0 THEN 10 ELSE 0 END) AS BIGINT) AS points FROM orders")
def plan_quality(spark, d):
    even = lambda c: F.col(c) % 2 == 0
    return A.table(spark, d, "orders").select("o_orderkey", R.plan_quality(even("o_orderkey"), F.col("o_custkey") % 5, F.col("o_custkey") % 9, even("o_custkey")).cast("long").alias("points"))


_NAMES = ["edge-FW-1", "core_rtr", "lb-3", "main-db", "dns1", "app-7", "printer", "S-3"]


@query("root_kinds", with_sql("nodes", f", u AS (SELECT kind FROM nodes GROUP BY ALL ORDER BY count(*) DESC, kind LIMIT 1), r AS (SELECT o_orderkey, {_pick('o_orderkey', _NAMES)} AS root FROM orders) SELECT o_orderkey, coalesce(kind, CASE o_orderkey % 8 WHEN 0 THEN 'firewall' WHEN 1 THEN 'router' WHEN 2 THEN 'load_balancer' WHEN 3 THEN 'database' WHEN 4 THEN 'dns' WHEN 5 THEN 'server' END, (SELECT kind FROM u)) AS kind FROM r LEFT JOIN nodes ON node_id = root"))
def root_kinds(spark, d):
    o = A.table(spark, d, "orders")
    o = o.select("o_orderkey", _words(o, "o_orderkey", _NAMES).alias("root"))
    n = A.nodes(spark, d)
    usual = n.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(1).select(F.col("kind").alias("usual"))
    j = o.join(F.broadcast(n.select(F.col("node_id").alias("root"), "kind").where(F.col("root").isin(_NAMES))), "root", "left").crossJoin(F.broadcast(usual))
    return j.select("o_orderkey", R.root_kind(F.col("kind"), F.col("root"), F.col("usual")).alias("kind"))


@query("normalised_results", with_sql("alerts", ", r AS (SELECT case_id, node, min(ordinal) AS o, count(*) AS n, min_by(diagram_id, ordinal) AS d FROM alerts GROUP BY ALL), g AS (SELECT case_id, list(node ORDER BY n DESC, o) AS nodes, list(n::DOUBLE ORDER BY n DESC, o) AS scores, list(d ORDER BY n DESC, o) AS ds FROM r GROUP BY ALL), k AS (SELECT *, length(case_id) + CAST(right(case_id, 1) AS INTEGER) AS z FROM g) SELECT case_id, nodes[1] AS root_cause, CASE WHEN z % 2 = 0 THEN 0.5 ELSE scores[1] END::DOUBLE AS confidence, CASE WHEN z % 3 = 0 THEN 'D7' ELSE array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(ds[1:10], lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ',') END AS impacted FROM k"))
def normalised_results(spark, d):
    r = A.alerts(spark, d).groupBy("case_id", "node").agg(F.min("ordinal").alias("o"), F.count(F.lit(1)).alias("n"), F.min_by("diagram_id", "ordinal").alias("d"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o", "node", "d")))
    g = r.groupBy("case_id").agg(best.alias("c")).withColumn("z", F.length("case_id") + F.substring("case_id", -1, 1).cast("int"))
    top = F.col("c")[0]["node"]
    x = R.normalised_result(F.when(F.col("z") % 2 == 0, top), top, F.when(F.col("z") % 2 == 0, 0.5), F.transform("c", lambda v: (-v["m"]).cast("double")), F.when(F.col("z") % 3 == 0, F.array(F.lit("D7"))), F.transform("c", lambda v: v["d"]))
    return g.select("case_id", x["root_cause"].alias("root_cause"), x["confidence"].alias("confidence"), F.array_join(x["impacted"], ",").alias("impacted"))


@query("candidate_results", with_sql("alerts nodes", _RANKS + ", k AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(a, 6) DESC, o) AS INTEGER) AS rank FROM s), f AS (SELECT case_id, node, diagram_id, min(t * 1000000000::BIGINT + ordinal) AS x FROM alerts GROUP BY ALL), ob AS (SELECT case_id, node, string_agg(diagram_id, ',' ORDER BY x) AS observed FROM f GROUP BY ALL) SELECT case_id, rank, node, kind, round(a, 4) AS score, observed, 'alert_count=' || CAST(b AS BIGINT) AS evidence FROM k JOIN ob USING (case_id, node) LEFT JOIN nodes ON node_id = node WHERE rank <= 3"))
def candidate_results(spark, d):
    w = Window.partitionBy("case_id").orderBy(F.desc(F.round("a", 6)), "o")
    top = _scores(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    first = A.alerts(spark, d).groupBy("case_id", "node", "diagram_id").agg(F.min(F.struct("t", "ordinal")).alias("x"))
    seen = first.groupBy("case_id", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "diagram_id"))), lambda v: v["diagram_id"]), ",").alias("observed"))
    j = top.join(seen, ["case_id", "node"]).join(A.nodes(spark, d).select(F.col("node_id").alias("node"), "kind"), "node", "left")
    return j.select("case_id", "rank", "node", "kind", F.round("a", 4).alias("score"), "observed", F.concat(F.lit("alert_count="), F.col("b").cast("long").cast("string")).alias("evidence"))


@query("evidence_bullets", with_sql("alerts", _RANKS + ", c AS (SELECT case_id, list(node ORDER BY round(a, 6) DESC, o) AS n FROM s GROUP BY ALL), g AS (SELECT case_id, count(*) AS n_alerts, list_sort(list(DISTINCT diagram_id)) AS ds FROM alerts GROUP BY ALL) SELECT case_id, n_alerts || ' alert event(s) in simulated timeline | ' || len(ds) || ' diagram(s) impacted: ' || array_to_string(ds[1:5], ', ') || ' | Top candidates: ' || array_to_string(n[1:3], ', ') AS bullets FROM c JOIN g USING (case_id)"))
def evidence_bullets(spark, d):
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.round("a", 6)).alias("m"), "o", "node"))), lambda v: v["node"])
    c = _scores(spark, d).groupBy("case_id").agg(best.alias("n"))
    g = A.alerts(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.array_sort(F.collect_set("diagram_id")).alias("ds"))
    parts = [F.concat(F.col("n_alerts").cast("string"), F.lit(" alert event(s) in simulated timeline")), F.when(F.size("ds") > 0, F.concat(F.size("ds").cast("string"), F.lit(" diagram(s) impacted: "), F.array_join(F.slice("ds", 1, 5), ", "))), R.listed("Top candidates: ", F.col("n"), 3)]
    return c.join(g, "case_id").select("case_id", F.concat_ws(" | ", *parts).alias("bullets"))


@query("scenario_corpus", "WITH u AS (SELECT 0 AS dir, doc_id % 500 AS scenario, doc_id, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id % 500, doc_id, text FROM documents WHERE doc_id % 3 = 0) SELECT scenario, doc_id, length(text) AS n_chars FROM u WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY dir, doc_id) = 1")
def scenario_corpus(spark, d):
    docs = A.table(spark, d, "documents").where("text is not null").select((F.col("doc_id") % 500).alias("scenario"), "doc_id", F.length("text").cast("long").alias("n_chars"))
    return R.first_wins([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0")], ["scenario"], "doc_id")


@query("expanded_records", with_sql("nodes", "SELECT node_id || '-v' || v AS id, v::INTEGER AS variant, ('0x' || substr(md5(node_id || '-v' || v), 1, 8))::BIGINT % 10 < 8 AS train FROM nodes, range(3) r(v)"))
def expanded_records(spark, d):
    v = A.nodes(spark, d).select("node_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"))
    name = F.concat("node_id", F.lit("-v"), F.col("variant").cast("string"))
    return v.select(name.alias("id"), "variant", (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 10 < 8).alias("train"))


@query("detection_rows", "WITH r AS (SELECT l_orderkey AS image, l_linenumber, (l_partkey % 100) / 100.0::DOUBLE AS score, l_suppkey % 8 AS label FROM lineitem), k AS (SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY l_linenumber, score, label) - 1 AS INTEGER) AS place, score, label FROM r) SELECT image, place, CASE WHEN image % 2 = 0 THEN label ELSE 0 END AS class_id, CASE WHEN image % 3 = 0 THEN 1.0 ELSE round(score, 4) END::DOUBLE AS confidence FROM k WHERE image % 3 = 0 OR score >= 0.35")
def detection_rows(spark, d):
    """Detections of results that may lack scores (1) or classes (0), over a confidence."""
    r = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", ((F.col("l_partkey") % 100) / F.lit(100.0)).alias("score"), (F.col("l_suppkey") % 8).alias("label")))).alias("boxes"))
    scores = F.when(F.col("image") % 3 != 0, F.transform("boxes", lambda b: b["score"]))
    labels = F.when(F.col("image") % 2 == 0, F.transform("boxes", lambda b: b["label"]))
    rows = r.select("image", scores.alias("scores"), labels.alias("labels"), F.posexplode("boxes").alias("place", "b"))
    score, label = F.coalesce(F.get("scores", F.col("place")), F.lit(1.0)), F.coalesce(F.get("labels", F.col("place")), F.lit(0))
    return rows.where(score >= 0.35).select("image", "place", label.cast("long").alias("class_id"), F.round(score, 4).alias("confidence"))


_NEAR = f", sc AS (SELECT case_id, node, round(sum({'CASE severity ' + ' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in C.SEVERITY_SCORE.items()) + ' ELSE 0 END'}), 6) AS a, min(ordinal) AS o FROM alerts GROUP BY ALL), rk AS (SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY a DESC, o) AS r FROM sc), al AS (SELECT a.case_id, a.ordinal, a.node, a.t, a.diagram_id, a.severity, kind, CASE WHEN r <= 5 THEN round(1 - (r - 1) * 0.18::DOUBLE, 2) ELSE 0 END::DOUBLE AS near, greatest(1, (SELECT max(z.t) FROM alerts z WHERE z.case_id = a.case_id)) AS t_max FROM alerts a JOIN rk USING (case_id, node) JOIN nodes ON node_id = node)"
_LEVEL = "CASE {0}.severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.1 END::DOUBLE"
_PLACE = "(CASE {0}.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(R.KIND_INDEX)) + " ELSE 14 END / 14.0::DOUBLE)"
_NEXT = " OR ".join(f"({{0}}.kind = '{p}' AND {{1}}.kind = '{q}') OR ({{0}}.kind = '{q}' AND {{1}}.kind = '{p}')" for p, q in R.ADJACENT)


def _base_sql(a: str, b: str) -> str:
    return f"(0.22::DOUBLE + 0.2::DOUBLE * CAST({a}.diagram_id = {b}.diagram_id AS INTEGER) + 0.15::DOUBLE * greatest(0, 1 - 2 * abs({_LEVEL.format(a)} - {_LEVEL.format(b)})) + 0.1::DOUBLE * ({a}.near + {b}.near) / 2 + 0.08::DOUBLE * CASE WHEN {a}.kind = {b}.kind THEN 1 WHEN {_NEXT.format(a, b)} THEN 0.75 ELSE greatest(0, 1 - 2 * abs({_PLACE.format(a)} - {_PLACE.format(b)})) END)"


def _nearness(spark, d):
    """Nearness to the case's likely roots of each node of a case."""
    s = _scores(spark, d).withColumn("a", F.round("a", 6))
    r = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("a"), "o"))
    return s.select("case_id", "node", F.when(r <= 5, F.round(1 - (r - 1) * 0.18, 2)).otherwise(0.0).alias("near"))


def ops_alerts(spark, d):
    """Alerts with their node's kind, its nearness to the case's likely roots and the case's longest time."""
    al = A.alerts(spark, d).join(_nearness(spark, d), ["case_id", "node"]).join(A.nodes(spark, d).select(F.col("node_id").alias("node"), "kind"), "node")
    top = A.alerts(spark, d).groupBy("case_id").agg(F.greatest(F.max("t"), F.lit(1)).alias("t_max"))
    return al.join(top, "case_id").select("case_id", "ordinal", "node", "t", "diagram_id", "severity", "kind", "near", "t_max")


def whole_alerts(spark, d):
    """As ``ops_alerts``, with the alerts of unknown nodes (of kind unknown) and those without a node or a time (at 0)."""
    al = A.alerts(spark, d).withColumn("t", F.coalesce("t", F.lit(0)))
    near = _nearness(spark, d).select(F.col("case_id").alias("_c"), F.col("node").alias("_n"), "near")
    kinds = A.nodes(spark, d).groupBy(F.col("node_id").alias("_k")).agg(F.min("kind").alias("kind"))
    top = al.groupBy(F.col("case_id").alias("_t")).agg(F.greatest(F.max("t"), F.lit(1)).alias("t_max"))
    out = al.join(near, F.col("case_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")), "left").join(kinds, F.col("node") == F.col("_k"), "left").join(top, F.col("case_id").eqNullSafe(F.col("_t")))
    return out.select("case_id", "ordinal", "node", "t", "diagram_id", "severity", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("near", F.lit(0.0)).alias("near"), "t_max")


_CLUSTERED = _NEAR + f", cl AS (SELECT case_id, diagram_id, kind, severity, near, min(ordinal) AS o, list(DISTINCT t) AS ts, any_value(t_max) AS t_max, row_number() OVER () AS c FROM al GROUP BY ALL), mo AS (SELECT c, case_id, unnest(ts) AS t FROM cl), gp AS (SELECT a.c AS ca, b.c AS cb, min(abs(a.t - b.t)) AS gap FROM mo a JOIN mo b ON a.case_id = b.case_id AND a.c < b.c GROUP BY ALL), e AS (SELECT ca, cb FROM gp JOIN cl a ON a.c = ca JOIN cl b ON b.c = cb WHERE round({_base_sql('a', 'b')} + 0.25::DOUBLE * greatest(0, 1 - 3 * gap::DOUBLE / a.t_max), 4) >= 0.62), u AS (SELECT ca, cb FROM e UNION SELECT cb, ca FROM e), k AS (SELECT c AS x, c AS y FROM cl UNION SELECT k.x, u.cb FROM k JOIN u ON u.ca = k.y), rt AS (SELECT k.x AS c, min(cl.o) AS root FROM k JOIN cl ON cl.c = k.y GROUP BY ALL), mem AS (SELECT al.*, rt.root FROM al JOIN cl USING (case_id, diagram_id, kind, severity, near) JOIN rt USING (c))"


@query("alert_clusters", with_sql("alerts nodes", _CLUSTERED + " SELECT ordinal, root FROM mem", True))
def alert_clusters(spark, d):
    return R.correlate(ops_alerts(spark, d), "case_id").select("ordinal", "root")


_SEVRANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("ops_correlation", with_sql("alerts nodes", _CLUSTERED + f", pr AS (SELECT a.root, avg({_base_sql('a', 'b')} + 0.25::DOUBLE * greatest(0, 1 - 3 * abs(a.t - b.t)::DOUBLE / a.t_max)) AS score FROM mem a JOIN mem b ON a.root = b.root AND a.ordinal < b.ordinal GROUP BY ALL), su AS (SELECT case_id, root, count(*) AS n_alerts, max_by(severity, {_SEVRANK}) AS severity, array_to_string(list(node ORDER BY near DESC, {_SEVRANK} DESC, ordinal)[1:3], ',') AS signals FROM mem GROUP BY ALL) SELECT case_id, root, n_alerts, severity, signals, round(coalesce(score, 0.75), 4) AS correlation_score FROM su LEFT JOIN pr USING (root)", True))
def ops_correlation(spark, d):
    """Clusters of a case's alerts: worst severity, mean similarity, and the nodes nearest to the root."""
    m = cut(R.correlate(ops_alerts(spark, d), "case_id"))
    rank = lookup(F.col("severity"), C.SEVERITY_RANK, 0)
    w = Window.partitionBy("root").orderBy(F.desc("near"), F.desc(rank), "ordinal")
    signals = m.withColumn("_p", F.row_number().over(w)).where("_p <= 3").groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "node"))), lambda x: x["node"]), ",").alias("signals"))
    facts = m.groupBy("case_id", "root").agg(F.count(F.lit(1)).alias("n_alerts"), F.max_by("severity", rank).alias("severity"))
    score = R.mean_similarity(m, "root").select("root", F.round("score", 4).alias("correlation_score"))
    return facts.join(signals, "root").join(score, "root").select("case_id", "root", "n_alerts", "severity", "signals", "correlation_score")


@query("best_peer", with_sql("alerts nodes", _NEAR + f", p AS (SELECT a.ordinal, b.ordinal AS peer, round({_base_sql('a', 'b')} + 0.25::DOUBLE * greatest(0, 1 - 3 * abs(a.t - b.t)::DOUBLE / a.t_max), 4) AS similarity FROM al a JOIN al b ON a.case_id = b.case_id AND a.node = b.node AND a.ordinal <> b.ordinal) SELECT ordinal, peer, similarity FROM p QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY similarity DESC, peer) = 1"))
def best_peer(spark, d):
    """For each alert the most similar other one of its node."""
    al = cut(ops_alerts(spark, d))
    a, b = al.alias("a"), al.alias("b")
    both = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.node") == F.col("b.node")) & (F.col("a.ordinal") != F.col("b.ordinal")))
    s = both.select(F.col("a.ordinal").alias("ordinal"), F.col("b.ordinal").alias("peer"), F.round(R.timed_similarity("a", "b"), 4).alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("m"), "peer"))
    return s.groupBy("ordinal").agg(best.alias("x")).select("ordinal", F.col("x.peer").alias("peer"), (-F.col("x.m")).alias("similarity"))


@query("path_methods", with_sql("nodes edges", ", d AS (SELECT DISTINCT source, target FROM edges WHERE source <> target), v AS (SELECT source, target FROM d UNION SELECT target, source FROM d), tg AS (SELECT node_id AS target FROM nodes WHERE node_id LIKE 'N-%'), f AS (SELECT 'N-3' AS node, 0 AS depth UNION SELECT d.target, depth + 1 FROM f JOIN d ON d.source = f.node), b AS (SELECT 'N-3' AS node, 0 AS depth UNION SELECT d.source, depth + 1 FROM b JOIN d ON d.target = b.node), w AS (SELECT 'N-3' AS node, 0 AS depth UNION SELECT v.target, depth + 1 FROM w JOIN v ON v.source = w.node WHERE depth < 6), a AS (SELECT node AS target, 1 AS m, min(depth) AS depth FROM f GROUP BY ALL UNION ALL SELECT node, 2, min(depth) FROM b GROUP BY ALL UNION ALL SELECT node, 3, min(depth) FROM w GROUP BY ALL), k AS (SELECT target, CASE m WHEN 1 THEN 'directed_root_to_target' WHEN 2 THEN 'directed_target_to_root' ELSE 'undirected' END AS method, CAST(depth + 1 AS INTEGER) AS path_length FROM a JOIN tg USING (target) WHERE target <> 'N-3' QUALIFY row_number() OVER (PARTITION BY target ORDER BY m) = 1) SELECT * FROM k ORDER BY target LIMIT 10", True))
def path_methods(spark, d):
    """How a root is joined to up to ten targets: along the edges, against them, or either way."""
    e = G.directed(A.edges(spark, d))
    root = spark.createDataFrame([("N-3",)], "root string")
    ways = {"directed_root_to_target": e, "directed_target_to_root": e.select(F.col("target").alias("source"), F.col("source").alias("target")), "undirected": G.undirected(e)}
    targets = A.nodes(spark, d).where("node_id like 'N-%'").select(F.col("node_id").alias("target"))
    found = [G.reach(edges, root).select(F.col("node").alias("target"), F.lit(name).alias("method"), (F.col("depth") + 1).alias("path_length")).join(targets, "target") for name, edges in ways.items()]
    return R.first_wins(found, ["target"], "path_length").orderBy("target").limit(10).select("target", "method", "path_length")


@query("pair_similarity", with_sql("alerts nodes", _NEAR + f" SELECT a.ordinal AS a, b.ordinal AS b, round({_base_sql('a', 'b')} + 0.25::DOUBLE * greatest(0, 1 - 3 * abs(a.t - b.t)::DOUBLE / a.t_max), 4) AS similarity FROM al a JOIN al b ON a.case_id = b.case_id AND a.node = b.node AND a.ordinal < b.ordinal"))
def pair_similarity(spark, d):
    """Similarities of all alerts of one node and case; alert_clusters has the links of all alerts of a case."""
    al = cut(ops_alerts(spark, d))
    a, b = al.alias("a"), al.alias("b")
    both = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.node") == F.col("b.node")) & (F.col("a.ordinal") < F.col("b.ordinal")))
    return both.select(F.col("a.ordinal").alias("a"), F.col("b.ordinal").alias("b"), F.round(R.timed_similarity("a", "b"), 4).alias("similarity"))
