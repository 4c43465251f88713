"""Queries over incidents: stitching, enrichment, evidence, documents, geometry, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import scalars as S
from emberline.operators import events as E
from emberline.operators import graph as G
from emberline.operators import incidents as I
from emberline.plans.correlation import _WINDOWS
from emberline.plans.correlation import _MATCH
from emberline.operators.graph import cut
from emberline.plans.assembly import whole_alerts
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


_RULES = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in I.STITCH_RULES) + ") AS r(l, r, relationship)"


@query("stitch_rules", with_sql("alerts", f", p AS (SELECT DISTINCT case_id AS scenario, diagram_id FROM alerts WHERE severity = 'critical') SELECT a.scenario, r.l AS \"left\", r.r AS \"right\", relationship FROM {_RULES} JOIN p a ON a.diagram_id = r.l JOIN p b ON b.diagram_id = r.r AND a.scenario = b.scenario"))
def stitch_rules(spark, d):
    present = A.alerts(spark, d).where("severity = 'critical'").select(F.col("case_id").alias("scenario"), "diagram_id")
    return I.stitched(present, spark.createDataFrame(I.STITCH_RULES, "left string, right string, relationship string"))


@query("node_alias_resolution", with_sql("nodes", ", a AS (SELECT node_id, unnest(list_distinct(['net.' || node_id, lower('net.' || node_id), node_id, lower(node_id)])) AS name FROM nodes) SELECT name, min(node_id) AS node_id FROM a WHERE name LIKE 's-%' GROUP BY ALL"))
def node_alias_resolution(spark, d):
    n = A.nodes(spark, d).select(F.concat(F.lit("net."), "node_id").alias("node"), F.col("node_id").alias("o"))
    names = n.select(F.lower("o").alias("name")).where("name like 's-%'").distinct()
    return I.resolve(names, n, "name", "node", "o").select("name", F.regexp_replace("node", "^net.", "").alias("node_id"))


@query("node_diagram_precedence", with_sql("alerts nodes", ", c AS (SELECT node, diagram_id FROM alerts WHERE bucket = 'cpu' QUALIFY row_number() OVER (PARTITION BY node ORDER BY ordinal) = 1) SELECT node_id, coalesce(c.diagram_id, n.diagram_id) AS diagram_id FROM nodes n LEFT JOIN c ON node = node_id"))
def node_diagram_precedence(spark, d):
    c = A.alerts(spark, d).where("bucket = 'cpu'").groupBy(F.col("node").alias("node_id")).agg(F.min_by("diagram_id", "ordinal").alias("c"))
    return A.nodes(spark, d).join(c, "node_id", "left").select("node_id", F.coalesce("c", "diagram_id").alias("diagram_id"))


@query("node_diagrams_in_order", with_sql("alerts", ", f AS (SELECT node, diagram_id, min(t::BIGINT * 100000000 + ordinal) AS k FROM alerts WHERE case_id = '2024-01-03' GROUP BY ALL) SELECT node, string_agg(diagram_id, ',' ORDER BY k) AS diagrams FROM f GROUP BY ALL"))
def node_diagrams_in_order(spark, d):
    x = A.alerts(spark, d).where("case_id = '2024-01-03'").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("t", "ordinal", "diagram_id"))).alias("x"))
    return x.select("node", F.array_join(F.array_distinct(F.transform("x", lambda v: v["diagram_id"])), ",").alias("diagrams"))


@query("cluster_enrichment", with_sql("alerts", ", k AS (SELECT case_id, count(*) AS n FROM alerts WHERE severity = 'critical' GROUP BY ALL), b AS (SELECT DISTINCT case_id FROM alerts) SELECT case_id, coalesce(n, 0) AS n_critical FROM b LEFT JOIN k USING (case_id)"))
def cluster_enrichment(spark, d):
    a = A.alerts(spark, d)
    k = a.where("severity = 'critical'").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return a.select("case_id").distinct().join(k, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n_critical"))


@query("artifact_full_outer", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n) AS n, CASE WHEN a.k IS NULL THEN 'second' ELSE 'first' END AS origin FROM a FULL JOIN b ON a.k = b.k")
def artifact_full_outer(spark, d):
    o = A.table(spark, d, "orders")
    count = lambda s, name: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return count("F", "a").join(count("P", "b"), "k", "full").select("k", F.coalesce("a", "b").alias("n"), F.when(F.col("a").isNull(), "second").otherwise("first").alias("origin"))


@query("alert_enrichment", with_sql("alerts nodes edges", ", g AS (SELECT node, string_agg(o, ',' ORDER BY p, o) AS neighbors FROM (SELECT source AS node, target AS o, 0 AS p FROM edges UNION ALL SELECT target, source, 1 FROM edges) GROUP BY ALL) SELECT ordinal, kind, neighbors FROM alerts LEFT JOIN nodes ON node = node_id LEFT JOIN g USING (node) WHERE severity = 'critical'"))
def alert_enrichment(spark, d):
    e = A.edges(spark, d)
    ends = e.select(F.col("source").alias("node"), F.lit(0).alias("p"), F.col("target").alias("o")).union(e.select("target", F.lit(1), "source"))
    g = ends.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("x")).select("node", F.array_join(F.transform("x", lambda v: v["o"]), ",").alias("neighbors"))
    n = A.nodes(spark, d).select(F.col("node_id").alias("node"), "kind")
    return A.alerts(spark, d).where("severity = 'critical'").join(n, "node", "left").join(g, "node", "left").select("ordinal", "kind", "neighbors")


@query("gnn_proximity", with_sql("alerts", ", s AS (SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, node) AS r FROM alerts GROUP BY case_id, node) SELECT ordinal, round(CASE WHEN r <= 5 THEN 1.0::DOUBLE - 0.18::DOUBLE * (r - 1) ELSE 0.0 END, 6)::DOUBLE AS proximity FROM alerts JOIN s USING (case_id, node)"))
def gnn_proximity(spark, d):
    a = A.alerts(spark, d)
    c = a.groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "node")))
    return I.proximity(a, c, "case_id", "node").select("ordinal", F.round("proximity", 6).alias("proximity"))


@query("evidence_rows", with_sql("alerts", _WINDOWS + f", c AS (SELECT case_id, diagram_id, window_start, count(*) AS n, count(DISTINCT node) AS k, max(t) - min(t) AS span, string_agg(bucket, ',' ORDER BY t, ordinal) AS b FROM x GROUP BY ALL), m AS (SELECT *, {_MATCH} AS matches, CASE WHEN span <= 15 THEN 1.0 WHEN span <= 30 THEN 0.85 WHEN span <= 60 THEN 0.65 ELSE 0.4 END::DOUBLE AS temporal FROM c), r AS (SELECT case_id, diagram_id, window_start, 'onset' AS stage, 0.9::DOUBLE AS confidence FROM m UNION ALL SELECT case_id, diagram_id, window_start, 'propagation', round(least(1.0, 0.55::DOUBLE + 0.15::DOUBLE * matches), 4) FROM m WHERE matches > 0 UNION ALL SELECT case_id, diagram_id, window_start, 'spread', temporal FROM m WHERE k > 1 UNION ALL SELECT case_id, diagram_id, window_start, 'impact', temporal FROM m WHERE n > 3) SELECT * FROM r", True))
def evidence_rows(spark, d):
    keys = ["case_id", "diagram_id"]
    c = E.clusters(E.anchored_windows(A.alerts(spark, d), keys), keys)
    cols = {"n_events": F.col("n_events"), "matches": S.pattern_matches(F.col("buckets")), "n_nodes": F.size("nodes"), "n_diagrams": F.size("diagrams"), "temporal": S.temporal_score(F.col("t_max") - F.col("t_min"))}
    return c.select(*keys, "window_start", F.explode(I.evidence(cols)).alias("e")).select(*keys, "window_start", "e.stage", "e.confidence")


@query("path_edges", with_sql("edges", ", p AS (SELECT DISTINCT a.source AS s0, a.target AS s1, b.target AS s2 FROM edges a JOIN edges b ON a.target = b.source WHERE a.source LIKE 'R-%') SELECT DISTINCT s0 AS root, unnest([s0, s1]) AS source, unnest([s1, s2]) AS target FROM p"))
def path_edges(spark, d):
    roots = A.nodes(spark, d).where("node_id like 'R-%'").select(F.col("node_id").alias("root"))
    e = A.edges(spark, d).select("source", "target")
    two = roots.join(e.select(F.col("source").alias("root"), F.col("target").alias("b")), "root").join(e.select(F.col("source").alias("b"), F.col("target").alias("c")), "b")
    return I.path_edges(two.select("root", F.array("root", "b", "c").alias("path")), "root", "path")


@query("path_sampling", "WITH p AS (SELECT s_suppkey AS k, range(0, s_suppkey % 20 + 1) AS p FROM supplier) SELECT k, array_to_string(CASE WHEN len(p) <= 5 THEN p ELSE list_append(list_transform([0, 1, 2, 3], lambda i: p[i * greatest(1, (len(p) - 1) // 4) + 1]), p[-1]) END, ',') AS path FROM p")
def path_sampling(spark, d):
    k = F.col("s_suppkey")
    p = F.sequence(F.lit(0).cast("long"), k % 20)
    return A.table(spark, d, "supplier").select(k.alias("k"), F.array_join(F.transform(I.sampled(p), lambda x: x.cast("string")), ",").alias("path"))


@query("capped_timeline", with_sql("alerts", ", o AS (SELECT case_id, diagram_id, ordinal, t FROM alerts QUALIFY row_number() OVER (PARTITION BY case_id, diagram_id ORDER BY t, ordinal) <= 2), p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t, ordinal) AS place FROM o) SELECT case_id, diagram_id, ordinal, CAST(place AS INTEGER) AS place, CAST((place - 1) * 5 AS INTEGER) AS clock FROM p WHERE place <= 7"))
def capped_timeline(spark, d):
    c = I.capped(A.alerts(spark, d).select("case_id", "diagram_id", "ordinal", "t"), "case_id", "diagram_id", ["t", "ordinal"], 2, 7)
    return c.select("case_id", "diagram_id", "ordinal", "place", ((F.col("place") - 1) * 5).alias("clock"))


@query("zone_grid", "SELECT s_suppkey, 'zone-' || CAST(least(1, greatest(0, floor((s_suppkey * 29 % 320) / 300 * 2))) AS INTEGER) || '-' || CAST(least(2, greatest(0, floor((s_suppkey * 41 % 420) / 400 * 3))) AS INTEGER) AS zone FROM supplier")
def zone_grid(spark, d):
    k = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select("s_suppkey", I.zone(k * 41 % 420, k * 29 % 320, 400.0, 300.0).alias("zone"))


@query("polyline_length", "SELECT s_suppkey, round(sqrt(power(3 * (s_suppkey % 7), 2) + power(4 * (s_suppkey % 7), 2)) + sqrt(1 + power(s_suppkey % 5, 2)), 6) AS length FROM supplier")
def polyline_length(spark, d):
    k = F.col("s_suppkey")
    x, y = (3 * (k % 7)).cast("double"), (4 * (k % 7)).cast("double")
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(x, y), F.array(x + 1, y + (k % 5)))
    return A.table(spark, d, "supplier").select("s_suppkey", F.round(I.polyline(points), 6).alias("length"))


@query("synthetic_addresses", "SELECT s_suppkey, '10.' || (s_suppkey % 9) || '.' || (s_suppkey // 250) || '.' || (s_suppkey % 250 + 1) AS ip FROM supplier")
def synthetic_addresses(spark, d):
    k = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select("s_suppkey", F.format_string("10.%d.%d.%d", k % 9, F.floor(k / 250), k % 250 + 1).alias("ip"))


@query("vector_documents", with_sql("alerts nodes edges", ", x AS (SELECT 'node' AS kind, 'Node ' || node_id || ' is a ' || kind || ' in diagram ' || diagram_id || '.' AS text FROM nodes UNION ALL SELECT 'edge', source || ' connects to ' || target || '.' FROM edges UNION ALL SELECT 'alert', 'At minute ' || t || ' of ' || case_id || ', ' || node || ' raised ' || alert_type || ' with severity ' || severity || '.' FROM alerts WHERE severity = 'critical') SELECT sha1(kind || '|' || text) AS id, kind FROM x"))
def vector_documents(spark, d):
    return I.documents(A.nodes(spark, d), A.edges(spark, d), A.alerts(spark, d).where("severity = 'critical'")).select("id", "kind")


@query("template_remedies", with_sql("alerts nodes", ", i AS (SELECT case_id, arg_min(node, ordinal) AS node, count(DISTINCT diagram_id) AS n_diagrams FROM alerts GROUP BY ALL) SELECT case_id, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.TEMPLATES.items()) + " ELSE 'collect evidence' END AS first_step, n_diagrams <= 1 AS unattended FROM i JOIN nodes ON node = node_id"))
def template_remedies(spark, d):
    i = A.alerts(spark, d).groupBy("case_id").agg(F.min_by("node", "ordinal").alias("node_id"), F.count_distinct("diagram_id").alias("n_diagrams"))
    return I.remedies(i.join(A.nodes(spark, d).select("node_id", "kind"), "node_id"), "kind").select("case_id", "first_step", "unattended")


@query("prompt_text", with_sql("alerts", ", k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t, ordinal) AS r FROM alerts), p AS (SELECT case_id, max(CASE WHEN r = 1 THEN node END) AS root, string_agg('- T+' || t || 'm ' || node, chr(10) ORDER BY r) FILTER (WHERE r <= 8) AS tl FROM k GROUP BY ALL) SELECT case_id, md5('Root cause: ' || root || chr(10) || 'Timeline:' || chr(10) || tl || chr(10) || 'Candidates:' || chr(10) || '- ' || root) AS digest FROM p"))
def prompt_text(spark, d):
    x = A.alerts(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("t", "ordinal", "node"))).alias("x"))
    timeline = F.transform("x", lambda v: F.concat(F.lit("T+"), v["t"].cast("string"), F.lit("m "), v["node"]))
    root = F.get("x", F.lit(0))["node"]
    return x.select("case_id", F.md5(I.prompt(root, timeline, F.array(root)).cast("binary")).alias("digest"))


@query("candidate_scores", with_sql("nodes edges", ", d AS (SELECT DISTINCT source, target FROM edges WHERE source <> target), o AS (SELECT source AS node_id, count(*) AS o FROM d GROUP BY ALL), i AS (SELECT DISTINCT target AS node_id FROM d) SELECT node_id, round(least(0.99, 0.4::DOUBLE + 0.11::DOUBLE * coalesce(o, 0) + 0.14::DOUBLE * CAST(i.node_id IS NULL AS INTEGER) + 0.2::DOUBLE * CAST(node_id = 'R-0' AS INTEGER)), 6) AS score FROM nodes LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id)"))
def candidate_scores(spark, d):
    g = G.degrees(A.nodes(spark, d), A.edges(spark, d))
    score = 0.4 + 0.11 * F.col("out_degree") + F.when(F.col("is_source"), 0.14).otherwise(0.0) + F.when(F.col("node_id") == "R-0", 0.2).otherwise(0.0)
    return g.select("node_id", F.round(F.least(F.lit(0.99), score), 6).alias("score"))


@query("qa_counters", "SELECT l_shipmode_ AS mode, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.08) AS high_discount, count(*) FILTER (WHERE l_quantity < 5) AS small, round(3.0::DOUBLE * count(*) FILTER (WHERE l_discount > 0.08) + count(*) FILTER (WHERE l_quantity < 5), 3) AS suspicion FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY ROLLUP (l_shipmode_)")
def qa_counters(spark, d):
    x = A.table(spark, d, "lineitem").withColumn("mode", F.concat("l_returnflag", "l_linestatus"))
    high, small = F.count_if(F.col("l_discount") > 0.08), F.count_if(F.col("l_quantity") < 5)
    return x.rollup("mode").agg(F.count(F.lit(1)).alias("n"), high.alias("high_discount"), small.alias("small"), F.round(3.0 * high + small, 3).alias("suspicion"))


@query("suspicious_top", "WITH q AS (SELECT l_suppkey, count(*) FILTER (WHERE l_discount > 0.08) AS a, count(*) FILTER (WHERE l_quantity < 5) AS b FROM lineitem GROUP BY ALL) SELECT * FROM q ORDER BY a DESC, b DESC, l_suppkey DESC LIMIT 20")
def suspicious_top(spark, d):
    q = A.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") > 0.08).alias("a"), F.count_if(F.col("l_quantity") < 5).alias("b"))
    return q.orderBy(F.desc("a"), F.desc("b"), F.desc("l_suppkey")).limit(20)


@query("confidence_summary", "SELECT o_orderpriority AS kind, round(avg(coalesce(try_cast(CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '—' ELSE '0.' || (o_orderkey % 100) END AS DOUBLE), 0.5)), 6) AS mean_confidence, count(*) FILTER (WHERE coalesce(try_cast(CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '—' ELSE '0.' || (o_orderkey % 100) END AS DOUBLE), 0.5) < 0.9) AS low FROM orders GROUP BY ALL")
def confidence_summary(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, "—").otherwise(F.concat(F.lit("0."), (k % 100).cast("string")))
    c = F.coalesce(raw.try_cast("double"), F.lit(0.5))
    return A.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.round(F.avg(c), 6).alias("mean_confidence"), F.count_if(c < 0.9).alias("low"))


@query("interface_assignment", with_sql("edges", ", e AS (SELECT source AS node_id, target AS peer, ordinal FROM edges UNION ALL SELECT target, source, ordinal FROM edges) SELECT node_id, arg_min(peer, ordinal * 2 + CASE WHEN peer > node_id THEN 0 ELSE 1 END) AS peer FROM e GROUP BY ALL"))
def interface_assignment(spark, d):
    e = A.edges(spark, d)
    both = e.select(F.col("source").alias("node_id"), F.col("target").alias("peer"), "ordinal").union(e.select("target", "source", "ordinal"))
    return both.groupBy("node_id").agg(F.min_by("peer", F.col("ordinal") * 2 + F.when(F.col("peer") > F.col("node_id"), 0).otherwise(1)).alias("peer"))


@query("latency_summary", "SELECT event_type, round(min(value), 6) AS lo, round(avg(value), 6) AS mean, round(max(value), 6) AS hi FROM events GROUP BY ALL")
def latency_summary(spark, d):
    return A.table(spark, d, "events").groupBy("event_type").agg(F.round(F.min("value"), 6).alias("lo"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("hi"))


@query("best_scenario", with_sql("alerts", ", s AS (SELECT case_id, count(*) + 10 * count(DISTINCT diagram_id) + 5 * count(*) FILTER (WHERE severity = 'critical') AS score FROM alerts GROUP BY ALL) SELECT case_id, score FROM s ORDER BY score DESC, case_id LIMIT 1"))
def best_scenario(spark, d):
    s = A.alerts(spark, d).groupBy("case_id").agg((F.count(F.lit(1)) + 10 * F.count_distinct("diagram_id") + 5 * F.count_if(F.col("severity") == "critical")).alias("score"))
    return s.orderBy(F.desc("score"), "case_id").limit(1)


@query("wall_clock", with_sql("alerts", ", m AS (SELECT case_id, max(t) AS m FROM alerts GROUP BY ALL) SELECT ordinal, strftime(TIMESTAMP '2024-06-01 12:00:00' - to_minutes(CAST(m - t AS BIGINT)), '%H:%M') AS clock FROM alerts JOIN m USING (case_id)"))
def wall_clock(spark, d):
    last = F.max("t").over(Window.partitionBy("case_id"))
    base = F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    return A.alerts(spark, d).withColumn("back", last - F.col("t")).select("ordinal", F.date_format(base - F.make_interval(mins=F.col("back")), "HH:mm").alias("clock"))


@query("average_linkage")
def average_linkage(spark, d):
    """Average-linkage clusters of all alerts of each case."""
    return I.alert_linkage(cut(whole_alerts(spark, d)), "case_id", 0.62)


@query("dataset_summary", "SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((source), (lang), (source, lang), ())")
def dataset_summary(spark, d):
    return A.table(spark, d, "documents").cube("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
