"""Queries over alerts: aggregation, ranking, windows, correlation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import constants as C
from emberline.functions.scalars import alert_bucket, lookup, pattern_matches, sequence_score, temporal_score, unit_hash
from emberline.operators import events as E
from emberline.operators import graph as G
from emberline.sources import adapters as A
from emberline.sources.adapters import with_sql

QUERIES, ORACLE_SQL = {}, {}
KEYS = ["case_id", "diagram_id"]
_SEV = "CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.8 WHEN 'warning' THEN 0.6 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.3 WHEN 'info' THEN 0.1 ELSE 0.0 END"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _severity():
    return lookup(F.col("severity"), C.SEVERITY_SCORE, 0.0)


@query("alert_dedup", with_sql("alerts", "SELECT case_id, node, alert_type, severity, t, diagram_id, min(ordinal) AS ordinal FROM alerts GROUP BY ALL"))
def alert_dedup(spark, d):
    return E.dedup(A.alerts(spark, d), ["case_id", "node", "alert_type", "severity", "t", "diagram_id"]).drop("bucket")


@query("node_alert_summary", with_sql("alerts", f"SELECT case_id, node, count(*) AS n_alerts, max({_SEV}) AS max_severity, min(t) AS first_t, max(t) AS last_t, round(avg(t), 6) AS mean_t, round(count(*) / (max(t) - min(t) + 1), 6) AS burst FROM alerts GROUP BY ALL"))
def node_alert_summary(spark, d):
    return A.alerts(spark, d).groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("n_alerts"), F.max(_severity()).alias("max_severity"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round(F.avg("t"), 6).alias("mean_t"), F.round(F.count(F.lit(1)) / (F.max("t") - F.min("t") + 1), 6).alias("burst"))


@query("severity_weighted_score", with_sql("alerts", f"SELECT case_id, node, round(sum({_SEV} / ln(t + exp(1))), 6) AS weighted FROM alerts GROUP BY ALL"))
def severity_weighted_score(spark, d):
    return A.alerts(spark, d).groupBy("case_id", "node").agg(F.round(F.sum(_severity() / F.log(F.col("t") + F.exp(F.lit(1.0)))), 6).alias("weighted"))


_BUCKETS = [*C.ALERT_BUCKETS, "other"]


@query("alert_bucket_counts", with_sql("alerts", "SELECT case_id, node, " + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in _BUCKETS) + " FROM alerts GROUP BY ALL"))
def alert_bucket_counts(spark, d):
    pivoted = A.alerts(spark, d).groupBy("case_id", "node").pivot("bucket", _BUCKETS).count()
    return pivoted.select("case_id", "node", *[F.coalesce(b, F.lit(0)).alias(b) for b in _BUCKETS])


@query("alert_presence_vector", with_sql("alerts", "SELECT node, " + ", ".join(f"max(CASE WHEN bucket = '{b}' THEN 1.0 ELSE 0.0 END)::DOUBLE AS {b}" for b in _BUCKETS) + " FROM alerts GROUP BY ALL"))
def alert_presence_vector(spark, d):
    return A.alerts(spark, d).groupBy("node").agg(*[F.max((F.col("bucket") == b).cast("double")).alias(b) for b in _BUCKETS])


_COMPAT = "CASE kind " + " ".join(f"WHEN '{k}' THEN bucket IN ({', '.join(repr(x) for x in v)})" for k, v in C.NODE_BUCKETS.items()) + " ELSE false END"


def _fits(kind, bucket):
    out = F.lit(False)
    for k, v in C.NODE_BUCKETS.items():
        out = F.when(kind == k, bucket.isin(v)).otherwise(out)
    return out


@query("alert_compatibility", with_sql("alerts nodes", f"SELECT case_id, node, round(avg(CAST({_COMPAT} AS DOUBLE)), 6) AS by_alert, round(count(DISTINCT bucket) FILTER (WHERE {_COMPAT}) / count(DISTINCT bucket), 6) AS by_bucket FROM alerts JOIN nodes ON node = node_id GROUP BY ALL"))
def alert_compatibility(spark, d):
    j = A.alerts(spark, d).join(A.nodes(spark, d).select(F.col("node_id").alias("node"), "kind"), "node")
    fit = _fits(F.col("kind"), F.col("bucket"))
    return j.groupBy("case_id", "node").agg(F.round(F.avg(fit.cast("double")), 6).alias("by_alert"), F.round(F.count_distinct(F.when(fit, F.col("bucket"))) / F.count_distinct("bucket"), 6).alias("by_bucket"))


@query("first_alert_rank", with_sql("alerts", ", f AS (SELECT case_id, node, min(t) AS first_t, min(ordinal) AS first_ordinal FROM (SELECT *, min(t) OVER (PARTITION BY case_id, node) AS m FROM alerts) WHERE t = m GROUP BY ALL) SELECT case_id, node, first_t, CAST(row_number() OVER w AS INTEGER) AS first_rank, row_number() OVER w = 1 AS is_first, row_number() OVER w = count(*) OVER (PARTITION BY case_id) AS is_last FROM f WINDOW w AS (PARTITION BY case_id ORDER BY first_t, first_ordinal)"))
def first_alert_rank(spark, d):
    first = A.alerts(spark, d).groupBy("case_id", "node").agg(F.min(F.struct("t", "ordinal")).alias("f"))
    w = Window.partitionBy("case_id")
    rank = F.row_number().over(w.orderBy("f.t", "f.ordinal"))
    return first.select("case_id", "node", F.col("f.t").alias("first_t"), rank.alias("first_rank"), (rank == 1).alias("is_first"), (rank == F.count(F.lit(1)).over(w)).alias("is_last"))


@query("sequence_position", with_sql("alerts", ", f AS (SELECT case_id, node, min(t::BIGINT * 1000000000 + ordinal) AS k FROM alerts GROUP BY ALL), r AS (SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY k) AS r, count(*) OVER (PARTITION BY case_id) AS n FROM f) SELECT case_id, node, CASE WHEN n = 1 THEN 0.0 ELSE round((r - 1) / (n - 1), 6) END::DOUBLE AS position FROM r"))
def sequence_position(spark, d):
    first = A.alerts(spark, d).groupBy("case_id", "node").agg(F.min(F.struct("t", "ordinal")).alias("f"))
    w = Window.partitionBy("case_id")
    r, n = F.row_number().over(w.orderBy("f.t", "f.ordinal")), F.count(F.lit(1)).over(w)
    return first.select("case_id", "node", F.when(n == 1, 0.0).otherwise(F.round((r - 1) / F.when(n > 1, n - 1), 6)).alias("position"))


@query("top_nodes_per_case", with_sql("alerts", f", s AS (SELECT case_id, node, count(*) AS n_alerts, round(sum({_SEV}), 6) AS score, min(ordinal) AS o FROM alerts GROUP BY ALL) SELECT case_id, node, n_alerts, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, o) AS INTEGER) AS rank FROM s QUALIFY rank <= 3"))
def top_nodes_per_case(spark, d):
    s = A.alerts(spark, d).groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("n_alerts"), F.round(F.sum(_severity()), 6).alias("score"), F.min("ordinal").alias("o"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "o"))
    return s.withColumn("rank", rank).where("rank <= 3").drop("o")


@query("severity_rollup", with_sql("alerts", f"SELECT case_id, diagram_id, count(*) AS n, bool_or(severity = 'critical') AS any_critical, max_by(severity, {_RANK}) AS worst FROM alerts GROUP BY GROUPING SETS ((case_id, diagram_id), (case_id), ())"))
def severity_rollup(spark, d):
    rank = lookup(F.col("severity"), C.SEVERITY_RANK, 0)
    return A.alerts(spark, d).rollup("case_id", "diagram_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity") == "critical").alias("any_critical"), F.max_by("severity", rank).alias("worst"))


@query("dominant_alert_type", with_sql("alerts", ", c AS (SELECT case_id, alert_type, count(*) AS n FROM alerts GROUP BY ALL) SELECT case_id, alert_type, n FROM c QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, alert_type) = 1"))
def dominant_alert_type(spark, d):
    c = A.alerts(spark, d).groupBy("case_id", "alert_type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "alert_type"))).where("r = 1").drop("r")


_WINDOWS = """, w AS (
        SELECT case_id, diagram_id, min(t) AS s FROM alerts GROUP BY ALL
        UNION ALL
        SELECT w.case_id, w.diagram_id, (SELECT min(a.t) FROM alerts a WHERE a.case_id = w.case_id AND a.diagram_id = w.diagram_id AND a.t > w.s + 60) FROM w
        WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.case_id = w.case_id AND a.diagram_id = w.diagram_id AND a.t > w.s + 60)
    ), x AS (
        SELECT a.*, w.s AS window_start FROM alerts a JOIN w ON a.case_id = w.case_id AND a.diagram_id = w.diagram_id AND a.t BETWEEN w.s AND w.s + 60
    )"""


def _windowed(spark, d):
    return E.anchored_windows(A.alerts(spark, d), KEYS)


@query("anchored_windows", with_sql("alerts", _WINDOWS + " SELECT case_id, diagram_id, ordinal, t, window_start FROM x", True))
def anchored_windows(spark, d):
    return _windowed(spark, d).select(*KEYS, "ordinal", "t", "window_start")


@query("window_cluster_dims", with_sql("alerts", _WINDOWS + " SELECT case_id, diagram_id, window_start, count(*) AS n_events, min(t) AS t_min, max(t) AS t_max, string_agg(bucket, ',' ORDER BY t, ordinal) AS buckets, CASE WHEN max(t) - min(t) <= 15 THEN 1.0 WHEN max(t) - min(t) <= 30 THEN 0.85 WHEN max(t) - min(t) <= 60 THEN 0.65 ELSE 0.4 END::DOUBLE AS temporal FROM x GROUP BY ALL", True))
def window_cluster_dims(spark, d):
    c = E.clusters(_windowed(spark, d), KEYS)
    return c.select(*KEYS, "window_start", "n_events", "t_min", "t_max", F.array_join("buckets", ",").alias("buckets"), temporal_score(F.col("t_max") - F.col("t_min")).alias("temporal"))


_MATCH = " + ".join("CAST(regexp_matches(',' || b || ',', '" + ",(.*,)?".join(["", *p]) + ",') AS INTEGER)" for p in C.PROPAGATION)


@query("pattern_match_score", with_sql("alerts", _WINDOWS + f", c AS (SELECT case_id, diagram_id, window_start, string_agg(bucket, ',' ORDER BY t, ordinal) AS b FROM x GROUP BY ALL), m AS (SELECT *, {_MATCH} AS matches FROM c) SELECT case_id, diagram_id, window_start, matches, CASE WHEN matches = 0 THEN 0.2::DOUBLE ELSE least(1.0::DOUBLE, round(0.55::DOUBLE + 0.15::DOUBLE * matches, 6)) END AS score FROM m", True))
def pattern_match_score(spark, d):
    m = pattern_matches(F.col("buckets"))
    return E.clusters(_windowed(spark, d), KEYS).select(*KEYS, "window_start", m.alias("matches"), F.round(sequence_score(m), 6).alias("score"))


_CASE_WINDOWS = _WINDOWS.replace(", diagram_id, min(t)", ", min(t)").replace("w.case_id, w.diagram_id, (", "w.case_id, (").replace(" AND a.diagram_id = w.diagram_id", "")


@query("source_peer_score", with_sql("alerts", _CASE_WINDOWS + ", g AS (SELECT case_id, window_start, diagram_id, count(*) AS n FROM x GROUP BY ALL) SELECT case_id, window_start, CASE WHEN sum(n) < 2 THEN 0.0 ELSE round((0.3::DOUBLE * sum(n) * (sum(n) - 1) / 2 + 0.4::DOUBLE * sum(n * (n - 1) / 2)) / (sum(n) * (sum(n) - 1) / 2), 6) END::DOUBLE AS source_peer FROM g GROUP BY ALL", True))
def source_peer_score(spark, d):
    w = E.anchored_windows(A.alerts(spark, d), ["case_id"])
    return E.peer_score(w, ["case_id"]).withColumn("source_peer", F.round("source_peer", 6))


@query("correlation_roles", with_sql("alerts", _CASE_WINDOWS + ", p AS (SELECT case_id, window_start, ordinal, bucket, diagram_id, row_number() OVER w AS place, first_value(bucket) OVER w AS b1, nth_value(bucket, 2) OVER w AS b2, first_value(diagram_id) OVER w AS d1 FROM x WINDOW w AS (PARTITION BY case_id, window_start ORDER BY t, ordinal)) SELECT case_id, window_start, ordinal, CAST(place AS INTEGER) AS place, CASE WHEN place = 1 THEN 'cluster_seed' WHEN place = 2 AND b1 || '>' || bucket IN (" + ", ".join(sorted({f"'{p[0]}>{p[1]}'" for p in C.PROPAGATION})) + ") THEN 'propagation_signal' WHEN place = 3 AND b1 || '>' || b2 || '>' || bucket IN (" + ", ".join(f"'{'>'.join(p)}'" for p in C.PROPAGATION if len(p) == 3) + ") THEN 'propagation_signal' WHEN diagram_id = d1 THEN 'peer_signal' ELSE 'noise_candidate' END AS role FROM p", True))
def correlation_roles(spark, d):
    return E.roles(E.anchored_windows(A.alerts(spark, d), ["case_id"]), ["case_id"]).select("case_id", "window_start", "ordinal", "place", "role")


@query("cluster_fingerprint", with_sql("alerts", _WINDOWS + ", k AS (SELECT DISTINCT case_id, diagram_id, window_start, alert_type FROM x), n AS (SELECT case_id, diagram_id, window_start, node FROM (SELECT DISTINCT case_id, diagram_id, window_start, node FROM x) QUALIFY row_number() OVER (PARTITION BY case_id, diagram_id, window_start ORDER BY node) <= 3), kk AS (SELECT case_id, diagram_id, window_start, string_agg(alert_type, '|' ORDER BY alert_type) AS k FROM k GROUP BY ALL), nn AS (SELECT case_id, diagram_id, window_start, string_agg(node, '|' ORDER BY node) AS n FROM n GROUP BY ALL) SELECT case_id, diagram_id, window_start, substr(sha1(k || '@' || n), 1, 12) AS fingerprint FROM kk JOIN nn USING (case_id, diagram_id, window_start)", True))
def cluster_fingerprint(spark, d):
    return E.fingerprint(_windowed(spark, d), KEYS)


_HOPS = ", ed AS (SELECT DISTINCT source, target FROM edges WHERE source <> target), eu AS (SELECT source, target FROM ed UNION SELECT target, source FROM ed), rr AS (SELECT node_id AS root, node_id AS node, 0 AS depth FROM nodes WHERE node_id IN (SELECT node FROM alerts) UNION SELECT rr.root, eu.target, rr.depth + 1 FROM rr JOIN eu ON eu.source = rr.node WHERE rr.depth < 4), ds AS (SELECT root, node, min(depth) AS depth FROM rr GROUP BY ALL)"


def _score_sql(keys: str, enterprise: bool) -> str:
    nodes = f", nd AS (SELECT DISTINCT {keys}, window_start, node FROM x WHERE node IN (SELECT node_id FROM nodes)), tp AS (SELECT {keys}, window_start, avg(CASE depth WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.45 ELSE 0 END)::DOUBLE AS topology FROM nd a JOIN nd b USING ({keys}, window_start) LEFT JOIN ds ON ds.root = a.node AND ds.node = b.node WHERE a.node < b.node GROUP BY ALL)"
    diagrams = f", dg AS (SELECT DISTINCT {keys}, window_start, diagram_id AS dia FROM x), cr AS (SELECT {keys}, window_start, CASE WHEN count(*) <= 1 THEN 0 WHEN bool_or(EXISTS (SELECT 1 FROM cross_edges c WHERE c.source_diagram = dg.dia AND c.target_diagram IN (SELECT e.dia FROM dg e WHERE e.case_id = dg.case_id AND e.window_start = dg.window_start))) THEN 1 ELSE 0.6 END::DOUBLE AS crossing FROM dg GROUP BY ALL)" if enterprise else f", cr AS (SELECT {keys}, window_start, 0.0::DOUBLE AS crossing FROM x GROUP BY ALL)"
    peers = f", pg AS (SELECT {keys}, window_start, diagram_id AS dia, count(*) AS n FROM x GROUP BY ALL), pe AS (SELECT {keys}, window_start, CASE WHEN sum(n) < 2 THEN 0 ELSE (0.3::DOUBLE * sum(n) * (sum(n) - 1) / 2 + 0.4::DOUBLE * sum(n * (n - 1) / 2)) / (sum(n) * (sum(n) - 1) / 2) END::DOUBLE AS peer FROM pg GROUP BY ALL)"
    w = C.WEIGHTS_ENTERPRISE if enterprise else C.WEIGHTS_TOPOLOGY
    return _HOPS + nodes + diagrams + peers + f", c AS (SELECT {keys}, window_start, count(*) AS n_events, max(t) - min(t) AS span, string_agg(bucket, ',' ORDER BY t, ordinal) AS b FROM x GROUP BY ALL), m AS (SELECT *, {_MATCH} AS k FROM c) SELECT {keys}, window_start, n_events, round(coalesce(topology, 0), 6) AS topology, round(greatest(0, least(1, {w['temporal']}::DOUBLE * CASE WHEN span <= 15 THEN 1.0 WHEN span <= 30 THEN 0.85 WHEN span <= 60 THEN 0.65 ELSE 0.4 END + {w['topology']}::DOUBLE * coalesce(topology, 0) + {w['alert_type_seq']}::DOUBLE * CASE WHEN k = 0 THEN 0.2 ELSE least(1.0, 0.55::DOUBLE + 0.15::DOUBLE * k) END + {w['source_peer']}::DOUBLE * peer + {w['cross_diagram']}::DOUBLE * crossing)) + 1e-9::DOUBLE, 4) AS cluster_score FROM m LEFT JOIN tp USING ({keys}, window_start) JOIN pe USING ({keys}, window_start) JOIN cr USING ({keys}, window_start)"


def _scored(spark, d, keys: list[str], enterprise: bool):
    w = G.cut(E.anchored_windows(A.alerts(spark, d), keys))
    at = [*keys, "window_start"]
    c = E.clusters(w, keys).join(E.peer_score(w, keys).withColumnRenamed("source_peer", "_peer"), at).join(E.topology_score(w, keys, A.edges(spark, d), A.nodes(spark, d)).withColumnRenamed("topology", "_topology"), at, "left")
    crossing = F.lit(0.0)
    if enterprise:
        c, crossing = c.join(E.cross_score(w, keys, A.cross_edges(spark, d)), at), F.col("cross")
    s = E.cluster_score(c, enterprise, F.coalesce("_topology", F.lit(0.0)), F.col("_peer"), crossing)
    return s.select(*at, "n_events", F.round("topology", 6).alias("topology"), "cluster_score")


@query("cluster_score", with_sql("alerts nodes edges", _WINDOWS + _score_sql("case_id, diagram_id", False), True))
def cluster_score(spark, d):
    return _scored(spark, d, KEYS, False)


@query("cluster_score_enterprise", with_sql("alerts nodes edges cross_edges", _CASE_WINDOWS + _score_sql("case_id", True), True))
def cluster_score_enterprise(spark, d):
    return _scored(spark, d, ["case_id"], True)


@query("alert_hash_features", with_sql("alerts", "SELECT ordinal, round(('0x' || substr(md5(diagram_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE, 9) AS diagram_hash, CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 WHEN 'info' THEN 0.1 ELSE 0.25 END::DOUBLE AS severity_score, round(t / (SELECT max(t) FROM alerts), 9) AS t_norm FROM alerts"))
def alert_hash_features(spark, d):
    al = A.alerts(spark, d)
    return al.crossJoin(F.broadcast(al.agg(F.max("t").alias("m")))).select("ordinal", F.round(unit_hash(F.col("diagram_id")), 9).alias("diagram_hash"), lookup(F.col("severity"), C.SEVERITY_CORRELATION, 0.25).alias("severity_score"), F.round(F.col("t") / F.col("m"), 9).alias("t_norm"))


@query("running_path", with_sql("alerts", ", l AS (SELECT case_id, ordinal, list(node) OVER (PARTITION BY case_id ORDER BY t, ordinal ROWS UNBOUNDED PRECEDING) AS p FROM alerts) SELECT case_id, ordinal, (SELECT count(DISTINCT u) FROM unnest(p) AS q(u)) AS n_nodes FROM l"))
def running_path(spark, d):
    """How many nodes the path of a case's alerts has touched so far: first places are marked and summed."""
    al = A.alerts(spark, d)
    first = F.row_number().over(Window.partitionBy("case_id", "node").orderBy("t", "ordinal")) == 1
    so_far = Window.partitionBy("case_id").orderBy("t", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return al.withColumn("_f", (first & F.col("node").isNotNull()).cast("long")).select("case_id", "ordinal", F.sum("_f").over(so_far).alias("n_nodes"))


@query("event_ids_after_filter", with_sql("alerts", "SELECT case_id, ordinal, printf('EVT-%04d', row_number() OVER (PARTITION BY case_id ORDER BY t, ordinal)) AS event_id FROM alerts WHERE diagram_id = 'D1'"))
def event_ids_after_filter(spark, d):
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("t", "ordinal"))
    return A.alerts(spark, d).where("diagram_id = 'D1'").select("case_id", "ordinal", F.format_string("EVT-%04d", n).alias("event_id"))


@query("alert_classification", """SELECT event_type || '-' || b AS raw, CASE b WHEN 0 THEN 'cpu' WHEN 1 THEN 'latency' WHEN 2 THEN 'packet_drop' WHEN 3 THEN 'link_errors' WHEN 4 THEN 'other' END AS bucket, count(*) AS n FROM (SELECT event_type, event_id % 5 AS b FROM events) GROUP BY ALL""")
def alert_classification(spark, d):
    names = F.array(*[F.lit(x) for x in ("High CPU", "slow-response", "Packet Loss", "interface-flap", "something else")])
    e = A.table(spark, d, "events").select("event_type", (F.col("event_id") % 5).alias("b"))
    return e.select(F.concat("event_type", F.lit("-"), F.col("b").cast("string")).alias("raw"), alert_bucket(F.element_at(names, (F.col("b") + 1).cast("int"))).alias("bucket")).groupBy("raw", "bucket").agg(F.count(F.lit(1)).alias("n"))
