"""Queries over questions, formats and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from emberline.operators import copilot
from emberline.session import shared_dir
from emberline.sources import adapters as A
from emberline.sources import readers
from emberline.sources.adapters import with_sql
from emberline.streaming import alerts as ST

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _graph(spark, d):
    return copilot.GraphQueries(A.nodes(spark, d), A.edges(spark, d), A.cross_edges(spark, d))


@query("ask_blast_radius", with_sql("edges", ", d AS (SELECT DISTINCT source, target FROM edges WHERE source <> target), r AS (SELECT 'N-4' AS root, 'N-4' AS node, 0 AS depth UNION SELECT r.root, d.target, r.depth + 1 FROM r JOIN d ON d.source = r.node WHERE r.depth < 7), m AS (SELECT root, node, min(depth) AS depth FROM r WHERE node <> root GROUP BY ALL) SELECT * FROM m ORDER BY depth, node LIMIT 50", True))
def ask_blast_radius(spark, d):
    return copilot.answer(_graph(spark, d), "What is the blast radius of 'N-4'?")


@query("ask_edges_between", with_sql("edges cross_edges", "SELECT source, target FROM (SELECT source, target FROM edges UNION ALL SELECT source, target FROM cross_edges) WHERE (source = 'N-1' AND target = 'N-7') OR (source = 'N-7' AND target = 'N-1')"))
def ask_edges_between(spark, d):
    return copilot.answer(_graph(spark, d), "Show links between 'N-1' and 'N-7'")


@query("ask_node_diagrams", with_sql("nodes", "SELECT DISTINCT diagram_id FROM nodes WHERE node_id = 'S-3'"))
def ask_node_diagrams(spark, d):
    return copilot.answer(_graph(spark, d), "Which diagrams hold 'S-3'?")


@query("ask_neighbors", with_sql("edges", "SELECT 'out' AS direction, target AS node FROM edges WHERE source = 'N-9' UNION ALL SELECT 'in', source FROM edges WHERE target = 'N-9'"))
def ask_neighbors(spark, d):
    return copilot.answer(_graph(spark, d), "neighbors of 'N-9'")


def _shared(spark, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(8).hex()}"


@query("json_round_trip", "SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_round_trip(spark, d):
    from emberline.sources import sinks

    path = _shared(spark, "json")
    e = A.table(spark, d, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    sinks.json_lines(e, path)
    return readers.json_lines(spark, path, "event_id long, user_id long, event_type string, props struct<k:long>").select("event_id", "user_id", "event_type", "props.k")


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    from emberline.sources import sinks

    path = _shared(spark, "csv")
    sinks.csv(A.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.csv_rows(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("source_fallback", "WITH u AS (SELECT s_suppkey AS k, 0 AS p, s_name AS v FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 1, s_name || '-b' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 2, s_name || '-c' FROM supplier) SELECT k, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY p) = 1")
def source_fallback(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return readers.first_valid([s.where("k % 3 = 0"), s.where("k % 2 = 0").withColumn("v", F.concat("v", F.lit("-b"))), s.withColumn("v", F.concat("v", F.lit("-c")))], "k", "v is not null")


def _drained(spark, build, d: str, name: str):
    """A stream over the events table, run over all that is there, and read back."""
    out = _shared(spark, name)
    events = spark.readStream.schema(A.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    run = build(events).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    return _drained(spark, lambda e: ST.dedup(e, ["event_id"]).select("event_id", "user_id", "event_type"), d, "dedup")


@query("stream_window_counts", "WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS s FROM events), m AS (SELECT max(ts) - INTERVAL 60 MINUTE AS wm FROM events) SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM w, m WHERE s + INTERVAL 6 HOUR <= wm GROUP BY ALL")
def stream_window_counts(spark, d):
    w = _drained(spark, lambda e: ST.window_counts(e, "event_type", size="6 hours"), d, "windows")
    return w.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stream_anchored_clusters")
def stream_anchored_clusters(spark, d):
    return _drained(spark, lambda e: ST.anchored_clusters(e, "event_type"), d, "anchored")


@query("session_counts", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(spark, d):
    e = A.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "60 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
