"""The driver's tables as alerts, topology nodes and edges, boxes and records.

``SQL`` has the same definitions for DuckDB, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import alert_bucket, lookup

KINDS = ["router", "switch", "firewall", "server", "database", "load_balancer", "service", "cloud", "wan"]
ALERT_TYPES = {"error": "packet_drop", "click": "latency", "view": "cpu_spike", "signup": "auth_errors", "purchase": "connection_timeout"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, ordinal, node, diagram_id, alert_type, bucket, severity, t (minutes of the day)."""
    e = table(spark, sf_dir, "events")
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    value = F.col("value")
    severity = F.when(value >= 200, "critical").when(value >= 100, "high").when(value >= 50, "medium").when(value >= 20, "low").otherwise("info")
    kind = lookup(F.col("event_type"), ALERT_TYPES, "other")
    return e.crossJoin(F.broadcast(suppliers)).select(
        F.date_format("ts", "yyyy-MM-dd").alias("case_id"),
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("S-"), (F.col("user_id") % F.col("n") + 1).cast("string")).alias("node"),
        F.concat(F.lit("D"), (F.col("user_id") % 5).cast("string")).alias("diagram_id"),
        kind.alias("alert_type"),
        alert_bucket(kind).alias("bucket"),
        severity.alias("severity"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("int").alias("t"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, kind, diagram_id of regions, nations and suppliers."""
    kind = lambda key: F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % len(KINDS) + 1).cast("int"))
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    r = region.select(F.concat(F.lit("R-"), F.col("r_regionkey").cast("string")).alias("node_id"), kind(F.col("r_regionkey")).alias("kind"), F.concat(F.lit("D"), F.col("r_regionkey").cast("string")).alias("diagram_id"))
    n = nation.select(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("node_id"), kind(F.col("n_nationkey")).alias("kind"), F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("diagram_id"))
    s = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("node_id"), kind(F.col("s_suppkey")).alias("kind"), F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("diagram_id"))
    return r.unionByName(n).unionByName(s)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, ordinal: regions to nations to suppliers, and each supplier to the next of its nation."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    down = nation.select(F.concat(F.lit("R-"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("target"), F.col("n_nationkey").cast("long").alias("ordinal"))
    to = supplier.select(F.concat(F.lit("N-"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("target"), (F.col("s_suppkey") + 1000).alias("ordinal"))
    following = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    across = supplier.select(F.col("s_suppkey").alias("x"), following.alias("y")).where("y is not null")
    across = across.select(F.concat(F.lit("S-"), F.col("x").cast("string")).alias("source"), F.concat(F.lit("S-"), F.col("y").cast("string")).alias("target"), (F.col("x") + 1_000_000).alias("ordinal"))
    return down.unionByName(to).unionByName(across)


def cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, source_diagram, target_diagram: trade between nations of different regions, by number of orders' lines."""
    line, orders, customer, supplier, nation = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "nation"))
    sn = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sr"))
    cn = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("cr"))
    trade = (
        line.select("l_orderkey", "l_suppkey")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .join(customer.select("c_custkey", "c_nationkey"), "c_custkey")
        .join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .groupBy("s_nationkey", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )
    out = trade.join(F.broadcast(sn), "s_nationkey").join(F.broadcast(cn), "c_nationkey").where("sr <> cr")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return out.select(name("N-", "s_nationkey").alias("source"), name("N-", "c_nationkey").alias("target"), name("D", "sr").alias("source_diagram"), name("D", "cr").alias("target_diagram"), "n_lines")


_kind = "list_extract(['" + "', '".join(KINDS) + "'], CAST({0} % " + str(len(KINDS)) + " + 1 AS INTEGER))"

#: DuckDB definitions of the same entities.
SQL = {
    "alerts": """alerts AS (
        SELECT strftime(ts, '%Y-%m-%d') AS case_id, event_id AS ordinal, 'S-' || (user_id % (SELECT count(*) FROM supplier) + 1) AS node,
            'D' || (user_id % 5) AS diagram_id,
            CASE event_type WHEN 'error' THEN 'packet_drop' WHEN 'click' THEN 'latency' WHEN 'view' THEN 'cpu_spike' WHEN 'signup' THEN 'auth_errors' WHEN 'purchase' THEN 'connection_timeout' ELSE 'other' END AS alert_type,
            CASE event_type WHEN 'error' THEN 'packet_drop' WHEN 'click' THEN 'latency' WHEN 'view' THEN 'cpu' WHEN 'signup' THEN 'auth_errors' WHEN 'purchase' THEN 'connection_timeout' ELSE 'other' END AS bucket,
            CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value >= 20 THEN 'low' ELSE 'info' END AS severity,
            CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS t
        FROM events)""",
    "nodes": f"""nodes AS (
        SELECT 'R-' || r_regionkey AS node_id, {_kind.format('r_regionkey')} AS kind, 'D' || r_regionkey AS diagram_id FROM region
        UNION ALL SELECT 'N-' || n_nationkey, {_kind.format('n_nationkey')}, 'D' || n_regionkey FROM nation
        UNION ALL SELECT 'S-' || s_suppkey, {_kind.format('s_suppkey')}, 'D' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "edges": """edges AS (
        SELECT 'R-' || n_regionkey AS source, 'N-' || n_nationkey AS target, CAST(n_nationkey AS BIGINT) AS ordinal FROM nation
        UNION ALL SELECT 'N-' || s_nationkey, 'S-' || s_suppkey, s_suppkey + 1000 FROM supplier
        UNION ALL SELECT 'S-' || a.s_suppkey, 'S-' || min(b.s_suppkey), a.s_suppkey + 1000000 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_suppkey)""",
    "cross_edges": """cross_edges AS (
        SELECT 'N-' || s_nationkey AS source, 'N-' || c_nationkey AS target, 'D' || a.n_regionkey AS source_diagram, 'D' || b.n_regionkey AS target_diagram, count(*) AS n_lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
        WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL)""",
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """A DuckDB query over the named entities."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(SQL[n] for n in names.split())}{body if body.lstrip().startswith(',') else ' ' + body}"
