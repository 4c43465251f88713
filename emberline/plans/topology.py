"""Queries over the topology: degrees, closures, paths, ranks, set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import constants as C
from emberline.functions.scalars import hop_score, lookup
from emberline.operators import graph as G
from emberline.operators import topology as T
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


_D = ", d AS (SELECT DISTINCT source, target FROM edges WHERE source <> target)"


@query("degree_features", with_sql("nodes edges", _D + ", o AS (SELECT source AS node_id, count(*) AS out_degree FROM d GROUP BY ALL), i AS (SELECT target AS node_id, count(*) AS in_degree FROM d GROUP BY ALL) SELECT node_id, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) + coalesce(in_degree, 0) AS degree, coalesce(in_degree, 0) = 0 AS is_source, coalesce(out_degree, 0) = 0 AS is_sink FROM nodes LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id)"))
def degree_features(spark, d):
    return G.degrees(A.nodes(spark, d), A.edges(spark, d))


@query("cross_degree", with_sql("cross_edges", ", p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM cross_edges), e AS (SELECT a AS node_id FROM p UNION ALL SELECT b FROM p) SELECT node_id, count(*) AS cross_degree FROM e GROUP BY ALL"))
def cross_degree(spark, d):
    p = A.cross_edges(spark, d).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return p.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("cross_degree"))


@query("capped_multigraph_degree", with_sql("edges cross_edges", ", e AS (SELECT source, target FROM edges UNION ALL SELECT source, target FROM cross_edges), x AS (SELECT source AS node_id FROM e UNION ALL SELECT target FROM e) SELECT node_id, least(count(*) / 10.0, 1.0)::DOUBLE AS degree FROM x GROUP BY ALL"))
def capped_multigraph_degree(spark, d):
    e = A.edges(spark, d).select("source", "target").unionAll(A.cross_edges(spark, d).select("source", "target"))
    return e.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.least(F.count(F.lit(1)) / 10.0, F.lit(1.0)).cast("double").alias("degree"))


def _reach_sql(seed: str, forward: bool = True, depth: int = 7) -> str:
    a, b = ("source", "target") if forward else ("target", "source")
    return _D + f", r AS (SELECT {seed} AS root, {seed} AS node, 0 AS depth FROM (SELECT 1) UNION SELECT r.root, d.{b}, r.depth + 1 FROM r JOIN d ON d.{a} = r.node WHERE r.depth < {depth})"


@query("descendants", with_sql("nodes edges", _D + ", r AS (SELECT node_id AS root, node_id AS node, 0 AS depth FROM nodes WHERE node_id LIKE 'R-%' UNION SELECT r.root, d.target, r.depth + 1 FROM r JOIN d ON d.source = r.node) SELECT root, node, min(depth) AS depth FROM r WHERE node <> root GROUP BY ALL", True))
def descendants(spark, d):
    roots = A.nodes(spark, d).where("node_id like 'R-%'").select(F.col("node_id").alias("root"))
    return G.reach(G.directed(A.edges(spark, d)), roots)


@query("ancestors", with_sql("nodes edges", _D + ", r AS (SELECT node_id AS root, node_id AS node, 0 AS depth FROM nodes UNION SELECT r.root, d.source, r.depth + 1 FROM r JOIN d ON d.target = r.node) SELECT root, node, min(depth) AS depth FROM r WHERE node <> root GROUP BY ALL", True))
def ancestors(spark, d):
    return G.closure(A.edges(spark, d)).select(F.col("node").alias("root"), F.col("root").alias("node"), "depth")


@query("blast_radius", with_sql("edges", _reach_sql("'R-1'") + ", m AS (SELECT node, min(depth) AS depth FROM r WHERE node <> root GROUP BY ALL) SELECT node, depth FROM m ORDER BY depth, node LIMIT 50", True))
def blast_radius(spark, d):
    seen = G.reach(G.directed(A.edges(spark, d)), spark.createDataFrame([("R-1",)], "root string"))
    return seen.orderBy("depth", "node").limit(50).select("node", "depth")


@query("upstream_path", with_sql("edges", _D + ", p AS (SELECT 'S-7' AS node, ['S-7'] AS path, 0 AS depth UNION ALL SELECT d.source, list_append(p.path, d.source), p.depth + 1 FROM p JOIN d ON d.target = p.node WHERE p.depth < 8), s AS (SELECT node AS root, depth, path FROM p WHERE depth > 0 AND node NOT IN (SELECT target FROM d)), b AS (SELECT * FROM s ORDER BY depth, root, path LIMIT 1) SELECT root, depth, array_to_string(list_reverse(path), '>') AS path FROM b", True))
def upstream_path(spark, d):
    return G.upstream(A.edges(spark, d), "S-7")


_U = _D + ", u AS (SELECT source, target FROM d UNION SELECT target, source FROM d)"


@query("undirected_distance", with_sql("nodes edges", _U + ", r AS (SELECT node_id AS root, node_id AS node, 0 AS depth FROM nodes WHERE node_id IN ('S-1', 'S-2', 'S-3', 'S-4', 'S-5', 'S-6') UNION SELECT r.root, u.target, r.depth + 1 FROM r JOIN u ON u.source = r.node WHERE r.depth < 7) SELECT root, node, min(depth) AS depth, CASE min(depth) WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.45 ELSE 0.0 END::DOUBLE AS hop_score FROM r WHERE node <> root AND node IN ('S-1', 'S-2', 'S-3', 'S-4', 'S-5', 'S-6') GROUP BY ALL", True))
def undirected_distance(spark, d):
    six = [f"S-{k}" for k in range(1, 7)]
    roots = A.nodes(spark, d).where(F.col("node_id").isin(six)).select(F.col("node_id").alias("root"))
    seen = G.reach(G.undirected(A.edges(spark, d)), roots).where(F.col("node").isin(six))
    return seen.withColumn("hop_score", hop_score(F.col("depth")))


@query("shortest_paths", with_sql("edges", _D + ", p AS (SELECT 'R-2' AS node, ['R-2'] AS path, 0 AS depth UNION ALL SELECT d.target, list_append(p.path, d.target), p.depth + 1 FROM p JOIN d ON d.source = p.node WHERE p.depth < 4 AND NOT list_contains(p.path, d.target)), m AS (SELECT node, min(depth) AS depth FROM p GROUP BY ALL) SELECT p.node, p.depth, array_to_string(min(p.path), '>') AS path FROM p JOIN m ON p.node = m.node AND p.depth = m.depth GROUP BY ALL", True))
def shortest_paths(spark, d):
    found = G.paths(G.directed(A.edges(spark, d)), spark.createDataFrame([("R-2",)], "root string"), 4)
    return found.select("node", "depth", F.array_join("path", ">").alias("path"))


@query("neighbors", with_sql("edges", "SELECT 'out' AS direction, target AS node FROM edges WHERE source = 'N-3' UNION ALL SELECT 'in', source FROM edges WHERE target = 'N-3'"))
def neighbors(spark, d):
    return G.neighbours(A.edges(spark, d), "N-3")


@query("edges_between", with_sql("cross_edges", "SELECT source, target, n_lines, CASE WHEN source = 'N-1' THEN 0 ELSE 1 END AS priority FROM cross_edges WHERE (source = 'N-1' AND target = 'N-2') OR (source = 'N-2' AND target = 'N-1')"))
def edges_between(spark, d):
    e = A.cross_edges(spark, d)
    ab, ba = (F.col("source") == "N-1") & (F.col("target") == "N-2"), (F.col("source") == "N-2") & (F.col("target") == "N-1")
    return e.where(ab | ba).select("source", "target", "n_lines", F.when(ab, 0).otherwise(1).alias("priority"))


@query("galaxy_rollup", with_sql("nodes", "SELECT kind, diagram_id, count(*) AS n, CAST(grouping(kind, diagram_id) AS BIGINT) AS level FROM nodes GROUP BY GROUPING SETS ((kind), (diagram_id), ())"))
def galaxy_rollup(spark, d):
    A.nodes(spark, d).createOrReplaceTempView("emberline_nodes")
    return spark.sql("SELECT kind, diagram_id, count(*) AS n, grouping_id(kind, diagram_id) AS level FROM emberline_nodes GROUP BY GROUPING SETS ((kind), (diagram_id), ())")


@query("canonical_pair_dedup", with_sql("cross_edges", "SELECT source, target, n_lines FROM cross_edges QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY n_lines DESC, source) = 1"))
def canonical_pair_dedup(spark, d):
    return T.pair_dedup(A.cross_edges(spark, d), [F.desc("n_lines"), "source"]).select("source", "target", "n_lines")


@query("bidirectional_edges", with_sql("edges", "SELECT DISTINCT source, target FROM (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges) WHERE source <> target"))
def bidirectional_edges(spark, d):
    return G.undirected(A.edges(spark, d))


@query("enterprise_union_shared", "WITH v AS (SELECT 'P-' || (l_partkey % 500) AS node_id, 'D' || (l_suppkey % 5) AS diagram_id, min(l_orderkey) AS o FROM lineitem GROUP BY ALL) SELECT node_id, diagram_id, count(*) OVER (PARTITION BY node_id) > 1 AS shared FROM v QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY o, diagram_id) = 1")
def enterprise_union_shared(spark, d):
    line = A.table(spark, d, "lineitem").select(F.concat(F.lit("P-"), (F.col("l_partkey") % 500).cast("string")).alias("node_id"), F.concat(F.lit("D"), (F.col("l_suppkey") % 5).cast("string")).alias("diagram_id"), "l_orderkey")
    seen = line.groupBy("node_id", "diagram_id").agg(F.min(F.struct("l_orderkey", "diagram_id")).alias("o"))
    return T.merge_shared(seen, "node_id", "o").drop("o")


@query("matched_entities", with_sql("alerts nodes", "SELECT DISTINCT node FROM alerts WHERE node IN (SELECT node_id FROM nodes WHERE diagram_id = 'D1')"))
def matched_entities(spark, d):
    return A.alerts(spark, d).select("node").intersect(A.nodes(spark, d).where("diagram_id = 'D1'").select("node_id"))


@query("new_entities", with_sql("alerts nodes", "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node FROM alerts)"))
def new_entities(spark, d):
    return A.nodes(spark, d).select("node_id").join(A.alerts(spark, d).select(F.col("node").alias("node_id")), "node_id", "left_anti")


@query("graph_minus_diagram_anti", with_sql("nodes edges", ", g AS (SELECT node_id FROM nodes WHERE diagram_id = 'D2') SELECT source, target, ordinal FROM edges WHERE source NOT IN (SELECT node_id FROM g) AND target NOT IN (SELECT node_id FROM g)"))
def graph_minus_diagram_anti(spark, d):
    return T.without_diagram(A.nodes(spark, d), A.edges(spark, d), "D2")[1]


@query("graph_minus_diagram_semi", with_sql("nodes edges", ", s AS (SELECT node_id FROM nodes WHERE diagram_id <> 'D2') SELECT source, target, ordinal FROM edges WHERE source IN (SELECT node_id FROM s) AND target IN (SELECT node_id FROM s)"))
def graph_minus_diagram_semi(spark, d):
    return T.of_other_diagrams(A.nodes(spark, d), A.edges(spark, d), "D2")[1]


@query("cross_links_for_diagram", with_sql("cross_edges", "SELECT source, target, source_diagram, target_diagram FROM cross_edges WHERE source_diagram = 'D3' OR target_diagram = 'D3'"))
def cross_links_for_diagram(spark, d):
    return A.cross_edges(spark, d).where("source_diagram = 'D3' or target_diagram = 'D3'").drop("n_lines")


@query("absorption_summary", with_sql("alerts nodes", "SELECT (SELECT count(DISTINCT node) FROM alerts) AS local_nodes, (SELECT count(*) FROM nodes) AS graph_nodes, (SELECT count(DISTINCT node) FROM alerts WHERE node IN (SELECT node_id FROM nodes)) AS matched, (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT node FROM alerts)) AS missing"))
def absorption_summary(spark, d):
    local, graph = A.alerts(spark, d).select(F.col("node").alias("node_id")).distinct(), A.nodes(spark, d).select("node_id")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(local, "local_nodes").crossJoin(one(graph, "graph_nodes")).crossJoin(one(local.join(graph, "node_id", "left_semi"), "matched")).crossJoin(one(graph.join(local, "node_id", "left_anti"), "missing"))


def _pagerank_sql(rounds: int) -> str:
    sql = _D + ", o AS (SELECT source, count(*) AS n FROM d GROUP BY ALL), c AS (SELECT count(*) AS n FROM nodes), k0 AS (SELECT node_id, 1.0::DOUBLE / (SELECT n FROM c) AS rank FROM nodes)"
    for i in range(rounds):
        sql += f", g{i} AS (SELECT target AS node_id, sum(rank / o.n) AS got FROM k{i} JOIN d ON d.source = node_id JOIN o ON o.source = node_id GROUP BY ALL), l{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM k{i} WHERE node_id NOT IN (SELECT source FROM o)), k{i + 1} AS (SELECT k{i}.node_id, 0.15::DOUBLE / (SELECT n FROM c) + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT loose FROM l{i}) / (SELECT n FROM c)) AS rank FROM k{i} LEFT JOIN g{i} USING (node_id))"
    return sql + f" SELECT node_id, round(rank, 9) AS rank FROM k{rounds}"


@query("pagerank_fixed_iter", with_sql("nodes edges", _pagerank_sql(5)))
def pagerank_fixed_iter(spark, d):
    return G.pagerank(A.nodes(spark, d), A.edges(spark, d), 5).withColumn("rank", F.round("rank", 9))


@query("closeness", with_sql("nodes edges", _U + ", r AS (SELECT node_id AS root, node_id AS node, 0 AS depth FROM nodes WHERE node_id LIKE 'N-%' UNION SELECT r.root, u.target, r.depth + 1 FROM r JOIN u ON u.source = r.node WHERE r.depth < 5), m AS (SELECT root, node, min(depth) AS depth FROM r WHERE node <> root GROUP BY ALL) SELECT root AS node_id, round(count(*) / sum(depth) * count(*) / ((SELECT count(*) FROM nodes) - 1), 9)::DOUBLE AS closeness FROM m GROUP BY ALL", True))
def closeness(spark, d):
    n = A.nodes(spark, d)
    seen = G.reach(G.undirected(A.edges(spark, d)), n.where("node_id like 'N-%'").select(F.col("node_id").alias("root")), 5)
    return G.closeness(seen, n.count()).withColumn("closeness", F.round("closeness", 9))


@query("connected_components", "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 400 AS a, l_suppkey % 400 + 400 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.1), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS root FROM r GROUP BY ALL")
def connected_components(spark, d):
    o, line = A.table(spark, d, "orders"), A.table(spark, d, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1")
    e = line.join(o, line["l_orderkey"] == o["o_orderkey"]).select((F.col("o_custkey") % 400).alias("source"), (F.col("l_suppkey") % 400 + 400).alias("target"))
    return G.components(e)


@query("betweenness", None)
def betweenness(spark, d):
    return G.betweenness(A.edges(spark, d).withColumn("case_id", F.lit("all")), "case_id")


@query("symmetric_adjacency", with_sql("edges", _U + ", l AS (SELECT source, target FROM u UNION SELECT DISTINCT source, source FROM u), g AS (SELECT source, count(*) AS n FROM l GROUP BY ALL) SELECT l.source, l.target, round(1 / sqrt(a.n * b.n), 9) AS weight FROM l JOIN g a ON a.source = l.source JOIN g b ON b.source = l.target"))
def symmetric_adjacency(spark, d):
    return G.normalised_adjacency(A.edges(spark, d)).withColumn("weight", F.round("weight", 9))


@query("mean_messages", with_sql("nodes edges", _D + ", o AS (SELECT node_id, (SELECT count(*) FROM d WHERE source = node_id)::DOUBLE AS x, (SELECT count(*) FROM d WHERE target = node_id)::DOUBLE AS y FROM nodes) SELECT target AS node_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM d JOIN o ON source = node_id GROUP BY ALL"))
def mean_messages(spark, d):
    deg = G.degrees(A.nodes(spark, d), A.edges(spark, d)).select("node_id", F.array(F.col("out_degree").cast("double"), F.col("in_degree").cast("double")).alias("features"))
    return G.mean_messages(deg, A.edges(spark, d)).select("node_id", F.round(F.col("features")[0], 6).alias("x"), F.round(F.col("features")[1], 6).alias("y"))


_PRIO = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.NODE_PRIORITY.items()) + " ELSE 0.1 END"
_SEVERITY = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SEVERITY_SCORE.items()) + " ELSE 0 END::DOUBLE"


@query("heuristic_baseline", with_sql("alerts nodes edges cross_edges", _U + f", a AS (SELECT node, max({_SEVERITY}) AS s FROM alerts GROUP BY ALL), n AS (SELECT count(*) AS n FROM nodes), p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM cross_edges), x AS (SELECT node_id, count(*) AS xd FROM (SELECT a AS node_id FROM p UNION ALL SELECT b FROM p) GROUP BY ALL), r AS (SELECT node_id AS node, 0 AS depth FROM nodes WHERE node_id IN (SELECT node FROM a) UNION SELECT u.target, r.depth + 1 FROM r JOIN u ON u.source = r.node WHERE r.depth < 12), q AS (SELECT node AS node_id, min(depth) AS depth FROM r GROUP BY ALL), s AS (SELECT node_id, 0.5::DOUBLE * coalesce(s, 0) + 0.2::DOUBLE * least(1, coalesce(xd, 0) / n) + 0.15::DOUBLE * {_PRIO} + 0.15::DOUBLE * (1 - coalesce(least(1, depth / n), 1)) AS score FROM nodes LEFT JOIN a ON node = node_id LEFT JOIN x USING (node_id) LEFT JOIN q USING (node_id), n) SELECT node_id, round(score / (SELECT sum(score) FROM s), 9) AS share FROM s", True))
def heuristic_baseline(spark, d):
    """Shares of a score of severity, links across diagrams, kind, and nearness to an alerted node."""
    n, al = G.cut(A.nodes(spark, d)), A.alerts(spark, d)
    a = G.cut(al.groupBy(F.col("node").alias("node_id")).agg(F.max(lookup(F.col("severity"), C.SEVERITY_SCORE, 0.0)).alias("s")))
    near = G.nearest_seed(G.undirected(A.edges(spark, d)), n.join(a, "node_id", "left_semi").select(F.col("node_id").alias("node"))).withColumnRenamed("node", "node_id")
    size = F.lit(float(max(1, n.count())))
    j = n.join(a, "node_id", "left").join(cross_degree(spark, d), "node_id", "left").join(near, "node_id", "left")
    far = F.coalesce(F.least(F.lit(1.0), F.col("depth") / size), F.lit(1.0))
    score = 0.5 * F.coalesce("s", F.lit(0.0)) + 0.2 * F.least(F.lit(1.0), F.coalesce("cross_degree", F.lit(0)) / size) + 0.15 * lookup(F.col("kind"), C.NODE_PRIORITY, 0.1) + 0.15 * (1 - far)
    s = j.select("node_id", score.alias("score"))
    return s.crossJoin(F.broadcast(s.agg(F.sum("score").alias("total")))).select("node_id", F.round(F.col("score") / F.col("total"), 9).alias("share"))


@query("propagation_features", with_sql("alerts edges", _D + ", f AS (SELECT node, min(t) AS t0, max(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.3 ELSE 0.1 END) AS s FROM alerts WHERE case_id = '2024-01-05' GROUP BY ALL), r AS (SELECT node AS root, node, 0 AS depth FROM f UNION SELECT r.root, d.target, r.depth + 1 FROM r JOIN d ON d.source = r.node WHERE r.depth < 5), p AS (SELECT DISTINCT root, node FROM r WHERE node <> root) SELECT a.node, count(b.node) AS downstream_alerted, count(*) FILTER (WHERE b.s <= 0.6) AS downstream_warning, count(*) FILTER (WHERE b.t0 >= a.t0) AS after_it FROM f a LEFT JOIN p ON p.root = a.node LEFT JOIN f b ON b.node = p.node GROUP BY ALL", True))
def propagation_features(spark, d):
    al = A.alerts(spark, d).where("case_id = '2024-01-05'")
    f = G.cut(al.groupBy("node").agg(F.min("t").alias("t0"), F.max(lookup(F.col("severity"), C.SEVERITY_SCORE, 0.0)).alias("s")))
    down = G.reach(G.directed(A.edges(spark, d)), f.select(F.col("node").alias("root")), 5).select(F.col("root").alias("node"), F.col("node").alias("other"))
    other = f.select(F.col("node").alias("other"), F.col("t0").alias("t1"), F.col("s").alias("s1"))
    j = f.join(down.join(other, "other"), "node", "left")
    return j.groupBy("node").agg(F.count("other").alias("downstream_alerted"), F.count_if(F.col("s1") <= 0.6).alias("downstream_warning"), F.count_if(F.col("t1") >= F.col("t0")).alias("after_it"))


#: Parts of an alert's type that fit a kind of device.
_FITS = {
    "firewall": ["packet", "drop", "deny", "policy", "firewall", "block"],
    "router": ["unreachable", "route", "bgp", "ospf", "link", "latency"],
    "database": ["database", "query", "sql", "db", "slow", "timeout"],
    "load_balancer": ["load", "balance", "pool", "upstream", "502", "503"],
    "server": ["cpu", "memory", "app", "service", "process", "crash"],
}
_FIT = "CASE WHEN " + " OR ".join(f"(kind = '{k}' AND regexp_matches(lower(alert_type), '{'|'.join(v)}'))" for k, v in _FITS.items()) + " THEN 0.5 ELSE 0 END::DOUBLE"


@query("topology_root_cause", with_sql("alerts nodes edges", _D + f", r AS (SELECT DISTINCT node AS root, node FROM alerts WHERE node IN (SELECT node_id FROM nodes) UNION SELECT r.root, d.target FROM r JOIN d ON d.source = r.node), n AS (SELECT root, count(DISTINCT node) - 1 AS desc_n FROM r GROUP BY ALL), s AS (SELECT case_id, node, round(sum(2 * CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + 10.0::DOUBLE / (1 + t) + 3.0::DOUBLE * desc_n / (SELECT count(*) FROM nodes) + {_FIT}), 6) AS score FROM alerts JOIN n ON root = node JOIN nodes ON node_id = node GROUP BY ALL), k AS (SELECT *, round(score / sum(score) OVER (PARTITION BY case_id), 6) AS share, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, node) AS INTEGER) AS rank FROM s) SELECT * FROM k WHERE rank <= 3", True))
def topology_root_cause(spark, d):
    """Three likely roots of a case: severity, earliness, share of the graph below, and whether the kind fits the alert."""
    al, kinds = A.alerts(spark, d), G.cut(A.nodes(spark, d).select(F.col("node_id").alias("node"), "kind"))
    reached = G.closure(A.edges(spark, d)).groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("desc_n"))
    weight = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    fit = F.lit(0.0)
    for kind, parts in _FITS.items():
        fit = F.when((F.col("kind") == kind) & F.lower("alert_type").rlike("|".join(parts)), 0.5).otherwise(fit)
    j = al.join(kinds, "node").join(reached, "node", "left")
    s = j.groupBy("case_id", "node").agg(F.round(F.sum(2 * weight + 10.0 / (1 + F.col("t")) + 3.0 * F.coalesce("desc_n", F.lit(0)) / F.lit(max(1, kinds.count())) + fit), 6).alias("score"))
    w = Window.partitionBy("case_id")
    k = s.withColumns({"share": F.round(F.col("score") / F.sum("score").over(w), 6), "rank": F.row_number().over(w.orderBy(F.desc("score"), "node"))})
    return k.where("rank <= 3")
