"""Hand-computed cases of single operators."""

import pytest
from pyspark.sql import functions as F

from emberline.functions import scalars as S
from emberline.operators import copilot, datasets, detection, events, graph, ranking, retrieval, rules, topology


def alerts(spark, rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], "case_id string, ordinal long, t int, node string, diagram_id string, alert_type string, severity string").withColumn("bucket", S.alert_bucket(F.col("alert_type")))


def one(df):
    return df.first().asDict()


def test_windows_take_sixty_minutes_from_their_first_event(spark):
    a = alerts(spark, [(t, "n", "A", "latency", "low") for t in (0, 60, 61, 121, 122, 300)])
    got = {r.t: r.window_start for r in events.anchored_windows(a, ["case_id"]).collect()}
    assert got == {0: 0, 60: 0, 61: 61, 121: 61, 122: 122, 300: 300}


def test_dedup_keeps_the_first_row_of_equal_keys(spark):
    a = alerts(spark, [(5, "n", "A", "latency", "low"), (5, "n", "A", "latency", "low"), (5, "n", "A", "latency", "high")])
    got = events.dedup(a, ["node", "alert_type", "severity", "t", "diagram_id"])
    assert sorted(r.ordinal for r in got.collect()) == [0, 2]
    assert events.dedup(got, ["node", "alert_type", "severity", "t", "diagram_id"]).count() == 2


def test_roles_and_patterns_of_a_spreading_fault(spark):
    a = alerts(spark, [(0, "a", "A", "link_errors", "low"), (1, "b", "B", "packet_drop", "low"), (2, "c", "B", "connection_timeout", "low")])
    w = events.anchored_windows(a, ["case_id"])
    assert [r.role for r in events.roles(w, ["case_id"]).orderBy("ordinal").collect()] == ["cluster_seed", "propagation_signal", "propagation_signal"]
    m = events.clusters(w, ["case_id"]).select(S.pattern_matches(F.col("buckets")).alias("m")).first()["m"]
    assert m == 3


def test_a_broken_prefix_is_noise_and_still_matches_as_a_subsequence(spark):
    a = alerts(spark, [(0, "a", "A", "link_errors", "low"), (1, "b", "B", "strange", "low"), (2, "c", "B", "packet_drop", "low")])
    w = events.anchored_windows(a, ["case_id"])
    assert [r.role for r in events.roles(w, ["case_id"]).orderBy("ordinal").collect()] == ["cluster_seed", "noise_candidate", "noise_candidate"]
    m = S.pattern_matches(F.col("buckets"))
    assert events.clusters(w, ["case_id"]).select(F.round(S.sequence_score(m), 2).alias("s")).first()["s"] == 0.70


def test_peer_score_is_the_mean_over_pairs(spark):
    a = alerts(spark, [(0, "a", "A", "x", "low"), (1, "b", "A", "x", "low"), (2, "c", "B", "x", "low")])
    got = events.peer_score(events.anchored_windows(a, ["case_id"]), ["case_id"]).first()["source_peer"]
    assert got == pytest.approx((0.7 + 0.3 + 0.3) / 3)


def test_calibration(spark):
    df = spark.createDataFrame([(0.70, "Enterprise GNN RCA", [0.9, 0.5], 2, 5), (0.9, "fallback", [0.9], 0, 1), (0.0, "", [], 3, 2)], "raw double, source string, scores array<double>, d int, e int")
    c = df.select(rules.calibrated(F.col("raw"), F.col("source"), F.col("scores"), F.col("d"), F.col("e")).alias("c"))
    assert [r.c for r in c.collect()] == [0.748, 0.55, 0.1]
    assert [r.b for r in c.select(rules.band(F.col("c")).alias("b")).collect()] == ["medium", "medium", "low"]


def test_policy(spark):
    df = spark.createDataFrame([(0.49, "low"), (0.74, "low"), (0.9, "critical"), (0.9, "high"), (0.9, "medium")], "c double, risk string")
    p = rules.policy(F.col("c"), F.col("risk"), F.lit(True))
    assert [r[0] for r in df.select(p["execution_mode"]).collect()] == ["manual_only", "automated", "manual_only", "automated", "automated"]


def test_governance(spark):
    base = {"root": "'S-1'", "in_graph": "true", "source": "'GNN'", "confidence": "0.8D", "n_evidence": "3", "has_plan": "false", "n_validation": "1", "n_rollback": "1", "n_graph_evidence": "1", "n_runbooks": "1", "risky": "false", "approval": "true"}

    def run(**over):
        g = rules.governance({k: F.expr(v) for k, v in {**base, **over}.items()})
        return one(spark.range(1).select(*[v.alias(k) for k, v in g.items()]))

    assert (run()["score"], run()["status"], run()["recommendation"]) == (90, "passed", "approve_for_demo")
    assert run(has_plan="true", n_rollback="0")["recommendation"] == "block_execution"
    assert run(has_plan="true", risky="true", approval="false")["status"] == "failed"


def test_a_named_device_that_is_not_known_costs_half(spark):
    r = rules.rewards(F.lit("DC-FW-01 and APP-LB-2"), F.lit("DC-FW-01"), F.array().cast("array<string>"), F.lit(1))
    assert spark.range(1).select(r["no_hallucinated_device"].alias("x")).first()["x"] == 0.5


def test_boxes(spark):
    a = {k: F.lit(float(v)) for k, v in zip(("x1", "y1", "x2", "y2"), (0, 0, 10, 10))}
    b = {k: F.lit(float(v)) for k, v in zip(("x1", "y1", "x2", "y2"), (5, 0, 15, 10))}
    assert spark.range(1).select(S.iou(a, b).alias("i")).first()["i"] == pytest.approx(1 / 3)
    assert spark.range(1).select(S.point_to_box(F.lit(13.0), F.lit(14.0), a).alias("d")).first()["d"] == 5.0


def test_average_precision(spark):
    s = spark.createDataFrame([("k", 0.9, True, 2), ("k", 0.8, False, 2), ("k", 0.7, True, 2)], "k string, c double, hit boolean, n int")
    assert detection.average_precision(s, "k", [F.desc("c")], "hit", "n").first()["ap"] == pytest.approx(0.791667, abs=1e-6)


def test_matching_is_one_to_one(spark):
    box = "image int, id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    det = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 0.0, 10.0, 9.0), (1, 3, 0.7, 50.0, 50.0, 60.0, 60.0)], box)
    truth = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0, 10.0, 10.0), (1, 8, 0.0, 0.0, 1.0, 10.0, 10.0)], box)
    got = {r.id: r.t_id for r in detection.match(det, truth, ["image"], 0.5).collect()}
    assert got == {1: 7, 2: 8, 3: None}
    assert sorted(r.id for r in detection.suppress(det, "image", 0.5).collect()) == [1, 3]


def test_chunks_of_2500_characters(spark):
    got = spark.createDataFrame([("x" * 2500,), ("",), (None,)], "text string").select(F.transform(S.windows(F.col("text")), F.length).alias("n")).collect()
    assert [r.n for r in got] == [[1200, 1200, 400], [], []]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_a_cycle_does_not_reach_itself(spark):
    got = graph.reach(edges(spark, [("A", "B"), ("B", "C"), ("C", "A")]), spark.createDataFrame([("A",)], "root string"))
    assert sorted(r.node for r in got.collect()) == ["B", "C"]


def test_betweenness_closeness_and_rank(spark):
    path = edges(spark, [("A", "B"), ("B", "C"), ("C", "D")])
    got = {r.node_id: r.betweenness for r in graph.betweenness(path.withColumn("g", F.lit(1)), "g").collect()}
    assert got == {"A": 0, "B": pytest.approx(2 / 6), "C": pytest.approx(2 / 6), "D": 0}
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "node_id string")
    assert sum(r["rank"] for r in graph.pagerank(nodes, path, 30).collect()) == pytest.approx(1)


def test_shared_nodes_of_two_diagrams(spark):
    n = spark.createDataFrame([("x", "A", 1), ("x", "B", 2), ("y", "B", 3)], "node_id string, diagram_id string, o int")
    got = {r.node_id: (r.diagram_id, r.shared) for r in topology.merge_shared(n, "node_id", "o").collect()}
    assert got == {"x": ("A", True), "y": ("B", False)}
    e = edges(spark, [("x", "y"), ("y", "z")])
    assert topology.without_diagram(n, e, "A")[1].count() == 1
    assert topology.of_other_diagrams(n, e, "A")[0].count() == 3


def test_questions():
    assert copilot.parse("what is at 10.0.0.1?") == ("nodes_by_ip", ("10.0.0.1",))
    assert copilot.parse("if 'a b' should fail?") == ("blast_radius", ("a b",))
    assert copilot.parse("neighbours of DC-FW-01") == ("neighbors", ("DC-FW-01",))
    assert copilot.parse("path from A-1 to B-2") == ("impact_path", ("A-1", "B-2"))
    assert copilot.parse("hello") == ("none", ())


def test_domains_and_order(spark):
    df = spark.createDataFrame([("DC-FW-01",), ("oracle",), ("db-7",), ("x",)], "t string").select(retrieval.domain(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == ["firewall", "firewall", "database", ""]


def test_splits_cover_all(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    s = datasets.ordered_split(df, "k", 0.8).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 9, "val": 2}
    assert ranking.margin(ranking.rank_in(spark.createDataFrame([("c", "a", 1.0)], "c string, node string, s double"), "c", "s", "node"), "c", "s").first()["margin"] is None
