"""Queries over ranked candidates and rules: metrics, calibration, runbooks, governance, tickets, rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import constants as C
from emberline.functions.scalars import lookup
from emberline.operators import ranking as R
from emberline.operators import rules
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


_SEV = "CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.3 WHEN 'info' THEN 0.1 ELSE 0.0 END"
_RANKED = f", s AS (SELECT case_id, node, round(sum({_SEV}), 6) AS score, min(t) AS first_t, count(*) AS n FROM alerts GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, node) AS INTEGER) AS rank FROM s)"
_SPLIT = "CASE CAST(substr(case_id, 9, 2) AS INTEGER) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


def _ranked(spark, d):
    s = A.alerts(spark, d).groupBy("case_id", "node").agg(F.round(F.sum(lookup(F.col("severity"), C.SEVERITY_SCORE, 0.0)), 6).alias("score"), F.min("t").alias("first_t"), F.count(F.lit(1)).alias("n"))
    return R.rank_in(s, "case_id", "score", "node")


def _split():
    day = F.substring("case_id", 9, 2).cast("int") % 5
    return F.when(day == 0, "test").when(day == 1, "val").otherwise("train")


@query("rank_metrics_rollup", with_sql("alerts", _RANKED + f", x AS (SELECT case_id, arg_min(node, ordinal) AS node FROM alerts GROUP BY ALL), e AS (SELECT {_SPLIT} AS split, rank FROM r JOIN x USING (case_id, node)) SELECT split, count(*) AS n_cases, round(avg(CAST(rank = 1 AS INTEGER)), 6) AS top1, round(avg(CAST(rank <= 3 AS INTEGER)), 6) AS topk, round(avg(1 / rank), 6) AS mrr FROM e GROUP BY ROLLUP (split)"))
def rank_metrics_rollup(spark, d):
    truth = A.alerts(spark, d).groupBy("case_id").agg(F.min_by("node", "ordinal").alias("node"))
    return R.rank_metrics(_ranked(spark, d).withColumn("split", _split()), truth, "case_id", "split")


@query("candidate_margin", with_sql("alerts", _RANKED + ", m AS (SELECT case_id, node, score, rank, round(score - lead(score) OVER (PARTITION BY case_id ORDER BY rank), 6) AS margin FROM r) SELECT case_id, node, score, margin FROM m WHERE rank = 1"))
def candidate_margin(spark, d):
    return R.margin(_ranked(spark, d), "case_id", "score").withColumn("margin", F.round("margin", 6))


@query("hybrid_ranking", with_sql("alerts", _RANKED + ", h AS (SELECT case_id, node, round(0.75::DOUBLE * least(1.0, score / 20) + 0.25::DOUBLE * n / max(n) OVER (PARTITION BY case_id), 6) AS hybrid FROM r) SELECT * FROM h"))
def hybrid_ranking(spark, d):
    m = _ranked(spark, d).withColumn("model", F.least(F.lit(1.0), F.col("score") / 20))
    return R.hybrid(m, "case_id", "model", "n").select("case_id", "node", F.round("hybrid", 6).alias("hybrid"))


_CASES = _RANKED + ", c AS (SELECT case_id, max(score) / 20.0 AS raw, list(score / 20.0 ORDER BY rank) AS scores, CASE CAST(substr(case_id, 9, 2) AS INTEGER) % 3 WHEN 0 THEN 'Enterprise GNN RCA' WHEN 1 THEN 'graph fallback' ELSE 'rules' END AS source, CAST(substr(case_id, 9, 2) AS INTEGER) % 4 AS n_diagrams, CAST(substr(case_id, 9, 2) AS INTEGER) % 6 AS n_evidence FROM r GROUP BY ALL)"


def _cases(spark, d):
    day = F.substring("case_id", 9, 2).cast("int")
    c = _ranked(spark, d).groupBy("case_id").agg((F.max("score") / 20.0).alias("raw"), F.array_sort(F.collect_list(F.struct("rank", (F.col("score") / 20.0).alias("s")))).alias("x"))
    return c.select("case_id", "raw", F.transform("x", lambda v: v["s"]).alias("scores"), F.when(day % 3 == 0, "Enterprise GNN RCA").when(day % 3 == 1, "graph fallback").otherwise("rules").alias("source"), (day % 4).alias("n_diagrams"), (day % 6).alias("n_evidence"))


_CAL = ", k1 AS (SELECT *, CASE WHEN raw <= 0 THEN 0.1 ELSE raw END AS c1 FROM c), k2 AS (SELECT *, CASE WHEN contains(lower(source), 'fallback') THEN least(c1, 0.65) ELSE c1 END AS c2, scores[1] - scores[2] AS m FROM k1), k3 AS (SELECT *, CASE WHEN m >= 0.2 THEN least(1.0, c2 + least(0.06, m * 0.12)) WHEN m < 0.05 THEN greatest(0.1, c2 - 0.08) ELSE c2 END AS c3 FROM k2), k4 AS (SELECT *, CASE WHEN n_diagrams = 0 THEN greatest(0.1, c3 - 0.05) ELSE c3 END AS c4 FROM k3), k5 AS (SELECT *, CASE WHEN n_evidence < 2 THEN greatest(0.1, c4 - 0.05) ELSE c4 END AS c5 FROM k4), k AS (SELECT case_id, source, n_diagrams, n_evidence, round(least(1.0, greatest(0.05, c5)), 4)::DOUBLE AS confidence FROM k5)"


@query("calibrate_confidence", with_sql("alerts", _CASES + _CAL + " SELECT case_id, confidence, CASE WHEN confidence >= 0.85 THEN 'very_high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, confidence >= 0.75 AS passed FROM k"))
def calibrate_confidence(spark, d):
    c = _cases(spark, d).withColumn("confidence", rules.calibrated(F.col("raw"), F.col("source"), F.col("scores"), F.col("n_diagrams"), F.col("n_evidence")))
    return c.select("case_id", "confidence", rules.band(F.col("confidence")).alias("band"), (F.col("confidence") >= 0.75).alias("passed"))


_INC = ", i AS (SELECT case_id, arg_min(node, ordinal) AS node, list(DISTINCT bucket ORDER BY bucket) AS alert_types, arg_min(diagram_id, ordinal) AS diagram, count(DISTINCT diagram_id) AS n_diagrams, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS sev FROM alerts GROUP BY ALL), j AS (SELECT i.*, kind AS node_type FROM i JOIN nodes ON node = node_id)"
_CATALOG = ", b AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r['id']}', '{r['domain']}', '{r['risk']}', {str(r['automation']).lower()}, {r['node_types']}, {r['alert_types']})" for k, r in enumerate(rules.RUNBOOKS)) + ") AS v(place, runbook_id, domain, risk, automation, node_types, kinds))"
_POINTS = ", p AS (SELECT case_id, runbook_id, domain, risk, automation, node_types, node_type, n_diagrams, sev, place, 3 * CAST(list_contains(node_types, node_type) AS INTEGER) + 2 * len(list_intersect(alert_types, kinds)) + CASE WHEN domain = 'enterprise' AND n_diagrams > 1 THEN 2 ELSE 0 END + CAST(contains(lower(node), domain) AS INTEGER) + CAST(contains(lower(diagram), domain) AS INTEGER) AS score FROM j, b), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM p WHERE score > 0)"


def _incidents(spark, d):
    rank = lookup(F.col("severity"), C.SEVERITY_RANK, 0)
    i = A.alerts(spark, d).groupBy("case_id").agg(F.min_by("node", "ordinal").alias("root"), F.collect_set("bucket").alias("alert_types"), F.min_by("diagram_id", "ordinal").alias("diagram"), F.count_distinct("diagram_id").alias("n_diagrams"), F.max(rank).alias("sev"))
    return i.join(A.nodes(spark, d).select(F.col("node_id").alias("root"), F.col("kind").alias("node_type")), "root")


@query("runbook_match", with_sql("alerts nodes", _INC + _CATALOG + _POINTS + " SELECT case_id, runbook_id, rank, CAST(score AS INTEGER) AS score FROM q WHERE rank <= 5"))
def runbook_match(spark, d):
    return rules.candidate_runbooks(_incidents(spark, d), ["case_id"]).select("case_id", "runbook_id", "rank", "score")


@query("runbook_rerank", with_sql("alerts nodes", _INC + _CATALOG + _POINTS + ", z AS (SELECT case_id, runbook_id, round(0.25::DOUBLE + 0.4::DOUBLE * CAST(list_contains(node_types, node_type) AS INTEGER) + 0.15::DOUBLE * CAST(abs(sev - CASE risk WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) <= 1 AS INTEGER) + 0.2::DOUBLE * CAST(n_diagrams > 1 AND domain = 'enterprise' AS INTEGER) + 0.1::DOUBLE * CAST(automation AS INTEGER), 4) AS rerank_score FROM q WHERE rank <= 5) SELECT * FROM z"))
def runbook_rerank(spark, d):
    c = rules.candidate_runbooks(_incidents(spark, d), ["case_id"])
    names = F.element_at(F.array(*[F.lit(x) for x in ("info", "low", "medium", "high", "critical")]), F.col("sev") + 1)
    return c.select("case_id", "runbook_id", rules.rerank_score(F.lit("Enterprise GNN"), F.lit(0.9), F.col("node_type"), names, F.col("n_diagrams")).alias("rerank_score"))


@query("runbook_policy", with_sql("alerts nodes", _INC + _CATALOG + _POINTS + _CASES.replace(", s AS", ", s0 AS").replace(" FROM s)", " FROM s0)") + _CAL + " SELECT q.case_id, runbook_id, true AS approval_required, automation AND NOT (confidence < 0.5 OR (confidence >= 0.75 AND risk = 'critical')) AS automation_eligible, CASE WHEN confidence < 0.5 OR (confidence >= 0.75 AND risk = 'critical') THEN 'manual_only' WHEN automation THEN 'automated' ELSE 'manual' END AS execution_mode FROM q JOIN k USING (case_id) WHERE rank <= 5"))
def runbook_policy(spark, d):
    c = rules.candidate_runbooks(_incidents(spark, d), ["case_id"])
    conf = _cases(spark, d).select("case_id", rules.calibrated(F.col("raw"), F.col("source"), F.col("scores"), F.col("n_diagrams"), F.col("n_evidence")).alias("confidence"))
    p = rules.policy(F.col("confidence"), F.col("risk"), F.col("automation"))
    return c.join(conf, "case_id").select("case_id", "runbook_id", *[v.alias(k) for k, v in p.items()])


@query("governance_score", """WITH r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'S-1' END AS root, o_orderkey % 3 <> 0 AS in_graph, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'GNN' END AS source, (o_orderkey % 100) / 100.0 AS confidence, o_orderkey % 4 AS n_evidence, o_orderkey % 5 <> 0 AS has_plan, o_orderkey % 2 AS nv, o_orderkey % 7 AS nr, o_orderkey % 3 AS ng, o_orderkey % 6 AS nb, o_orderkey % 10 = 1 AS risky, o_orderkey % 4 <> 1 AS approval FROM orders),
    s AS (SELECT *, greatest(0, 100 - CASE WHEN root = '' THEN 25 ELSE 0 END - CASE WHEN root <> '' AND NOT in_graph THEN 5 ELSE 0 END - CASE WHEN source = '' THEN 10 ELSE 0 END - CASE WHEN confidence < 0.75 THEN 10 ELSE 0 END - CASE WHEN n_evidence < 2 THEN 10 ELSE 0 END - CASE WHEN has_plan AND nv = 0 THEN 10 ELSE 0 END - CASE WHEN has_plan AND nr = 0 THEN 15 ELSE 0 END - CASE WHEN has_plan AND ng = 0 THEN 5 ELSE 0 END - CASE WHEN has_plan AND nb = 0 THEN 5 ELSE 0 END - CASE WHEN has_plan AND risky AND NOT approval THEN 20 ELSE 0 END - CASE WHEN NOT has_plan THEN 10 ELSE 0 END - CASE WHEN NOT approval THEN 5 ELSE 0 END) AS score, root = '' OR source = '' OR (has_plan AND nr = 0) OR (has_plan AND risky AND NOT approval) AS blocked FROM r)
    SELECT run_id, CAST(score AS INTEGER) AS score, CASE WHEN blocked THEN 'failed' WHEN score < 70 THEN 'warning' ELSE 'passed' END AS status, CASE WHEN blocked THEN 'block_execution' WHEN score < 70 THEN 'needs_human_review' ELSE 'approve_for_demo' END AS recommendation FROM s""")
def governance_score(spark, d):
    k = F.col("o_orderkey")
    run = {"root": F.when(k % 11 == 0, "").otherwise("S-1"), "in_graph": k % 3 != 0, "source": F.when(k % 13 == 0, "").otherwise("GNN"), "confidence": (k % 100) / 100.0, "n_evidence": k % 4, "has_plan": k % 5 != 0, "n_validation": k % 2, "n_rollback": k % 7, "n_graph_evidence": k % 3, "n_runbooks": k % 6, "risky": k % 10 == 1, "approval": k % 4 != 1}
    g = rules.governance(run)
    return A.table(spark, d, "orders").select(k.alias("run_id"), g["score"].alias("score"), g["status"].alias("status"), g["recommendation"].alias("recommendation"))


@query("itsm_priority", with_sql("alerts nodes", _INC + " SELECT case_id, CASE WHEN sev = 4 OR n_diagrams >= 3 THEN 'P1' WHEN sev = 3 OR n_diagrams = 2 THEN 'P2' WHEN sev = 2 THEN 'P3' ELSE 'P4' END AS priority, 'INC-' || upper(substr(md5(case_id || node), 1, 6)) AS ticket_id, CASE WHEN n_diagrams >= 3 THEN 'enterprise-wide' WHEN n_diagrams = 2 THEN 'cross-diagram' ELSE 'local' END AS blast FROM j"))
def itsm_priority(spark, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("info", "low", "medium", "high", "critical")]), F.col("sev") + 1)
    return _incidents(spark, d).select("case_id", rules.ticket_priority(names, F.col("n_diagrams")).alias("priority"), F.concat(F.lit("INC-"), F.upper(F.substring(F.md5(F.concat("case_id", "root").cast("binary")), 1, 6))).alias("ticket_id"), rules.blast(F.col("n_diagrams"), F.lit(0)).alias("blast"))


_RESP = """WITH r AS (SELECT s_suppkey AS id, 'S-' || s_suppkey AS root, s_suppkey % 3 AS nd,
    '{"executive_summary": "x", "probable_root_cause": "node S-' || (s_suppkey - s_suppkey % 2) || ' failed", "scope": "local", "validation_steps": ["check DC-FW-0' || s_suppkey % 10 || '"], "remediation_steps": ["restart"], "rollback_or_safety_notes": ' || CASE s_suppkey % 3 WHEN 0 THEN '["a", "b", "c"]' WHEN 1 THEN '["a"]' ELSE '[]' END || ', "itsm_ticket_summary": {"short_description": "s", "priority": "P' || s_suppkey % 4 || '"}' || CASE WHEN s_suppkey % 4 = 0 THEN ', "note": "escalate to network NOC"' ELSE '' END || '}' AS resp FROM supplier)"""


@query("reward_total", _RESP + """, x AS (SELECT *, contains(lower(resp), lower(root)) AS anywhere, contains(lower(json_extract_string(resp, '$.probable_root_cause')), lower(root)) AS exact FROM r)
    SELECT id, 0.7::DOUBLE AS json_format, CASE WHEN exact THEN 1.0 WHEN anywhere THEN 0.5 ELSE 0.0 END::DOUBLE AS root_cause_match, CASE WHEN anywhere THEN 1.0 ELSE 0.0 END::DOUBLE AS grounded_node, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS rollback_safety, CASE WHEN nd <= 1 OR id % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS enterprise_escalation, 0.4::DOUBLE AS itsm_ticket_summary FROM x""")
def reward_total(spark, d):
    k = F.col("s_suppkey")
    s = k.cast("string")
    resp = F.concat(F.lit('{"executive_summary": "x", "probable_root_cause": "node S-'), (k - k % 2).cast("string"), F.lit(' failed", "scope": "local", "validation_steps": ["check DC-FW-0'), (k % 10).cast("string"), F.lit('"], "remediation_steps": ["restart"], "rollback_or_safety_notes": '), F.when(k % 3 == 0, '["a", "b", "c"]').when(k % 3 == 1, '["a"]').otherwise("[]"), F.lit(', "itsm_ticket_summary": {"short_description": "s", "priority": "P'), (k % 4).cast("string"), F.lit('"}'), F.when(k % 4 == 0, ', "note": "escalate to network NOC"').otherwise(""), F.lit("}"))
    r = rules.rewards(F.col("resp"), F.col("root"), F.array().cast("array<string>"), F.col("nd"))
    keep = ("json_format", "root_cause_match", "grounded_node", "rollback_safety", "enterprise_escalation", "itsm_ticket_summary")
    return A.table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("S-"), s).alias("root"), (k % 3).alias("nd"), resp.alias("resp")).select("id", *[r[c].cast("double").alias(c) for c in keep])


@query("fallback_ranking", with_sql("alerts", f", e AS (SELECT case_id, node, {_SEV} AS s, t, ordinal FROM alerts), o AS (SELECT *, row_number() OVER (PARTITION BY case_id, node ORDER BY s DESC, t, ordinal) AS n FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, t, ordinal) AS r FROM o WHERE n = 1) SELECT case_id, node, CAST(r AS INTEGER) AS rank, round(greatest(0.1, s - 0.2 * (r - 1)), 6)::DOUBLE AS score FROM k WHERE r <= 3"))
def fallback_ranking(spark, d):
    e = A.alerts(spark, d).withColumn("s", lookup(F.col("severity"), C.SEVERITY_SCORE, 0.0))
    order = [F.desc("s"), "t", "ordinal"]
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "node").orderBy(*order))).where("n = 1")
    r = F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    return first.withColumn("rank", r).where("rank <= 3").select("case_id", "node", "rank", F.round(F.greatest(F.lit(0.1), F.col("s") - 0.2 * (F.col("rank") - 1)), 6).alias("score"))


@query("stratified_quota", with_sql("alerts", f", c AS (SELECT case_id, diagram_id, count(*) AS n, {_SPLIT} AS split FROM alerts GROUP BY ALL) SELECT case_id, diagram_id, split FROM c QUALIFY row_number() OVER (PARTITION BY diagram_id ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, case_id) <= 4"))
def stratified_quota(spark, d):
    c = A.alerts(spark, d).groupBy("case_id", "diagram_id").agg(F.count(F.lit(1)).alias("n")).withColumn("split", _split())
    pref = F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).otherwise(2)
    return c.withColumn("r", F.row_number().over(Window.partitionBy("diagram_id").orderBy(pref, "case_id"))).where("r <= 4").select("case_id", "diagram_id", "split")


@query("ml_ranking", None)
def ml_ranking(spark, d):
    """A forest on alert features; trained on two splits, scored on the third."""
    from pyspark.ml.functions import vector_to_array

    truth = A.alerts(spark, d).groupBy("case_id").agg(F.min_by("node", "ordinal").alias("truth"))
    f = _ranked(spark, d).join(truth, "case_id").join(A.nodes(spark, d).select(F.col("node_id").alias("node"), "kind"), "node").withColumns({"label": (F.col("node") == F.col("truth")).cast("double"), "split": _split()})
    model = R.pipeline(["kind"], ["score", "first_t", "n"], 10).fit(R.balanced(f.where("split <> 'test'"), "label"))
    out = model.transform(f.where("split = 'test'")).select("case_id", "node", vector_to_array("probability")[1].alias("p"))
    return R.rank_in(out, "case_id", "p", "node").where("rank <= 3").select("case_id", "node", "rank")
