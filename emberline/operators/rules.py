"""Row rules: calibration, runbook scoring and policy, governance, tickets, rewards, reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calibrated(raw: Column, source: Column, scores: Column, n_diagrams: Column, n_evidence: Column) -> Column:
    """Confidence after the rules on source, margin of the two best, diagrams and evidence; between 0.05 and 1."""
    src = F.lower(F.coalesce(source, F.lit("")))
    gnn = F.contains(src, F.lit("gnn"))
    fallback = F.contains(src, F.lit("fallback")) | F.contains(src, F.lit("error")) | F.contains(src, F.lit("scenario_grounded"))
    c = F.when(F.coalesce(raw, F.lit(0.0)) <= 0, 0.10).otherwise(raw)
    c = F.when(fallback & ~gnn, F.least(c, F.lit(0.65))).otherwise(c)
    margin = F.get(scores, F.lit(0)) - F.get(scores, F.lit(1))
    boosted = F.least(F.lit(1.0), c + F.least(F.lit(0.06), margin * 0.12))
    c = F.when((F.size(scores) >= 2) & (margin >= 0.20), boosted).when((F.size(scores) >= 2) & (margin < 0.05), F.greatest(F.lit(0.10), c - 0.08)).otherwise(c)
    c = F.when(n_diagrams == 0, F.greatest(F.lit(0.10), c - 0.05)).otherwise(c)
    c = F.when(n_evidence < 2, F.greatest(F.lit(0.10), c - 0.05)).otherwise(c)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), c)), 4)


def band(c: Column) -> Column:
    return F.when(c >= 0.85, "very_high").when(c >= 0.75, "high").when(c >= 0.50, "medium").otherwise("low")


def runbook_score(runbook: dict, node_type: Column, alert_types: Column, root: Column, diagram: Column, cross: Column) -> Column:
    """Points of one runbook of the catalog for an incident."""
    n = F.when(node_type.isin(runbook["node_types"]), 3).otherwise(0)
    n = n + 2 * F.size(F.array_intersect(alert_types, F.array(*[F.lit(x) for x in runbook["alert_types"]])))
    if runbook["domain"] == "enterprise":
        n = n + F.when(cross, 2).otherwise(0)
    for text in (root, diagram):
        n = n + F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(runbook["domain"])).cast("int")
    return n


#: The runbook catalog: id, domain, kinds of nodes and of alerts, risk, automation.
RUNBOOKS = [
    {"id": "SEC-FW-001", "domain": "firewall", "node_types": ["firewall"], "alert_types": ["auth_errors", "packet_drop", "connection_timeout"], "risk": "high", "automation": False},
    {"id": "SEC-FW-002", "domain": "firewall", "node_types": ["firewall"], "alert_types": ["auth_errors", "link_errors", "packet_drop"], "risk": "medium", "automation": False},
    {"id": "NET-RTR-001", "domain": "router", "node_types": ["router", "wan"], "alert_types": ["route_flap", "packet_drop", "link_errors"], "risk": "high", "automation": False},
    {"id": "NET-WAN-001", "domain": "wan", "node_types": ["wan", "router"], "alert_types": ["latency", "packet_drop", "link_errors"], "risk": "medium", "automation": True},
    {"id": "APP-LB-001", "domain": "load_balancer", "node_types": ["load_balancer"], "alert_types": ["backend_pool_unhealthy", "user_timeout", "latency"], "risk": "high", "automation": True},
    {"id": "DB-REPL-001", "domain": "database", "node_types": ["database"], "alert_types": ["latency", "connection_timeout", "dependency_error"], "risk": "high", "automation": False},
    {"id": "INF-SRV-001", "domain": "server", "node_types": ["server", "compute"], "alert_types": ["cpu", "latency", "user_timeout"], "risk": "medium", "automation": True},
    {"id": "ENT-XDIAG-001", "domain": "enterprise", "node_types": ["router", "firewall", "load_balancer", "database", "server"], "alert_types": ["packet_drop", "latency", "connection_timeout", "auth_errors"], "risk": "critical", "automation": False},
]

_RISK_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def candidate_runbooks(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """Up to five runbooks with points for each incident (node_type, alert_types, root, diagram, n_diagrams), best first."""
    cross = F.col("n_diagrams") > 1
    offers = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(r["id"]).alias("runbook_id"), F.lit(r["domain"]).alias("domain"), F.lit(r["risk"]).alias("risk"), F.lit(r["automation"]).alias("automation"), F.array(*[F.lit(x) for x in r["node_types"]]).alias("node_types"), runbook_score(r, F.col("node_type"), F.col("alert_types"), F.col("root"), F.col("diagram"), cross).alias("score")) for k, r in enumerate(RUNBOOKS)])
    ranked = F.array_sort(F.transform(F.filter(offers, lambda o: o["score"] > 0), lambda o: F.struct((-o["score"]).alias("order"), o["place"].alias("place"), o.alias("r"))))
    best = F.slice(ranked, 1, 5)
    return incidents.select(*incidents.columns, F.posexplode(best).alias("rank", "_o")).select(*incidents.columns, (F.col("rank") + 1).alias("rank"), "_o.r.runbook_id", "_o.r.domain", "_o.r.risk", "_o.r.automation", "_o.r.node_types", "_o.r.score").dropDuplicates([*keys, "runbook_id"])


def rerank_score(source: Column, confidence: Column, node_type: Column, severity: Column, n_diagrams: Column) -> Column:
    """Second score of a candidate (risk, automation, node_types, domain) for its incident."""
    from emberline.functions.scalars import lookup

    near = F.abs(lookup(severity, _RISK_RANK, 2) - lookup(F.col("risk"), _RISK_RANK, 2)) <= 1
    parts = [
        (F.contains(F.lower(source), F.lit("gnn")) & (confidence >= 0.75), 0.25),
        (F.array_contains(F.col("node_types"), node_type), 0.40),
        (near, 0.15),
        ((n_diagrams > 1) & (F.col("domain") == "enterprise"), 0.20),
        ((confidence >= 0.80) & F.col("automation"), 0.10),
    ]
    return F.round(reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in parts]), 4)


def policy(confidence: Column, risk: Column, automation: Column) -> dict[str, Column]:
    """How a runbook may be run: approval, automation and mode; the most restrictive rule wins."""
    manual = (confidence < 0.50) | ((confidence >= 0.75) & (risk == "critical"))
    return {
        "approval_required": F.lit(True) | (confidence < 0.75) | risk.isin("critical", "high"),
        "automation_eligible": automation & ~manual,
        "execution_mode": F.when(manual, "manual_only").when(automation, "automated").otherwise("manual"),
    }


def governance(run: dict[str, Column]) -> dict[str, Column]:
    """Score, status and recommendation of a run.

    ``run`` has root, in_graph, source, confidence, n_evidence, has_plan,
    n_validation, n_rollback, n_graph_evidence, n_runbooks, risky, approval.
    """
    root = F.coalesce(run["root"], F.lit("")) != ""
    source = F.coalesce(run["source"], F.lit("")) != ""
    plan = run["has_plan"]
    cost = lambda c, n: F.when(c, n).otherwise(0)
    lost = [
        cost(~root, 25), cost(root & ~run["in_graph"], 5), cost(~source, 10), cost(run["confidence"] < 0.75, 10), cost(run["n_evidence"] < 2, 10),
        cost(plan & (run["n_validation"] == 0), 10), cost(plan & (run["n_rollback"] == 0), 15), cost(plan & (run["n_graph_evidence"] == 0), 5), cost(plan & (run["n_runbooks"] == 0), 5),
        cost(plan & run["risky"] & ~run["approval"], 20), cost(~plan, 10), cost(~run["approval"], 5),
    ]
    score = F.greatest(F.lit(0), F.lit(100) - reduce(lambda a, b: a + b, lost))
    blockers = F.array_compact(F.array(F.when(~root, F.lit("root cause is missing")), F.when(~source, F.lit("source is missing")), F.when(plan & (run["n_rollback"] == 0), F.lit("rollback notes are missing")), F.when(plan & run["risky"] & ~run["approval"], F.lit("risky actions without approval"))))
    blocked = F.size(blockers) > 0
    return {
        "score": score,
        "blocking": blockers,
        "status": F.when(blocked, "failed").when(score < 70, "warning").otherwise("passed"),
        "recommendation": F.when(blocked, "block_execution").when(score < 70, "needs_human_review").otherwise("approve_for_demo"),
    }


def ticket_priority(severity: Column, n_diagrams: Column) -> Column:
    return F.when((severity == "critical") | (n_diagrams >= 3), "P1").when((severity == "high") | (n_diagrams == 2), "P2").when(severity == "medium", "P3").otherwise("P4")


def blast(n_diagrams: Column, n_nodes: Column) -> Column:
    return F.when(n_diagrams >= 3, "enterprise-wide").when(n_diagrams == 2, "cross-diagram").when(n_nodes > 3, "diagram-wide").otherwise("local")


#: Weights of the eight text rewards.
REWARD_WEIGHTS = {"json_format": 0.16, "root_cause_match": 0.18, "grounded_node": 0.14, "no_hallucinated_device": 0.14, "validation_before_remediation": 0.12, "rollback_safety": 0.12, "enterprise_escalation": 0.08, "itsm_ticket_summary": 0.06}
#: Keys that a response, and its ticket, must have.
RESPONSE_KEYS = ["executive_summary", "probable_root_cause", "scope", "risk_level", "automation_eligibility", "blast_radius", "validation_steps", "remediation_steps", "rollback_or_safety_notes", "itsm_ticket_summary"]
TICKET_KEYS = ["short_description", "description", "affected_ci", "priority", "assignment_group"]


def rewards(response: Column, root: Column, nodes: Column, n_diagrams: Column) -> dict[str, Column]:
    """The eight rewards of a JSON response and their weighted total."""
    from emberline.functions.scalars import devices

    keys = F.coalesce(F.json_object_keys(response), F.array().cast("array<string>"))
    get = lambda k: F.get_json_object(response, f"$.{k}")
    length = lambda k: F.coalesce(F.json_array_length(get(k)), F.when(get(k).isNotNull() & (get(k) != ""), F.lit(1)).otherwise(F.lit(0)))
    n_required = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in RESPONSE_KEYS])))
    low, probable = F.lower(response), F.lower(F.coalesce(get("probable_root_cause"), F.lit("")))
    wanted = F.array_distinct(F.filter(F.array_append(nodes, root), lambda x: x.isNotNull() & (x != "")))
    cited = F.filter(wanted, lambda x: F.contains(response, x))
    named = F.array_distinct(devices(response))
    strange = F.size(F.array_except(named, F.transform(wanted, lambda x: F.upper(x))))
    v, r = F.instr(low, "validation"), F.instr(low, "remediation")
    both = (length("validation_steps") > 0) & (length("remediation_steps") > 0)
    guards = length("rollback_or_safety_notes") + length("do_not_execute_if")
    to = F.contains(low, F.lit("escalat")) & (F.contains(low, F.lit("enterprise")) | F.contains(low, F.lit("noc")) | F.contains(low, F.lit("sre")) | F.contains(low, F.lit("network")))
    ticket = reduce(lambda a, b: a + b, [(F.coalesce(F.get_json_object(response, f"$.itsm_ticket_summary.{k}"), F.lit("")) != "").cast("int") for k in TICKET_KEYS])
    out = {
        "json_format": n_required / F.lit(float(len(RESPONSE_KEYS))),
        "root_cause_match": F.when(root == "", 0.5).when(F.contains(probable, F.lower(root)), 1.0).when(F.contains(low, F.lower(root)), 0.5).otherwise(0.0),
        "grounded_node": F.when(F.size(wanted) == 0, 0.5).otherwise(F.size(cited) / F.greatest(F.size(wanted), F.lit(1))),
        "no_hallucinated_device": F.when(F.size(named) == 0, 0.6).otherwise(F.greatest(F.lit(0.0), 1 - strange / F.greatest(F.size(named), F.lit(1)))),
        "validation_before_remediation": F.when(~both, 0.0).when((v > 0) & (r > 0) & (v < r), 1.0).otherwise(0.7),
        "rollback_safety": F.when(guards >= 3, 1.0).when(guards >= 1, 0.5).otherwise(0.0),
        "enterprise_escalation": F.when((n_diagrams <= 1) | to, 1.0).otherwise(0.0),
        "itsm_ticket_summary": ticket / F.lit(float(len(TICKET_KEYS))),
    }
    out["total"] = F.round(reduce(lambda a, b: a + b, [F.lit(w) * out[k] for k, w in REWARD_WEIGHTS.items()]), 4)
    return out


def violations(*rules: tuple[Column, str]) -> Column:
    """The messages of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))
