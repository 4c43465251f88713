"""Questions about a topology: one method for each, and a dispatcher from text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import graph as G


class GraphQueries:
    """Answers over nodes (node_id, kind, diagram_id[, ip]), edges and cross edges, as DataFrames."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, cross: DataFrame, root: DataFrame | None = None):
        self.nodes, self.edges, self.cross, self.root = nodes, edges, cross, root

    def node_by_id(self, node: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node)

    def nodes_by_ip(self, ip: str) -> DataFrame:
        return self.nodes.where(F.col("ip") == ip) if "ip" in self.nodes.columns else self.nodes.limit(0)

    def node_info(self, node: str) -> DataFrame:
        d = G.degrees(self.node_by_id(node), self.edges.where((F.col("source") == node) | (F.col("target") == node)))
        return self.node_by_id(node).join(d, "node_id")

    def neighbors(self, node: str) -> DataFrame:
        return G.neighbours(self.edges, node)

    def edges_between(self, a: str, b: str) -> DataFrame:
        e = self.edges.select("source", "target").unionAll(self.cross.select("source", "target"))
        ab, ba = (F.col("source") == a) & (F.col("target") == b), (F.col("source") == b) & (F.col("target") == a)
        return e.where(ab | ba).orderBy(F.when(ab, 0).otherwise(1))

    def diagrams_for_node(self, node: str) -> DataFrame:
        return self.node_by_id(node).select("diagram_id").distinct()

    def cross_links(self) -> DataFrame:
        return self.cross

    def root_cause(self) -> DataFrame | None:
        return self.root

    def impacted_diagrams(self, node: str) -> DataFrame:
        return self.blast_radius(node).join(self.nodes.withColumnRenamed("node_id", "node"), "node").select("diagram_id").distinct()

    def impact_path(self, node: str, target: str) -> DataFrame:
        spark = self.nodes.sparkSession
        return G.paths(G.directed(self.edges), spark.createDataFrame([(node,)], "root string")).where(F.col("node") == target)

    def blast_radius(self, node: str, most: int = 50, include_cross: bool = False) -> DataFrame:
        e = self.edges.select("source", "target")
        if include_cross:
            e = e.unionAll(self.cross.select("source", "target"))
        spark = self.nodes.sparkSession
        return G.reach(G.directed(e), spark.createDataFrame([(node,)], "root string")).orderBy("depth", "node").limit(most)

    def upstream_path(self, node: str, hops: int = 8) -> DataFrame:
        return G.upstream(self.edges, node, hops)


def parse(question: str) -> tuple[str, tuple]:
    """The method that a question asks for, and its arguments; the first rule that fits."""
    low, names = question.lower(), re.findall(r"'([^']+)'|\b([A-Z]+-[A-Z0-9-]+)\b", question)
    nodes = [a or b for a, b in names]
    ip = re.search(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", question)
    if ip:
        return "nodes_by_ip", (ip.group(),)
    if nodes and re.search(r"blast|impact of|affected|if .*fail", low):
        return "blast_radius", (nodes[0],)
    if nodes and "upstream" in low:
        return "upstream_path", (nodes[0],)
    if nodes and re.search(r"neighbo|connected to", low):
        return "neighbors", (nodes[0],)
    if len(nodes) > 1 and re.search(r"between|edge|link", low):
        return "edges_between", (nodes[0], nodes[1])
    if nodes and re.search(r"which diagram|diagram.*node|diagrams? (?:of|for)", low):
        return "diagrams_for_node", (nodes[0],)
    if nodes and "impacted diagram" in low:
        return "impacted_diagrams", (nodes[0],)
    if "root cause" in low:
        return "root_cause", ()
    if len(nodes) > 1 and "path" in low:
        return "impact_path", (nodes[0], nodes[1])
    if "cross" in low:
        return "cross_links", ()
    return ("node_info", (nodes[0],)) if nodes else ("none", ())


def answer(q: GraphQueries, question: str) -> DataFrame | None:
    """The answer to a question, or None if no rule fits."""
    method, args = parse(question)
    return None if method == "none" else getattr(q, method)(*args)
