"""Set operators on graphs: stitching, absorption, removal of a diagram, pair deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_shared(nodes: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each ``key``: the first by ``order``, with ``shared`` if the key is in several diagrams."""
    w = Window.partitionBy(key)
    out = nodes.withColumn("shared", F.count(F.lit(1)).over(w) > 1).withColumn("_n", F.row_number().over(w.orderBy(order)))
    return out.where("_n = 1").drop("_n")


def pair_dedup(edges: DataFrame, order: list) -> DataFrame:
    """One edge for each unordered pair of ends, the first by ``order``."""
    w = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_diagram(nodes: DataFrame, edges: DataFrame, diagram: str) -> tuple[DataFrame, DataFrame]:
    """Nodes outside a diagram, and edges that touch none of its nodes."""
    gone = nodes.where(F.col("diagram_id") == diagram).select("node_id")
    kept = edges.join(gone.withColumnRenamed("node_id", "source"), "source", "left_anti").join(gone.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), kept.select(*edges.columns)


def of_other_diagrams(nodes: DataFrame, edges: DataFrame, diagram: str) -> tuple[DataFrame, DataFrame]:
    """Nodes that any other diagram holds, shared ones too, and the edges between them."""
    stays = nodes.where(F.col("diagram_id") != diagram).select("node_id").distinct()
    kept = edges.join(stays.withColumnRenamed("node_id", "source"), "source", "left_semi").join(stays.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return nodes.join(stays, "node_id", "left_semi"), kept.select(*edges.columns)
