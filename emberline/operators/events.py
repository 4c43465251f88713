"""Alert operators: deduplication, anchored windows, cluster dimensions, roles, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import constants as C
from emberline.functions.scalars import hop_score, pattern_matches, sequence_score, temporal_score, weighted
from emberline.operators.graph import cut, reach, undirected

WINDOW_MINUTES = 60


def dedup(alerts: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The first row, by ``order``, of each combination of ``keys``."""
    first = Window.partitionBy(*keys).orderBy(order)
    return alerts.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def anchored_windows(alerts: DataFrame, keys: list[str], time: str = "t", span: int = WINDOW_MINUTES) -> DataFrame:
    """``alerts`` with ``window_start``: a window takes all within ``span`` of its first event; the next event opens another.

    A gap over ``span`` always ends a window, so events are first cut there; the
    fold runs over the distinct times of one such run only.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    gap = F.coalesce((F.col(time) - F.lag(time).over(order) > span).cast("int"), F.lit(0))
    runs = alerts.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    anchors = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_set(time)).alias("_times"))
    kind = alerts.schema[time].dataType.simpleString()
    fold = F.aggregate("_times", F.array().cast(f"array<{kind}>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.coalesce(F.try_element_at(acc, F.lit(-1)), x) > span), F.array_append(acc, x)).otherwise(acc))
    anchors = anchors.select(*keys, "_run", fold.alias("_anchors"))
    return runs.join(anchors, [*keys, "_run"]).withColumn("window_start", F.array_max(F.filter("_anchors", lambda a: a <= F.col(time)))).drop("_gap", "_run", "_anchors")


def clusters(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each window: counts, span, ordered buckets and nodes, sorted diagrams."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "ordinal", "bucket", "node")))
    return (
        windowed.groupBy(*keys, "window_start")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min("t").alias("t_min"),
            F.max("t").alias("t_max"),
            ordered.alias("_events"),
            F.array_sort(F.collect_set("diagram_id")).alias("diagrams"),
        )
        .select(*keys, "window_start", "n_events", "t_min", "t_max", F.transform("_events", lambda e: e["bucket"]).alias("buckets"), F.array_distinct(F.transform("_events", lambda e: e["node"])).alias("nodes"), "diagrams")
    )


def peer_score(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the pairs of a window of 0.7 for one diagram and 0.3 for two, from counts by diagram."""
    by = windowed.groupBy(*keys, "window_start", "diagram_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    same = F.sum(F.when(F.coalesce(F.col("diagram_id"), F.lit("")) != "", pairs(F.col("n"))).otherwise(0.0))
    total = pairs(F.sum("n"))
    return by.groupBy(*keys, "window_start").agg(F.when(F.sum("n") < 2, 0.0).otherwise((0.3 * total + 0.4 * same) / F.when(total > 0, total)).alias("source_peer"))


def cluster_score(clusters_: DataFrame, enterprise: bool, topology: Column, peer: Column, cross: Column) -> DataFrame:
    """The five dimensions and their weighted score, halves of its last digit rounded up."""
    dims = {
        "temporal": temporal_score(F.col("t_max") - F.col("t_min")),
        "topology": topology,
        "alert_type_seq": sequence_score(pattern_matches(F.col("buckets"))),
        "source_peer": peer,
        "cross_diagram": cross,
    }
    score = weighted(dims, C.WEIGHTS_ENTERPRISE if enterprise else C.WEIGHTS_TOPOLOGY)
    return clusters_.select("*", *[v.alias(k) for k, v in dims.items()], F.round(score + 1e-9, 4).alias("cluster_score"))


#: Nodes with more neighbours are hubs.
HUB = 8


def hop_table(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How near the nodes (node_id) of a graph are, up to four hops, without their pairs.

    A way of four hops leads through a hub or through none. Nodes at the same
    distances from the same hubs are one class: (node, cls), and classes have the
    points (twentieths of a hop score) of the ways through hubs: (a, b, points),
    with a <= b. Pairs that a way without a hub brings nearer than that are few,
    as it branches little: (root, node, more), with root < node.
    """
    both = cut(undirected(edges))
    hubs = cut(both.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB).select(F.col("source").alias("root")))
    near = reach(both, hubs, 4).unionByName(hubs.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    signs = near.join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("root", "depth"))).alias("sign"))
    signs = cut(signs)
    names = cut(signs.groupBy("sign").agg(F.min("node").alias("cls")))
    classes = cut(signs.join(names, "sign").select("node", "cls"))
    of = names.select("cls", F.explode("sign").alias("s")).select("cls", "s.root", "s.depth")
    a, b = of.select("root", F.col("cls").alias("a"), F.col("depth").alias("_x")), of.select("root", F.col("cls").alias("b"), F.col("depth").alias("_y"))
    points = lambda hops: F.round(20 * hop_score(hops)).cast("long")
    through = a.join(b, "root").where((F.col("a") <= F.col("b")) & (F.col("_x") + F.col("_y") <= 4)).groupBy("a", "b").agg(F.min(F.col("_x") + F.col("_y")).alias("hops"))
    through = cut(through.select("a", "b", points(F.col("hops")).alias("points")))
    plain = both.join(hubs.withColumnRenamed("root", "source"), "source", "left_anti").join(hubs.withColumnRenamed("root", "target"), "target", "left_anti")
    plain = cut(plain.select("source", "target"))
    ways = reach(plain, plain.select(F.col("source").alias("root")).distinct(), 4).where("root < node")
    ways = ways.join(classes.select(F.col("node").alias("root"), F.col("cls").alias("_a")), "root", "left").join(classes.select("node", F.col("cls").alias("_b")), "node", "left")
    ways = ways.withColumns({"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")}).join(through, ["a", "b"], "left")
    more = points(F.col("depth")) - F.when(F.col("_a").isNull() | F.col("_b").isNull(), 0).otherwise(F.coalesce("points", F.lit(0)))
    return classes, through, cut(ways.select("root", "node", more.alias("more")).where("more > 0"))


def topology_score(windowed: DataFrame, keys: list[str], edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean hop score over the pairs of a window's nodes that the graph (``edges``, ``nodes``) has; from counts by class, no pairs are made."""
    at = [*keys, "window_start"]
    known = nodes.select(F.col("node_id").alias("node"))
    present = cut(windowed.select(*at, "node").distinct().join(known, "node", "left_semi").select(*at, "node"))
    classes, through, ways = hop_table(edges, nodes)
    size = present.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    by = cut(present.join(classes, "node").groupBy(*at, "cls").agg(F.count(F.lit(1)).alias("m")))
    a, b = by.select(*at, F.col("cls").alias("a"), F.col("m").alias("_x")), by.select(*at, F.col("cls").alias("b"), F.col("m").alias("_y"))
    many = F.when(F.col("a") == F.col("b"), F.col("_x") * (F.col("_x") - 1) / 2).otherwise(F.col("_x") * F.col("_y"))
    hubs = a.join(b, at).where("a <= b").join(through, ["a", "b"]).groupBy(*at).agg(F.sum(many * F.col("points")).alias("_p"))
    mine = present.withColumnRenamed("node", "root").join(ways, "root").join(present, [*at, "node"], "left_semi")
    nearer = mine.groupBy(*at).agg(F.sum("more").alias("_q"))
    total = F.coalesce("_p", F.lit(0.0)) + F.coalesce("_q", F.lit(0))
    j = size.join(hubs, at, "left").join(nearer, at, "left")
    return j.select(*at, (total / 20 / (F.col("n") * (F.col("n") - 1) / 2)).alias("topology"))


def cross_score(windowed: DataFrame, keys: list[str], links: DataFrame) -> DataFrame:
    """0 for a window of one diagram, 1 if ``links`` (source_diagram, target_diagram) join two of its diagrams, else 0.6."""
    of = windowed.where("diagram_id <> ''").select(*keys, "window_start", "diagram_id").distinct()
    size = of.groupBy(*keys, "window_start").agg(F.count(F.lit(1)).alias("n"))
    linked = links.where("source_diagram <> target_diagram").select("source_diagram", "target_diagram").distinct()
    a, b = of.withColumnRenamed("diagram_id", "source_diagram"), of.withColumnRenamed("diagram_id", "target_diagram")
    met = a.join(b, [*keys, "window_start"]).join(linked, ["source_diagram", "target_diagram"], "left_semi").select(*keys, "window_start").distinct().withColumn("met", F.lit(True))
    return size.join(met, [*keys, "window_start"], "left").select(*keys, "window_start", F.when(F.col("n") <= 1, 0.0).when(F.col("met"), 1.0).otherwise(0.6).alias("cross"))


def roles(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Each event's role: the seed, a propagation that continues a known sequence from the window's start, a peer of the seed's diagram, or noise.

    Known sequences have at most three items, so only the first two events
    before one are looked at.
    """
    w = Window.partitionBy(*keys, "window_start").orderBy("t", "ordinal")
    place = F.row_number().over(w)
    seed, second = F.first("bucket").over(w), F.nth_value("bucket", 2).over(w)
    out = windowed.withColumns({"place": place, "_seed": seed, "_second": second, "_diagram": F.first("diagram_id").over(w)})
    continues = F.lit(False)
    for p in C.PROPAGATION:
        for n in range(1, len(p)):
            before = F.col("_seed") == p[0]
            if n == 2:
                before = before & (F.col("_second") == p[1])
            continues = continues | ((F.col("place") == n + 1) & before & (F.col("bucket") == p[n]))
    role = F.when(F.col("place") == 1, "cluster_seed").when(continues, "propagation_signal").when((F.col("diagram_id") != "") & (F.col("diagram_id") == F.col("_diagram")), "peer_signal").otherwise("noise_candidate")
    return out.withColumn("role", role).drop("_seed", "_second", "_diagram")


def fingerprint(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """A window's fingerprint: sorted kinds of alerts and the first three sorted nodes, hashed."""
    by = windowed.groupBy(*keys, "window_start").agg(F.array_sort(F.collect_set("alert_type")).alias("kinds"), F.array_sort(F.collect_set("node")).alias("nodes"))
    text = F.concat(F.array_join("kinds", "|"), F.lit("@"), F.array_join(F.slice("nodes", 1, 3), "|"))
    return by.select(*keys, "window_start", F.substring(F.sha1(text.cast("binary")), 1, 12).alias("fingerprint"))
