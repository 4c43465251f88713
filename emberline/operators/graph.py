"""Graph operators over node and edge tables, by rounds of frontier joins.

Each round's result is checkpointed in the shared folder of
``spark.checkpoint.dir``, so a plan never holds more than one round.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def directed(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends and no loop."""
    return edges.where("source <> '' and target <> '' and source <> target").select("source", "target").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each distinct pair of ends in both directions."""
    e = directed(edges)
    return e.union(e.select("target", "source")).distinct()


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth: all that each root (a table with ``root``) reaches, itself left out, at its least depth.

    Without ``max_depth`` rounds go on until none finds a further node.
    """
    edges = cut(edges.select("source", "target"))
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["source"]).select("root", F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen.where("depth > 0")


def closure(edges: DataFrame) -> DataFrame:
    """root, node, depth: all that each node reaches, itself left out, at its least depth; for every node as a root.

    Lengths double: a pair more than ``far`` and at most twice as far apart has a
    node at ``far`` from its root on the way, so the rounds are the logarithm of
    the longest distance, and what is found is never written again.
    """
    e = directed(edges)
    names = cut(e.select(F.col("source").alias("name")).union(e.select("target")).distinct().withColumn("id", F.monotonically_increasing_id()))
    tail, head = (names.select(F.col("name").alias(c), F.col("id").alias(i)) for c, i in (("source", "root"), ("target", "node")))
    last = cut(e.join(tail, "source").join(head, "target").select("root", "node", F.lit(1).alias("depth")))
    seen = last
    for k in itertools.count():
        far = 1 << k
        on = last.where(F.col("depth") == far).select("root", F.col("node").alias("mid"))
        step = on.join(seen.select(F.col("root").alias("mid"), "node", "depth"), "mid").where("root <> node")
        step = step.groupBy("root", "node").agg((F.min("depth") + far).alias("depth"))
        last = cut(step.join(seen, ["root", "node"], "left_anti"))
        if last.isEmpty():
            break
        seen = seen.union(last)
    named = seen.join(tail, "root").drop("root").join(head, "node").drop("node")
    return named.select(F.col("source").alias("root"), F.col("target").alias("node"), "depth")


def nearest_seed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, depth: how far each node is from the nearest of ``seeds`` (node), those at 0; one frontier for all seeds."""
    edges = cut(edges.select("source", "target"))
    frontier = cut(seeds.select("node", F.lit(0).alias("depth")).distinct())
    seen = frontier
    for depth in itertools.count(1):
        step = frontier.join(edges, frontier["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))


def paths(edges: DataFrame, roots: DataFrame, max_depth: int = 8) -> DataFrame:
    """root, node, depth, path: one shortest path to each reached node; the smallest by its text where several are."""
    edges = cut(edges.select("source", "target"))
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["source"]).select("root", F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path"))
        best = step.groupBy("root", "node").agg(F.min("path").alias("path"))
        frontier = cut(best.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, out_degree, in_degree, degree, is_source, is_sink."""
    e = directed(edges)
    out = e.groupBy(F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = e.groupBy(F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = nodes.select("node_id").join(out, "node_id", "left").join(into, "node_id", "left").na.fill(0, ["out_degree", "in_degree"])
    return both.select("node_id", "out_degree", "in_degree", (F.col("out_degree") + F.col("in_degree")).alias("degree"), (F.col("in_degree") == 0).alias("is_source"), (F.col("out_degree") == 0).alias("is_sink"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 0.85) -> DataFrame:
    """node_id, rank after a fixed number of rounds; nodes without an out edge give to all."""
    e = directed(edges)
    out = e.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    links = cut(e.join(out, "source").select("source", "target", (F.lit(1.0) / F.col("n")).alias("w")))
    total = nodes.select("node_id").distinct().count()
    rank = cut(nodes.select("node_id").distinct().withColumn("rank", F.lit(1.0 / max(1, total))))
    for _ in range(rounds):
        given = rank.join(links, rank["node_id"] == links["source"]).groupBy(F.col("target").alias("node_id")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        loose = rank.join(links.select(F.col("source").alias("node_id")).distinct(), "node_id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        rank = cut(rank.select("node_id").join(given, "node_id", "left").crossJoin(F.broadcast(loose)).select("node_id", (F.lit((1 - alpha) / total) + F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / total)).alias("rank")))
    return rank


def closeness(distances: DataFrame, n_nodes: int) -> DataFrame:
    """node_id, closeness from root-to-node distances, scaled by the share of nodes that are reached."""
    by = distances.groupBy(F.col("root").alias("node_id")).agg(F.count(F.lit(1)).alias("r"), F.sum("depth").alias("s"))
    return by.select("node_id", (F.col("r") / F.col("s") * F.col("r") / F.lit(max(1, n_nodes - 1))).alias("closeness"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, by alternating large-star and small-star rounds."""
    old = cut(edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    mark = None
    while True:
        both = old.union(old.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        head = large.groupBy("u").agg(F.min("v").alias("m"))
        old = cut(large.join(head, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(head.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(old.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return old.select(F.col("u").alias("node"), F.col("v").alias("root")).union(old.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Parts at most into which the sources of a graph are dealt.
PARTS = 64


def betweenness(edges: DataFrame, key: str) -> DataFrame:
    """key, node_id, betweenness: normalised, directed, of each graph named by ``key``.

    The sources of a graph are dealt to tasks, each of which has the graph's
    edges: the cost grows with nodes times edges, so a graph that can be done at
    all fits a task. What a source costs depends on what it reaches only.
    """
    e = cut(edges.select(key, "source", "target").distinct())
    nodes = cut(e.select(key, F.col("source").alias("node_id")).union(e.select(key, "target")).distinct())
    sizes = nodes.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    sized = cut(nodes.join(F.broadcast(sizes), F.col(key).eqNullSafe(F.col("_of"))).drop("_of"))
    dealt = sized.select(key, "node_id", F.pmod(F.xxhash64("node_id"), F.least(F.lit(PARTS), F.ceil(F.col("n") / 64))).alias("part"))
    parts = cut(dealt.select(F.col(key).alias("_key"), F.col("part").alias("_part")).distinct())
    copies = e.join(parts, F.col(key).eqNullSafe(F.col("_key"))).select("_key", "_part", "source", "target")

    def brandes(sources: pa.Table, graph: pa.Table) -> pa.Table:
        names, at = np.unique(np.concatenate([graph.column(c).to_numpy() for c in ("source", "target")]), return_inverse=True)
        tails, heads = np.split(at, 2)
        keep = tails != heads
        tails, heads = tails[keep], heads[keep]
        order = np.lexsort((heads, tails))
        starts = np.searchsorted(tails[order], np.arange(len(names) + 1)).tolist()
        heads = heads[order].tolist()
        after = [heads[i:j] for i, j in zip(starts, starts[1:])]
        score, dist, sigma, delta = [0.0] * len(names), [-1] * len(names), [0.0] * len(names), [0.0] * len(names)
        for s in np.searchsorted(names, sources.column("node_id").to_numpy()).tolist():
            sigma[s], dist[s] = 1.0, 0
            queue = [s]
            for v in queue:
                further, ways = dist[v] + 1, sigma[v]
                for w in after[v]:
                    if dist[w] < 0:
                        dist[w] = further
                        queue.append(w)
                    if dist[w] == further:
                        sigma[w] += ways
            for v in reversed(queue):
                further, ways, total = dist[v] + 1, sigma[v], 0.0
                for w in after[v]:
                    if dist[w] == further:
                        total += ways / sigma[w] * (1 + delta[w])
                delta[v] = total
                if v != s:
                    score[v] += total
            for v in queue:
                dist[v], sigma[v], delta[v] = -1, 0.0, 0.0
        got = np.array(score)
        some = np.flatnonzero(got)
        return pa.table({key: sources.column(key).take(pa.array(np.zeros(len(some), np.int64))), "node_id": pa.array(names[some], pa.string()), "score": got[some]})

    kind = edges.schema[key].dataType.simpleString()
    partial = dealt.groupBy(key, "part").cogroup(copies.groupBy("_key", "_part")).applyInArrow(brandes, f"{key} {kind}, node_id string, score double")
    sums = partial.groupBy(F.col(key).alias("_key"), F.col("node_id").alias("_node")).agg(F.sum("score").alias("score"))
    j = sized.join(sums, (F.col("node_id") == F.col("_node")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    share = F.coalesce("score", F.lit(0.0)) / F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2)).otherwise(1)
    return j.select(key, "node_id", share.alias("betweenness"))


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """source, target, weight of the symmetric adjacency with self loops, each edge divided by the roots of both degrees."""
    both = undirected(edges)
    names = both.select("source").distinct()
    loops = both.union(names.select("source", F.col("source").alias("target")))
    degree = loops.groupBy("source").agg(F.count(F.lit(1)).alias("d"))
    a = loops.join(degree, "source")
    return a.join(degree.select(F.col("source").alias("target"), F.col("d").alias("d2")), "target").select("source", "target", (1 / F.sqrt(F.col("d") * F.col("d2"))).alias("weight"))


def mean_messages(features: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and the mean of its in-neighbours' feature arrays: one round of message passing."""
    sent = directed(edges).join(features.withColumnRenamed("node_id", "source"), "source")
    parts = sent.select(F.col("target").alias("node_id"), F.posexplode("features").alias("at", "x")).groupBy("node_id", "at").agg(F.avg("x").alias("x"))
    return parts.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("features"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """direction, node: ends of the edges that leave or enter ``node``."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("node"))
    return out.union(edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("node")))


def upstream(edges: DataFrame, node: str, max_depth: int = 8) -> DataFrame:
    """root, depth, path: the shortest way to ``node`` from a node without an in edge."""
    e = directed(edges)
    spark = edges.sparkSession
    back = paths(e.select(F.col("target").alias("source"), F.col("source").alias("target")), spark.createDataFrame([(node,)], "root string"), max_depth)
    starts = back.where("depth > 0").join(e.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
    return starts.orderBy("depth", "node").limit(1).select(F.col("node").alias("root"), "depth", F.array_join(F.reverse("path"), ">").alias("path"))


def best_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
