"""Links of near duplicates: band buckets to verified links to components, without all pairs of a group.

A bucket's members are compared with its smallest node. What is verified gives
components. Where a bucket holds several, its members are compared with another
of its nodes, a few times over, and at last across all its components, by an
exact prefix filter over their sets. So the
members of a large group of mutual copies cost one comparison each, and no link
between different groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.scratch import Scratch

#: Narrow rows (ids and a few numbers) up to which a written table is sent to all tasks, some 20 MB; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 250_000
#: The same for tables with lists, in bytes of the lists.
BROADCAST_BYTES = 24_000_000
PARITY_LONGS = 8
#: Further rounds in which the members of a bucket are compared with another of its nodes.
STAR_TURNS = 2


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (a few narrow columns, written before) with a broadcast hint if its size is under the bound."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def bounded_lists(df: DataFrame, column: str, width: int = 8) -> DataFrame:
    """``df`` (written before) with a broadcast hint if its rows and the items of ``column``, of ``width`` bytes, are under the bounds."""
    rows, items = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(column).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and items * width <= BROADCAST_BYTES else df


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in one partition if its ``rows`` narrow ones would fit in a broadcast: what follows needs no shuffle then."""
    return df.coalesce(1) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes in ``edges`` (a, b).

    Alternating large-star and small-star rounds; each writes its edges, so a
    lost executor costs one round at most. Few edges are dealt with in one task.
    """
    first = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    rows = first.count()
    old = gathered(first, rows).distinct()
    mark, written = None, first
    while True:
        both = old.select("u", "v").union(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        head = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(head, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(head.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(written)
        old, written = gathered(new, rows), new
        if tuple(now) == mark:
            break
        mark = tuple(now)
    heads = old.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = scratch.write(old.select(F.col("u").alias("node"), F.col("v").alias("root")).union(heads), "labels")
    scratch.drop(written)
    return out


def agreement(a: str, b: str, k: int) -> Column:
    """Similarity estimated from two 2-bit sketches of ``k`` minima, corrected for chance collisions (one in four).

    A sketch is four longs: the low bits of all minima (two), then their next bits.
    """
    p = lambda side, i: F.col(side)[i]
    differ = sum((F.bit_count(p(a, i).bitwiseXOR(p(b, i)).bitwiseOR(p(a, i + 2).bitwiseXOR(p(b, i + 2)))) for i in (0, 1)), F.lit(0))
    return ((1 - differ / F.lit(k)) - 0.25) / 0.75


def prefix_pairs(nodes: DataFrame, tokens: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b), a < b, of different roots, among ``nodes`` (node, root) with sets ``tokens`` (node, n, token).

    Two sets of the similarity share one of the tokens that come first when each
    set is ordered by frequency among ``nodes``, rare ones first; and what follows
    that token in both must suffice for the overlap. Sets with more tokens of
    their own than the similarity allows meet nobody. ``parities`` (node, odd) has
    PARITY_LONGS longs of parities of the tokens by hash: two sets differ in at
    least as many tokens as parities. No link is lost.
    """
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    counted = tokens.join(often, "token")
    head = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100) - F.lit(1e-9)) + 1
    first = counted.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all")).select("node", "n", F.posexplode(F.slice("all", F.lit(1), head.cast("int"))).alias("at", "x"))
    first = first.where("x.df > 1").select("node", "n", "at", F.col("x.token").alias("token")).join(nodes.join(parities, "node"), "node")
    a, b = (first.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "at", "odd")]) for side in "ab")
    overlap = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    enough = overlap * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    close = close_sets(F.col("n_a"), F.col("n_b"), parity_distance(F.col("odd_a"), F.col("odd_b")), percent)
    return a.join(b, "token").where("node_a < node_b and root_a <> root_b").where(enough & close).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def parity_distance(a: Column, b: Column, first: int = 0, longs: int = PARITY_LONGS) -> Column:
    """How many parities two arrays differ in, held in ``longs`` longs from ``first`` on."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(first, first + longs)])


def close_sets(n_a: Column, n_b: Column, apart: Column, percent: int) -> Column:
    """Whether sets that differ in ``apart`` tokens at least can be of the similarity: |A| + |B| - 2 * overlap."""
    return apart * (100 + percent) <= (n_a + n_b) * (100 - percent)


def link(bands: DataFrame, sketches: DataFrame, near: Callable[[str, str], Column], percent: int, sets_of: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], tokens: Callable[[DataFrame], tuple[DataFrame, DataFrame]], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Labels (node, root) and verified links (a, b) of ``percent`` similarity.

    ``bands``: bucket, node (written). ``sketches``: node, sketch, also more than once. Candidates of
    which ``near`` does not hold for their sketches are passed by. ``sets_of``
    gives the sets of a table with ``node``; they are made once, for all nodes
    that share a bucket. ``verify`` keeps the true links of a table of candidates
    (a, b), given the sets; ``tokens`` unpacks sets to (node, n, token) and their
    parities (node, odd).
    """

    def promising(pairs: DataFrame) -> DataFrame:
        s = sketched.select("node", "sketch")
        both = pairs.join(s.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(s.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
        return both.where(near("sa", "sb")).select("a", "b")

    def apart(members: DataFrame) -> DataFrame:
        """Of bucket, node: those in buckets of several components, with their root."""
        placed = members.select("bucket", F.col("node").alias("_n")).join(bounded(labels.withColumnRenamed("node", "_n")), "_n", "left").select("bucket", F.col("_n").alias("node"), F.coalesce("root", "_n").alias("root"))
        several = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        # Written first, so that the rows of a large bucket are joined where they are, or can be split.
        several = scratch.write(several, "several")
        out = scratch.write(placed.join(bounded(several), "bucket"), "apart")
        scratch.drop(several)
        return out

    heads = bands.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("bucket", "a")
    heads = scratch.write(heads, "heads")
    # Of all bands only those in buckets of two nodes or more.
    shared = scratch.write(bands.join(bounded(heads), "bucket").distinct(), "shared")
    scratch.drop(heads)
    nodes = scratch.write(shared.select("node").distinct(), "nodes")
    own = scratch.write(sketches.join(bounded(nodes), "node", "left_semi").dropDuplicates(["node"]), "sketches")
    sketched = bounded_lists(own, "sketch")
    sets = scratch.write(sets_of(nodes), "sets")
    scratch.drop(nodes)
    tested = [scratch.write(promising(shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()), "pairs")]
    edges = [scratch.write(verify(tested[0], sets), "links")]

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs.join(bounded(reduce(DataFrame.union, tested)), ["a", "b"], "left_anti")

    labels = components(edges[0], scratch)
    live = apart(shared)
    scratch.drop(shared)
    for turn in range(STAR_TURNS):
        mark = F.xxhash64("node", F.lit(turn))
        centres = live.groupBy("bucket").agg(F.min_by("node", mark).alias("centre"), F.min_by("root", mark).alias("centre_root"))
        centres = scratch.write(centres, "centres")
        pairs = live.join(bounded(centres), "bucket").where("root <> centre_root").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        tested.append(scratch.write(promising(untested(pairs)), "pairs"))
        found = scratch.write(verify(tested[-1], sets), "links")
        edges.append(found)
        scratch.drop(centres)
        if found.isEmpty():
            break
        old = [labels, live]
        labels = components(reduce(DataFrame.union, edges), scratch)
        live = apart(live)
        scratch.drop(*old)

    rest = scratch.write(live.select("node", "root").distinct(), "rest")
    scratch.drop(live, own)
    # All tested pairs have a < b as well.
    pairs = scratch.write(untested(prefix_pairs(rest, *tokens(sets.join(bounded(rest.select("node")), "node", "left_semi")), percent)), "pairs")
    scratch.drop(rest, *tested)
    if not pairs.isEmpty():
        edges.append(scratch.write(verify(pairs, sets), "links"))
        scratch.drop(labels)
        labels = components(reduce(DataFrame.union, edges), scratch)
    scratch.drop(pairs, sets)
    return labels, reduce(DataFrame.union, edges)
