"""Incident assembly: stitching rules, enrichment, evidence rows, documents, prompts, templates, linkage clusters."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules that link two kinds of diagrams, if a scenario has both.
STITCH_RULES = [("D0", "D1", "uplink"), ("D1", "D2", "backbone"), ("D2", "D3", "service"), ("D3", "D4", "replication"), ("D0", "D4", "management")]


def stitched(present: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (left, right, relationship) of which both diagrams are present, by scenario."""
    p = present.select("scenario", "diagram_id").distinct()
    return p.withColumnRenamed("diagram_id", "left").join(F.broadcast(rules), "left").join(p.withColumnRenamed("diagram_id", "right"), ["scenario", "right"]).select("scenario", "left", "right", "relationship")


def aliases(node: Column) -> Column:
    """Names by which a node may be meant: itself, lower case, and its last part after a colon or point."""
    last = F.element_at(F.split(node, "[:.]"), -1)
    return F.array_distinct(F.array(node, F.lower(node), last, F.lower(last)))


def resolve(names: DataFrame, nodes: DataFrame, name: str, node: str, order: str) -> DataFrame:
    """The first node, by ``order``, that has the name among its aliases."""
    a = nodes.select(node, order, F.explode(aliases(F.col(node))).alias(name))
    first = a.groupBy(name).agg(F.min(F.struct(order, node)).alias("m")).select(name, F.col(f"m.{node}").alias(node))
    return names.join(first, name, "left")


def proximity(df: DataFrame, candidates: DataFrame, key: str, node: str) -> DataFrame:
    """1 for the first candidate of a case, 0.18 less for each further of five, else 0."""
    c = candidates.where("rank <= 5").select(key, node, (1.0 - 0.18 * (F.col("rank") - 1)).alias("proximity"))
    return df.join(c, [key, node], "left").na.fill(0.0, ["proximity"])


def evidence(cluster: dict[str, Column]) -> Column:
    """Up to five stages of evidence of a cluster, each with its confidence: stage, confidence."""
    row = lambda ok, stage, c: F.when(ok, F.struct(F.lit(stage).alias("stage"), F.round(c, 4).alias("confidence")))
    return F.array_compact(
        F.array(
            row(cluster["n_events"] > 0, "onset", F.lit(0.9)),
            row(cluster["matches"] > 0, "propagation", F.least(F.lit(1.0), 0.55 + 0.15 * cluster["matches"])),
            row(cluster["n_nodes"] > 1, "spread", cluster["temporal"]),
            row(cluster["n_diagrams"] > 1, "cross_diagram", F.lit(0.7)),
            row(cluster["n_events"] > 3, "impact", cluster["temporal"]),
        )
    )


def path_edges(paths: DataFrame, key: str, path: str) -> DataFrame:
    """Distinct directed pairs of neighbours on the paths."""
    pairs = F.arrays_zip(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))).alias("a"), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))).alias("b"))
    return paths.select(key, F.explode(pairs).alias("p")).select(key, F.col("p.a").alias("source"), F.col("p.b").alias("target")).distinct()


def sampled(path: Column, points: int = 5) -> Column:
    """At most ``points`` nodes of a path: evenly spaced ones and the last."""
    step = F.greatest(F.lit(1), ((F.size(path) - 1) / (points - 1)).cast("int"))
    some = F.transform(F.sequence(F.lit(0), F.lit(points - 2)), lambda i: F.get(path, i * step))
    return F.when(F.size(path) <= points, path).otherwise(F.array_append(some, F.element_at(path, -1)))


def capped(df: DataFrame, case: str, group: str, order: list, per_group: int, overall: int) -> DataFrame:
    """The first rows of each case: at most ``per_group`` of a group and ``overall`` in all, with their place."""
    one = df.withColumn("_g", F.row_number().over(Window.partitionBy(case, group).orderBy(*order))).where(F.col("_g") <= per_group).drop("_g")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy(*order))).where(F.col("place") <= overall)


def zone(x: Column, y: Column, width: float, height: float) -> Column:
    """The cell of a 2 by 3 grid in which a point lies."""
    column = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(x / width * 3)))
    row = F.least(F.lit(1), F.greatest(F.lit(0), F.floor(y / height * 2)))
    return F.concat(F.lit("zone-"), row.cast("string"), F.lit("-"), column.cast("string"))


def polyline(points: Column) -> Column:
    """Length of a line through points (arrays of x and y)."""
    pairs = F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.hypot(p["b"][0] - p["a"][0], p["b"][1] - p["a"][1]))


def documents(nodes: DataFrame, edges: DataFrame, alerts: DataFrame) -> DataFrame:
    """id, kind, text: one sentence for each node, edge and alert, with an id of its content."""
    n = nodes.select(F.lit("node").alias("kind"), F.format_string("Node %s is a %s in diagram %s.", "node_id", "kind", "diagram_id").alias("text"))
    e = edges.select(F.lit("edge").alias("kind"), F.format_string("%s connects to %s.", "source", "target").alias("text"))
    a = alerts.select(F.lit("alert").alias("kind"), F.format_string("At minute %d of %s, %s raised %s with severity %s.", "t", "case_id", "node", "alert_type", "severity").alias("text"))
    both = n.unionByName(e).unionByName(a)
    return both.select(F.sha1(F.concat_ws("|", "kind", "text").cast("binary")).alias("id"), "kind", "text")


#: First steps of a remedy by domain.
TEMPLATES = {"router": "check peers and links", "switch": "check ports", "firewall": "review the rule set", "server": "check load", "database": "check replication", "load_balancer": "check pool members", "service": "check dependencies", "cloud": "check the gateway", "wan": "test the circuit"}


def remedies(incidents: DataFrame, kind: str) -> DataFrame:
    """``incidents`` with the first step of their domain's template and whether it may run unattended."""
    from emberline.functions.scalars import lookup

    return incidents.withColumns({"first_step": lookup(F.col(kind), TEMPLATES, "collect evidence"), "unattended": (F.col("n_diagrams") <= 1)})


def prompt(root: Column, timeline: Column, ranking: Column, most: int = 8) -> Column:
    """The text of a question to a model, its lists held to ``most`` lines."""
    lines = lambda c: F.array_join(F.transform(F.slice(c, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("Root cause: "), F.coalesce(root, F.lit("unknown")), F.lit("\nTimeline:\n"), lines(timeline), F.lit("\nCandidates:\n"), lines(ranking))


def _kernels():
    """joined, rounded and Similarities; defined within, so that tasks get them by value."""

    def joined(sums: np.ndarray, size: np.ndarray, stacks: list, least: float, above: float = -np.inf) -> list[list[int]]:
        """Clusters by average linkage, joined while the greatest mean is at least ``least`` and over ``above``.

        A row stands for equal clusters: ``stacks`` has their members, the first
        cluster last; ``size`` counts members of one, and ``sums`` has the whole
        similarities of one of a row to one of another (on the diagonal: to another of
        its own). Of equal means the pair of the smallest first member is joined, then
        of the smallest second.
        """
        k = len(stacks)
        count, lead = np.array([len(s) for s in stacks]), np.array([s[-1][0] for s in stacks])
        size, gone, free = size.astype(float), np.zeros(k), []

        def means(rows: np.ndarray) -> np.ndarray:
            m = sums[rows] / (size[rows, None] * size) + gone
            m[np.arange(len(rows)), rows] = np.where(count[rows] > 1, m[np.arange(len(rows)), rows], -np.inf)
            return m

        def parts(rows: np.ndarray) -> list[np.ndarray]:
            return np.array_split(rows, max(1, len(rows) * len(size) // 1_000_000))

        # Rows of equal clusters that are nearer to each other than to all else are joined at once.
        own = np.where(count > 1, np.diagonal(sums) / size**2, -np.inf)
        count, several = np.ones(k, int), count
        best = np.concatenate([means(p).max(1) for p in parts(np.arange(k))])
        whole = (own > best) & (own > above) & (own >= least)
        for i in np.flatnonzero(whole):
            stacks[i] = [sorted(v for c in stacks[i] for v in c)]
        times = np.where(whole, several, 1)
        sums *= times[:, None]
        sums *= times
        size *= times
        count = np.where(whole, 1, several)
        best = np.where(whole, best, np.maximum(best, own))
        while len(best):
            top = best.max()
            if not (top >= least and top > above):
                break
            ties = np.flatnonzero(best == top)
            i = int(ties[lead[ties].argmin()])
            at_i = means(np.array([i]))[0]
            ties = np.flatnonzero(at_i == top)
            second = np.where(ties == i, stacks[i][-2][0] if count[i] > 1 else 0, lead[ties])
            j = int(ties[second.argmin()])
            at_j = at_i if i == j else means(np.array([j]))[0]
            first, one, two = lead[i], stacks[i].pop(), stacks[j].pop()
            total, n = sums[i] + sums[j], size[i] + size[j]
            count[i] -= 1
            count[j] -= 1
            lost = np.full(len(best), -np.inf)
            for y, at in ((i, at_i), (j, at_j)):
                if count[y] == 0:
                    lost = np.maximum(lost, at)
                else:
                    lead[y] = stacks[y][-1][0]
            spent = [y for y in {i, j} if count[y] == 0]
            if not spent and not free:
                more = len(best) // 8 + 8
                free = list(range(len(best), len(best) + more))
                sums = np.pad(sums, (0, more))
                total, lost, best, gone = (np.pad(x, (0, more), constant_values=v) for x, v in ((total, 0.0), (lost, -np.inf), (best, -np.inf), (gone, -np.inf)))
                size, count, lead = np.pad(size, (0, more), constant_values=1), np.pad(count, (0, more)), np.pad(lead, (0, more))
                stacks = stacks + [[] for _ in range(more)]
            x = spent.pop() if spent else free.pop()
            for y in spent:
                gone[y], best[y] = -np.inf, -np.inf
                free.append(y)
            one, two = (one, two) if len(one) >= len(two) else (two, one)
            one.extend(two)
            if one[0] != first:
                one[0], one[len(one) - len(two)] = one[len(one) - len(two)], one[0]
            sums[x], sums[:, x] = total, total
            size[x], count[x], lead[x], gone[x], stacks[x] = n, 1, first, 0.0, [one]
            now = total / (n * size) + gone
            now[x] = -np.inf
            # Rows whose best was a cluster that is no more look anew, as do what is left of the two rows.
            stale = (best == lost) & (now < best)
            stale[[y for y in (i, j) if count[y] and y != x]] = True
            stale[x] = False
            best = np.maximum(best, now)
            best[x] = now.max()
            for p in parts(np.flatnonzero(stale)):
                best[p] = means(p).max(1)
        return [c for s in stacks for c in s]

    def rounded(x: np.ndarray) -> np.ndarray:
        """Similarities in ten-thousandths, as Spark rounds them: halves of the shortest decimal up."""
        scaled = x * 1e4
        out = np.floor(scaled + 0.5)
        for at in np.argwhere(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
            out[tuple(at)] = float(Decimal(repr(float(x[tuple(at)]))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
        return out

    class Similarities:
        """Similarities of alerts by their classes and the gap of their times, in ten-thousandths."""

        def __init__(self, bases: pa.Table, t_max: int):
            self.names = np.unique(bases.column("a").to_numpy())
            values, kind = np.unique(bases.column("base").to_numpy(), return_inverse=True)
            self.kind = np.zeros((len(self.names), len(self.names)), np.int64)
            self.kind[np.searchsorted(self.names, bases.column("a").to_numpy()), np.searchsorted(self.names, bases.column("b").to_numpy())] = kind
            # From a third of the longest time on the gap does not count.
            self.far = -(-int(t_max) // 3)
            gaps = np.arange(self.far + 1)
            self.table = rounded(values[:, None] + 0.25 * np.maximum(0.0, 1 - (3 * gaps) / float(t_max)))
            self.shapes, self.shape = np.unique(self.table - self.table[:, -1:], axis=0, return_inverse=True)
            self.shape = self.shape.ravel()

        def between(self, cls_a: np.ndarray, t_a: np.ndarray, cls_b: np.ndarray, t_b: np.ndarray) -> np.ndarray:
            """Of each of the first to each of the second alerts, classes as places among the names."""
            gap = np.minimum(np.abs(t_a[:, None] - t_b), self.far)
            return self.table.ravel().take(self.kind[cls_a][:, cls_b] * (self.far + 1) + gap)

        def sums(self, who: np.ndarray, cls: np.ndarray, t: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
            """Whole similarities of ``k`` clusters, by entries (who, class, time, weight) in the order of who."""
            times, at_time = np.unique(t, return_inverse=True)
            if len(who) ** 2 <= len(self.shapes) * len(times) * (len(who) + len(times)):
                out, starts = np.zeros((k, k)), np.searchsorted(who, np.arange(k))
                for p in np.array_split(np.arange(len(who)), max(1, len(who) ** 2 // 1_000_000)):
                    some = np.add.reduceat(self.between(cls[p], t[p], cls, t) * weight, starts, axis=1) * weight[p, None]
                    own, at = np.unique(who[p], return_index=True)
                    out[own] += np.add.reduceat(some, at, axis=0)
                return out
            # What does not depend on the gap comes from counts of classes; the rest has few shapes, each a table of times.
            counts = np.zeros((k, len(self.names)))
            np.add.at(counts, (who, cls), weight)
            out = counts @ self.table[:, -1][self.kind] @ counts.T
            shape = self.shape[self.kind]
            _, one, group = np.unique(shape, axis=0, return_index=True, return_inverse=True)
            group, shape = group.ravel()[cls], shape[one][:, one]
            gaps = np.minimum(np.abs(times[:, None] - times), self.far)
            for n, curve in enumerate(self.shapes):
                if not curve.any():
                    continue
                table = curve[gaps]
                for q in np.flatnonzero((shape == n).any(1)):
                    mine, other = np.flatnonzero(group == q), np.flatnonzero((shape[q] == n)[group])
                    if not len(mine) or not len(other):
                        continue
                    rows, starts = np.unique(who[mine], return_index=True)
                    cols, begins = np.unique(who[other], return_index=True)
                    ends = np.append(starts[1:], len(mine))
                    for p in np.array_split(np.arange(len(rows)), max(1, max(len(rows) * len(other), len(mine) * len(times)) // 1_000_000)):
                        if len(p):
                            e = mine[starts[p[0]] : ends[p[-1]]]
                            by_time = np.add.reduceat(table[at_time[e]] * weight[e, None], starts[p] - starts[p[0]], axis=0)
                            out[np.ix_(rows[p], cols)] += np.add.reduceat(by_time[:, at_time[other]] * weight[other], begins, axis=1)
            return out

        def components(self, who: np.ndarray, cls: np.ndarray, t: np.ndarray, weight: np.ndarray, k: int, level: float) -> np.ndarray | None:
            """The least cluster that each reaches by means of ``level`` or more; None if too many pairs have to be looked at."""
            span, order = int(t.max()) + 1, np.lexsort((t, cls))
            key = cls[order] * span + t[order]
            most, found = 4_000_000, [np.zeros(0, np.int64)]
            present = np.unique(cls)
            near = np.argwhere(np.triu(self.table[:, 0][self.kind[np.ix_(present, present)]] >= level))
            for ci, cj in present[near]:
                g = np.count_nonzero(self.table[self.kind[ci, cj]] >= level) - 1
                g = span if g >= self.far else g
                mine = order[np.searchsorted(key, ci * span) : np.searchsorted(key, (ci + 1) * span)]
                lo = np.searchsorted(key, cj * span + np.maximum(t[mine] - g, 0))
                n = np.searchsorted(key, cj * span + np.minimum(t[mine] + g, span - 1), "right") - lo
                most -= n.sum()
                if most < 0:
                    return None
                a = who[np.repeat(mine, n)]
                b = who[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]]
                found.append(np.unique((np.minimum(a, b) * k + np.maximum(a, b))[a != b]))
            pairs = np.unique(np.concatenate(found))
            x, y = pairs // k, pairs % k
            start, many = np.searchsorted(who, np.arange(k)), np.bincount(who, minlength=k)
            size, work = np.bincount(who, weight, minlength=k), many[x] * many[y]
            if work.sum() > 100_000_000:
                return None
            linked = np.zeros(len(pairs), bool)
            block = np.cumsum(work) // 2_000_000
            for p in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(block)) + 1):
                if len(p):
                    ends = np.cumsum(work[p])
                    off = np.arange(ends[-1]) - np.repeat(ends - work[p], work[p])
                    wide = np.repeat(many[y[p]], work[p])
                    i, j = np.repeat(start[x[p]], work[p]) + off // wide, np.repeat(start[y[p]], work[p]) + off % wide
                    v = self.table[self.kind[cls[i], cls[j]], np.minimum(np.abs(t[i] - t[j]), self.far)] * (weight[i] * weight[j])
                    linked[p] = np.add.reduceat(v, ends - work[p]) / (size[x[p]] * size[y[p]]) >= level
            x, y, label = x[linked], y[linked], np.arange(k)
            while (label[x] != label[y]).any():
                low = np.minimum(label[x], label[y])
                np.minimum.at(label, label[x], low)
                np.minimum.at(label, label[y], low)
                while (label[label] != label).any():
                    label = label[label]
            return label

    return joined, rounded, Similarities


def average_linkage(pairs: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, node, cluster: average-linkage clusters of each key's pairs (a, b, similarity), joined down to ``threshold``.

    The pair of clusters with the greatest mean similarity is joined first; of
    equal ones that of the smallest first node, then the smallest second.
    Similarities count to nine digits, so means are exact. One block is one task,
    with a square of its size in memory.
    """
    joined, _, _ = _kernels()

    def join(g: pa.Table) -> pa.Table:
        ends = np.concatenate([g.column(c).to_numpy() for c in ("a", "b")])
        names, at = np.unique(ends, return_inverse=True)
        a, b = np.split(at, 2)
        n = len(names)
        sums = np.zeros((n, n))
        sums[a, b] = sums[b, a] = np.round(g.column("similarity").to_numpy() * 1e9)
        leader = np.arange(n)
        for c in joined(sums, np.ones(n), [[[v]] for v in range(n)], np.round(threshold * 1e9)):
            leader[c] = min(c)
        one = g.column(key).take(pa.array(np.zeros(n, np.int64)))
        return pa.table({key: one, "node": names, "cluster": names[leader]})

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy(key).applyInArrow(join, f"{key} {kinds[key]}, node {kinds['a']}, cluster {kinds['a']}")


def alert_linkage(alerts: DataFrame, case: str, threshold: float, wide: int = 4000) -> DataFrame:
    """case, node, cluster: average-linkage clusters of all of a case's ``alerts`` (case, ordinal, t, diagram_id, kind, severity, near, t_max), by ordinals.

    As ``average_linkage`` over all pairs of a case's alerts, without the pairs:
    equal alerts (class and time) are one row until they are joined, and a
    diagram's alerts are joined on their own as long as the means are over any
    similarity to another diagram, since no such pair can come first. Means go
    down, so what is left is joined by case as if nothing had been split. More
    than ``wide`` rows of a diagram are first joined down to levels at which
    their components (by means) have no more; a task holds a square of these.
    """
    from emberline.operators.assembly import similarity_terms
    from emberline.operators.graph import cut

    terms = ["diagram_id", "kind", "severity", "near"]
    order = Window.partitionBy(case)
    classes = alerts.select(case, *terms, "t_max").distinct()
    classes = cut(classes.withColumns({"cls": F.row_number().over(order.orderBy(*terms)), "part": F.dense_rank().over(order.orderBy("diagram_id"))}))
    a, b = classes.alias("a"), classes.alias("b")
    pairs = a.join(b, F.col(f"a.{case}").eqNullSafe(F.col(f"b.{case}")))
    pairs = cut(pairs.select(F.col(f"a.{case}").alias(case), "a.t_max", F.col("a.part").alias("part"), F.col("b.part").alias("_p"), F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), similarity_terms("a", "b").alias("base")))
    floors = pairs.groupBy(case, "part").agg(F.max(F.when(F.col("part") != F.col("_p"), F.col("base") + 0.25)).alias("floor"))
    same = reduce(lambda p, q: p & q, [F.col(f"x.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (case, *terms)])
    points = alerts.alias("x").join(classes.alias("c"), same).select(f"x.{case}", "x.ordinal", "x.t", "c.cls", "c.part")
    least = float(np.round(threshold * 1e4))
    joined, rounded, Similarities = _kernels()

    def of_part(g: pa.Table, bases: pa.Table) -> pa.Table:
        sim = Similarities(bases, bases.column("t_max")[0].as_py())
        floor = bases.column("floor")[0].as_py()
        g = g.sort_by([("ordinal", "ascending"), ("t", "ascending"), ("cls", "ascending")])
        t, cls = g.column("t").to_numpy().astype(np.int64), np.searchsorted(sim.names, g.column("cls").to_numpy())
        _, at, place = np.unique(t * len(sim.names) + cls, return_index=True, return_inverse=True)
        above = -np.inf if floor is None else float(rounded(np.array([floor]))[0])
        bottom, level, step = max(least, above), sim.table.max(), 8.0
        clusters = [[v] for v in range(len(place))]
        while True:
            # Single alerts of one place are one row; what was joined is a row of its own.
            singles, stacks = {}, []
            for c in clusters:
                if len(c) > 1:
                    stacks.append([c])
                else:
                    singles.setdefault(place[c[0]], []).append(c)
            stacks += [sorted(x, reverse=True) for x in singles.values()]
            sizes = np.array([len(x[-1]) for x in stacks])
            keys, weight = np.unique(np.repeat(np.arange(len(stacks)), sizes) * len(at) + place[np.concatenate([x[-1] for x in stacks])], return_counts=True)
            who, what, when = keys // len(at), cls[at][keys % len(at)], t[at][keys % len(at)]
            label, to = None, bottom
            while len(stacks) > wide:
                to = max(level - step, bottom)
                label = sim.components(who, what, when, weight, len(stacks), to)
                if label is not None and np.bincount(label).max() <= wide:
                    break
                label = None
                if step == 1:
                    break
                step = max(1.0, step / 2)
            if label is None:
                clusters = joined(sim.sums(who, what, when, weight, len(stacks)), sizes, stacks, least, above)
                break
            # Means of clusters of two components are under the level, so each is joined on its own, some at a time.
            several = np.array([len(x) > 1 for x in stacks]) | (np.bincount(label, minlength=len(stacks))[label] > 1)
            clusters = [c for i in np.flatnonzero(~several) for c in stacks[i]]
            rows = np.flatnonzero(several)
            rows = rows[np.argsort(label[rows], kind="stable")]
            first = np.flatnonzero(np.diff(label[rows], prepend=-1))
            turn = np.repeat(first // 500, np.diff(np.append(first, len(rows))))
            for some in np.split(rows, np.flatnonzero(np.diff(turn)) + 1):
                if len(some):
                    some = np.sort(some)
                    new = np.full(len(stacks), -1)
                    new[some] = np.arange(len(some))
                    m = new[who] >= 0
                    clusters += joined(sim.sums(new[who[m]], what[m], when[m], weight[m], len(some)), sizes[some], [stacks[i] for i in some], max(to, least), above)
            if to == bottom:
                break
            level, step = to, step * 1.5
        k = np.empty(len(place), np.int64)
        for n, c in enumerate(clusters):
            k[c] = n
        return g.append_column("k", pa.array(k))

    def of_case(g: pa.Table, bases: pa.Table) -> pa.Table:
        sim = Similarities(bases, bases.column("t_max")[0].as_py())
        g = g.sort_by([("ordinal", "ascending"), ("t", "ascending"), ("cls", "ascending")])
        part, k = g.column("part").to_numpy().astype(np.int64), g.column("k").to_numpy()
        t, cls = g.column("t").to_numpy().astype(np.int64), np.searchsorted(sim.names, g.column("cls").to_numpy())
        _, first, of = np.unique(part * (k.max() + 1) + k, return_index=True, return_inverse=True)
        places = np.argsort(first)
        rank = np.empty(len(first), np.int64)
        rank[places] = np.arange(len(first))
        of, first = rank[of], first[places]
        span = t.max() + 1
        keys, weight = np.unique((of * len(sim.names) + cls) * span + t, return_counts=True)
        who, what, when = keys // span // len(sim.names), keys // span % len(sim.names), keys % span
        sums = sim.sums(who, what, when, weight, len(first))
        leader = np.empty(len(first), np.int64)
        for c in joined(sums, np.bincount(of), [[[v]] for v in range(len(first))], least):
            leader[c] = first[min(c)]
        return pa.table({case: g.column(case), "node": g.column("ordinal"), "cluster": g.column("ordinal").take(pa.array(leader[of]))})

    kinds = {f.name: f.dataType.simpleString() for f in alerts.schema}
    f = floors.select(F.col(case).alias("_c"), F.col("part").alias("_f"), "floor")
    inner = pairs.where(F.col("part") == F.col("_p")).drop("_p").join(f, F.col(case).eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_f"))).drop("_c", "_f")
    held = f"{case} {kinds[case]}, ordinal {kinds['ordinal']}, t {kinds['t']}, cls int, part int, k long"
    # Groups are small and dear, so their tasks are counted, not sized by bytes.
    tasks = 4 * alerts.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df, *k: df.repartition(tasks, *k).groupBy(*k)
    parts = cut(dealt(points, case, "part").cogroup(dealt(inner, case, "part")).applyInArrow(of_part, held))
    return dealt(parts, case).cogroup(dealt(pairs, case)).applyInArrow(of_case, f"{case} {kinds[case]}, node {kinds['ordinal']}, cluster {kinds['ordinal']}")


def external(df: DataFrame, call, schema: str, columns: list[str]) -> DataFrame:
    """A stage that hands batches of ``columns`` to ``call`` (a model behind HTTP, a detector, a recogniser), which gives rows of ``schema``."""

    def run(batches):
        for b in batches:
            yield call(b)

    return df.select(*columns).mapInPandas(run, schema)
