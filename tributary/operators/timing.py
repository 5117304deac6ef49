"""Timing: dominance in a fixed number of steps, and the dependences that follow."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bits
from ..plans.fixpoint import lattice_fixpoint, least_fixpoint, written
from ..sources.flowgraphs import FlowGraph
from .dominance import frontier as frontier_of
from .dominance import max_dominance
from .structure import reach


def _costed(g: FlowGraph, costs: DataFrame | None) -> DataFrame:
    k = list(g.keys)
    edges = g.edges.withColumn("cost", F.lit(1).cast("long")) if costs is None else g.edges.join(costs, [*k, "src", "dst"])
    return edges.join(g.outdegree().withColumnRenamed("node", "src"), [*k, "src"])


def timing_dominance(g: FlowGraph, costs: DataFrame | None = None) -> DataFrame:
    """keys, y, x, steps: on every way from y, x comes after exactly so many steps (or cost; costs: keys, src, dst, cost)."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        h = replace(g, nodes=g.nodes.join(big, k, "left_semi"), edges=written(g.edges.join(big, k, "left_semi")))
        edges = written(_costed(h, costs))

        def step(delta, seen):
            new = delta.withColumnRenamed("y", "dst").join(edges, [*k, "dst"]).where("src <> x").select(*k, "src", "x", (F.col("steps") + F.col("cost")).alias("steps")).distinct()
            every = new.join(edges, [*k, "src"]).join(seen.select(*k, F.col("y").alias("dst"), "x", F.col("steps").alias("rest")), [*k, "dst", "x"]).where("rest + cost = steps")
            return every.groupBy(*k, "src", "x", "steps").agg(F.count("*").alias("n"), F.first("outdegree").alias("d")).where("n = d").select(*k, F.col("src").alias("y"), "x", "steps")

        return least_fixpoint(h.nodes.select(*k, F.col("node").alias("y"), F.col("node").alias("x"), F.lit(0).cast("long").alias("steps")), step)

    return bits.solved(bits.flow_rows(g, costs), g.keys, bits.timed_pairs, ("y", "x", "steps"), large)


def timing_sensitive(g: FlowGraph, costs: DataFrame | None = None, timdom: DataFrame | None = None) -> DataFrame:
    """keys, n, m: timing-sensitive control dependence: some but not all successors of n lead to m in the same time."""
    k = list(g.keys)
    t = timdom if timdom is not None else timing_dominance(g, costs)
    hits = _costed(g, costs).join(t.select(*k, F.col("y").alias("dst"), F.col("x").alias("m"), "steps"), [*k, "dst"])
    hits = hits.groupBy(*k, F.col("src").alias("n"), "m", (F.col("steps") + F.col("cost")).alias("at")).agg(F.count("*").alias("hit"), F.first("outdegree").alias("d"))
    return hits.where("hit < d").select(*k, "n", "m").distinct()


def coarse(g: FlowGraph, closure: DataFrame) -> DataFrame:
    """keys, n, m: m is reachable from two successors of n (by the nonempty closure of edges, reflexive)."""
    k = list(g.keys)
    hits = g.edges.join(closure.select(*k, F.col("a").alias("dst"), F.col("b").alias("m")), [*k, "dst"])
    return hits.groupBy(*k, F.col("src").alias("n"), "m").agg(F.count("*").alias("hit")).where("hit > 1").select(*k, "n", "m")


def frontier(g: FlowGraph, costs: DataFrame | None = None) -> DataFrame:
    """keys, x, y: x timing-dominates a successor of y but not (twice removed) y itself."""
    dom = timing_dominance(g, costs).select(*g.keys, "y", "x").distinct()
    return frontier_of(g, written(dom))


def _timed(head: np.ndarray, tail: np.ndarray, n: int) -> np.ndarray:
    """Which of n nodes have a timing dominator but themselves, by edges without repeats in the order of their heads. All nodes
    lead to nodes without edges.

    Timing dominators of a node follow one another, so each node has a pointer to its next one, and the steps to it. A node
    with one successor has that. The others get one where the pointers from all successors first meet at one time: of two
    walkers the one that is earlier goes on, and waits where there is no pointer yet."""
    first = np.searchsorted(head, np.arange(n + 1))
    degree = np.diff(first)
    to, steps = np.full(n, -1), np.zeros(n, np.int64)
    one = np.flatnonzero(degree == 1)
    to[one], steps[one] = tail[first[one]], 1
    y = np.flatnonzero(degree > 1)
    a, b, at, bt, done = tail[first[y]], tail[first[y] + 1], np.ones(len(y), np.int64), np.ones(len(y), np.int64), np.full(len(y), 2)
    while len(y):
        met = (a == b) & (at == bt)
        more = met & (done < degree[y])
        b[more], bt[more] = tail[first[y[more]] + done[more]], 1
        done[more] += 1
        found = met & ~more
        to[y[found]], steps[y[found]] = a[found], at[found]
        # Walkers that are at one node at different times never meet.
        on = ~found & ((a != b) | (at == bt) | more)
        y, a, b, at, bt, done = (v[on] for v in (y, a, b, at, bt, done))
        left, right = (at <= bt) & (a != b) & (to[a] >= 0), (bt <= at) & (a != b) & (to[b] >= 0)
        at[left] += steps[a[left]]
        a[left] = to[a[left]]
        bt[right] += steps[b[right]]
        b[right] = to[b[right]]
        if not (left.any() or right.any() or found.any() or more.any()):
            break
    return to >= 0


#: Nodes of cut graphs that are worked on at once; more only if one graph has them.
CUT_NODES = 1 << 20


def _timing_dependent(p: dict) -> tuple:
    """n and m of gathered graphs: n is among the nodes that reach m, and has no timing dominator there but itself."""
    f = bits.Flow(p)
    node, own = f.node, f.single()
    to = bits.grown(own, f.out)
    inside = f.own[f.out.head] & f.own[f.out.tail]
    head, tail = f.out.head[inside], f.out.tail[inside]
    out = [(np.zeros(0, np.int64),) * 2]
    # The graphs of a range of columns m: nodes and edges by their places in the pairs of a node and a column.
    width = max(1, CUT_NODES // max(f.n, 1) // 64) * 64
    for begin in range(0, node.width, width):
        row, column = bits.pairs(to[:, begin // 64 : (begin + width) // 64])
        keep = f.own[row]
        row, column = row[keep], column[keep] + begin
        m = node.first[row] + column
        keep = f.own[m]
        row, column, m = row[keep], column[keep], m[keep]
        place = row * width + column - begin
        # Of each edge those columns that its end leads to, but not the edges that leave m.
        low, high = np.searchsorted(row, tail), np.searchsorted(row, tail, "right")
        many = high - low
        edge = np.repeat(np.arange(len(tail)), many)
        at = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many) + low[edge]
        live = m[at] != head[edge]
        edge, at = edge[live], at[live]
        from_ = np.searchsorted(place, head[edge] * width + column[at] - begin)
        order = np.argsort(from_, kind="stable")
        lonely = ~_timed(from_[order], at[order], len(row)) & (row != m)
        out.append((row[lonely], m[lonely]))
    n, m = (np.concatenate(c) for c in zip(*out))
    return node.of[n], node.name[n], node.name[m]


def dependence(g: FlowGraph, closure: DataFrame | None = None) -> DataFrame:
    """keys, n, m: the time at which m is reached, if it is, depends on n: of the nodes that reach m, in the graph of these
    without the edges that leave m, n has no timing dominator but itself. The graphs of all m are as large as reachability;
    those of small graphs are made inside tasks."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        mine = written(g.edges.join(big, k, "left_semi"))
        r = closure.join(big, k, "left_semi") if closure is not None else reach(replace(g, nodes=g.nodes.join(big, k, "left_semi"), edges=mine))
        nodes = written(r.select(*k, F.col("b").alias("m"), F.col("a").alias("node")))
        edges = nodes.withColumnRenamed("node", "src").where("src <> m").join(mine, [*k, "src"]).join(nodes.withColumnRenamed("node", "dst"), [*k, "m", "dst"], "left_semi")
        each = FlowGraph(nodes, written(edges.select(*k, "m", "src", "dst")), (*k, "m"))
        timed = timing_dominance(each).where("y <> x").select(*k, "m", F.col("y").alias("node")).distinct()
        return nodes.where("node <> m").join(timed, [*k, "m", "node"], "left_anti").select(*k, F.col("node").alias("n"), "m")

    return bits.solved(bits.flow_rows(g), g.keys, _timing_dependent, ("n", "m"), large)


def dependence_of_threads(g: FlowGraph, spawns: DataFrame, closure: DataFrame) -> DataFrame:
    """keys, n, m: timing dependence along edges that aren't spawns; what decides when a thread starts decides it for all that the thread reaches."""
    k = list(g.keys)
    own = written(dependence(FlowGraph(g.nodes, written(g.edges.join(spawns, [*k, "src", "dst"], "left_anti").select(*k, "src", "dst")), g.keys)))
    started = own.join(spawns.select(*k, F.col("src").alias("m"), F.col("dst").alias("a")), [*k, "m"]).join(closure, [*k, "a"]).select(*k, "n", F.col("b").alias("m"))
    return own.union(started).distinct()


def slowest(g: FlowGraph, dom: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """keys, y, x, steps: the longest way from y to x, up to the first visit, for all x that are on every maximal path from y
    (dom: keys, y, x): then no way goes round in between."""
    k = list(g.keys)
    edges, dom = written(_costed(g, costs).select(*k, "src", "dst", "cost")), written(dom.select(*k, "y", "x"))

    def step(delta: DataFrame) -> DataFrame:
        on = delta.withColumnRenamed("y", "dst").join(edges, [*k, "dst"]).where("src <> x").select(*k, F.col("src").alias("y"), "x", (F.col("steps") + F.col("cost")).alias("steps"))
        return on.join(dom, [*k, "y", "x"], "left_semi")

    return lattice_fixpoint(g.nodes.select(*k, F.col("node").alias("y"), F.col("node").alias("x"), F.lit(0).cast("long").alias("steps")), step, {"steps": lambda c: F.max(c)})


def _corrected(p: dict) -> tuple:
    """src, dst and corrected cost of gathered graphs' edges."""
    f = bits.Flow(p)
    node, out = f.node, f.out
    dom = np.unpackbits(bits.on_maximal_paths(f).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")[:, : node.width] > 0
    number, never = np.arange(f.n), bits.NEVER
    longest = np.full((f.n, node.width), never)
    longest[number, node.column] = 0
    dom[number, node.column] = False
    dom[~f.own] = False
    while len(out.heads):
        then = longest[out.tail]
        then = np.where(then == never, never, then + f.cost[:, None])
        new = np.where(dom[out.heads], out(np.maximum, then), longest[out.heads])
        if np.array_equal(new, longest[out.heads]):
            break
        longest[out.heads] = new
    # The next node on all ways: of the least time, the first of several.
    time = np.where(dom & (longest != never), longest, np.iinfo(np.int64).max)
    next_ = time.argmin(axis=1)
    whole, rest = time[number, next_][out.head], longest[out.tail, next_[out.head]]
    mended = (whole != np.iinfo(np.int64).max) & (rest != never)
    return node.of[out.head], node.name[out.head], node.name[out.tail], np.where(mended, whole - rest, f.cost)


def correction(g: FlowGraph, costs: DataFrame | None = None) -> DataFrame:
    """keys, src, dst, cost: costs of edges, raised so that all ways from a branch to the next node on all of them take as
    long as the slowest. Then that node is met after a fixed time, and so is the next one after it: timing dominance is dominance,
    but where two nodes are on all maximal paths in either order, which no costs can mend. Branches with no such node, and
    other edges, keep their costs."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        h = replace(g, nodes=written(g.nodes.join(big, k, "left_semi")), edges=written(g.edges.join(big, k, "left_semi")))
        longest = written(slowest(h, max_dominance(h), costs))
        nearest = longest.where("y <> x").groupBy(*k, F.col("y").alias("src")).agg(F.min(F.struct("steps", "x")).alias("next")).select(*k, "src", F.col("next.steps").alias("whole"), F.col("next.x").alias("x"))
        edges = _costed(h, costs).select(*k, "src", "dst", "cost").join(nearest, [*k, "src"], "left")
        rest = longest.select(*k, F.col("y").alias("dst"), "x", F.col("steps").alias("rest"))
        return edges.join(rest, [*k, "dst", "x"], "left").select(*k, "src", "dst", F.coalesce(F.col("whole") - F.col("rest"), "cost").alias("cost"))

    return bits.solved(bits.flow_rows(g, costs), g.keys, _corrected, ("src", "dst", "cost"), large)
