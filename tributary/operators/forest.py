"""Sink dominators as a forest: one pointer a node instead of all pairs.

A graph is first made to have one end: each control sink is one node, and all sinks
lead to a common root.  Any tree of its edges that leads to the root holds, above
each node, all that dominates it.  Then every node moves up to the nearest common
ancestor of its successors, all nodes at once, until none moves: a tree in which each
node's parent is an ancestor of its successors is the tree of dominators.  Ancestors
are found by pointers that double in length, so a round costs the logarithm of the
depth in joins of tables with a row a node.

The first tree takes, of each node, the successor with the largest number; nodes whose
pointers don't lead to the root then take one that does.  Any choice is right.

Small graphs are gathered (plans.bits): a task reads pointers and depths off the bits of
dominance, and walks up the pointers for what is asked of them.  All else is tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bits
from ..plans.fixpoint import written
from ..sources.flowgraphs import FlowGraph

#: The common end of a graph's sinks.
ROOT = 1 << 62


def _root():
    return F.lit(ROOT).cast("long")


def doubled(pointers: DataFrame, keys: tuple[str, ...]) -> tuple[list[DataFrame], DataFrame]:
    """Tables of jumps of 1, 2, 4 … pointers (keys, node, to), each jump stopping where pointers end; and keys, node, to,
    steps, least (the smallest node jumped to), on (still not at an end, that is, on a cycle or on the way to one)."""
    k = list(keys)
    at = written(pointers.select(*k, "node", "to", F.lit(1).cast("long").alias("steps"), F.col("to").alias("least")))
    most = (at.groupBy(*k).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) + 1
    jumps, reach = [at], 1
    while True:
        far = at.select(*k, F.col("node").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("least").alias("low"))
        new = at.join(far, [*k, "to"], "left")
        new = written(new.select(*k, "node", F.coalesce("far", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("least", F.coalesce("low", "least")).alias("least"), F.col("far").isNotNull().alias("on")))
        if new.where("on").isEmpty():
            return jumps, new
        at, reach = new.drop("on"), 2 * reach
        jumps.append(at)
        if reach > most:
            return jumps, new


def looping_sinks(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, node, cls of the nodes of sinks of two nodes or more, among nodes that can't leave them for an end: cycles of
    pointers are put together, until what is together has no way out."""
    k = list(keys)
    of = nodes.select(*k, "node", F.col("node").alias("cls"))
    while True:
        end = lambda c: of.select(*k, F.col("node").alias(c), F.col("cls").alias(f"of_{c}"))
        out = edges.join(end("src"), [*k, "src"]).join(end("dst"), [*k, "dst"]).where("of_src <> of_dst")
        pointers = written(out.groupBy(*k, F.col("of_src").alias("node")).agg(F.max("of_dst").alias("to")))
        _, last = doubled(pointers, keys)
        turning = last.where("on")
        cycles = written(turning.join(turning.select(*k, F.col("to").alias("node")).distinct(), [*k, "node"], "left_semi").select(*k, F.col("node").alias("cls"), "least"))
        if cycles.isEmpty():
            stays = of.join(pointers.select(*k, F.col("node").alias("cls")), [*k, "cls"], "left_anti")
            return stays.select(*k, "node", "cls")
        of = written(of.join(cycles, [*k, "cls"], "left").select(*k, "node", F.coalesce("least", "cls").alias("cls")))


def spanning(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...], root: DataFrame) -> DataFrame:
    """keys, node, to: a tree of edges that leads to the root (keys and node) from all nodes that can reach it."""
    k = list(keys)
    pointers = edges.where("src < dst").groupBy(*k, F.col("src").alias("node")).agg(F.max("dst").alias("to"))
    pointers = written(pointers.join(root, [*k, "node"], "left_anti"))
    while True:
        _, last = doubled(pointers, keys)
        there = last.where("not on").select(*k, "node", F.col("to").alias("end")).join(root.withColumnRenamed("node", "end"), [*k, "end"], "left_semi").select(*k, "node")
        there = written(there.union(root.select(*k, "node")))
        rest = edges.join(there.withColumnRenamed("node", "src"), [*k, "src"], "left_anti").join(there.withColumnRenamed("node", "dst"), [*k, "dst"], "left_semi")
        more = written(rest.groupBy(*k, F.col("src").alias("node")).agg(F.max("dst").alias("to")))
        if more.isEmpty():
            return pointers.join(there, [*k, "node"], "left_semi").select(*k, "node", "to")
        pointers = written(pointers.join(more, [*k, "node"], "left_anti").select(*k, "node", "to").union(more))


@dataclass(frozen=True)
class Forest:
    """parents (keys, node, to; ROOT above what nothing dominates), the jumps up (of a part with larger graphs, else none) and
    the depth of each node, and the nodes of sinks of several nodes (keys, node, cls), each of which is one node, cls, of the forest."""

    keys: tuple[str, ...]
    parents: DataFrame
    jumps: list[DataFrame]
    depths: DataFrame
    sinks: DataFrame

    def represented(self, df: DataFrame, column: str) -> DataFrame:
        """df with nodes of sinks in the column replaced by their sink's node."""
        k = list(self.keys)
        to = self.sinks.select(*k, F.col("node").alias(column), F.col("cls").alias("_cls"))
        return df.join(to, [*k, column], "left").withColumn(column, F.coalesce("_cls", column)).drop("_cls").select(*df.columns)

    def part(self, big: DataFrame) -> Forest:
        """The forest of some graphs (keys), with jumps."""
        return _forest(written(self.parents.join(big, list(self.keys), "left_semi")), self.keys, self.sinks)

    def rows(self, arcs: DataFrame, *ends: str) -> DataFrame:
        """Gathered rows of the forest and of arcs (keys and two ends) beside it."""
        up = self.parents.join(self.depths, [*self.keys, "node"])
        rows = bits.rows_of(up, self.keys, PARENT, "node", "to", "depth").union(bits.rows_of(self.sinks, self.keys, MEMBER, "node", "cls"))
        return rows.union(bits.rows_of(arcs, self.keys, ARC, *ends))

    def nearest(self, pairs: DataFrame) -> DataFrame:
        """pairs (keys, a, b and more columns; nodes of the forest) with lca, the nearest common ancestor of a and b, and its depth."""
        k, more = list(self.keys), [c for c in pairs.columns if c not in (*self.keys, "a", "b")]
        depth = lambda c, d: self.depths.select(*k, F.col("node").alias(c), F.col("depth").alias(d))
        zero = F.lit(0).cast("long")
        at = pairs.join(depth("a", "da"), [*k, "a"], "left").join(depth("b", "db"), [*k, "b"], "left").withColumns({"da": F.coalesce("da", zero), "db": F.coalesce("db", zero)})
        lower = F.col("da") >= F.col("db")
        at = at.select(*k, *more, *(F.when(lower, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("da", "db", "da"), ("db", "da", "db"))))
        jump = lambda j, c: self.jumps[j].select(*k, F.col("node").alias(c), F.col("to").alias(f"j{c}"))
        for j in reversed(range(len(self.jumps))):
            far = F.col("da") - F.col("db") >= 1 << j
            at = at.join(jump(j, "a"), [*k, "a"], "left").withColumns({"a": F.when(far, F.coalesce("ja", "a")).otherwise(F.col("a")), "da": F.when(far, F.col("da") - (1 << j)).otherwise(F.col("da"))}).drop("ja")
        at = written(at)
        for j in reversed(range(len(self.jumps))):
            at = at.join(jump(j, "a"), [*k, "a"], "left").join(jump(j, "b"), [*k, "b"], "left")
            apart = F.coalesce("ja", "a") != F.coalesce("jb", "b")
            at = at.withColumns({"da": F.when(apart, F.greatest(F.col("da") - (1 << j), F.lit(0))).otherwise(F.col("da")), "a": F.when(apart, F.coalesce("ja", "a")).otherwise(F.col("a")), "b": F.when(apart, F.coalesce("jb", "b")).otherwise(F.col("b"))}).drop("ja", "jb")
        at = written(at).join(jump(0, "a"), [*k, "a"], "left")
        met = F.col("a") == F.col("b")
        return at.select(*k, *more, F.when(met, F.col("a")).otherwise(F.coalesce("ja", "a")).alias("lca"), F.when(met, F.col("da")).otherwise(F.greatest(F.col("da") - 1, F.lit(0))).alias("depth"))


def _forest(parents: DataFrame, keys: tuple[str, ...], sinks: DataFrame) -> Forest:
    jumps, last = doubled(parents, keys)
    return Forest(keys, parents, jumps, written(last.select(*keys, "node", F.col("steps").alias("depth"))), sinks)


#: Kinds of rows of a gathered forest and what stands in them: (node, to, depth), (node, cls), (src, dst).
PARENT, MEMBER, ARC = range(3)


def _solved(p: dict) -> tuple:
    """Kinds and rows of the forests of gathered graphs."""
    f = bits.Flow(p)
    node, number = f.node, np.arange(f.n)
    row, column = bits.pairs(bits.on_sink_paths(f))
    x, size = node.first[row] + column, np.bincount(row, minlength=f.n)
    # Nodes of a sink dominate one another, and have as many dominators; any other dominator of a node has fewer than it.
    equal = size[x] == size[row]
    cls, most = number.copy(), np.full(f.n, -1)
    np.minimum.at(cls, row[equal], x[equal])
    np.maximum.at(most, row[~equal], size[x[~equal]] * node.width + node.width - 1 - column[~equal])
    to = np.where(most < 0, ROOT, node.name[np.where(most < 0, 0, node.first + node.width - 1 - most % node.width)])
    depth = np.bincount(row, weights=cls[x] == x, minlength=f.n).astype(np.int64)
    single = f.own & (cls == number)
    member = f.own & (np.bincount(cls, minlength=f.n) > 1)[cls]
    src, dst = cls[f.out.head], cls[f.out.tail]
    arc = np.unique(src[src != dst] * f.n + dst[src != dst])
    src, dst = arc // max(f.n, 1), arc % max(f.n, 1)
    ends = np.flatnonzero(single & (np.bincount(src, minlength=f.n) == 0))
    at = (np.flatnonzero(single), np.flatnonzero(member), src, ends)
    what = np.repeat([PARENT, MEMBER, ARC, ARC], [len(i) for i in at])
    second = np.r_[to[at[0]], node.name[cls[at[1]]], node.name[dst], np.full(len(ends), ROOT)]
    at = np.concatenate(at)
    return node.of[at], what, node.name[at], second, np.where(what == PARENT, depth[at], 0)


class _Tree:
    """Gathered rows of a forest as pointers, each node of a sink replaced by the sink's; arcs by the numbers of their ends."""

    def __init__(self, p: dict):
        kind, n = p["kind"], len(p["kind"])
        self.node = bits.Numbers(np.r_[p["graph"], p["graph"]], np.r_[p["a"], p["b"]])
        a, b = self.node.at[:n], self.node.at[n:]
        self.to = np.arange(len(self.node.of))
        self.depth, cls = np.zeros(len(self.to), np.int64), self.to.copy()
        up, member, self.arc = (kind == x for x in (PARENT, MEMBER, ARC))
        self.to[a[up]], self.depth[a[up]], cls[a[member]] = b[up], p["c"][up], b[member]
        self.begin, self.end = cls[a[self.arc]], cls[b[self.arc]]


def _met(p: dict) -> tuple:
    """a, b, and their nearest common ancestor, if it isn't the root."""
    t = _Tree(p)
    x, y = t.begin.copy(), t.end.copy()
    live = np.flatnonzero(x != y)
    while len(live):
        dx, dy = t.depth[x[live]], t.depth[y[live]]
        i, j = live[dx >= dy], live[dy >= dx]
        x[i], y[j] = t.to[x[i]], t.to[y[j]]
        live = live[(x[live] != y[live]) & (np.maximum(dx, dy) > 0)]
    found = (x == y) & (t.node.name[x] != ROOT)
    return p["graph"][t.arc][found], p["a"][t.arc][found], p["b"][t.arc][found], t.node.name[x[found]]


def _controlled(p: dict) -> tuple:
    """n and m: from the end of each arc of n up to n's parent, all nodes but n."""
    t = _Tree(p)
    n, m = t.begin, t.end
    found = []
    while len(n):
        on = t.depth[m] > np.maximum(t.depth[n] - 1, 0)
        n, m = n[on], m[on]
        found.append((n * len(t.to) + m)[n != m])
        m = t.to[m]
    pair = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    n, m = pair // max(len(t.to), 1), pair % max(len(t.to), 1)
    return t.node.of[n], t.node.name[n], t.node.name[m]


def sink_forest(g: FlowGraph) -> tuple[Forest, DataFrame]:
    """The forest of sink dominators, and the edges (keys, src, dst) of the graph whose sinks are single nodes."""
    k, columns = list(g.keys), ("what", "a", "b", "c")

    def large(big: DataFrame) -> DataFrame:
        part, whole = _by_tables(replace(g, nodes=g.nodes.join(big, k, "left_semi"), edges=g.edges.join(big, k, "left_semi")))
        row = lambda df, what, *of: df.select(*k, *(F.lit(v).cast("long").alias(c) if isinstance(v, int) else F.col(v).cast("long").alias(c) for c, v in zip(columns, (what, *of))))
        up = part.parents.join(part.depths, [*k, "node"])
        return row(up, PARENT, "node", "to", "depth").union(row(part.sinks, MEMBER, "node", "cls", 0)).union(row(whole, ARC, "src", "dst", 0))

    rows = bits.solved(bits.flow_rows(g), g.keys, _solved, columns, large)
    of = lambda what, **names: rows.where(F.col("what") == what).select(*k, *(F.col(c).alias(name) for name, c in names.items()))
    return Forest(g.keys, of(PARENT, node="a", to="b"), [], of(PARENT, node="a", depth="c"), of(MEMBER, node="a", cls="b")), of(ARC, src="a", dst="b")


def _by_tables(g: FlowGraph) -> tuple[Forest, DataFrame]:
    k = list(g.keys)
    nodes, edges = written(g.nodes.select(*k, "node")), written(g.edges.where("src <> dst").select(*k, "src", "dst"))
    ends = written(nodes.join(edges.select(*k, F.col("src").alias("node")).distinct(), [*k, "node"], "left_anti"))
    root = nodes.select(*k).distinct().withColumn("node", _root())

    def rooted(nodes: DataFrame, edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
        whole = written(edges.union(ends.select(*k, "node", _root())))
        return whole, written(spanning(nodes, whole, g.keys, written(root)))

    whole, tree = rooted(nodes, edges, ends)
    lost = written(nodes.join(tree, [*k, "node"], "left_anti").select(*k, "node"))
    sinks = lost.withColumn("cls", F.col("node")).limit(0)
    if not lost.isEmpty():
        inside = edges.join(lost.withColumnRenamed("node", "src"), [*k, "src"], "left_semi")
        sinks = written(looping_sinks(lost, written(inside), g.keys))
        single = Forest(g.keys, tree, [], tree, sinks)
        edges = single.represented(single.represented(edges, "src"), "dst").where("src <> dst").distinct()
        nodes = single.represented(nodes, "node").distinct()
        whole, tree = rooted(written(nodes), written(edges), ends.union(sinks.select(*k, F.col("cls").alias("node")).distinct()))
    branches = written(whole.groupBy(*k, "src").agg(F.count("*").alias("n")).where("n > 1").select(*k, "src"))
    arcs = written(whole.join(branches, [*k, "src"], "left_semi"))
    while True:
        forest = _forest(tree, g.keys, sinks)
        own = tree.select(*k, F.col("node").alias("src"), F.col("to").alias("b"))
        asked = arcs.join(own, [*k, "src"]).where("dst <> b").select(*k, "src", F.col("dst").alias("a"), "b")
        met = forest.nearest(asked).groupBy(*k, "src").agg(F.min(F.struct("depth", "lca")).alias("up"))
        moved = written(met.select(*k, F.col("src").alias("node"), F.col("up.lca").alias("far")).join(tree, [*k, "node"]).where("far <> to").select(*k, "node", "far"))
        if moved.isEmpty():
            return forest, whole
        tree = written(tree.join(moved, [*k, "node"], "left").select(*k, "node", F.coalesce("far", "to").alias("to")))


def immediate(forest: Forest) -> DataFrame:
    """keys, y, x: the immediate sink dominator of each node that has one: of a sink of several nodes, all of them, and for
    each of these all the others, as they dominate one another."""
    k = list(forest.keys)
    up = forest.parents.where(F.col("to") != _root()).select(*k, F.col("node").alias("y"), F.col("to").alias("x"))
    up = up.join(forest.sinks.select(*k, F.col("cls").alias("x"), F.col("node").alias("member")), [*k, "x"], "left").select(*k, "y", F.coalesce("member", "x").alias("x"))
    within = forest.sinks.select(*k, "cls", F.col("node").alias("y")).join(forest.sinks.select(*k, "cls", F.col("node").alias("x")), [*k, "cls"])
    return up.union(within.select(*k, "y", "x"))


def above(forest: Forest, starts: DataFrame) -> DataFrame:
    """starts (keys, node, stop: an ancestor's depth, and more) with each ancestor of node that is deeper than stop, node
    itself included, in the column node. Jumps of 1, 2, 4 … reach all of them."""
    k = list(forest.keys)
    columns = starts.columns
    at = written(starts.join(forest.depths, [*k, "node"]).where("depth > stop").select(*columns, "depth"))
    for j, jump in enumerate(forest.jumps):
        on = at.where(F.col("depth") - (1 << j) > F.col("stop")).join(jump.select(*k, "node", "to"), [*k, "node"])
        at = written(at.union(on.select(*(F.col("to").alias(c) if c == "node" else F.col(c) for c in columns), (F.col("depth") - (1 << j)).alias("depth"))))
    return at.select(*columns)


def control_dependence(forest: Forest, edges: DataFrame) -> DataFrame:
    """keys, n, m: nontermination-insensitive control dependence: from each successor of a branch n up to n's parent, all
    nodes but n. edges: those of sink_forest."""
    k = list(forest.keys)
    arcs = edges.where(F.col("dst") != _root())

    def large(big: DataFrame) -> DataFrame:
        part = forest.part(big)
        parent = part.parents.join(part.depths, [*k, "node"]).select(*k, F.col("node").alias("n"), (F.col("depth") - 1).alias("stop"))
        starts = arcs.select(*k, F.col("src").alias("n"), F.col("dst").alias("node")).join(parent, [*k, "n"])
        return above(part, starts.distinct()).where("n <> node").select(*k, "n", F.col("node").alias("m")).distinct()

    pairs = bits.solved(forest.rows(arcs, "src", "dst"), forest.keys, _controlled, ("n", "m"), large)
    members = forest.sinks.select(*k, F.col("cls").alias("m"), F.col("node").alias("member"))
    return pairs.join(members, [*k, "m"], "left").select(*k, "n", F.coalesce("member", "m").alias("m"))


def nearest_common(forest: Forest, pairs: DataFrame) -> DataFrame:
    """keys, a, b, lca: the nearest common sink dominator of each pair that has one; all nodes of a sink of several."""
    k = list(forest.keys)
    pairs = pairs.select(*k, "a", "b").distinct()

    def large(big: DataFrame) -> DataFrame:
        at = pairs.join(big, k, "left_semi").select(*k, F.col("a").alias("_a"), F.col("b").alias("_b"), "a", "b")
        met = forest.part(big).nearest(forest.represented(forest.represented(at, "a"), "b")).where(F.col("lca") != _root())
        return met.select(*k, F.col("_a").alias("a"), F.col("_b").alias("b"), "lca")

    met = bits.solved(forest.rows(pairs, "a", "b"), forest.keys, _met, ("a", "b", "lca"), large)
    members = forest.sinks.select(*k, F.col("cls").alias("lca"), F.col("node").alias("member"))
    return met.join(members, [*k, "lca"], "left").select(*k, "a", "b", F.coalesce("member", "lca").alias("lca"))
