"""Order dependence: triples (m1, m2, n), n decides whether m1 or m2 comes first.

Whether m1 comes before m2 on all paths from x is dominance in the graph without
the edges that leave m2, so each m2 that can matter gives a graph of its own by
one more key column; all of them run in one job.  Weak order dependence cuts small
graphs inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bits
from ..plans.fixpoint import written
from ..sources.flowgraphs import FlowGraph
from .dominance import max_dominance, sink_dominance
from .structure import reach


def certain(g: FlowGraph, dom: DataFrame) -> DataFrame:
    """keys, n, m: branch n, all of whose successors m dominates, m ≠ n."""
    k = list(g.keys)
    hits = g.edges.join(dom.select(*k, F.col("y").alias("dst"), F.col("x").alias("m")), [*k, "dst"]).groupBy(*k, F.col("src").alias("n"), "m").agg(F.count("*").alias("hit"))
    return hits.join(g.branches().withColumnRenamed("node", "n"), [*k, "n"]).where("hit = outdegree and n <> m").select(*k, "n", "m", "outdegree")


def before(g: FlowGraph, second: DataFrame, dom: DataFrame, dominance: Callable[[FlowGraph], DataFrame]) -> DataFrame:
    """keys, m2, y, x: x comes before m2 on all paths from y, for the m2 of second (keys and m2) and the y that m2 dominates.

    What such a y reaches before m2 is dominated by m2, too, so the graph of m2 has these nodes alone: all graphs
    together are as large as dom."""
    k = list(g.keys)
    nodes = written(dom.select(*k, F.col("x").alias("m2"), F.col("y").alias("node")).join(second, [*k, "m2"], "left_semi"))
    edges = nodes.withColumnRenamed("node", "src").where("src <> m2").join(g.edges, [*k, "src"])
    return dominance(FlowGraph(nodes.select(*k, "m2", "node"), written(edges.select(*k, "m2", "src", "dst")), (*g.keys, "m2")))


def _counted(g: FlowGraph, dominance: Callable[[FlowGraph], DataFrame]) -> DataFrame:
    """keys, n, m1, m2, outdegree, first: of the successors of n, whose both m1 and m2 are certain, how many see m1 first."""
    k = list(g.keys)
    dom = written(dominance(g))
    sure = written(certain(g, dom))
    pairs = sure.select(*k, "n", F.col("m").alias("m1"), "outdegree").join(sure.select(*k, "n", F.col("m").alias("m2")), [*k, "n"]).where("m1 <> m2")
    second = pairs.select(*k, "m2").distinct()
    order = before(g, second, dom, dominance).where("x <> m2")
    hits = pairs.join(g.edges.withColumnRenamed("src", "n"), [*k, "n"]).join(order.select(*k, "m2", F.col("y").alias("dst"), F.col("x").alias("m1")), [*k, "m2", "dst", "m1"])
    return hits.groupBy(*k, "n", "m1", "m2").agg(F.count("*").alias("first"), F.first("outdegree").alias("outdegree"))


def insensitive(g: FlowGraph) -> DataFrame:
    """Nontermination-insensitive order dependence: some but not all successors see m1 first, by sink paths."""
    return _counted(g, sink_dominance).where("first < outdegree").select(*g.keys, "m1", "m2", "n")


def sensitive(g: FlowGraph) -> DataFrame:
    """Nontermination-sensitive order dependence: the same by maximal paths."""
    return _counted(g, max_dominance).where("first < outdegree").select(*g.keys, "m1", "m2", "n")


def decisive(g: FlowGraph) -> DataFrame:
    """Decisive order dependence: one successor always sees m1 first, another m2."""
    k = list(g.keys)
    one = written(_counted(g, max_dominance)).select(*k, "n", "m1", "m2")
    return one.join(one.select(*k, "n", F.col("m2").alias("m1"), F.col("m1").alias("m2")), [*k, "n", "m1", "m2"]).select(*k, "m1", "m2", "n")


def to_pairs(triples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, m: n controls the order of m and some other node."""
    k = list(keys)
    return triples.select(*k, "n", F.col("m1").alias("m")).union(triples.select(*k, "n", F.col("m2").alias("m"))).distinct()


def cut_at_each(g: FlowGraph) -> FlowGraph:
    """A graph for each node of g (key column cut), without the edges that leave it. Its size is the square of g's."""
    k = list(g.keys)
    cuts = g.nodes.withColumnRenamed("node", "cut")
    nodes, edges = g.nodes.join(cuts, k), g.edges.join(cuts, k).where("src <> cut")
    return FlowGraph(written(nodes.select(*k, "cut", "node")), written(edges.select(*k, "cut", "src", "dst")), (*g.keys, "cut"))


def _either_first(g: FlowGraph, without: DataFrame) -> DataFrame:
    """keys, n, m1, m2: branches from which m1 can come before m2, and m2 before m1. without: reachability in cut graphs."""
    k = list(g.keys)
    may = without.where("b <> cut").join(g.branches().select(*k, F.col("node").alias("a")), [*k, "a"], "left_semi").select(*k, F.col("a").alias("n"), F.col("b").alias("m1"), F.col("cut").alias("m2"))
    may = written(may)
    return written(may.join(may.select(*k, "n", F.col("m2").alias("m1"), F.col("m1").alias("m2")), [*k, "n", "m1", "m2"]))


def _weak(g: FlowGraph) -> DataFrame:
    k = list(g.keys)
    cut = cut_at_each(g)
    either = _either_first(g, reach(cut))
    always = max_dominance(cut).where("x <> cut").select(*k, F.col("y").alias("dst"), F.col("x").alias("m1"), F.col("cut").alias("m2"))
    after = either.withColumnRenamed("n", "src").join(g.edges, [*k, "src"]).join(always, [*k, "dst", "m1", "m2"], "left_semi").select(*k, F.col("src").alias("n"), "m1", "m2").distinct()
    return after.union(after.select(*k, "n", F.col("m2").alias("m1"), F.col("m1").alias("m2"))).distinct().select(*k, "m1", "m2", "n")


def _weak_reachable(g: FlowGraph) -> DataFrame:
    k = list(g.keys)
    without = written(reach(cut_at_each(g)))
    either = _either_first(g, without)
    at = either.withColumnRenamed("n", "src").join(g.edges, [*k, "src"])
    at = at.join(reach(g).select(*k, F.col("a").alias("dst"), F.col("b").alias("m1")), [*k, "dst", "m1"], "left_semi")
    after = at.join(without.select(*k, F.col("cut").alias("m1"), F.col("a").alias("dst"), F.col("b").alias("m2")), [*k, "m1", "dst", "m2"], "left_anti").select(*k, F.col("src").alias("n"), "m1", "m2").distinct()
    return after.union(after.select(*k, "n", F.col("m2").alias("m1"), F.col("m1").alias("m2"))).distinct().select(*k, "m1", "m2", "n")


#: Rows of the largest graph that is cut at each node inside a task, and bits of pairs that are looked at there at once.
MOST_CUT, CUT_BITS = 256, 1 << 24


def _cut_in_task(p: dict, decides: Callable[..., np.ndarray]) -> tuple:
    """m1, m2 and n of gathered graphs: either of m1 and m2 may come first from branch n, and decides(graph, column, cut
    edges, reachability along these) has, for each begin of edges, m2 or m1 in the graph cut at the other."""
    f = bits.Flow(p)
    node, out, own = f.node, f.out, f.single()
    branch = np.flatnonzero((np.diff(np.r_[out.starts, len(out.head)]) > 1) & f.own[out.heads])
    may, after = [], []
    for c in range(node.width):
        cut = out.where(node.column[out.head] != c)
        reached = bits.grown(own, cut)
        may.append(reached[out.heads[branch]])
        after.append(decides(f, c, cut, reached)[branch])
    found = [(np.zeros(0, np.int64),) * 3]
    many = max(1, CUT_BITS // node.width**2)
    square = lambda rows, at: np.unpackbits(np.stack([r[at : at + many] for r in rows]).astype("<u8", copy=False).view(np.uint8), axis=2, bitorder="little")[:, :, : node.width] > 0
    for at in range(0, len(branch), many):
        first = square(may, at)
        on = first & first.transpose(2, 1, 0) & square(after, at)
        on[np.arange(node.width), :, np.arange(node.width)] = False
        m2, n, m1 = np.nonzero(on | on.transpose(2, 1, 0))
        n = out.heads[branch[at + n]]
        m1, m2 = node.first[n] + m1, node.first[n] + m2
        keep = f.own[m1] & f.own[m2]
        found.append((n[keep], m1[keep], m2[keep]))
    n, m1, m2 = (np.concatenate(x) for x in zip(*found))
    return node.of[n], node.name[m1], node.name[m2], node.name[n]


def _always_first(f: bits.Flow, column: int, cut: bits.Fold, reached: np.ndarray) -> np.ndarray:
    return f.out(np.bitwise_or, bits.on_maximal_paths(f, cut)[f.out.tail])


def _only_past(f: bits.Flow, column: int, cut: bits.Fold, reached: np.ndarray) -> np.ndarray:
    """What successors that reach the cut node can't reach but past it."""
    at_cut = (reached[:, column >> 6] >> np.uint64(column & 63)) & np.uint64(1)
    return f.out(np.bitwise_or, np.where(at_cut[f.out.tail, None] > 0, ~reached[f.out.tail], np.uint64(0)))


def _dependent(g: FlowGraph, decides: Callable[..., np.ndarray], plain: Callable[[FlowGraph], DataFrame]) -> DataFrame:
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        return plain(replace(g, nodes=written(g.nodes.join(big, k, "left_semi")), edges=written(g.edges.join(big, k, "left_semi"))))

    return bits.solved(bits.flow_rows(g), g.keys, lambda p: _cut_in_task(p, decides), ("m1", "m2", "n"), large, MOST_CUT)


def weak(g: FlowGraph) -> DataFrame:
    """Weak order dependence: from n either of m1 and m2 may come first, and after some successor of n, on maximal paths,
    one of them always does."""
    return _dependent(g, _always_first, _weak)


def weak_reachable(g: FlowGraph) -> DataFrame:
    """Weak order dependence by reachability: from n either may come first, and some successor of n reaches one of them
    and can't reach the other but past it."""
    return _dependent(g, _only_past, _weak_reachable)
