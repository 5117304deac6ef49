"""Post-dominance on all sink paths or all maximal paths, immediate post-dominators, frontiers.

x sink-dominates y if x is on every path from y into a control sink that goes
through all of the sink; x max-dominates y if x is on every maximal path from y.
Both are pairs (y, x) and hold of x = y.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bits
from ..plans.bits import solved
from ..plans.fixpoint import HOPS, least_fixpoint, written
from ..sources.flowgraphs import FlowGraph
from .structure import reach


def sink_dominance(g: FlowGraph, closure: DataFrame | None = None) -> DataFrame:
    """keys, y, x: x is on all sink paths from y.

    It is the greatest set of reachable pairs in which x, if it isn't y, dominates all of y's successors.  Its violations
    are a least fixpoint among reachable pairs: x isn't reachable from a successor of y, or a successor violates it."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        h = replace(g, nodes=written(g.nodes.join(big, k, "left_semi")), edges=written(g.edges.join(big, k, "left_semi")))
        pairs = written(closure.join(big, k, "left_semi")) if closure is not None else reach(h)
        edges = written(h.edges.join(h.outdegree().withColumnRenamed("node", "src"), [*k, "src"]))
        hit = edges.withColumnRenamed("src", "y").join(pairs.select(*k, F.col("a").alias("dst"), F.col("b").alias("x")), [*k, "dst"]).where("y <> x").groupBy(*k, "y", "x").agg(F.count("*").alias("n"), F.first("outdegree").alias("d"))
        bad = hit.where("n < d").select(*k, "x", "y")
        bad = least_fixpoint(bad, lambda delta, _: delta.withColumnRenamed("y", "dst").join(edges, [*k, "dst"]).where("src <> x").select(*k, "x", F.col("src").alias("y")), HOPS)
        return pairs.select(*k, F.col("a").alias("y"), F.col("b").alias("x")).join(bad, [*k, "x", "y"], "left_anti").select(*k, "y", "x")

    return solved(bits.flow_rows(g), g.keys, bits.sink_pairs, ("y", "x"), large)


def max_dominance(g: FlowGraph) -> DataFrame:
    """keys, y, x: x is on all maximal paths from y: it is y, or dominates all of y's successors."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        h = replace(g, nodes=g.nodes.join(big, k, "left_semi"), edges=written(g.edges.join(big, k, "left_semi")))
        edges = written(h.edges.join(h.outdegree().withColumnRenamed("node", "src"), [*k, "src"]))

        def step(delta, seen):
            maybe = delta.withColumnRenamed("y", "dst").join(edges, [*k, "dst"]).select(*k, "src", "x").distinct()
            every = maybe.join(edges, [*k, "src"]).join(seen.withColumnRenamed("y", "dst"), [*k, "dst", "x"])
            return every.groupBy(*k, "src", "x").agg(F.count("*").alias("n"), F.first("outdegree").alias("d")).where("n = d").select(*k, F.col("src").alias("y"), "x")

        return least_fixpoint(h.nodes.select(*k, F.col("node").alias("y"), F.col("node").alias("x")), step)

    return solved(bits.flow_rows(g), g.keys, bits.maximal_pairs, ("y", "x"), large)


def one_dominance(dom: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, y, x: x dominates a dominator of y other than x: x ≠ y, or x = y on a cycle of dominators."""
    k = list(keys)
    other = dom.where("y <> x")
    turned = other.join(other.select(*k, F.col("y").alias("x"), F.col("x").alias("y")), [*k, "y", "x"], "left_semi").select(*k, "y", F.col("y").alias("x")).distinct()
    return other.select(*k, "y", "x").union(turned)


def _sizes(dom: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """How many dominators each node has."""
    return dom.groupBy(*keys, F.col("y").alias(name)).agg(F.count("*").alias("size"))


def immediate_dominance(dom: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, y, x: of those, the ones that all the others dominate; several if they form a cycle.

    Dominance is transitive, so the dominators of x are among those of y: all of them count if they are as many."""
    k = list(keys)
    one = written(one_dominance(dom, keys))
    many = one.groupBy(*k, "y").agg(F.count("*").alias("others"))
    return one.join(_sizes(dom, keys, "x"), [*k, "x"]).join(many, [*k, "y"]).where("size = others").select(*k, "y", "x")


def frontier(g: FlowGraph, dom: DataFrame) -> DataFrame:
    """keys, x, y: x dominates a successor of y but not (twice removed) y itself."""
    k = list(g.keys)
    one = one_dominance(dom, g.keys)
    reached = g.edges.select(*k, F.col("src").alias("y"), F.col("dst").alias("p")).join(dom.select(*k, F.col("y").alias("p"), "x"), [*k, "p"]).select(*k, "x", "y").distinct()
    return reached.join(one, [*k, "x", "y"], "left_anti")


def nearest_common(ancestor: DataFrame, pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, a, b, lca: for pairs of nodes, the common dominators that all other common dominators dominate: those that
    have as many dominators as are common."""
    k = list(keys)
    both = pairs.join(ancestor.select(*k, F.col("y").alias("a"), F.col("x").alias("lca")), [*k, "a"]).join(ancestor.select(*k, F.col("y").alias("b"), F.col("x").alias("lca")), [*k, "b", "lca"])
    both = written(both.select(*k, "a", "b", "lca").distinct())
    common = both.groupBy(*k, "a", "b").agg(F.count("*").alias("common"))
    return both.join(common, [*k, "a", "b"]).join(_sizes(ancestor, keys, "lca"), [*k, "lca"]).where("size = common").select(*k, "a", "b", "lca")
