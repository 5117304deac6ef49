"""Slices, and closure under what decides the next observation. Criteria and slices are nodes (keys, node)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bits import spread
from ..plans.fixpoint import least_fixpoint, written
from ..sources.flowgraphs import FlowGraph
from . import control
from .dominance import immediate_dominance, sink_dominance
from .structure import reach_from


def backward(pairs: DataFrame, criterion: DataFrame, keys: tuple[str, ...], triples: DataFrame | None = None) -> DataFrame:
    """The least set with the criterion, closed under dependence pairs (n, m) backwards, and under triples (m1, m2, n)
    of which it has m1 and m2."""
    k = list(keys)
    if triples is None:
        seeds = criterion.select(*k, "node", F.lit(0).alias("value"))
        return spread(keys, seeds, pairs.select(*k, F.col("m").alias("src"), F.col("n").alias("dst"))).select(*k, "node")

    def step(delta, seen):
        out = delta.withColumnRenamed("node", "m").join(pairs, [*k, "m"]).select(*k, F.col("n").alias("node"))
        a = triples.join(delta.withColumnRenamed("node", "m1"), [*k, "m1"]).join(seen.withColumnRenamed("node", "m2"), [*k, "m2"])
        b = triples.join(delta.withColumnRenamed("node", "m2"), [*k, "m2"]).join(seen.withColumnRenamed("node", "m1"), [*k, "m1"])
        return out.union(a.select(*k, F.col("n").alias("node"))).union(b.select(*k, F.col("n").alias("node")))

    return least_fixpoint(criterion.select(*k, "node"), step)


def settled(g: FlowGraph) -> FlowGraph:
    """The graph as tables, for what reads it many times."""
    return replace(g, nodes=written(g.nodes), edges=written(g.edges))


def control_slice(g: FlowGraph, criterion: DataFrame, dependence: Callable[[FlowGraph], DataFrame] = control.insensitive) -> DataFrame:
    """Closed under control dependence."""
    return backward(written(dependence(g)), criterion, g.keys)


def order_slice(g: FlowGraph, criterion: DataFrame, dependence: Callable[[FlowGraph], DataFrame] = control.insensitive) -> DataFrame:
    """Closed under control and order dependence: control dependence alone suffices once the edges that leave the criterion are cut."""
    return control_slice(settled(g.cut(criterion)), criterion, dependence)


def weak_slice(g: FlowGraph, criterion: DataFrame) -> DataFrame:
    """Weak order dependence: only nodes that reach the criterion count."""
    to = written(reach_from(g.reverse(), criterion))
    return order_slice(g.induced(to), criterion)


def weak_closure(g: FlowGraph, criterion: DataFrame) -> DataFrame:
    """Weak control closure: besides, only nodes that the criterion reaches."""
    h = settled(g.induced(written(reach_from(g.reverse(), criterion))))
    return order_slice(h.induced(written(reach_from(h, criterion))), criterion)


def by_immediate(g: FlowGraph, criterion: DataFrame, dominance: Callable[[FlowGraph], DataFrame] = sink_dominance) -> DataFrame:
    """The order slice again: of the nodes that reach the criterion in the cut graph, those without an immediate dominator, and the criterion."""
    k = list(g.keys)
    h = settled(g.cut(criterion))
    imm = immediate_dominance(dominance(h), g.keys).select(*k, F.col("y").alias("node")).distinct()
    to = reach_from(h.reverse(), criterion)
    return to.join(imm, [*k, "node"], "left_anti").union(criterion.select(*k, "node")).distinct()


def next_observable(g: FlowGraph, observed: DataFrame) -> DataFrame:
    """keys, node, first: the observed nodes that node can meet first (an observed node meets itself)."""
    k = list(g.keys)
    cut = settled(g.cut(observed))
    seed = observed.select(*k, "node", F.col("node").alias("value"))
    return spread(g.keys, seed, cut.reverse().edges).select(*k, "node", F.col("value").alias("first"))


def weakly_closed(g: FlowGraph, observed: DataFrame) -> DataFrame:
    """keys, closed: whether every other node meets at most one observed node first."""
    k = list(g.keys)
    bad = next_observable(g, observed).groupBy(*k, "node").agg(F.count("*").alias("n")).where("n > 1").select(*k).distinct().withColumn("bad", F.lit(True))
    return g.nodes.select(*k).distinct().join(bad, k, "left").select(*k, F.col("bad").isNull().alias("closed"))


def sensitive_slice(g: FlowGraph, criterion: DataFrame) -> DataFrame:
    return control_slice(g, criterion, control.sensitive)
