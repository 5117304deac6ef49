"""Control dependence: pairs (n, m), n controls m."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bits
from ..plans.bits import spread
from ..plans.fixpoint import written
from ..sources.flowgraphs import FlowGraph
from .dominance import immediate_dominance, max_dominance, sink_dominance
from .structure import reach_from, with_exit


def from_dominance(g: FlowGraph, dom: DataFrame) -> DataFrame:
    """m dominates some but not all of n's successors."""
    k = list(g.keys)
    hits = g.edges.join(dom.select(*k, F.col("y").alias("dst"), F.col("x").alias("m")), [*k, "dst"]).groupBy(*k, F.col("src").alias("n"), "m").agg(F.count("*").alias("hit"))
    return hits.join(g.outdegree().withColumnRenamed("node", "n"), [*k, "n"]).where("hit < outdegree and n <> m").select(*k, "n", "m")


def _decided(g: FlowGraph, solve: Callable[[dict], tuple], plain: Callable[[FlowGraph], DataFrame]) -> DataFrame:
    """Pairs of small graphs by solve, without a table of dominance; of the others by plain."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        return plain(replace(g, nodes=written(g.nodes.join(big, k, "left_semi")), edges=written(g.edges.join(big, k, "left_semi"))))

    return bits.solved(bits.flow_rows(g), g.keys, solve, ("n", "m"), large)


def insensitive(g: FlowGraph, closure: DataFrame | None = None) -> DataFrame:
    """Nontermination-insensitive control dependence: by sink paths."""
    return _decided(g, bits.sink_control, lambda h: from_dominance(h, sink_dominance(h, closure)))


def sensitive(g: FlowGraph) -> DataFrame:
    """Nontermination-sensitive control dependence: by maximal paths."""
    return _decided(g, bits.maximal_control, lambda h: from_dominance(h, max_dominance(h)))


def classic(g: FlowGraph, exit_: int = -1) -> DataFrame:
    """Classic control dependence of the graph with one exit; only nodes that reach it take part."""
    k = list(g.keys)

    def plain(g: FlowGraph) -> DataFrame:
        full = with_exit(g, exit_)
        ends = full.nodes.select(*k).distinct().withColumn("node", F.lit(exit_).cast("long"))
        whole = full.induced(written(reach_from(full.reverse(), ends)))
        whole = replace(whole, nodes=written(whole.nodes), edges=written(whole.edges))
        return from_dominance(whole, sink_dominance(whole)).where(F.col("m") != exit_)

    return _decided(g, bits.ending_control, plain)


def between(g: FlowGraph, dom: DataFrame) -> DataFrame:
    """keys, n, m: nodes on the way from n's successors to its immediate dominators, without those and n."""
    k = list(g.keys)
    stop = written(immediate_dominance(dom, g.keys).select(*k, F.col("y").alias("n"), F.col("x").alias("m")))
    seed = g.edges.select(*k, F.col("dst").alias("node"), F.col("src").alias("value"))
    on = spread(g.keys, seed, g.edges, stop.select(*k, F.col("m").alias("node"), F.col("n").alias("value"))).select(*k, F.col("value").alias("n"), F.col("node").alias("m"))
    return on.join(stop, [*k, "n", "m"], "left_anti").where("n <> m")
