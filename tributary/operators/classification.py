"""Security of programs with threads: what information and timing of high nodes can reach, and verdicts for each graph.

Dependences are pairs (keys, n, m), n influences m; mhp (keys, a, b) are nodes that may run at the same time, both
ways round; closure (keys, a, b) is reachability.  Levels are two, so a level is the set of nodes that are high.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import written
from ..sources.flowgraphs import FlowGraph
from .dataflow import information_flow
from .dominance import sink_dominance
from .slicing import settled
from .structure import reach_from


def dominators(g: FlowGraph, entry: DataFrame) -> DataFrame:
    """keys, y, x: x is on every path from entry (keys, node) to y; of nodes that entry reaches."""
    live = settled(g.induced(written(reach_from(g, entry))))
    return sink_dominance(settled(live.reverse().cut(entry)))


def common_dominators(doms: DataFrame, mhp: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, a, b, dom: for nodes that may run at the same time, their nearest common dominator that runs at the same time
    as neither. Dominators of a node are a chain, so the nearest one has the most dominators itself."""
    k = list(keys)
    size = doms.groupBy(*k, F.col("y").alias("dom")).agg(F.count("*").alias("size"))
    both = mhp.join(doms.select(*k, F.col("y").alias("a"), F.col("x").alias("dom")), [*k, "a"]).join(doms.select(*k, F.col("y").alias("b"), F.col("x").alias("dom")), [*k, "b", "dom"])
    for side in ("a", "b"):
        both = both.join(mhp.select(*k, F.col("a").alias("dom"), F.col("b").alias(side)), [*k, "dom", side], "left_anti")
    return both.join(size, [*k, "dom"]).groupBy(*k, "a", "b").agg(F.max_by("dom", "size").alias("dom"))


def minimal(dependence: DataFrame, common: DataFrame, closure: DataFrame, high: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, node: high by dependence, or by what stands between a common dominator with a parallel node and the node."""
    k = list(keys)
    stops = common.select(*k, "dom", F.col("a").alias("m")).distinct()
    after = stops.join(closure.select(*k, F.col("a").alias("dom"), F.col("b").alias("n")), [*k, "dom"]).select(*k, "n", "m").distinct()
    inside = after.join(closure.select(*k, F.col("a").alias("n"), F.col("b").alias("m")), [*k, "n", "m"])
    return information_flow(written(dependence.select(*k, "n", "m").union(inside).distinct()), high, keys)


def timed_by(common: DataFrame, closure: DataFrame, timing: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, a, b, x: x decides the relative timing of a and b: it comes after their common dominator, and the timing of one
    depends on it."""
    k = list(keys)
    pre = timing.select(*k, F.col("n").alias("x"), F.col("m").alias("side"))
    each = [common.join(pre.withColumnRenamed("side", side), [*k, side]).select(*k, "a", "b", "dom", "x") for side in ("a", "b")]
    return each[0].union(each[1]).join(closure.select(*k, F.col("a").alias("dom"), F.col("b").alias("x")), [*k, "dom", "x"], "left_semi").select(*k, "a", "b", "x").distinct()


def timing_classes(dependence: DataFrame, conflicts: DataFrame, timed: DataFrame, high: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(keys, node) of high nodes, and (keys, a, b) of pairs whose relative timing is high. A node is high by dependence, or
    if it conflicts with a node and the pair's timing is high."""
    k = list(keys)
    races = timed.join(conflicts.select(*k, F.col("n").alias("a"), F.col("m").alias("b")), [*k, "a", "b"], "left_semi").select(*k, F.col("x").alias("n"), F.col("b").alias("m"))
    nodes = written(information_flow(written(dependence.select(*k, "n", "m").union(races).distinct()), high, keys))
    return nodes, timed.join(nodes.withColumnRenamed("node", "x"), [*k, "x"], "left_semi").select(*k, "a", "b").distinct()


def low_security(g: FlowGraph, dependence: DataFrame, mhp: DataFrame, racing: DataFrame, high: DataFrame, low: DataFrame) -> DataFrame:
    """keys, secure: no low node depends on a high one or on a racing one (keys, node), and no two low nodes run at the same time."""
    k = list(g.keys)
    seeds = high.select(*k, "node").union(racing.select(*k, "node")).distinct()
    bad = information_flow(dependence, seeds, g.keys).join(low, [*k, "node"], "left_semi").select(*k)
    pairs = mhp.join(low.select(*k, F.col("node").alias("a")), [*k, "a"], "left_semi").join(low.select(*k, F.col("node").alias("b")), [*k, "b"], "left_semi").select(*k)
    return _verdict(g, bad.union(pairs))


def timing_security(g: FlowGraph, nodes: DataFrame, pairs: DataFrame, mhp: DataFrame, low: DataFrame) -> DataFrame:
    """keys, secure: no low node is high, and no two low nodes that may run at the same time have high relative timing."""
    k = list(g.keys)
    both = pairs.join(mhp, [*k, "a", "b"], "left_semi").join(low.select(*k, F.col("node").alias("a")), [*k, "a"], "left_semi").join(low.select(*k, F.col("node").alias("b")), [*k, "b"], "left_semi")
    return _verdict(g, nodes.join(low, [*k, "node"], "left_semi").select(*k).union(both.select(*k)))


def _verdict(g: FlowGraph, bad: DataFrame) -> DataFrame:
    k = list(g.keys)
    return g.nodes.select(*k).distinct().join(bad.distinct().withColumn("bad", F.lit(True)), k, "left").select(*k, F.col("bad").isNull().alias("secure"))
