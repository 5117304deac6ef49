"""Programs with threads: which thread a node belongs to, what may run at the same time, and conflicts.

Spawns are edges (keys, src, dst) of the graph that start the thread at dst; a
thread is named after its first node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bits import spread
from ..plans.fixpoint import written
from ..sources.flowgraphs import FlowGraph
from .dataflow import information_flow
from .structure import components, cyclic, reach_from


def _marked(g: FlowGraph, spawns: DataFrame) -> DataFrame:
    k = list(g.keys)
    return g.edges.join(spawns.select(*k, "src", "dst", F.lit(True).alias("spawn")), [*k, "src", "dst"], "left").withColumn("spawn", F.coalesce("spawn", F.lit(False)))


def threads_of(g: FlowGraph, spawns: DataFrame, entry: DataFrame) -> DataFrame:
    """keys, node, thread: the threads that may run a node; the main thread starts at entry (keys, node)."""
    k = list(g.keys)
    starts = spawns.join(reach_from(g, entry).withColumnRenamed("node", "src"), [*k, "src"], "left_semi").select(*k, F.col("dst").alias("node"))
    seeds = entry.select(*k, "node").union(starts).select(*k, "node", F.col("node").alias("value"))
    own = g.edges.join(spawns.select(*k, "src", "dst"), [*k, "src", "dst"], "left_anti")
    return spread(g.keys, seeds, own).select(*k, "node", F.col("value").alias("thread"))


def many(g: FlowGraph, spawns: DataFrame, entry: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """keys, node: nodes of threads that may run several times at once: spawned on a cycle or from two places, or by such a thread."""
    k = list(g.keys)
    live = written(threads_of(g, spawns, entry).select(*k, "node").distinct())
    loops = cyclic(components(g, closure)).select(*k, F.col("node").alias("src"))
    entries = g.edges.groupBy(*k, "dst").agg(F.count("*").alias("n")).where("n > 1").select(*k, "dst")
    started = spawns.join(live.withColumnRenamed("node", "src"), [*k, "src"], "left_semi")
    seed = started.join(loops, [*k, "src"], "left_semi").select(*k, F.col("dst").alias("node")).union(started.join(entries, [*k, "dst"], "left_semi").select(*k, F.col("dst").alias("node")))
    return reach_from(g, seed)


def spawned_apart(g: FlowGraph, spawns: DataFrame) -> DataFrame:
    """keys, a, b: one is reachable from a spawned thread, the other from what the spawning thread does next."""
    k = list(g.keys)
    then = _marked(g, spawns).where("not spawn").select(*k, "src", F.col("dst").alias("next"))
    pairs = spawns.select(*k, "src", F.col("dst").alias("thread")).join(then, [*k, "src"]).select(*k, "thread", "next").distinct()
    # Nodes go back to what reaches them (2 n), over from what is next to the thread, and on to what the thread reaches
    # (2 n + 1): joining what both reach would give a row for each pair of nodes and each spawn.
    back = g.edges.select(*k, (2 * F.col("dst")).alias("src"), (2 * F.col("src")).alias("dst"))
    over = pairs.select(*k, (2 * F.col("next")).alias("src"), (2 * F.col("thread") + 1).alias("dst"))
    on = g.edges.select(*k, (2 * F.col("src") + 1).alias("src"), (2 * F.col("dst") + 1).alias("dst"))
    seeds = g.nodes.select(*k, (2 * F.col("node")).alias("node"), F.col("node").alias("value"))
    found = spread(g.keys, seeds, back.union(over).union(on)).where(F.pmod("node", F.lit(2)) == 1)
    left = found.select(*k, F.expr("shiftright(node, 1)").alias("a"), F.col("value").alias("b"))
    return left.union(left.select(*k, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def parallel(g: FlowGraph, spawns: DataFrame, entry: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """keys, a, b: nodes that may run at the same time: of threads spawned apart, or of one thread that runs several times."""
    k = list(g.keys)
    t = written(threads_of(g, spawns, entry).groupBy(*k, "node").agg(F.count("*").alias("n"), F.min("thread").alias("thread")).where("n = 1").drop("n"))
    same = written(t.withColumnRenamed("node", "a").join(t.withColumnRenamed("node", "b"), [*k, "thread"]).select(*k, "a", "b"))
    again = same.join(many(g, spawns, entry, closure).withColumnRenamed("node", "a"), [*k, "a"], "left_semi")
    return again.union(spawned_apart(g, spawns).join(same, [*k, "a", "b"], "left_anti"))


def conflicts(mhp: DataFrame, defines: DataFrame, uses: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, m: n defines a name that m, which may run at the same time, uses or defines."""
    k = list(keys)
    touched = uses.union(defines.select(uses.columns)).distinct()
    return mhp.join(defines.select(*k, F.col("node").alias("a"), "name"), [*k, "a"]).join(touched.select(*k, F.col("node").alias("b"), "name"), [*k, "b", "name"]).select(*k, F.col("a").alias("n"), F.col("b").alias("m")).distinct()


def between_threads(mhp: DataFrame, defines: DataFrame, uses: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, m: m uses a name that n, which may run at the same time, defines."""
    k = list(keys)
    return mhp.join(defines.select(*k, F.col("node").alias("a"), "name"), [*k, "a"]).join(uses.select(*k, F.col("node").alias("b"), "name"), [*k, "b", "name"]).select(*k, F.col("a").alias("n"), F.col("b").alias("m")).distinct()


def classified(g: FlowGraph, dependence: DataFrame, mhp: DataFrame, high: DataFrame) -> DataFrame:
    """keys, node: nodes whose information or, if something may run at the same time, whose timing is high:
    along dependences, and along flow edges into nodes that have a parallel one."""
    k = list(g.keys)
    timed = g.edges.join(mhp.select(*k, F.col("a").alias("dst")).distinct(), [*k, "dst"], "left_semi").select(*k, F.col("src").alias("n"), F.col("dst").alias("m"))
    pairs = written(dependence.select(*k, "n", "m").union(timed).distinct())
    return information_flow(pairs, high, g.keys)
