"""Reachability, components, sinks, and transformations of graphs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bits import spread
from ..plans.fixpoint import written
from ..sources.flowgraphs import FlowGraph
from .paths import roots


def reach(g: FlowGraph) -> DataFrame:
    """keys, a, b: b is reachable from a; every node from itself."""
    k = list(g.keys)
    seed = g.nodes.select(*k, "node", F.col("node").alias("value")).union(g.edges.select(*k, F.col("dst").alias("node"), F.col("src").alias("value")))
    return spread(g.keys, seed, g.edges).select(*k, F.col("value").alias("a"), F.col("node").alias("b"))


def reach_from(g: FlowGraph, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from seeds (keys and node), without building the closure."""
    return spread(g.keys, seeds.select(*g.keys, "node", F.lit(0).alias("value")), g.edges).select(*g.keys, "node")


def components(g: FlowGraph, closure: DataFrame | None = None) -> DataFrame:
    """keys, node, scc (the component's smallest node), size."""
    k = list(g.keys)
    r = closure if closure is not None else reach(g)
    both = r.join(r.select(*k, F.col("b").alias("a"), F.col("a").alias("b")), [*k, "a", "b"])
    return both.groupBy(*k, F.col("a").alias("node")).agg(F.min("b").alias("scc"), F.count("*").alias("size"))


def sinks(g: FlowGraph, scc: DataFrame) -> DataFrame:
    """keys, node, sink: nodes of control sinks, components that no edge leaves."""
    k = list(g.keys)
    a, b = scc.select(*k, F.col("node").alias("src"), F.col("scc").alias("from")), scc.select(*k, F.col("node").alias("dst"), F.col("scc").alias("to"))
    left = g.edges.join(a, [*k, "src"]).join(b, [*k, "dst"]).where("`from` <> `to`").select(*k, F.col("from").alias("scc")).distinct()
    return scc.join(left, [*k, "scc"], "left_anti").select(*k, "node", F.col("scc").alias("sink"))


def cyclic(scc: DataFrame) -> DataFrame:
    """Nodes in a component of two or more; a node with an edge to itself alone is in none."""
    return scc.where("size > 1").drop("size", "scc")


def quotient(g: FlowGraph, classes: DataFrame) -> FlowGraph:
    """The graph of classes (keys, node, cls), without edges of a class to itself."""
    k = list(g.keys)
    edges = g.edges.join(classes.select(*k, F.col("node").alias("src"), F.col("cls").alias("a")), [*k, "src"]).join(classes.select(*k, F.col("node").alias("dst"), F.col("cls").alias("b")), [*k, "dst"])
    return replace(g, nodes=classes.select(*k, F.col("cls").alias("node")).distinct(), edges=edges.where("a <> b").select(*k, F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


def transitive_reduction(g: FlowGraph, closure: DataFrame, scc: DataFrame) -> DataFrame:
    """keys, src, dst: the condensation's edges that no longer path makes up for."""
    k = list(g.keys)
    q = quotient(g, scc.select(*k, "node", F.col("scc").alias("cls")))
    r = closure.join(q.nodes.withColumnRenamed("node", "a"), [*k, "a"], "left_semi").join(q.nodes.withColumnRenamed("node", "b"), [*k, "b"], "left_semi").where("a <> b")
    longer = q.edges.select(*k, "src", F.col("dst").alias("m")).join(r.select(*k, F.col("a").alias("m"), F.col("b").alias("dst")), [*k, "m"]).select(*k, "src", "dst").distinct()
    return q.edges.join(longer, [*k, "src", "dst"], "left_anti")


def next_branch(g: FlowGraph) -> DataFrame:
    """keys, node, branch: the first node with two or more successors on the chain of single successors from node
    (itself at once); nodes whose chain ends or turns back have none. Pointers double in length each round."""
    k = list(g.keys)
    out = g.outdegree()
    chain = written(g.edges.join(out.where("outdegree = 1").select(*k, F.col("node").alias("src")), [*k, "src"]).select(*k, F.col("src").alias("node"), F.col("dst").alias("to")))
    found = written(out.where("outdegree > 1").select(*k, "node", F.col("node").alias("branch")))
    while True:
        more = chain.join(found.select(*k, F.col("node").alias("to"), "branch"), [*k, "to"]).select(*k, "node", "branch")
        more = written(more.join(found, [*k, "node"], "left_anti"))
        rest = chain.join(more, [*k, "node"], "left_anti")
        # A chain that comes back to where it jumps from can't end at a branch, and stays as it is.
        jumped = rest.join(chain.select(*k, F.col("node").alias("to"), F.col("to").alias("far")), [*k, "to"]).select(*k, "node", F.col("far").alias("to"))
        if more.isEmpty():
            return found
        found, chain = written(found.union(more)), written(jumped)


def join_nodes(g: FlowGraph) -> DataFrame:
    """Nodes with two or more predecessors."""
    return g.edges.groupBy(*g.keys, F.col("dst").alias("node")).agg(F.count("*").alias("n_in")).where("n_in > 1")


def with_exit(g: FlowGraph, exit_: int = -1) -> FlowGraph:
    """With one exit node that every node without successors leads to."""
    k = list(g.keys)
    ends = g.nodes.join(g.edges.select(*k, F.col("src").alias("node")).distinct(), [*k, "node"], "left_anti")
    e = F.lit(exit_).cast("long")
    return replace(g, nodes=g.nodes.union(g.nodes.select(*k).distinct().select(*k, e)), edges=g.edges.union(ends.select(*k, "node", e)))


def chop(closure: DataFrame, keys: tuple[str, ...], source: DataFrame, target: DataFrame) -> DataFrame:
    """Nodes on paths from some of source to some of target (keys and node)."""
    k = list(keys)
    forward = closure.join(source.withColumnRenamed("node", "a"), [*k, "a"], "left_semi").select(*k, F.col("b").alias("node")).distinct()
    backward = closure.join(target.withColumnRenamed("node", "b"), [*k, "b"], "left_semi").select(*k, F.col("a").alias("node")).distinct()
    return forward.join(backward, [*k, "node"])


def is_transitive(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, transitive for each graph of pairs (keys, src, dst)."""
    k = list(keys)
    two = pairs.select(*k, "src", F.col("dst").alias("m")).join(pairs.select(*k, F.col("src").alias("m"), "dst"), [*k, "m"]).select(*k, "src", "dst").distinct()
    missing = two.join(pairs, [*k, "src", "dst"], "left_anti").select(*k).distinct().withColumn("missing", F.lit(True))
    return pairs.select(*k).distinct().join(missing, k, "left").select(*k, F.col("missing").isNull().alias("transitive"))


def reducible(g: FlowGraph, entries: DataFrame) -> DataFrame:
    """keys, left, reducible of each graph with an entry (keys and node): nodes that are left of those that the entry
    reaches, when edges to oneself are dropped and nodes with one predecessor put into it, again and again; one is left of
    a reducible graph. A round puts whole chains of such nodes into their heads, so rounds grow with the nesting of loops."""
    k = list(g.keys)
    entries = written(entries.select(*k, "node").distinct())
    part = g.induced(written(reach_from(g, entries)))
    nodes, edges = written(part.nodes), written(part.edges.where("src <> dst"))
    while True:
        single = edges.groupBy(*k, F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.first("src").alias("parent")).where("n = 1").join(entries, [*k, "node"], "left_anti").select(*k, "node", "parent")
        single = written(single)
        if single.isEmpty():
            counts = nodes.groupBy(*k).agg(F.count("*").alias("left"))
            return counts.withColumn("reducible", F.col("left") == 1)
        heads = written(roots(single, g.keys).select(*k, "node", F.col("root").alias("head")))
        at = lambda end: heads.select(*k, F.col("node").alias(end), F.col("head").alias(f"to_{end}"))
        moved = edges.join(at("src"), [*k, "src"], "left").join(at("dst"), [*k, "dst"], "left").select(*k, F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst"))
        nodes, edges = written(nodes.join(single, [*k, "node"], "left_anti")), written(moved.where("src <> dst").distinct())
