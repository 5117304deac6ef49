"""Reaching definitions, data dependence, and information flow over dependence graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bits import spread
from ..plans.fixpoint import lattice_fixpoint, written
from ..sources.flowgraphs import FlowGraph


@dataclass(frozen=True)
class Lattice:
    """Values of a column that are joined by an aggregate; bottom (SQL) is below all of them."""

    bottom: str
    join: Callable[[Column], Column]


#: The largest of numbers, 0 at least; the smallest, null before there is one; sets as bits, by union and by intersection.
HIGHEST = Lattice("0L", lambda c: F.max(c))
NEAREST = Lattice("cast(null as bigint)", lambda c: F.min(c))
SOME = Lattice("0L", lambda c: F.bit_or(c))
EVERY = Lattice("-1L", lambda c: F.bit_and(c))
#: Sets as sorted arrays, by union.
UNION = Lattice("cast(array() as array<bigint>)", lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))))  # collect_list skips nulls


@dataclass(frozen=True)
class Analysis:
    """transfer(value) is the value at the end of an edge by the value at its begin and any columns that stand with the
    graph's edges; it must be monotone. initial (keys, node, value): values that nodes have besides."""

    lattice: Lattice
    transfer: Callable[[Column], Column]
    initial: DataFrame | None = None


def analysis(g: FlowGraph, **parts: Analysis) -> DataFrame:
    """keys, node, and a column for each part: the least solutions of forward analyses of all graphs, in one run.

    A node's value is the join of what its in-edges transfer, and of its initial one; of nodes that nothing reaches, the
    bottom is transferred. For a backward analysis turn the edges."""
    k = list(g.keys)
    edges = written(g.edges)
    bottoms = {c: F.expr(p.lattice.bottom) for c, p in parts.items()}
    seed = g.nodes.select(*k, "node", *(v.alias(c) for c, v in bottoms.items()))
    for c, p in parts.items():
        if p.initial is not None:
            seed = seed.union(p.initial.select(*k, "node", *((F.col("value").cast(seed.schema[x].dataType) if x == c else v).alias(x) for x, v in bottoms.items())))

    def step(delta: DataFrame) -> DataFrame:
        on = delta.withColumnRenamed("node", "src").join(edges, [*k, "src"])
        return on.select(*k, F.col("dst").alias("node"), *(p.transfer(F.col(c)).alias(c) for c, p in parts.items()))

    return lattice_fixpoint(seed, step, {c: p.lattice.join for c, p in parts.items()})


def reaching_definitions(g: FlowGraph, defines: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """keys, node, name, origin: the definition of name at origin (keys, node, name of defines) reaches node's start.
    A definition ends those of its name before it, but for names in weak (keys, name), such as arrays."""
    k = [*g.keys, "name"]
    kills = defines if weak is None else defines.join(weak, k, "left_anti")
    # A graph for each name, without the edges that leave definitions which end those before them.
    kept = g.edges.join(defines.select(*k).distinct(), list(g.keys)).join(kills.select(*k, F.col("node").alias("src")), [*k, "src"], "left_anti")
    seed = defines.withColumnRenamed("node", "src").join(g.edges, [*g.keys, "src"]).select(*k, F.col("dst").alias("node"), F.col("src").alias("value"))
    return spread(tuple(k), seed, kept).select(*g.keys, "node", "name", F.col("value").alias("origin"))


def data_dependence(reaching: DataFrame, uses: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, m: m uses a name (uses: keys, node, name) that n defined."""
    k = list(keys)
    return reaching.join(uses, [*k, "node", "name"]).select(*k, F.col("origin").alias("n"), F.col("node").alias("m")).distinct()


def information_flow(dependence: DataFrame, high: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, node: nodes that depend on some of high (keys, node) along pairs (n, m), themselves included."""
    seeds = high.select(*keys, "node", F.lit(0).alias("value"))
    return spread(keys, seeds, dependence.select(*keys, F.col("n").alias("src"), F.col("m").alias("dst"))).select(*keys, "node")


def insecure(dependence: DataFrame, high: DataFrame, low: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, node: observable nodes that information of high nodes reaches. A graph without any is secure."""
    return information_flow(dependence, high, keys).join(low, [*keys, "node"], "left_semi")


def balanced_reach(g: FlowGraph, parens: DataFrame) -> DataFrame:
    """keys, a, b: b is reachable from a by a path whose calls and returns match.
    parens (keys, src, dst, paren '(' or ')', site) marks edges; others are plain, each node reaches itself."""
    k = list(g.keys)
    # Of each node what it reaches, found backwards; a call leads on over its return once the callee's entry reaches its exit.
    plain = g.edges.join(parens, [*k, "src", "dst"], "left_anti").select(*k, F.col("dst").alias("src"), F.col("src").alias("dst"))
    opens = parens.where("paren = '('").select(*k, F.col("src").alias("dst"), F.col("dst").alias("at"), "site")
    closes = parens.where("paren = ')'").select(*k, F.col("src").alias("key"), F.col("dst").alias("src"), "site")
    seeds = g.nodes.select(*k, "node", F.col("node").alias("value"))
    return spread(g.keys, seeds, plain, gates=opens.join(closes, [*k, "site"])).select(*k, F.col("node").alias("a"), F.col("value").alias("b"))
