"""Matched calls and returns: components, folding, dominance, and configurations that lead to given ones.

parens (keys, src, dst, paren '(' or ')', site) mark the edges of a graph that call and return.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans import bits
from ..plans.bits import spread
from ..plans.fixpoint import HOPS, least_fixpoint, unsent, written
from ..sources.flowgraphs import FlowGraph
from .structure import components, quotient


def same_level_components(balanced: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, node, scc, size: nodes that reach one another by paths whose calls and returns match (balanced: keys, a, b)."""
    k = list(keys)
    both = balanced.join(balanced.select(*k, F.col("a").alias("b"), F.col("b").alias("a")), [*k, "a", "b"])
    return both.groupBy(*k, F.col("a").alias("node")).agg(F.min("b").alias("scc"), F.count("*").alias("size"))


def two_pass_folding(g: FlowGraph, parens: DataFrame) -> tuple[DataFrame, FlowGraph]:
    """Components without edges that return, folded; then components of that graph without edges that call.

    Gives keys, node, first, cls (the smallest node of its component after the first and after both passes), and the
    graph of the classes. In it no cycle calls alone or returns alone."""
    k = list(g.keys)
    marked = g.edges.join(parens.select(*k, "src", "dst", "paren"), [*k, "src", "dst"], "left")

    def pass_(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return written(components(FlowGraph(nodes, written(edges.select(*k, "src", "dst").distinct()), g.keys)).select(*k, "node", "scc"))

    marked = written(marked)
    first = pass_(g.nodes, marked.where("paren is null or paren = '('"))
    to = lambda end: first.select(*k, F.col("node").alias(end), F.col("scc").alias(f"of_{end}"))
    folded = marked.where("paren is null or paren = ')'").join(to("src"), [*k, "src"]).join(to("dst"), [*k, "dst"]).where("of_src <> of_dst").select(*k, F.col("of_src").alias("src"), F.col("of_dst").alias("dst"))
    second = pass_(first.select(*k, F.col("scc").alias("node")).distinct(), folded)
    classes = written(first.withColumnRenamed("scc", "first").join(second.select(*k, F.col("node").alias("first"), F.col("scc").alias("cls")), [*k, "first"]).select(*k, "node", "first", "cls"))
    return classes, quotient(g, classes.select(*k, "node", "cls"))


#: Kinds of gathered rows and what stands in them: (node), (node), (src, dst), (src, dst, site, whether it has one), the same
#: of other marks (whether they are calls of a site).
NODE, START, EDGE, CLOSE, MARK = range(5)


def valid_dominance(g: FlowGraph, parens: DataFrame, start: DataFrame) -> DataFrame:
    """keys, y, x: x dominates y from start (keys and node, one a graph) on paths whose returns match their calls.

    The greatest solution of: y is dominated by itself, and by what every way into y has in common, which for a return
    edge is what dominates its begin or any call of its site. Its complement is computed, a least fixpoint: x doesn't
    dominate y if on one way in it dominates neither. Nodes that nothing leads to are dominated by all."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        mine = lambda df: unsent(df.join(big, k, "left_semi"))
        return _valid_by_tables(FlowGraph(mine(g.nodes), mine(g.edges), g.keys), mine(parens), mine(start))

    if not isinstance(parens.schema["site"].dataType, IntegralType):
        return _valid_by_tables(g, parens, start)
    returns = F.col("paren").eqNullSafe(")")
    marks = parens.select(*k, "src", "dst", "paren", F.coalesce("site", F.lit(0)).alias("site"), (F.col("site").isNotNull() & F.col("paren").isin("(", ")")).cast("long").alias("has"))
    rows = bits.rows_of(g.nodes, g.keys, NODE, "node").union(bits.rows_of(start, g.keys, START, "node")).union(bits.rows_of(g.edges, g.keys, EDGE, "src", "dst"))
    rows = rows.union(bits.rows_of(marks.where(returns), g.keys, CLOSE, "src", "dst", "site", "has")).union(bits.rows_of(marks.where(~returns), g.keys, MARK, "src", "dst", "site", "has"))
    return bits.solved(rows, g.keys, _valid, ("y", "x"), large)


def _valid(p: dict) -> tuple:
    """Dominance of gathered graphs; bits are of nodes that don't dominate."""
    kind, graph, a, b, site, has = (p[x] for x in ("kind", "graph", *bits.ROW))
    pair = kind >= EDGE
    node = bits.Numbers(np.r_[graph, graph[pair]], np.r_[a, b[pair]])
    n, src, dst = len(node.of), node.at[: len(kind)], np.full(len(kind), -1)
    dst[pair] = node.at[len(kind) :]
    own, starts = np.zeros(n, bool), np.zeros(n, bool)
    own[src[kind == NODE]], starts[src[kind == START]] = True, True
    # The nodes that call from each site; returns to a site without any are plain edges.
    call, close = (kind == MARK) & (has > 0), (kind == CLOSE) & (has > 0)
    sites = bits.Numbers(np.r_[graph[call], graph[close]], np.r_[site[call], site[close]]).at
    called = bits.Fold(sites[: call.sum()], src[call])
    of = np.full(len(kind), -1)
    of[close] = sites[call.sum() :]
    close &= np.isin(of, called.heads)
    # Edges and marks of the same ends; an edge that only returns isn't plain.
    ends = src * n + dst
    edge = (kind == EDGE) & ~starts[dst]
    back = np.flatnonzero(close & np.isin(ends, ends[edge]))
    other = ((kind == MARK) | (kind == CLOSE)) & ~close
    plain = edge & (~np.isin(ends, ends[back]) | np.isin(ends, ends[other]))
    along, over = bits.Fold(dst[plain], src[plain]), bits.Fold(dst[back], np.arange(len(back)))
    of = np.searchsorted(called.heads, of[back])

    single = bits.ones(n, node.width, np.arange(n), node.column)
    every = bits.ones(int(graph.max(initial=-1)) + 1, node.width, node.of[own], node.column[own])
    bad = np.where(starts[:, None], every[node.of] & ~single, np.uint64(0))
    while True:
        more = bad.copy()
        if len(along.heads):
            more[along.heads] |= along(np.bitwise_or, bad[along.tail])
        if len(back):
            free = called(np.bitwise_and, bad[called.tail])
            more[over.heads] |= over(np.bitwise_or, (bad[src[back]] & free[of])[over.tail])
        more &= ~single
        if np.array_equal(more, bad):
            break
        bad = more
    y, x = bits.pairs(np.where(own[:, None], every[node.of] & ~bad, np.uint64(0)))
    return node.of[y], node.name[y], node.name[node.first[y] + x]


def _valid_by_tables(g: FlowGraph, parens: DataFrame, start: DataFrame) -> DataFrame:
    k = list(g.keys)
    marks = parens.select(*k, "src", "dst", "paren", "site")
    inner = g.edges.join(start.withColumnRenamed("node", "dst"), [*k, "dst"], "left_anti").join(marks, [*k, "src", "dst"], "left")
    calls = written(parens.where("paren = '('").select(*k, "site", F.col("src").alias("call")).distinct())
    n_calls = calls.groupBy(*k, "site").agg(F.count("*").alias("calls"))
    inner = written(inner.join(n_calls, [*k, "site"], "left").select(*k, "src", "dst", "site", F.when(F.col("paren") == ")", F.coalesce("calls", F.lit(0))).otherwise(F.lit(0)).alias("calls")))
    plain, back = inner.where("calls = 0"), inner.where("calls > 0")
    seed = start.select(*k, F.col("node").alias("y")).join(g.nodes.withColumnRenamed("node", "x"), k).where("x <> y")

    def step(delta: DataFrame, seen: DataFrame) -> DataFrame:
        on = front = delta
        for _ in range(HOPS):
            front = front.withColumnRenamed("y", "src").join(plain, [*k, "src"]).where("dst <> x").select(*k, F.col("dst").alias("y"), "x").distinct()
            on = front if on is delta else on.union(front)
        # Return edges that the new rows touch, at their begin or at a call; all calls must be without x, too.
        by_call = delta.withColumnRenamed("y", "call").join(calls, [*k, "call"]).select(*k, "site", "x").join(back, [*k, "site"]).select(*k, "src", "dst", "site", "calls", "x")
        by_begin = delta.withColumnRenamed("y", "src").join(back, [*k, "src"]).select(*k, "src", "dst", "site", "calls", "x")
        maybe = by_call.union(by_begin).distinct().join(seen.withColumnRenamed("y", "src"), [*k, "src", "x"], "left_semi")
        at = maybe.join(calls, [*k, "site"]).join(seen.withColumnRenamed("y", "call"), [*k, "call", "x"], "left_semi")
        through = at.groupBy(*k, "src", "dst", "site", "x").agg(F.count("*").alias("free"), F.first("calls").alias("calls")).where("free = calls").select(*k, F.col("dst").alias("y"), "x")
        return on.union(through).where("x <> y").select(*k, "y", "x")

    bad = least_fixpoint(seed.select(*k, "y", "x"), step)
    every = g.nodes.withColumnRenamed("node", "y").join(g.nodes.withColumnRenamed("node", "x"), k)
    return every.join(bad, [*k, "y", "x"], "left_anti").select(*k, "y", "x")


def reduced(dom: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, y, x: of the dominators x ≠ y those that y has not through another one."""
    k = list(keys)
    own = written(dom.where("y <> x"))
    other = own.join(own.select(*k, F.col("y").alias("x"), F.col("x").alias("far")), [*k, "x"]).where("far <> y").select(*k, "y", F.col("far").alias("x")).distinct()
    return own.join(other, [*k, "y", "x"], "left_anti").select(*k, "y", "x")


def pre_star(plain: DataFrame, calls: DataFrame, exits: DataFrame, automaton: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, src, symbol, dst: the automaton (the same columns, state 0 its start), saturated: it then accepts all stacks of
    nodes, the running one on top, from which some stack that it accepted before is reached.

    plain (keys, node, next), calls (keys, node, entry, back) and exits (keys, node) are the rules: the top node is replaced,
    or by the callee's entry above the return node, or taken away. If what a rule puts on the stack is read from state 0 to
    s, the node it replaces is read to s, too."""
    k = list(keys)
    zero = F.lit(0).cast(automaton.schema["src"].dataType)
    plain, calls = written(plain), written(calls)
    # States to which symbols are read from state 0, at the symbol's node 2 n; what other states read is given, at the nodes
    # of their own pairs, 2 n + 1. Of a call, what its return node is read to from where its callee's entry is read to counts.
    rest = automaton.where("src <> 0").select(*k, "src", "symbol").distinct()
    rest = written(rest.select(*k, F.col("src").alias("mid"), "symbol", (2 * F.row_number().over(Window.partitionBy(*k).orderBy("src", "symbol")).cast("long") + 1).alias("at_mid")))
    top = automaton.where("src = 0").select(*k, "symbol", "dst").union(exits.select(*k, F.col("node"), zero))
    seeds = top.select(*k, (2 * F.col("symbol")).alias("node"), F.col("dst").alias("value"))
    seeds = seeds.union(automaton.where("src <> 0").withColumnRenamed("src", "mid").join(rest, [*k, "mid", "symbol"]).select(*k, F.col("at_mid").alias("node"), F.col("dst").alias("value")))
    edges = plain.select(*k, (2 * F.col("next")).alias("src"), (2 * F.col("node")).alias("dst"))
    call = calls.select(*k, (2 * F.col("node")).alias("dst"), (2 * F.col("entry")).alias("at"), "back")
    gates = call.select(*k, (2 * F.col("back")).alias("src"), "dst", "at", F.lit(0).alias("key"))
    gates = gates.union(call.join(rest.withColumnRenamed("symbol", "back"), [*k, "back"]).select(*k, F.col("at_mid").alias("src"), "dst", "at", F.col("mid").alias("key")))
    found = spread(keys, seeds, edges, gates=gates).where(F.pmod("node", F.lit(2)) == 0)
    found = found.select(*k, zero.alias("src"), F.expr("shiftright(node, 1)").alias("symbol"), F.col("value").alias("dst"))
    return found.union(automaton.where("src <> 0").select(*k, "src", "symbol", "dst").distinct())
