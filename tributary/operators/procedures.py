"""Dependence graphs of programs with procedures: slices by kind of edge, summary edges, context-sensitive chops.

A dependence graph is a table of edges (keys, src, dst, kind).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans import bits
from ..plans.bits import spread
from ..plans.fixpoint import HOPS, least_fixpoint, unsent, written
from ..sources.flowgraphs import FlowGraph

CONTROL, DATA, CALL, SUMMARY, SPAWN, THREADS, IN, OUT = "control", "data", "call", "summary", "spawn", "threads", "in", "out"
WITHIN = (CONTROL, DATA, SUMMARY)
UPWARDS = (CONTROL, DATA, CALL, SUMMARY, SPAWN, THREADS, IN)
DOWNWARDS = (CONTROL, DATA, SUMMARY, SPAWN, THREADS, OUT)


def backward(edges: DataFrame, criterion: DataFrame, kinds: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Nodes that reach the criterion (keys, node) along edges of the kinds."""
    k = list(keys)
    own = unsent(edges.where(F.col("kind").isin(*kinds)).select(*k, "src", "dst").distinct())
    if _integers(own, "src", "dst"):
        return _closure(own, criterion, "dst", "src", keys)
    return least_fixpoint(criterion.select(*k, "node"), lambda delta, _: delta.withColumnRenamed("node", "dst").join(own, [*k, "dst"]).select(*k, F.col("src").alias("node")), HOPS)


def _integers(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[c].dataType, IntegralType) for c in columns)


def _closure(edges: DataFrame, seeds: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, node: what seeds (keys, node) lead to along edges from column a to column b."""
    seeds = seeds.select(*keys, "node", F.lit(0).alias("value"))
    return spread(keys, seeds, edges.select(*keys, F.col(a).alias("src"), F.col(b).alias("dst"))).select(*keys, "node")


def forward(edges: DataFrame, criterion: DataFrame, kinds: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    return backward(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"), criterion, kinds, keys)


def two_phase(edges: DataFrame, criterion: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The context-sensitive slice: first up into callers, then down into callees; needs summary edges."""
    return backward(edges, backward(edges, criterion, UPWARDS, keys), DOWNWARDS, keys)


def within_chop(edges: DataFrame, source: DataFrame, target: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Nodes that reach the source and that the target reaches, inside procedures."""
    return backward(edges, source, WITHIN, keys).join(forward(edges, target, WITHIN, keys), [*keys, "node"])


def summary_edges(edges: DataFrame, ins: DataFrame, outs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, src, dst: from an actual-in to an actual-out of one call, if what comes in can get out.

    ins: keys, actual, formal, call of the actual-in nodes; outs: the same of the actual-out nodes.
    reached (node, out) says that node reaches the formal-out `out` inside its procedure; a pair that reaches
    from a formal-in gives a summary edge at each call, which leads on."""
    k = list(keys)
    inside = unsent(edges.where(F.col("kind").isin(CONTROL, DATA)).select(*k, F.col("src").alias("prev"), F.col("dst").alias("node")).distinct())

    def summaries(reached):
        at = reached.join(ins.select(*k, F.col("formal").alias("node"), F.col("actual").alias("src"), "call"), [*k, "node"])
        return at.join(outs.select(*k, F.col("formal").alias("out"), F.col("actual").alias("dst"), "call"), [*k, "out", "call"]).select(*k, "src", "dst").distinct()

    def step(delta, seen):
        along = delta.join(inside, [*k, "node"]).select(*k, F.col("prev").alias("node"), "out")

        def over(new, reached):
            return new.withColumnRenamed("dst", "node").join(reached, [*k, "node"]).select(*k, F.col("src").alias("node"), "out")

        return along.union(over(summaries(delta), seen)).union(over(summaries(seen), delta))

    seed = outs.select(*k, F.col("formal").alias("node"), F.col("formal").alias("out")).distinct()
    if _integers(inside, "prev", "node"):
        calls = ins.select(*k, F.col("formal").alias("at"), F.col("actual").alias("dst"), "call").join(outs.select(*k, F.col("formal").alias("key"), F.col("actual").alias("src"), "call"), [*k, "call"])
        at = ins.select(*k, F.col("formal").alias("node")).distinct()
        reached = spread(keys, seed.withColumnRenamed("out", "value"), inside.select(*k, F.col("node").alias("src"), F.col("prev").alias("dst")), gates=calls.distinct(), at=at)
        return summaries(reached.withColumnRenamed("value", "out"))
    return summaries(least_fixpoint(seed, step))


def with_summaries(edges: DataFrame, ins: DataFrame, outs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return edges.select(*keys, "src", "dst", "kind").union(summary_edges(edges, ins, outs, keys).withColumn("kind", F.lit(SUMMARY)))


#: Kinds of gathered rows of a chop, and what stands in them: (node), (src, dst), (src, dst, site, whether it is an edge), the
#: same of returns, (node), (node).
NODE, PLAIN, OPEN, CLOSE, SOURCE, TARGET = range(6)
#: Rows of the largest graph that is chopped inside a task; pairs that are split there at once.
MOST_CHOP, SPLIT = 512, 1 << 17


def balanced_chop(g: FlowGraph, parens: DataFrame, balanced: Callable[[FlowGraph, DataFrame], DataFrame] | DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """keys, node: nodes on paths from source to target whose returns match their calls: returns out of source's
    procedures first, calls into target's then; balanced pairs (keys, a, b) stand for whole calls. Small graphs find their
    pairs inside tasks; of the others they are given, or are balanced(graph, parens)."""
    k = list(g.keys)

    def large(big: DataFrame) -> DataFrame:
        mine = lambda df: written(df.join(big, k, "left_semi"))
        h, marks = FlowGraph(mine(g.nodes), mine(g.edges), g.keys), mine(parens)
        pairs = mine(balanced) if isinstance(balanced, DataFrame) else written(balanced(h, marks))
        return _chop_by_tables(h, marks, pairs, mine(source), mine(target))

    marked = parens.join(g.edges.withColumn("edge", F.lit(1)), [*k, "src", "dst"], "left").withColumn("edge", F.coalesce("edge", F.lit(0)))
    rows = bits.rows_of(g.nodes, g.keys, NODE, "node").union(bits.rows_of(g.edges.join(parens, [*k, "src", "dst"], "left_anti"), g.keys, PLAIN, "src", "dst"))
    for paren, kind in (("(", OPEN), (")", CLOSE)):
        rows = rows.union(bits.rows_of(marked.where(F.col("paren") == paren), g.keys, kind, "src", "dst", "site", "edge"))
    rows = rows.union(bits.rows_of(source, g.keys, SOURCE, "node")).union(bits.rows_of(target, g.keys, TARGET, "node"))
    return bits.solved(rows, g.keys, _chop, ("node",), large, MOST_CHOP)


def _chop(p: dict) -> tuple:
    """Nodes of the chops of gathered graphs."""
    kind, graph, n_rows = p["kind"], p["graph"], len(p["kind"])
    pair = (kind == PLAIN) | (kind == OPEN) | (kind == CLOSE)
    node = bits.Numbers(np.r_[graph, graph[pair]], np.r_[p["a"], p["b"][pair]])
    n, a, b = len(node.of), node.at[:n_rows], np.full(n_rows, -1)
    b[pair] = node.at[n_rows:]
    plain, opens, closes = (np.flatnonzero(kind == x) for x in (PLAIN, OPEN, CLOSE))
    # A call and a return of one site: from src over the callee's entry and exit to dst.
    site = bits.Numbers(np.r_[graph[opens], graph[closes]], np.r_[p["c"][opens], p["c"][closes]]).at
    of_open, of_close = site[: len(opens)], site[len(opens) :]
    order = np.argsort(of_close, kind="stable")
    low, high = (np.searchsorted(of_close[order], of_open, side) for side in ("left", "right"))
    many = high - low
    call = np.repeat(opens, many)
    back = closes[order[np.arange(len(call)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]]
    src, entry, exit_, dst = a[call], b[call], a[back], b[back]
    own = np.zeros(n, bool)
    own[a[kind == NODE]] = True
    balanced = bits.ones(n, node.width, np.flatnonzero(own), node.column[own])
    has = lambda rows, row, column: (rows[row, node.column[column] >> 6] >> (node.column[column] & 63).astype(np.uint64)) & np.uint64(1) > 0
    whole = np.zeros(len(src), bool)
    while True:
        balanced = bits.grown(balanced, bits.Fold(np.r_[a[plain], src[whole]], np.r_[b[plain], dst[whole]]))
        now = has(balanced, entry, exit_)
        if np.array_equal(now, whole):
            break
        whole = now

    row, column = bits.pairs(balanced)
    column = node.first[row] + column
    over = row != column
    row, column = row[over], column[over]
    edge = p["d"] > 0
    right, left = (tuple(np.r_[end[plain], end[x[edge[x]]], far] for end, far in ((a, row), (b, column))) for x in (closes, opens))

    def led(seeds: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
        return bits.grown(seeds.astype(np.uint64)[:, None], bits.Fold(to, from_))[:, 0] > 0

    def at(kind_: int) -> np.ndarray:
        out = np.zeros(n, bool)
        out[a[kind == kind_]] = True
        return out

    out, into = led(at(SOURCE), *right), led(at(TARGET), *left[::-1])
    turn = out & into
    first, second = out & led(turn, *right[::-1]), led(turn, *left) & into

    # Nodes inside the calls that the halves pass over: balanced pairs are split where a node stands between their ends, and
    # those of a call lead to its callee's entry and exit.
    used = (first[row] & first[column]) | (second[row] & second[column])
    turned = bits.ones(n, node.width, np.r_[column, np.flatnonzero(own)], node.column[np.r_[row, np.flatnonzero(own)]])
    new = bits.ones(n, node.width, row[used], node.column[column[used]])
    spans = np.zeros_like(new)
    src, entry, exit_, dst = src[whole], entry[whole], exit_[whole], dst[whole]
    while new.any():
        spans |= new
        begin, end = bits.pairs(new)
        end = node.first[begin] + end
        more, back = np.zeros_like(new), np.zeros_like(new)
        for i in range(0, len(begin), SPLIT):
            x, y = begin[i : i + SPLIT], end[i : i + SPLIT]
            between = balanced[x] & turned[y]
            for to, ends in ((more, x), (back, y)):
                fold = bits.Fold(ends, np.arange(len(ends)))
                to[fold.heads] |= fold(np.bitwise_or, between[fold.tail])
        y, x = bits.pairs(back)
        inside = has(new, src, dst)
        x, y = np.r_[node.first[y] + x, entry[inside]], np.r_[y, exit_[inside]]
        new = (more | bits.ones(n, node.width, x, node.column[y])) & ~spans
    x, y = bits.pairs(spans)
    found = first | second
    found[x] = True
    found[node.first[x] + y] = True
    return node.of[found], node.name[found]


def _chop_by_tables(g: FlowGraph, parens: DataFrame, balanced: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    k = list(g.keys)
    marks = parens.select(*k, "src", "dst", "paren")
    plain = g.edges.join(marks, [*k, "src", "dst"], "left").withColumn("paren", F.coalesce("paren", F.lit("")))
    over = balanced.where("a <> b").select(*k, F.col("a").alias("src"), F.col("b").alias("dst"))
    right = written(plain.where("paren <> '('").select(*k, "src", "dst").union(over).distinct())
    left = written(plain.where("paren <> ')'").select(*k, "src", "dst").union(over).distinct())

    ends = [*k, "node"]
    out, into = _closure(right, source, "src", "dst", g.keys), _closure(left, target, "dst", "src", g.keys)
    turn = written(out.join(into, ends))
    first, second = out.join(_closure(right, turn, "dst", "src", g.keys), ends), _closure(left, turn, "src", "dst", g.keys).join(into, ends)
    on = written(first.withColumn("half", F.lit(1)).union(second.withColumn("half", F.lit(2))))
    # Nodes inside the calls that the halves pass over.
    used = over.join(on.select(*k, F.col("node").alias("src"), "half"), [*k, "src"]).join(on.select(*k, F.col("node").alias("dst"), "half"), [*k, "dst", "half"]).select(*k, "src", "dst").distinct()
    opens, closes = parens.where("paren = '('"), parens.where("paren = ')'")
    calls = opens.select(*k, "src", F.col("dst").alias("entry"), "site").join(closes.select(*k, F.col("src").alias("exit"), "dst", "site"), [*k, "site"])
    calls = calls.join(balanced.select(*k, F.col("a").alias("entry"), F.col("b").alias("exit")), [*k, "entry", "exit"]).select(*k, "src", "dst", "entry", "exit")
    spans = least_fixpoint(used, lambda delta, _: _inner(delta, calls, balanced, plain, k))
    inner = spans.select(*k, F.col("src").alias("node")).union(spans.select(*k, F.col("dst").alias("node")))
    return on.select(*ends).union(inner).distinct()


def _inner(spans: DataFrame, calls: DataFrame, balanced: DataFrame, plain: DataFrame, k: list[str]) -> DataFrame:
    """Balanced pairs inside balanced pairs: parts of a sequence, and what stands between a call and its return."""
    parts = spans.join(balanced.select(*k, F.col("a").alias("src"), F.col("b").alias("m")), [*k, "src"]).join(balanced.select(*k, F.col("a").alias("m"), F.col("b").alias("dst")), [*k, "m", "dst"])
    split = parts.select(*k, "src", F.col("m").alias("dst")).union(parts.select(*k, F.col("m").alias("src"), "dst"))
    return split.union(spans.join(calls, [*k, "src", "dst"]).select(*k, F.col("entry").alias("src"), F.col("exit").alias("dst")))
