"""Fixpoints of small graphs without a shuffle a round.

The nodes and edges of a graph are gathered into one row if they are at most MOST rows. A task takes many such rows, numbers
their nodes through, and holds the values of each node as a row of bits, so that a round is a few numpy calls for all of
them. Graphs of more rows stay tables, and are run by plans.fixpoint, or by what the operator gives for them: no group is
larger than MOST rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.flowgraphs import FlowGraph
from .fixpoint import HOPS, least_fixpoint, written

#: Rows of the largest graph that is gathered.
MOST = 4096
#: Rows that a task works on at once; more only if one graph has them.
ROWS = 8192
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Kinds of gathered rows and what stands in them: (node, value), (src, dst, cost), (node, value), (src, dst, node, value), (node).
SEED, EDGE, STOP, GATE, ASKED = range(5)
ROW = ("a", "b", "c", "d")


def rows_of(df: DataFrame, keys: tuple[str, ...], kind: int, *columns: str) -> DataFrame:
    values = [F.col(c).cast("long") for c in columns] + [F.lit(0).cast("long")] * (len(ROW) - len(columns))
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, F.lit(kind).cast("byte").alias("kind"), *(v.alias(c) for v, c in zip(values, ROW)))


def flow_rows(g: FlowGraph, costs: DataFrame | None = None) -> DataFrame:
    """A graph's nodes and edges (costs: keys, src, dst, cost of the edges, 1 each else)."""
    edges = g.edges.withColumn("cost", F.lit(1)) if costs is None else g.edges.join(costs, [*g.keys, "src", "dst"])
    return rows_of(g.nodes, g.keys, SEED, "node").union(rows_of(edges, g.keys, EDGE, "src", "dst", "cost"))


def _bounded(df: DataFrame) -> DataFrame:
    """df; Arrow batches of the session have 1,000 rows if they are as Spark sets them: so many graphs."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, "10000") == "10000":
        conf.set(BATCH_KEY, "1000")
    return df


def solved(rows: DataFrame, keys: tuple[str, ...], solve: Callable[[dict], tuple], names: tuple[str, ...], large: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """keys and names, as a table: of small graphs by solve, from the columns of their gathered rows and the number of each
    row's graph to numbers of graphs and columns of names; of the others, of more rows than MOST or most, by large(their keys)."""
    k, rows = list(keys), written(rows)
    big = rows.groupBy(*k).agg(F.count("*").alias("n")).where(F.col("n") > min(MOST, most or MOST)).select(*k)
    big = written(big)
    some = not big.isEmpty()
    packed = (rows.join(big, k, "left_anti") if some else rows).groupBy(*k).agg(F.collect_list(F.struct("kind", *ROW)).alias("rows"))
    schema = packed.select(*k, *(F.lit(0).cast("long").alias(c) for c in names)).schema
    out = written(_bounded(packed).mapInArrow(_task(k, solve, names), schema))
    return written(out.union(large(big).select(*k, *(F.col(c).cast("long") for c in names)))) if some else out


def _task(keys: list[str], solve: Callable[[dict], tuple], names: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("rows")).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // ROWS
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
            for begin, end in zip(cuts, cuts[1:]):
                piece = batch.slice(begin, end - begin)
                columns = (c.to_numpy(zero_copy_only=False) for c in piece.column("rows").flatten().flatten())
                p = dict(zip(("kind", *ROW), columns)) | {"graph": np.repeat(np.arange(end - begin), sizes[begin:end])}
                graph, *values = solve(p)
                # At most 2 ** 20 rows are given away at a time.
                for at in range(0, len(graph), 1 << 20):
                    some = slice(at, at + (1 << 20))
                    of = pa.array(graph[some])
                    yield pa.RecordBatch.from_arrays([*(piece.column(k).take(of) for k in keys), *(pa.array(v[some]) for v in values)], names=[*keys, *names])

    return run


class Numbers:
    """Names of graphs' nodes numbered through: of and name by number, number of each place asked for, column in its graph."""

    def __init__(self, graph: np.ndarray, name: np.ndarray):
        order = np.lexsort((name, graph))
        g, v = graph[order], name[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        self.at = np.empty(len(g), np.int64)
        self.at[order] = np.cumsum(new) - 1
        self.of, self.name = g[new], v[new]
        self.first = np.searchsorted(self.of, self.of)
        self.column = np.arange(len(self.of)) - self.first
        self.width = int(self.column.max(initial=0)) + 1


class Fold:
    """Rows gathered along edges: at each head, the join by ufunc of rows of the edges' tails."""

    def __init__(self, head: np.ndarray, tail: np.ndarray):
        order = np.argsort(head, kind="stable")
        self.tail, self.head = tail[order], head[order]
        self.starts = np.flatnonzero(np.r_[True, self.head[1:] != self.head[:-1]][: len(head)])
        self.heads, self.order = self.head[self.starts], order

    def where(self, keep: np.ndarray) -> Fold:
        """The fold of some edges, given in this fold's order."""
        return Fold(self.head[keep], self.tail[keep])

    def __call__(self, ufunc: np.ufunc, rows: np.ndarray) -> np.ndarray:
        return ufunc.reduceat(rows, self.starts, axis=0)


def ones(n: int, width: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """n rows of bits, those set of which row and column are given."""
    out = np.zeros((n, (width + 63) // 64), np.uint64)
    np.bitwise_or.at(out, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return out


def pairs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each bit that is set."""
    return np.nonzero(np.unpackbits(bits.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"))


def grown(bits: np.ndarray, along: Fold, stop: np.ndarray | None = None) -> np.ndarray:
    """The least rows of bits above bits that hold, at each head, all of its tails' that aren't stopped there."""
    while len(along.heads):
        live = bits if stop is None else bits & ~stop
        more = bits.copy()
        more[along.heads] |= along(np.bitwise_or, live[along.tail])
        if np.array_equal(more, bits):
            break
        bits = more
    return bits


def _spread_to(p: dict) -> tuple:
    """_spread, at the nodes that are asked for."""
    return _spread(p, p["kind"] == ASKED)


def _spread(p: dict, asked: np.ndarray | None = None) -> tuple:
    kind, graph, a, b, c, d = (p[x] for x in ("kind", "graph", *ROW))
    n_rows, edge, gate, valued = len(kind), (kind == EDGE) | (kind == GATE), kind == GATE, (kind == SEED) | (kind == STOP)
    node = Numbers(np.r_[graph, graph[edge], graph[gate]], np.r_[a, b[edge], c[gate]])
    value = Numbers(np.r_[graph[valued], graph[gate]], np.r_[b[valued], d[gate]])
    n, src = len(node.of), node.at[:n_rows]
    at_value = np.zeros(n_rows, np.int64)
    at_value[valued] = value.at[: valued.sum()]
    put = lambda k: ones(n, value.width, src[kind == k], value.column[at_value[kind == k]])
    bits, stop = put(SEED), put(STOP) if (kind == STOP).any() else None
    dst = np.full(n_rows, -1)
    dst[edge] = node.at[n_rows : n_rows + edge.sum()]
    at, key = node.at[n_rows + edge.sum() :], value.column[value.at[valued.sum() :]]
    is_open = np.zeros(n_rows, bool)
    while True:
        on = (kind == EDGE) | is_open
        bits = grown(bits, Fold(dst[on], src[on]), stop)
        live = bits if stop is None else bits & ~stop
        now = is_open.copy()
        now[gate] = (live[at, key >> 6] >> (key & 63).astype(np.uint64)) & np.uint64(1) > 0
        if np.array_equal(now, is_open):
            break
        is_open = now
    # A value's column is its place among those of the graph.
    if asked is not None:
        here = np.zeros(n, bool)
        here[src[asked]] = True
        bits[~here] = 0
    row, column = pairs(bits)
    begin = np.searchsorted(value.of, node.of[row])
    return node.of[row], node.name[row], value.name[begin + column]


def spread(keys: tuple[str, ...], seeds: DataFrame, edges: DataFrame, stops: DataFrame | None = None, gates: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """keys, node, value: the least set of rows that has seeds (keys, node, value) and goes on along edges (keys, src, dst),
    with a value from src to dst, unless it is stopped there: stops (keys, node, value) stay where they are. An edge of
    gates (keys, src, dst, at, key) counts once node at has the value key and that isn't stopped. Nodes and values are integers.
    at (keys, node): the nodes whose rows are wanted, else all."""
    k, columns = list(keys), [*keys, "node", "value"]
    rows = rows_of(seeds, keys, SEED, "node", "value").union(rows_of(edges, keys, EDGE, "src", "dst"))
    if stops is not None:
        rows = rows.union(rows_of(stops, keys, STOP, "node", "value"))
    if gates is not None:
        rows = rows.union(rows_of(gates, keys, GATE, "src", "dst", "at", "key"))
    if at is not None:
        rows = rows.union(rows_of(at, keys, ASKED, "node"))

    def large(big: DataFrame) -> DataFrame:
        mine = lambda df: None if df is None else written(df.join(big, k, "left_semi"))
        start, along, stop, gate = mine(seeds), mine(edges), mine(stops), mine(gates)
        live = lambda df: df if stop is None else df.join(stop, columns, "left_anti")
        move = lambda df, by: df.withColumnRenamed("node", "src").join(by, [*k, "src"]).select(*k, F.col("dst").alias("node"), "value")

        def step(delta: DataFrame, seen: DataFrame) -> DataFrame:
            delta = live(delta)
            out = move(delta, along)
            if gate is None:
                return out
            through = lambda df: gate.join(df.select(*k, F.col("node").alias("at"), F.col("value").alias("key")), [*k, "at", "key"]).select(*k, "src", "dst").distinct()
            return out.union(move(live(seen), through(delta))).union(move(delta, through(live(seen))))

        found = least_fixpoint(start.select(*columns), step, HOPS if gate is None else 1)
        return found if at is None else found.join(at, [*k, "node"], "left_semi")

    return solved(rows, keys, _spread if at is None else _spread_to, ("node", "value"), large)


class Flow:
    """Gathered rows as graphs: SEED rows are nodes, EDGE rows edges; their ends are numbered, edges folded by their begin."""

    def __init__(self, p: dict):
        kind, graph = p["kind"], p["graph"]
        edge = kind == EDGE
        self.node = Numbers(np.r_[graph, graph[edge]], np.r_[p["a"], p["b"][edge]])
        self.n = len(self.node.of)
        begin = self.node.at[: len(kind)]
        self.own = np.zeros(self.n, bool)
        self.own[begin[kind == SEED]] = True
        self.out = Fold(begin[edge], self.node.at[len(kind) :])
        self.cost = p["c"][edge][self.out.order]

    def single(self) -> np.ndarray:
        """A row for each node with its own bit."""
        return ones(self.n, self.node.width, np.arange(self.n), self.node.column)

    def named(self, bits: np.ndarray) -> tuple:
        row, column = pairs(bits)
        keep = self.own[row]
        row, column = row[keep], column[keep]
        return self.node.of[row], self.node.name[row], self.node.name[self.node.first[row] + column]


def on_sink_paths(f: Flow) -> np.ndarray:
    """Of what a node reaches, the greatest rows that hold, but for itself, only what all of its successors' do."""
    own, out = f.single(), f.out
    bits = grown(own, out)
    while len(out.heads):
        less = bits.copy()
        less[out.heads] &= own[out.heads] | out(np.bitwise_and, bits[out.tail])
        if np.array_equal(less, bits):
            break
        bits = less
    return bits


def on_maximal_paths(f: Flow, out: Fold | None = None) -> np.ndarray:
    """The least rows that hold each node itself and what all of its successors' do (out: some of the edges)."""
    bits, out = f.single(), f.out if out is None else out
    while len(out.heads):
        more = bits.copy()
        more[out.heads] |= out(np.bitwise_and, bits[out.tail])
        if np.array_equal(more, bits):
            break
        bits = more
    return bits


def sink_pairs(p: dict) -> tuple:
    f = Flow(p)
    return f.named(on_sink_paths(f))


def maximal_pairs(p: dict) -> tuple:
    f = Flow(p)
    return f.named(on_maximal_paths(f))


def decided(f: Flow, dominators: np.ndarray) -> tuple:
    """n and m: m dominates some but not all of n's successors, and isn't n."""
    out = f.out
    if not len(out.heads):
        return f.named(np.zeros_like(dominators))
    below = dominators[out.tail]
    some = np.zeros_like(dominators)
    some[out.heads] = out(np.bitwise_or, below) & ~out(np.bitwise_and, below) & ~f.single()[out.heads]
    return f.named(some)


def sink_control(p: dict) -> tuple:
    f = Flow(p)
    return decided(f, on_sink_paths(f))


def maximal_control(p: dict) -> tuple:
    f = Flow(p)
    return decided(f, on_maximal_paths(f))


def ending_control(p: dict) -> tuple:
    """sink_control among the nodes that reach one without successors."""
    f = Flow(p)
    ends = np.ones((f.n, 1), np.uint64)
    ends[f.out.heads] = 0
    ends[~f.own] = 0
    keep = grown(ends, f.out)[:, 0] > 0
    f.out, f.own = f.out.where(keep[f.out.head] & keep[f.out.tail]), f.own & keep
    return decided(f, on_sink_paths(f))


#: No time.
NEVER = np.iinfo(np.int64).min


def timed_pairs(p: dict) -> tuple:
    """Of each node, the nodes that all of its successors come to at one time, and that time; itself at 0."""
    f = Flow(p)
    out = f.out
    time = np.full((f.n, f.node.width), NEVER)
    time[np.arange(f.n), f.node.column] = 0
    while len(out.heads):
        then = time[out.tail]
        then = np.where(then == NEVER, NEVER, then + f.cost[:, None])
        low, old = out(np.minimum, then), time[out.heads]
        new = np.where((old == NEVER) & (low == out(np.maximum, then)), low, old)
        if np.array_equal(new, old):
            break
        time[out.heads] = new
    row, column = np.nonzero(time != NEVER)
    keep = f.own[row]
    row, column = row[keep], column[keep]
    return f.node.of[row], f.node.name[row], f.node.name[f.node.first[row] + column], time[row, column]
