"""Analyses across procedures: what calls must overwrite, definitions that reach through them, system dependence graphs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import bits
from ..plans.bits import spread
from ..plans.fixpoint import unsent
from ..sources.programs import Program
from . import procedures
from .control import classic

G = "graph_id"


def cut_lineage(p: Program) -> Program:
    """The program with its tables written once."""
    return Program(*(unsent(getattr(p, t)) for t in ("nodes", "edges", "procs", "defines", "uses")))


def without_return(p: Program) -> DataFrame:
    """graph_id, proc, exit of procedures whose exit no path inside from their entry reaches, calls being passed over."""
    ends = lambda end: p.procs.select(G, "proc", F.col(end).alias("node"))
    seen = spread((G, "proc"), ends("entry").withColumn("value", F.lit(0)), p.bodies().edges, at=ends("exit")).hint("merge")
    return unsent(p.procs.join(seen.withColumnRenamed("node", "exit"), [G, "proc", "exit"], "left_anti").select(G, "proc", "exit"))


def may_keep(p: Program, never: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """graph_id, node, name: on some path inside a procedure, from its entry to node, name isn't overwritten, by nodes on
    it or by all of a call that it passes over. A call keeps a name if its callee's entry keeps it to the exit: so the
    names that calls must overwrite, a greatest fixpoint, are those that this least one leaves out. never: without_return;
    at (graph_id, node): the nodes that are wanted, else all."""
    calls, at = unsent(p.calls()), p.nodes.select(G, "node") if at is None else at
    names = unsent(p.names().withColumn("value", F.dense_rank().over(Window.partitionBy(G).orderBy("name")).cast("long")))
    # A procedure that doesn't end is taken to overwrite nothing.
    never = calls.join((without_return(p) if never is None else never).select(G, "exit"), [G, "exit"], "left_semi").select(G, F.col("call").alias("src"), F.col("back").alias("dst"))
    along = unsent(p.flow().union(never))
    stops = unsent(p.defines.select(G, "node", "name").distinct())

    def large(big: DataFrame) -> DataFrame:
        # A graph for each name; a call leads over once the exit of its callee is found, and keeps the name.
        of = names.join(big, G, "left_semi")
        seeds = p.procs.select(G, F.col("entry").alias("node")).join(of, G).select(G, "node", "name", F.lit(0).alias("value"))
        over = calls.select(G, F.col("call").alias("src"), F.col("back").alias("dst"), F.col("exit").alias("at"), F.lit(0).alias("key"))
        mine = lambda df: df.join(of.drop("value"), G)
        found = spread((G, "name"), seeds, mine(along), stops.join(big, G, "left_semi").withColumn("value", F.lit(0)), mine(over), mine(at))
        return found.drop("value").join(of, [G, "name"]).select(G, "node", "value")

    rows = bits.rows_of(p.procs, (G,), bits.SEED, "entry").union(bits.rows_of(along, (G,), bits.EDGE, "src", "dst")).union(bits.rows_of(calls, (G,), bits.GATE, "call", "back", "exit"))
    rows = rows.union(bits.rows_of(stops.join(names, [G, "name"]), (G,), bits.STOP, "node", "value")).union(bits.rows_of(names, (G,), NAME, "value")).union(bits.rows_of(at, (G,), bits.ASKED, "node"))
    return bits.solved(rows, (G,), _keeping, ("node", "value"), large).join(names, [G, "value"]).select(G, "node", "name")


#: A kind of gathered rows: (the number of a name).
NAME = 6


def _keeping(p: dict) -> tuple:
    """What nodes of gathered programs keep, a bit for each name; a gate lets those names pass that its third node keeps."""
    kind, graph, a, b, c = (p[x] for x in ("kind", "graph", "a", "b", "c"))
    name, stop_, edge, gate = kind == NAME, kind == bits.STOP, (kind == bits.EDGE) | (kind == bits.GATE), kind == bits.GATE
    value = bits.Numbers(np.r_[graph[name], graph[stop_]], np.r_[a[name], b[stop_]])
    node = bits.Numbers(np.r_[graph[~name], graph[edge], graph[gate]], np.r_[a[~name], b[edge], c[gate]])
    begin = np.full(len(kind), -1)
    begin[~name] = node.at[: (~name).sum()]
    n, end, over = len(node.of), node.at[(~name).sum() :][: edge.sum()], node.at[(~name).sum() + edge.sum() :]
    column = value.column[value.at]
    every = bits.ones(int(graph.max(initial=-1)) + 1, value.width, graph[name], column[: name.sum()])
    keep, stop = np.zeros((n, every.shape[1]), np.uint64), bits.ones(n, value.width, begin[stop_], column[name.sum() :])
    keep[begin[kind == bits.SEED]] = every[graph[kind == bits.SEED]]
    along = bits.Fold(end[~gate[edge]], begin[kind == bits.EDGE])
    call, back = begin[gate], bits.Fold(end[gate[edge]], np.arange(gate.sum()))
    while True:
        live, more = keep & ~stop, keep.copy()
        if len(along.heads):
            more[along.heads] |= along(np.bitwise_or, live[along.tail])
        if len(back.heads):
            more[back.heads] |= back(np.bitwise_or, (live[call] & live[over])[back.tail])
        if np.array_equal(more, keep):
            break
        keep = more
    asked = np.zeros(n, bool)
    asked[begin[kind == bits.ASKED]] = True
    keep[~asked] = 0
    row, column = bits.pairs(keep)
    return node.of[row], node.name[row], value.name[np.searchsorted(value.of, node.of[row]) + column]


def must_kill(p: Program, kept: DataFrame | None = None) -> DataFrame:
    """graph_id, proc, name: every run of proc from its entry to its exit overwrites name."""
    never, names = without_return(p), unsent(p.names())
    kept = may_keep(p, never, p.procs.select(G, F.col("exit").alias("node")).distinct()) if kept is None else kept
    left = unsent(kept.join(p.defines, [G, "node", "name"], "left_anti").withColumnRenamed("node", "exit"))
    ends = p.procs.join(never, [G, "proc", "exit"], "left_anti").join(names, G)
    return ends.join(left, [G, "exit", "name"], "left_anti").select(G, "proc", "name")


def strong_reaching_definitions(p: Program, killed: DataFrame | None = None) -> DataFrame:
    """graph_id, node, name, origin: what may have given name its value at node's start, inside a procedure: a node, the
    entry for the value before it, or a call for what the callee has done. A call that must overwrite a name (killed:
    must_kill) lets no other definition pass."""
    killed = unsent(must_kill(p)) if killed is None else killed
    flow, calls, defines, names = unsent(p.flow()), unsent(p.calls()), unsent(p.defines.select(G, "node", "name").distinct()), unsent(p.names())
    stopped = unsent(calls.select(G, "call", "callee").join(killed.withColumnRenamed("proc", "callee"), [G, "callee"]).select(G, F.col("call").alias("node"), "name"))
    passes = unsent(flow.withColumn("past", F.lit(False)).union(calls.select(G, "call", "back", F.lit(True))))
    # What no definition of a name passes: nodes that give it another value, and the way over calls that must.
    past = lambda df, *over: df.withColumnRenamed("node", "src").withColumn("past", F.explode(F.array(*map(F.lit, over))))
    stops = unsent(past(defines, False, True).union(past(stopped, True)).distinct())
    own = defines.withColumnRenamed("node", "src").join(passes, [G, "src"]).join(past(stopped, True), [G, "src", "name", "past"], "left_anti")
    own = own.select(G, F.col("dst").alias("node"), "name", F.col("src").alias("origin"))
    before = p.procs.select(G, F.col("entry").alias("node"), F.col("entry").alias("origin")).join(names, G).select(G, "node", "name", "origin")
    after = calls.select(G, F.col("back").alias("node"), F.col("call").alias("origin")).join(names, G).select(G, "node", "name", "origin")

    # A graph for each name, without these edges.
    along = passes.join(names, G).join(stops, [G, "src", "name", "past"], "left_anti")
    seeds = before.union(after).union(own).distinct().withColumnRenamed("origin", "value")
    return spread((G, "name"), seeds, along).select(G, "node", "name", F.col("value").alias("origin"))


def label(kind: str, at: Column | str, name: Column | str = "name") -> Column:
    """The name of a parameter node: fi and fo of a procedure, ai and ao of a call, one for each variable."""
    at = F.col(at) if isinstance(at, str) else at
    return F.concat_ws(":", F.lit(kind), at.cast("string"), name)


def parameter_nodes(p: Program) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Formal nodes (graph_id, proc, entry, exit, name, fi, fo), actual nodes (graph_id, call, back, callee, name, ai, ao),
    and the labels of both (graph_id, number, label). They are numbered in their graph, odd; the program's nodes n are 2 n."""
    names = unsent(p.names())
    place = lambda at: 8 * F.dense_rank().over(Window.partitionBy(G).orderBy(at, "name")).cast("long")
    formal = unsent(p.procs.join(names, G).withColumn("place", place("proc")).select(G, "proc", "entry", "exit", "name", (F.col("place") + 1).alias("fi"), (F.col("place") + 3).alias("fo")))
    actual = unsent(p.calls().join(names, G).withColumn("place", place("call")).select(G, "call", "back", "callee", "name", (F.col("place") + 5).alias("ai"), (F.col("place") + 7).alias("ao")))
    both = lambda df, at, *kinds: df.select(G, F.explode(F.array(*(F.struct(F.col(k).alias("number"), label(k, at).alias("label")) for k in kinds))).alias("of"))
    return formal, actual, unsent(both(formal, "proc", "fi", "fo").union(both(actual, "call", "ai", "ao")).select(G, "of.number", "of.label").distinct())


def labelled(df: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """df with labels for the numbers in columns."""
    for c in columns:
        named = labels.select(G, F.col("number").alias(c), F.col("label").alias("_label"))
        df = df.join(named, [G, c], "left").withColumn(c, F.coalesce("_label", F.expr(f"cast(shiftright({c}, 1) as string)"))).drop("_label")
    return df


def parameter_data_dependence(p: Program, formal: DataFrame, actual: DataFrame) -> DataFrame:
    """graph_id, src, dst (numbers): data dependence inside procedures. Formal-in nodes define all variables after
    the entry, formal-out nodes use them before the exit; actual-in nodes use them after the call, actual-out nodes
    define them before its return node. No definition passes over a call but through these."""
    flow, defines = unsent(p.flow()), unsent(p.defines.select(G, "node", "name").distinct())
    own = unsent(defines.withColumn("value", 2 * F.col("node")).union(formal.select(G, F.col("entry").alias("node"), "name", F.col("fi").alias("value"))))
    # A graph for each name.
    after = actual.select(G, F.col("back").alias("node"), "name", F.col("ao").alias("value"))
    seeds = own.withColumnRenamed("node", "src").join(flow, [G, "src"]).select(G, F.col("dst").alias("node"), "name", "value").union(after)
    along = flow.join(unsent(p.names()), G).join(defines.withColumnRenamed("node", "src"), [G, "src", "name"], "left_anti")
    reaching = spread((G, "name"), seeds, along).hint("merge")
    uses = unsent(p.uses.select(G, "node", "name", (2 * F.col("node")).alias("dst")).union(formal.select(G, F.col("exit").alias("node"), "name", "fo")))
    leaving = reaching.join(defines, [G, "node", "name"], "left_anti").select(G, "node", "name", "value").union(own)
    into = leaving.join(actual.select(G, F.col("call").alias("node"), "name", F.col("ai").alias("dst")), [G, "node", "name"])
    return reaching.join(uses, [G, "node", "name"]).select(G, F.col("value").alias("src"), "dst").union(into.select(G, F.col("value").alias("src"), "dst")).distinct()


def procedure_control_dependence(p: Program) -> DataFrame:
    """graph_id, src, dst: classic control dependence of each procedure, its exit depending on its entry as if the entry could skip the body."""
    body, ends = p.bodies(), p.procs.select(G, "proc", F.col("entry").alias("src"), F.col("exit").alias("dst"))
    skipping = replace(body, nodes=unsent(body.nodes), edges=unsent(body.edges.union(ends).distinct()))
    pairs = classic(skipping).select(G, F.col("n").alias("src"), F.col("m").alias("dst"))
    return pairs.union(ends.select(G, "src", "dst")).distinct()


def numbered_dependence(p: Program) -> tuple[DataFrame, DataFrame]:
    """The system dependence graph with numbers for its nodes (graph_id, src, dst, kind), and the labels of its parameter nodes."""
    formal, actual, labels = parameter_nodes(p)
    of_kind = lambda df, src, dst, kind: df.select(G, F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"))
    doubled = lambda df, src, dst, kind: of_kind(df.select(G, (2 * F.col(src)).alias("src"), (2 * F.col(dst)).alias("dst")), "src", "dst", kind)
    both = unsent(actual.join(formal.select(G, F.col("proc").alias("callee"), "name", "fi", "fo"), [G, "callee", "name"]))
    edges = of_kind(parameter_data_dependence(p, formal, actual), "src", "dst", procedures.DATA).union(doubled(procedure_control_dependence(p), "src", "dst", procedures.CONTROL))
    edges = edges.union(doubled(p.calls(), "call", "entry", procedures.CALL)).union(of_kind(both, "ai", "fi", procedures.IN)).union(of_kind(both, "fo", "ao", procedures.OUT))
    actuals = (both.select(G, F.col(a).alias("actual"), F.col(f).alias("formal"), "call") for a, f in (("ai", "fi"), ("ao", "fo")))
    return procedures.with_summaries(unsent(edges), *actuals, (G,)), labels


def system_dependence(p: Program) -> DataFrame:
    """graph_id, src, dst, kind: the system dependence graph. Nodes are the program's and its parameter nodes, as strings;
    edges are data and control dependence inside procedures, calls, parameters in and out, and the summaries of calls."""
    return labelled(*numbered_dependence(p), "src", "dst").select(G, "src", "dst", "kind")


def slice_of(p: Program, criterion: DataFrame) -> DataFrame:
    """program_slice of the program's system dependence graph, on numbers until the nodes are found."""
    edges, labels = numbered_dependence(p)
    return labelled(procedures.two_phase(unsent(edges), criterion.select(G, (2 * F.col("node")).alias("node")), (G,)), labels, "node").select(G, "node")


def program_slice(system: DataFrame, criterion: DataFrame) -> DataFrame:
    """graph_id, node: what the criterion (graph_id, node) may depend on, along calls that return to where they came from."""
    return procedures.two_phase(system, criterion.select(G, F.col("node").cast("string").alias("node")), (G,))
