"""Programs with procedures and variables as tables, many programs to a table.

nodes (graph_id, node, proc), edges (graph_id, src, dst, kind), procs (graph_id,
proc, entry, exit), defines and uses (graph_id, node, name).  An edge is flow inside
a procedure, goes from a call to the callee's entry, from its exit to the return
node of the call, or across from a call to its return node.  A call has one callee.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import unsent
from ..sources.flowgraphs import FlowGraph, event_nodes

FLOW, CALL, RETURN, ACROSS = "flow", "call", "return", "across"


@dataclass(frozen=True)
class Program:
    nodes: DataFrame
    edges: DataFrame
    procs: DataFrame
    defines: DataFrame
    uses: DataFrame

    def names(self) -> DataFrame:
        """graph_id, name of all variables."""
        return self.defines.union(self.uses).select("graph_id", "name").distinct()

    def flow(self) -> DataFrame:
        return self.edges.where(F.col("kind") == FLOW).select("graph_id", "src", "dst")

    def calls(self) -> DataFrame:
        """graph_id, call, back (the return node), callee, entry, exit."""
        across = self.edges.where(F.col("kind") == ACROSS).select("graph_id", F.col("src").alias("call"), F.col("dst").alias("back"))
        into = self.edges.where(F.col("kind") == CALL).select("graph_id", F.col("src").alias("call"), F.col("dst").alias("entry"))
        return across.join(into, ["graph_id", "call"]).join(self.procs.withColumnRenamed("proc", "callee"), ["graph_id", "entry"]).select("graph_id", "call", "back", "callee", "entry", "exit")

    def bodies(self) -> FlowGraph:
        """A graph for each procedure, calls being edges to their return nodes."""
        edges = self.edges.where(F.col("kind").isin(FLOW, ACROSS)).select("graph_id", "src", "dst")
        edges = edges.join(self.nodes.withColumnRenamed("node", "src"), ["graph_id", "src"])
        return FlowGraph(self.nodes.select("graph_id", "proc", "node"), edges.select("graph_id", "proc", "src", "dst").distinct(), ("graph_id", "proc"))

    def whole(self) -> FlowGraph:
        """The graph of a program's flow, calls and returns."""
        return FlowGraph(self.nodes.select("graph_id", "node"), self.edges.where(F.col("kind") != ACROSS).select("graph_id", "src", "dst").distinct())


#: Events of a procedure of event_program.
LENGTH = 8


def event_program(spark: SparkSession, sf_dir: str) -> Program:
    """A program for each user. Each 8 events are a procedure, which ends early at a purchase, may go two back at an error
    and skip one at a view, and calls the next procedure (the last one: the first) at a click. An event defines the
    variable of its type, a click when its call returns, and uses that of the event before it. Event i is node 4 i,
    the return of its call 4 i + 1; the node before a procedure's first event is its entry, exit follows its last."""
    n = event_nodes(spark, sf_dir)
    by, order = Window.partitionBy("graph_id"), Window.partitionBy("graph_id").orderBy("node")
    n = n.select("graph_id", F.col("node").alias("i"), "event", F.lag("event").over(order).alias("before"), F.expr(f"(node - 1) div {LENGTH}").alias("proc"), F.max("node").over(by).alias("end"))
    first, last = F.col("proc") * LENGTH + 1, F.least((F.col("proc") + 1) * LENGTH, F.col("end"))
    click, leaves = F.col("event") == "click", F.col("i") * 4 + F.when(F.col("event") == "click", 1).otherwise(0)
    n = unsent(n.select("*", first.alias("first"), last.alias("last"), leaves.alias("out"), F.pmod(F.col("proc") + 1, F.expr(f"(end - 1) div {LENGTH} + 1")).alias("callee")))
    procs = unsent(n.select("graph_id", "proc", (F.col("first") * 4 - 1).alias("entry"), (F.col("last") * 4 + 2).alias("exit")).distinct())
    on = F.when((F.col("event") == "purchase") | (F.col("i") == F.col("last")), F.col("last") * 4 + 2).otherwise(F.col("i") * 4 + 4)
    to = F.array_compact(F.array(on, F.when(F.col("event") == "error", F.greatest(F.col("i") - 2, F.col("first")) * 4), F.when((F.col("event") == "view") & (F.col("i") + 2 <= F.col("last")), F.col("i") * 4 + 8)))
    flow = n.select("graph_id", F.col("out").alias("src"), F.explode(F.array_distinct(to)).alias("dst")).union(n.where("i = first").select("graph_id", F.col("i") * 4 - 1, F.col("i") * 4))
    calls = unsent(n.where(click).select("graph_id", F.col("i").alias("i"), F.col("callee").alias("proc")).join(procs, ["graph_id", "proc"]))
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    edges = kind(flow, FLOW).union(kind(calls.select("graph_id", F.col("i") * 4, "entry"), CALL)).union(kind(calls.select("graph_id", "exit", F.col("i") * 4 + 1), RETURN)).union(kind(calls.select("graph_id", F.col("i") * 4, F.col("i") * 4 + 1), ACROSS))
    nodes = n.select("graph_id", (F.col("i") * 4).alias("node"), "proc").union(n.where(click).select("graph_id", "out", "proc")).union(procs.select("graph_id", "entry", "proc")).union(procs.select("graph_id", "exit", "proc"))
    uses = n.where("before is not null").select("graph_id", (F.col("i") * 4).alias("node"), F.col("before").alias("name"))
    return Program(nodes, edges.distinct(), procs, n.select("graph_id", F.col("out").alias("node"), F.col("event").alias("name")), uses)
