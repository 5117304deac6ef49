"""Control-flow graphs as tables, many graphs to a table.

A graph is a pair of DataFrames: nodes (graph_id, node) and edges (graph_id, src,
dst), edges without repeats.  Any further key columns may stand with graph_id: a
graph for each of their values.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import unsent


@dataclass(frozen=True)
class FlowGraph:
    nodes: DataFrame
    edges: DataFrame
    keys: tuple[str, ...] = ("graph_id",)

    def reverse(self) -> FlowGraph:
        return replace(self, edges=self.edges.select(*self.keys, F.col("dst").alias("src"), F.col("src").alias("dst")))

    def induced(self, nodes: DataFrame) -> FlowGraph:
        """The subgraph on some of the nodes (keys and node)."""
        k = list(self.keys)
        edges = self.edges.join(nodes.select(*k, F.col("node").alias("src")), [*k, "src"], "left_semi").join(nodes.select(*k, F.col("node").alias("dst")), [*k, "dst"], "left_semi")
        return replace(self, nodes=self.nodes.join(nodes, [*k, "node"], "left_semi"), edges=edges.select(*k, "src", "dst"))

    def cut(self, nodes: DataFrame) -> FlowGraph:
        """Without the edges that leave some of the nodes."""
        k = list(self.keys)
        return replace(self, edges=self.edges.join(nodes.select(*k, F.col("node").alias("src")), [*k, "src"], "left_anti").select(*k, "src", "dst"))

    def outdegree(self) -> DataFrame:
        return self.edges.groupBy(*self.keys, F.col("src").alias("node")).agg(F.count("*").alias("outdegree"))

    def branches(self) -> DataFrame:
        """Nodes with two successors or more."""
        return self.outdegree().where("outdegree > 1")


def graph(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> FlowGraph:
    """A graph from tables; repeated nodes and edges count once."""
    return FlowGraph(nodes.select(*keys, "node").distinct(), edges.select(*keys, "src", "dst").distinct(), keys)


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (user), node (1, 2, … in order), event of all events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("graph_id"), seq.cast("long").alias("node"), F.col("event_type").alias("event"))


def event_flow(spark: SparkSession, sf_dir: str) -> FlowGraph:
    """A graph for each user: events in order; a purchase ends it, a click also leads three on, an error two back."""
    n = event_nodes(spark, sf_dir)
    last = Window.partitionBy("graph_id")
    n = n.withColumn("last", F.max("node").over(last))
    to = F.array_compact(F.array(F.when(F.col("event") != "purchase", F.col("node") + 1), F.when(F.col("event") == "click", F.col("node") + 3), F.when(F.col("event") == "error", F.greatest(F.col("node") - 2, F.lit(1)))))
    edges = n.select("graph_id", F.col("node").alias("src"), F.explode(F.array_distinct(to)).alias("dst"), "last").where("dst <= last")
    return FlowGraph(n.select("graph_id", "node"), edges.select("graph_id", "src", "dst"))


def order_flow(spark: SparkSession, sf_dir: str) -> FlowGraph:
    """A graph for each order: lines in order; a returned line also leads one back, an accepted one two on."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    n = lines.select(F.col("l_orderkey").alias("graph_id"), F.row_number().over(order).cast("long").alias("node"), F.col("l_returnflag").alias("flag"))
    n = unsent(n.withColumn("last", F.max("node").over(Window.partitionBy("graph_id"))))
    to = F.array_compact(F.array(F.col("node") + 1, F.when(F.col("flag") == "R", F.greatest(F.col("node") - 1, F.lit(1))), F.when(F.col("flag") == "A", F.col("node") + 2)))
    edges = n.select("graph_id", F.col("node").alias("src"), F.explode(F.array_distinct(to)).alias("dst"), "last").where("dst <= last")
    return FlowGraph(n.select("graph_id", "node"), edges.select("graph_id", "src", "dst"))


def exits_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criterion used by the slicing queries: each graph's last node."""
    return event_nodes(spark, sf_dir).groupBy("graph_id").agg(F.max("node").alias("node"))


def ladder(spark: SparkSession, rungs: int, graph_id: int = 0) -> FlowGraph:
    """Two rails and rungs: 0 → 1, 2; 2i+1 → 2i+3; 2i → 2i+1, 2i+2."""
    i = spark.range(rungs + 1)
    edges = i.select((2 * F.col("id")).alias("src"), F.explode(F.array(2 * F.col("id") + 1, 2 * F.col("id") + 2)).alias("dst"))
    edges = edges.union(i.where(F.col("id") < rungs).select(2 * F.col("id") + 1, 2 * F.col("id") + 3))
    nodes = spark.range(2 * rungs + 3).select(F.lit(graph_id).cast("long").alias("graph_id"), F.col("id").alias("node"))
    return FlowGraph(nodes, edges.select(F.lit(graph_id).cast("long").alias("graph_id"), "src", "dst"))


def edge_costs(edges: DataFrame) -> DataFrame:
    """A seeded cost of 1 … 32 for every edge."""
    return edges.withColumn("cost", (1 + F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(32))).cast("long"))


def read_graph(spark: SparkSession, path: str, keys: tuple[str, ...] = ("graph_id",)) -> FlowGraph:
    """A graph from Parquet tables nodes and edges in a folder."""
    return graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), keys)


def write_graph(g: FlowGraph, path: str, buckets: int | None = None) -> None:
    """Parquet tables nodes and edges, rows of a graph near one another."""
    for name, df in (("nodes", g.nodes), ("edges", g.edges)):
        (df.repartition(buckets, *g.keys) if buckets else df).sortWithinPartitions(*g.keys).write.parquet(f"{path}/{name}")
