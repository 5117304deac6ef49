"""The queries of the graph operators, on graphs of users' events and of orders' lines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import program_queries
from .functions import statistics, values
from .operators import classification, control, dataflow, dominance, order, paths, procedures, slicing, structure, threads, timing
from .plans.fixpoint import written
from .sources import flowgraphs as flow

K = ("graph_id",)


def events(spark: SparkSession, d: str) -> flow.FlowGraph:
    g = flow.event_flow(spark, d)
    return replace(g, nodes=written(g.nodes), edges=written(g.edges))


def orders(spark: SparkSession, d: str) -> flow.FlowGraph:
    g = flow.order_flow(spark, d)
    return replace(g, nodes=written(g.nodes), edges=written(g.edges))


def names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What event nodes define (their type) and use (the type of the event before)."""
    n = flow.event_nodes(spark, d)
    before = F.lag("event").over(Window.partitionBy("graph_id").orderBy("node"))
    return n.select("graph_id", "node", F.col("event").alias("name")), n.select("graph_id", "node", before.alias("name")).where("name is not null")


def dependence(g: flow.FlowGraph, spark: SparkSession, d: str, closure: DataFrame | None = None) -> DataFrame:
    """Control and data dependence together."""
    defines, uses = names(spark, d)
    return control.insensitive(g, closure).union(dataflow.data_dependence(dataflow.reaching_definitions(g, defines), uses, K)).distinct()


def of_type(spark: SparkSession, d: str, event: str) -> DataFrame:
    return flow.event_nodes(spark, d).where(F.col("event") == event).select("graph_id", "node")


def event_flow(spark, d):
    return flow.event_flow(spark, d).edges


def order_flow(spark, d):
    return flow.order_flow(spark, d).edges


def reachability(spark, d):
    return structure.reach(events(spark, d))


def order_reachability(spark, d):
    return structure.reach(orders(spark, d))


def strong_components(spark, d):
    return structure.components(events(spark, d))


def control_sinks(spark, d):
    g = events(spark, d)
    return structure.sinks(g, structure.components(g))


def cyclic_nodes(spark, d):
    return structure.cyclic(structure.components(events(spark, d)))


def join_nodes(spark, d):
    return structure.join_nodes(events(spark, d))


def branch_nodes(spark, d):
    return events(spark, d).branches()


def next_branch(spark, d):
    return structure.next_branch(events(spark, d))


def condensation(spark, d):
    g = events(spark, d)
    return structure.quotient(g, structure.components(g).select("graph_id", "node", F.col("scc").alias("cls"))).edges


def transitive_reduction(spark, d):
    g = events(spark, d)
    r = written(structure.reach(g))
    return structure.transitive_reduction(g, r, written(structure.components(g, r)))


def chop(spark, d):
    g = events(spark, d)
    return structure.chop(structure.reach(g), K, of_type(spark, d, "click"), of_type(spark, d, "purchase"))


def sink_dominance(spark, d):
    return dominance.sink_dominance(events(spark, d))


def max_dominance(spark, d):
    return dominance.max_dominance(events(spark, d))


def immediate_sink_dominance(spark, d):
    return dominance.immediate_dominance(dominance.sink_dominance(events(spark, d)), K)


def immediate_max_dominance(spark, d):
    return dominance.immediate_dominance(dominance.max_dominance(events(spark, d)), K)


def sink_frontier(spark, d):
    g = events(spark, d)
    return dominance.frontier(g, written(dominance.sink_dominance(g)))


def max_frontier(spark, d):
    g = events(spark, d)
    return dominance.frontier(g, written(dominance.max_dominance(g)))


def nearest_common_dominator(spark, d):
    g = events(spark, d)
    pairs = g.branches().select("graph_id").distinct().join(g.edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")), "graph_id")
    return dominance.nearest_common(written(dominance.sink_dominance(g)), pairs, K)


def nticd(spark, d):
    return control.insensitive(events(spark, d))


def ntscd(spark, d):
    return control.sensitive(events(spark, d))


def order_nticd(spark, d):
    return control.insensitive(orders(spark, d))


def classic_control_dependence(spark, d):
    return control.classic(events(spark, d))


def nodes_between_sink(spark, d):
    g = events(spark, d)
    return control.between(g, written(dominance.sink_dominance(g)))


def nodes_between_max(spark, d):
    g = events(spark, d)
    return control.between(g, written(dominance.max_dominance(g)))


def ntiod(spark, d):
    return order.insensitive(events(spark, d))


def ntsod(spark, d):
    return order.sensitive(events(spark, d))


def dod(spark, d):
    return order.decisive(events(spark, d))


def pairs_from_ntiod(spark, d):
    return order.to_pairs(order.insensitive(events(spark, d)), K)


def nticd_slice(spark, d):
    return slicing.control_slice(events(spark, d), flow.exits_of_events(spark, d))


def ntscd_slice(spark, d):
    return slicing.sensitive_slice(events(spark, d), flow.exits_of_events(spark, d))


def nticd_ntiod_slice(spark, d):
    return slicing.order_slice(events(spark, d), flow.exits_of_events(spark, d))


def ntscd_ntsod_slice(spark, d):
    return slicing.order_slice(events(spark, d), flow.exits_of_events(spark, d), control.sensitive)


def weak_order_slice(spark, d):
    return slicing.weak_slice(events(spark, d), of_type(spark, d, "signup"))


def weak_control_closure(spark, d):
    return slicing.weak_closure(events(spark, d), of_type(spark, d, "signup"))


def next_observable(spark, d):
    return slicing.next_observable(events(spark, d), of_type(spark, d, "signup"))


def weakly_closed(spark, d):
    return slicing.weakly_closed(events(spark, d), of_type(spark, d, "signup"))


def timing_dominance(spark, d):
    return timing.timing_dominance(events(spark, d))


def timing_dominance_cost(spark, d):
    g = events(spark, d)
    return timing.timing_dominance(g, flow.edge_costs(g.edges))


def tscd(spark, d):
    return timing.timing_sensitive(events(spark, d))


def tscd_cost(spark, d):
    g = events(spark, d)
    return timing.timing_sensitive(g, flow.edge_costs(g.edges))


def tscd_slice(spark, d):
    return slicing.control_slice(events(spark, d), flow.exits_of_events(spark, d), timing.timing_sensitive)


def coarse_timing_dependence(spark, d):
    g = events(spark, d)
    return timing.coarse(g, structure.reach(g))


def reaching_definitions(spark, d):
    return dataflow.reaching_definitions(events(spark, d), names(spark, d)[0])


def data_dependence(spark, d):
    defines, uses = names(spark, d)
    return dataflow.data_dependence(dataflow.reaching_definitions(events(spark, d), defines), uses, K)


def program_dependence(spark, d):
    return dependence(events(spark, d), spark, d)


def program_slice(spark, d):
    return slicing.backward(written(program_dependence(spark, d)), flow.exits_of_events(spark, d), K)


def information_flow(spark, d):
    return dataflow.information_flow(written(program_dependence(spark, d)), of_type(spark, d, "signup"), K)


def insecure_nodes(spark, d):
    return dataflow.insecure(written(program_dependence(spark, d)), of_type(spark, d, "signup"), of_type(spark, d, "purchase"), K)


def event_parens(g: flow.FlowGraph) -> DataFrame:
    """Jumps on call, jumps back return."""
    kind = F.when(F.col("dst") == F.col("src") + 3, "(").when(F.col("dst") < F.col("src"), ")")
    return written(g.edges.withColumn("paren", kind).where("paren is not null").withColumn("site", F.pmod(F.col("src"), F.lit(2))))


def balanced_reachability(spark, d):
    g = events(spark, d)
    return dataflow.balanced_reach(g, event_parens(g))


def spawns(g: flow.FlowGraph) -> DataFrame:
    """A click's edge three on starts a thread."""
    return g.edges.where("dst = src + 3")


def entries(g: flow.FlowGraph) -> DataFrame:
    return g.nodes.where("node = 1")


def threads_of(spark, d):
    g = events(spark, d)
    return threads.threads_of(g, spawns(g), entries(g))


def spawned_apart(spark, d):
    g = events(spark, d)
    return threads.spawned_apart(g, spawns(g))


def parallel_nodes(spark, d):
    g = events(spark, d)
    return threads.parallel(g, spawns(g), entries(g))


def data_conflicts(spark, d):
    g = events(spark, d)
    return threads.conflicts(threads.parallel(g, spawns(g), entries(g)), *names(spark, d), K)


def inter_thread_dependence(spark, d):
    g = events(spark, d)
    return threads.between_threads(threads.parallel(g, spawns(g), entries(g)), *names(spark, d), K)


def timed_classification(spark, d):
    g, mhp, closure = program(spark, d)
    return threads.classified(g, dependence(g, spark, d, closure), mhp, of_type(spark, d, "signup"))


def program(spark: SparkSession, d: str) -> tuple[flow.FlowGraph, DataFrame, DataFrame]:
    """The event graphs as programs with threads: what may run at the same time, and reachability."""
    g = events(spark, d)
    closure = structure.reach(g)
    return g, written(threads.parallel(g, spawns(g), entries(g), closure)), closure


def concurrent(g: flow.FlowGraph, mhp: DataFrame, closure: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Control and data dependence, dependence between threads, and starts of threads."""
    between = threads.between_threads(mhp, *names(spark, d), K)
    return written(dependence(g, spark, d, closure).union(between).union(spawns(g).select("graph_id", F.col("src").alias("n"), F.col("dst").alias("m"))).distinct())


def commons(g: flow.FlowGraph, mhp: DataFrame) -> DataFrame:
    return written(classification.common_dominators(written(classification.dominators(g, entries(g))), mhp, K))


def concurrent_dependence(spark, d):
    g, mhp, closure = program(spark, d)
    return concurrent(g, mhp, closure, spark, d)


def common_dominator(spark, d):
    return commons(*program(spark, d)[:2])


def minimal_classification(spark, d):
    g, mhp, closure = program(spark, d)
    return classification.minimal(concurrent(g, mhp, closure, spark, d), commons(g, mhp), closure, of_type(spark, d, "signup"), K)


def _timing_classes(spark, d):
    g, mhp, closure = program(spark, d)
    timed = written(classification.timed_by(commons(g, mhp), closure, written(timing.dependence_of_threads(g, spawns(g), closure)), K))
    nodes, pairs = classification.timing_classes(concurrent(g, mhp, closure, spark, d), threads.conflicts(mhp, *names(spark, d), K), timed, of_type(spark, d, "signup"), K)
    return g, mhp, nodes, pairs


def timing_classification(spark, d):
    return _timing_classes(spark, d)[2]


def timing_levels(spark, d):
    return _timing_classes(spark, d)[3]


def timing_security(spark, d):
    g, mhp, nodes, pairs = _timing_classes(spark, d)
    return classification.timing_security(g, nodes, pairs, mhp, of_type(spark, d, "purchase"))


def lsod(spark, d):
    """Both nodes of a conflict race."""
    g, mhp, closure = program(spark, d)
    pairs = threads.conflicts(mhp, *names(spark, d), K)
    racing = pairs.select("graph_id", F.col("n").alias("node")).union(pairs.select("graph_id", "m"))
    return classification.low_security(g, concurrent(g, mhp, closure, spark, d), mhp, racing, of_type(spark, d, "signup"), of_type(spark, d, "purchase"))


def rlsod(spark, d):
    """Only what another thread's definition reaches, or overwrites, races."""
    g, mhp, closure = program(spark, d)
    defines, uses = names(spark, d)
    racing = threads.between_threads(mhp, defines, uses, K).union(threads.between_threads(mhp, defines, defines, K)).select("graph_id", F.col("m").alias("node"))
    return classification.low_security(g, concurrent(g, mhp, closure, spark, d), mhp, racing, of_type(spark, d, "signup"), of_type(spark, d, "purchase"))


def timing_dependence(spark, d):
    return timing.dependence(events(spark, d))


def timing_frontier(spark, d):
    return timing.frontier(events(spark, d))


def timing_frontier_cost(spark, d):
    g = events(spark, d)
    return timing.frontier(g, flow.edge_costs(g.edges))


def nticd_timing_slice(spark, d):
    return slicing.control_slice(events(spark, d), flow.exits_of_events(spark, d), lambda g: control.insensitive(g).union(timing.dependence(g)).distinct())


def ntscd_timing_slice(spark, d):
    return slicing.control_slice(events(spark, d), flow.exits_of_events(spark, d), lambda g: control.sensitive(g).union(timing.dependence(g)).distinct())


def tscd_cost_slice(spark, d):
    return slicing.control_slice(events(spark, d), flow.exits_of_events(spark, d), lambda g: timing.timing_sensitive(g, flow.edge_costs(g.edges)))


def ternary_slice(spark, d):
    """The order slice by its definition: closed under pairs and triples."""
    g = events(spark, d)
    return slicing.backward(written(control.insensitive(g)), flow.exits_of_events(spark, d), K, written(order.insensitive(g)))


def immediate_slice(spark, d):
    return slicing.by_immediate(events(spark, d), flow.exits_of_events(spark, d))


def call_ends(g: flow.FlowGraph) -> tuple[DataFrame, DataFrame]:
    """Actual and formal nodes of jumps on (in) and back (out); calls are told apart by the parity of the actual node."""
    e = kinds(g)
    ins = e.where(F.col("kind") == procedures.IN).select("graph_id", F.col("src").alias("actual"), F.col("dst").alias("formal"), F.pmod("src", F.lit(2)).alias("call"))
    outs = e.where(F.col("kind") == procedures.OUT).select("graph_id", F.col("dst").alias("actual"), F.col("src").alias("formal"), F.pmod("dst", F.lit(2)).alias("call"))
    return ins, outs


def summary_edges(spark, d):
    g = events(spark, d)
    return procedures.summary_edges(kinds(g), *call_ends(g), K)


def summary_slice(spark, d):
    """Two phases over a graph with its summary edges."""
    g = events(spark, d)
    return procedures.two_phase(written(procedures.with_summaries(kinds(g), *call_ends(g), K)), flow.exits_of_events(spark, d), K)


def balanced_chop(spark, d):
    g = events(spark, d)
    return procedures.balanced_chop(g, event_parens(g), dataflow.balanced_reach, of_type(spark, d, "view"), of_type(spark, d, "purchase"))


def kinds(g: flow.FlowGraph) -> DataFrame:
    """Flow edges as a dependence graph: jumps on pass parameters in, edges back pass them out."""
    return g.edges.withColumn("kind", F.when(F.col("dst") == F.col("src") + 3, procedures.IN).when(F.col("dst") < F.col("src"), procedures.OUT).otherwise(procedures.DATA))


def two_phase_slice(spark, d):
    return procedures.two_phase(kinds(events(spark, d)), flow.exits_of_events(spark, d), K)


def within_chop(spark, d):
    return procedures.within_chop(kinds(events(spark, d)), flow.exits_of_events(spark, d), of_type(spark, d, "view"), K)


def distances(spark, d):
    g = events(spark, d)
    return paths.distances(g, flow.edge_costs(g.edges), entries(g))


def bounded_walks(spark, d):
    g = events(spark, d)
    return paths.within(g, entries(g), 5)


def chain_roots(spark, d):
    g = events(spark, d)
    return paths.roots(g.edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.max("dst").alias("parent")).where("parent > node"), K)


def accepted_words(spark, d):
    """Users whose first events match: any number of events, then a click, and at once an error or a purchase, then any."""
    n = flow.event_nodes(spark, d)
    words = n.select(F.col("graph_id").alias("word_id"), (F.col("node") - 1).cast("int").alias("pos"), F.col("event").alias("letter"))
    t = spark.createDataFrame([(0, 0, "all", None), (0, 1, "only", "click"), (1, 2, "only", "error"), (1, 2, "only", "purchase"), (2, 3, "free", None), (3, 3, "all", None)], "src int, dst int, kind string, letter string")
    return paths.accepted(words, spark.createDataFrame([(0,)], "state int"), spark.createDataFrame([(3,)], "state int"), t)


def value_arithmetic(spark, d):
    a, b = F.col("l_partkey"), F.col("l_linenumber")
    cols = {"plus": values.plus, "minus": values.minus, "times": values.times, "quotient": values.quotient, "remainder": values.remainder, "both": values.both, "either": values.either, "differ": values.differ}
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    out = line.select("l_orderkey", *(f(a, b).cast("bigint").alias(n) for n, f in cols.items()))
    sums = [F.sum(n).alias(n) for n in cols]
    return out.groupBy("l_orderkey").agg(*sums)


def level_join(spark, d):
    level = F.when(F.col("event") == "signup", values.HIGH).otherwise(values.LOW)
    return flow.event_nodes(spark, d).groupBy("graph_id").agg(values.join(level).cast("int").alias("join"), values.meet(level).cast("int").alias("meet"))


def _counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.pmod(F.col("user_id"), F.lit(2)).alias("half"), "event_type")
    return statistics.contingency(e, "half", "event_type")


def g_test(spark, d):
    return statistics.g_test(_counts(spark, d), "half", "event_type").select(F.round("g", 6).alias("g"), F.col("df").cast("bigint").alias("df"))


def equivalence_distance(spark, d):
    return statistics.squared_distance(_counts(spark, d), "half", "event_type", 0, 1).select(F.round("d2", 10).alias("d2"), "n1", "n2")


def two_sample_test(spark, d):
    return statistics.two_sample(_counts(spark, d), "half", "event_type", 0, 1).select(F.round("chi2", 6).alias("chi2"), F.col("df").cast("bigint").alias("df"))


QUERIES = (
    event_flow, order_flow, reachability, order_reachability, strong_components, control_sinks, cyclic_nodes, join_nodes, branch_nodes, next_branch, condensation, transitive_reduction, chop,
    sink_dominance, max_dominance, immediate_sink_dominance, immediate_max_dominance, sink_frontier, max_frontier, nearest_common_dominator,
    nticd, ntscd, order_nticd, classic_control_dependence, nodes_between_sink, nodes_between_max, ntiod, ntsod, dod, pairs_from_ntiod,
    nticd_slice, ntscd_slice, nticd_ntiod_slice, ntscd_ntsod_slice, weak_order_slice, weak_control_closure, next_observable, weakly_closed,
    timing_dominance, timing_dominance_cost, tscd, tscd_cost, tscd_slice, coarse_timing_dependence,
    reaching_definitions, data_dependence, program_dependence, program_slice, information_flow, insecure_nodes, balanced_reachability,
    threads_of, spawned_apart, parallel_nodes, data_conflicts, inter_thread_dependence, timed_classification, two_phase_slice, within_chop,
    distances, bounded_walks, chain_roots, accepted_words,
    timing_dependence, timing_frontier, timing_frontier_cost, nticd_timing_slice, ntscd_timing_slice, tscd_cost_slice, ternary_slice, immediate_slice,
    concurrent_dependence, common_dominator, minimal_classification, timing_classification, timing_levels, timing_security, lsod, rlsod,
    summary_edges, summary_slice, balanced_chop,
    value_arithmetic, level_join, g_test, equivalence_distance, two_sample_test,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | program_queries.queries()
