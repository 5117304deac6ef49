"""Queries over programs with procedures, and analyses with lattices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import automata, balanced, dataflow, forest, order, programs, structure, timing, traces
from .plans.fixpoint import written
from .sources import flowgraphs as flow
from .sources.programs import Program, event_program

K = ("graph_id",)

#: A bit for each type of event, and how grave it is.
BITS = {"click": 1, "error": 2, "purchase": 4, "signup": 8, "view": 16}
GRAVE = {"view": 1, "signup": 2, "click": 3, "error": 4}


def program(spark: SparkSession, d: str) -> Program:
    return programs.cut_lineage(event_program(spark, d))


def typed(spark: SparkSession, d: str) -> flow.FlowGraph:
    """The event graph, each edge with the type of event that it leaves."""
    g = flow.event_flow(spark, d)
    types = flow.event_nodes(spark, d).select("graph_id", F.col("node").alias("src"), "event")
    return replace(g, nodes=written(g.nodes), edges=written(g.edges.join(types, ["graph_id", "src"])))


def _of(table: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(F.col("event") == k, F.lit(v).cast("long")) for k, v in table.items()), F.lit(0).cast("long"))


def dataflow_analysis(spark, d):
    """Of each event: the types of events that some path has met before it (bits), those that every path from the first
    event has met, the gravest event since a purchase on some path, and the fewest edges from the first event."""
    g = typed(spark, d)
    first = g.nodes.where("node = 1")
    from_first = first.withColumn("value", F.lit(0))
    return dataflow.analysis(
        g,
        met=dataflow.Analysis(dataflow.SOME, lambda v: v.bitwiseOR(_of(BITS))),
        always=dataflow.Analysis(dataflow.EVERY, lambda v: v.bitwiseOR(_of(BITS)), from_first),
        gravest=dataflow.Analysis(dataflow.HIGHEST, lambda v: F.when(F.col("event") == "purchase", F.lit(0).cast("long")).otherwise(F.greatest(v, _of(GRAVE)))),
        steps=dataflow.Analysis(dataflow.NEAREST, lambda v: v + 1, from_first),
    )


def live_events(spark, d):
    """A backward analysis: the types of events (bits) that some path from each event, itself included, still meets."""
    g = typed(spark, d)
    types = flow.event_nodes(spark, d).select("graph_id", F.col("node").alias("src"), "event")
    back = g.reverse()
    back = replace(back, edges=back.edges.join(types, ["graph_id", "src"]))
    own = flow.event_nodes(spark, d).select("graph_id", "node", _of(BITS).alias("value"))
    return dataflow.analysis(back, meets=dataflow.Analysis(dataflow.SOME, lambda v: v, own))


def must_kill(spark, d):
    return programs.must_kill(program(spark, d))


def strong_reaching_definitions(spark, d):
    return programs.strong_reaching_definitions(program(spark, d))


def sdg(spark, d):
    return programs.system_dependence(program(spark, d))


def sdg_slice(spark, d):
    """What each program's purchases depend on."""
    p = program(spark, d)
    bought = p.defines.where("name = 'purchase'").select("graph_id", "node")
    return programs.slice_of(p, bought)


def order_parens(g: flow.FlowGraph) -> DataFrame:
    """On graphs of orders: two on calls, one back returns; sites by parity."""
    kind = F.when(F.col("dst") == F.col("src") + 2, "(").when(F.col("dst") < F.col("src"), ")")
    return written(g.edges.withColumn("paren", kind).where("paren is not null").withColumn("site", F.pmod(F.col("src"), F.lit(2))))


def events(spark: SparkSession, d: str) -> flow.FlowGraph:
    g = flow.event_flow(spark, d)
    return replace(g, nodes=written(g.nodes), edges=written(g.edges))


def orders(spark: SparkSession, d: str) -> flow.FlowGraph:
    g = flow.order_flow(spark, d)
    return replace(g, nodes=written(g.nodes), edges=written(g.edges))


def same_level_components(spark, d):
    g = orders(spark, d)
    return balanced.same_level_components(written(dataflow.balanced_reach(g, order_parens(g))), K)


def two_pass_folding(spark, d):
    g = orders(spark, d)
    return balanced.two_pass_folding(g, order_parens(g))[0]


def folded_graph(spark, d):
    g = orders(spark, d)
    return balanced.two_pass_folding(g, order_parens(g))[1].edges


def valid_dominance(spark, d):
    """From the first line of each order."""
    g = orders(spark, d)
    return balanced.valid_dominance(g, order_parens(g), g.nodes.where("node = 1"))


def valid_immediate_dominance(spark, d):
    return balanced.reduced(written(valid_dominance(spark, d)), K)


def pushdown_saturation(spark, d):
    """Configurations of each program from which a purchase can be reached, on any stack of return nodes."""
    p = program(spark, d)
    calls = p.calls()
    bought = p.defines.where("name = 'purchase'").select("graph_id", F.lit(0).cast("long").alias("src"), F.col("node").alias("symbol"), F.lit(1).cast("long").alias("dst"))
    rest = calls.select("graph_id", F.lit(1).cast("long").alias("src"), F.col("back").alias("symbol"), F.lit(1).cast("long").alias("dst"))
    plain = p.flow().select("graph_id", F.col("src").alias("node"), F.col("dst").alias("next"))
    return balanced.pre_star(plain, calls.select("graph_id", F.col("call").alias("node"), "entry", "back"), p.procs.select("graph_id", F.col("exit").alias("node")), bought.union(rest), K)


def automata_product(spark, d):
    """The pairs of events that follow one another in a user's table, as an automaton, with: any events, then a click and at
    once an error or a purchase, then any; trimmed."""
    n = flow.event_nodes(spark, d)
    after = F.lead("event").over(Window.partitionBy("graph_id").orderBy("node"))
    pairs = written(n.select("graph_id", "node", F.col("event").alias("src"), after.alias("dst")))
    t = pairs.where("dst is not null").select("graph_id", "src", "dst").distinct().union(pairs.where("node = 1").select("graph_id", F.lit("start"), "src"))
    users = automata.Automata(pairs.where("node = 1").select("graph_id", F.lit("start").alias("state")), pairs.where("dst is null").select("graph_id", F.col("src").alias("state")), t.select("graph_id", "src", "dst", F.lit("only").alias("kind"), F.col("dst").alias("letter")))
    pattern = spark.createDataFrame([(0, 0, "all", None), (0, 1, "only", "click"), (1, 2, "only", "error"), (1, 2, "only", "purchase"), (2, 3, "free", None), (3, 3, "all", None)], "src int, dst int, kind string, letter string")
    wanted = automata.Automata(spark.createDataFrame([(0,)], "state int"), spark.createDataFrame([(3,)], "state int"), pattern, ())
    name = lambda c: F.concat_ws(":", f"{c}.a", f"{c}.b").alias(c)
    return automata.trimmed(automata.product(users, wanted)).transitions.select("graph_id", name("src"), name("dst"), "kind", "letter")


def order_wod(spark, d):
    return order.weak(orders(spark, d))


def order_wod_reachable(spark, d):
    return order.weak_reachable(orders(spark, d))


def reducible(spark, d):
    g = events(spark, d)
    return structure.reducible(g, g.nodes.where("node = 1")).select("graph_id", "reducible")


def dominator_forest(spark, d):
    return forest.immediate(forest.sink_forest(events(spark, d))[0])


def forest_nticd(spark, d):
    return forest.control_dependence(*forest.sink_forest(events(spark, d)))


def order_forest_nticd(spark, d):
    return forest.control_dependence(*forest.sink_forest(orders(spark, d)))


def forest_lca(spark, d):
    """The nearest common dominator of the ends of each edge."""
    g = events(spark, d)
    return forest.nearest_common(forest.sink_forest(g)[0], g.edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")))


def timing_correction(spark, d):
    g = orders(spark, d)
    return timing.correction(g, flow.edge_costs(g.edges))


def corrected_timing_dominance(spark, d):
    """Timing dominance under corrected costs, without its times: dominance, but for nodes that come in either order."""
    g = orders(spark, d)
    return timing.timing_dominance(g, written(timing.correction(g, flow.edge_costs(g.edges)))).select("graph_id", "y", "x")


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of each event graph: input 0 takes the nearest successor of each node, input 1 the farthest."""
    g = events(spark, d)
    to = g.edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.min("dst").alias("low"), F.max("dst").alias("high"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("input"), F.col("low").alias("to")), F.struct(F.lit(1).alias("input"), F.col("high").alias("to"))))
    steps = to.select("graph_id", "node", both.alias("s")).select("graph_id", F.col("s.input").alias("input"), "node", F.col("s.to").alias("to"))
    starts = g.nodes.where("node = 1").select("graph_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("input"), "node")
    return traces.runs(steps, starts, K)


def runs(spark, d):
    return event_runs(spark, d)


def low_equivalence(spark, d):
    """Whether those who see the views of a user can tell both runs apart."""
    n = flow.event_nodes(spark, d)
    seen = n.where("event = 'view'").select("graph_id", "node")
    return traces.compared(written(event_runs(spark, d)), seen, K)


QUERIES = (
    dataflow_analysis, live_events, must_kill, strong_reaching_definitions, sdg, sdg_slice,
    same_level_components, two_pass_folding, folded_graph, valid_dominance, valid_immediate_dominance, pushdown_saturation, automata_product,
    order_wod, order_wod_reachable, reducible, dominator_forest, forest_nticd, order_forest_nticd, forest_lca,
    timing_correction, corrected_timing_dominance, runs, low_equivalence,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
