"""The forest of sink dominators against the plain relation, and a long graph."""

import time

import pytest
from pyspark.sql import functions as F
from test_graphs import GRAPHS, K, g, got  # noqa: F401

from tributary.operators import control, dominance, forest
from tributary.plans import bits
from tributary.plans.fixpoint import written
from tributary.sources import flowgraphs as flow


@pytest.fixture(scope="module")
def built(g):  # noqa: F811
    return forest.sink_forest(g)


def test_immediate_dominators(g, built):  # noqa: F811
    dom = written(dominance.sink_dominance(g))
    assert got(forest.immediate(built[0]), "y", "x") == got(dominance.immediate_dominance(dom, K), "y", "x")


def test_control_dependence(g, built):  # noqa: F811
    assert got(forest.control_dependence(*built), "n", "m") == got(control.from_dominance(g, dominance.sink_dominance(g)), "n", "m")


def test_nearest_common_dominators(g, built):  # noqa: F811
    pairs = g.nodes.select("graph_id", F.col("node").alias("a")).join(g.nodes.select("graph_id", F.col("node").alias("b")), "graph_id").where("a < b")
    want = dominance.nearest_common(written(dominance.sink_dominance(g)), pairs, K)
    assert got(forest.nearest_common(built[0], pairs), "a", "b", "lca") == got(want, "a", "b", "lca")


def test_no_tables_a_round(spark, monkeypatch):
    """A chain of 300 nodes with a way past every second takes as many tables as one of 4."""
    tables = []
    for module in (bits, forest):
        monkeypatch.setattr(module, "written", lambda df: tables.append(1) or written(df))

    def count(n):
        tables.clear()
        nodes = spark.range(n).select(F.lit(1).alias("graph_id"), F.col("id").alias("node"))
        on = lambda k: nodes.where((F.col("node") < n - k) & (F.col("node") % k == 0)).select("graph_id", F.col("node").alias("src"), (F.col("node") + k).alias("dst"))
        f, edges = forest.sink_forest(flow.FlowGraph(nodes, on(1).union(on(2))))
        assert forest.immediate(f).count() == n - 1
        assert forest.control_dependence(f, edges).count() == forest.nearest_common(f, edges.where("dst < 1000").select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))).count() - n + 1 > 0
        return len(tables)

    assert count(300) == count(4)


def test_ten_thousand_nodes(spark):
    """A chain in which every fifth node may skip the next two, with loops back, and a loop without an end."""
    n = 10_000
    i = spark.range(n - 1).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    skips = i.where("src % 5 = 0 and src + 3 < 9999").select("graph_id", "src", F.col("src") + 3)
    back = i.where("src % 7 = 6").select("graph_id", "src", F.col("src") - 4)
    end = spark.createDataFrame([(0, n - 1, n - 2)], "graph_id long, src long, dst long")
    began = time.time()
    built, edges = forest.sink_forest(flow.graph(spark.range(n).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("node")), i.union(skips).union(back).union(end)))
    up = {x.y: x.x for x in forest.immediate(built).where("x < 9998").collect()}
    took = time.time() - began
    # From the end: a node's parent is its only way on, or where both ways meet.
    assert all(up[v] == (v + 3 if v % 5 == 0 else v + 1) for v in range(9900) if v % 7 != 6 and v % 7 > 2), took
    assert control_pairs(built, edges) and took < 120


def control_pairs(built, edges):
    """Each pair is one of a branch and a node near it."""
    rows = forest.control_dependence(built, edges).collect()
    return rows and all(abs(x.n - x.m) < 20 for x in rows)
