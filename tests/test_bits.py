"""Fixpoints of gathered graphs: the same rows as without gathering, for small graphs and for some beside large ones."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import control, dominance, order, structure, timing
from tributary.plans import bits, fixpoint
from tributary.sources import flowgraphs as flow

from test_graphs import GRAPHS, K, every, got, mdom, reach, sdom, suc


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(k, n) for k, (ns, _) in GRAPHS.items() for n in ns]
    edges = [(k, a, b) for k, (_, es) in GRAPHS.items() for a, b in es]
    return flow.graph(spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame(edges, "graph_id long, src long, dst long"))


@pytest.mark.parametrize("most", [0, 12, 4096])
def test_small_and_large_graphs_agree(g, most, monkeypatch):
    monkeypatch.setattr(bits, "MOST", most)
    assert got(structure.reach(g), "a", "b") == every(reach)
    assert got(dominance.sink_dominance(g), "y", "x") == every(sdom)
    assert got(dominance.max_dominance(g), "y", "x") == every(mdom)


def test_times_agree(g, monkeypatch):
    costs = flow.edge_costs(g.edges)
    small = got(timing.timing_dominance(g, costs), "y", "x", "steps")
    monkeypatch.setattr(bits, "MOST", 0)
    assert small == got(timing.timing_dominance(g, costs), "y", "x", "steps")


def test_no_tables_a_round(spark, monkeypatch):
    """A chain of 300 nodes takes as many tables as one of 3."""
    tables = []
    for module in (bits, dominance, fixpoint, structure, timing):
        monkeypatch.setattr(module, "written", lambda df, w=fixpoint.written: tables.append(1) or w(df))

    def count(n):
        tables.clear()
        nodes = spark.range(n).select(F.lit(1).alias("graph_id"), F.col("id").alias("node"))
        g = flow.FlowGraph(nodes, nodes.where(F.col("node") < n - 1).select("graph_id", F.col("node").alias("src"), (F.col("node") + 1).alias("dst")))
        for of in (structure.reach, dominance.sink_dominance, dominance.max_dominance, timing.timing_dominance):
            assert of(g).count() == n * (n + 1) // 2
        return len(tables)

    assert count(300) == count(3)


def test_gates_and_stops_agree(spark, monkeypatch):
    """Edges that open with what is found, values that stop: gathered, as tables, and in plain Python."""
    r = random.Random(5)
    seeds, edges, stops, gates = set(), set(), set(), set()
    for k in range(30):
        n = lambda: r.randrange(9)
        seeds |= {(k, n(), n()) for _ in range(3)}
        edges |= {(k, n(), n()) for _ in range(8)}
        stops |= {(k, n(), n()) for _ in range(4)}
        gates |= {(k, n(), n(), n(), n()) for _ in range(12)}
    want = set(seeds)
    while True:
        live = want - stops
        on = edges | {(k, a, b) for k, a, b, at, key in gates if (k, at, key) in live}
        more = want | {(k, b, v) for k, a, b in on for j, x, v in live if (k, a) == (j, x)}
        if more == want:
            break
        want = more
    table = lambda rows, columns: spark.createDataFrame(sorted(rows), "graph_id long, " + ", ".join(f"{c} long" for c in columns.split()))
    given = table(seeds, "node value"), table(edges, "src dst"), table(stops, "node value"), table(gates, "src dst at key")
    assert want != seeds
    for most in (4096, 0):
        monkeypatch.setattr(bits, "MOST", most)
        assert sorted(map(tuple, bits.spread(K, *given).collect())) == sorted(want)


def _refuse(monkeypatch, module, *names):
    for name in names:
        monkeypatch.setattr(module, name, lambda *_, **__: pytest.fail("ran as tables"))


def test_classic_control_dependence_in_tasks(g, monkeypatch):
    """Small graphs need neither tables of what reaches the exit nor of dominance."""
    _refuse(monkeypatch, control, "reach_from", "sink_dominance", "from_dominance")

    def want(ns, es):
        r, ends = reach(ns, es), {n for n in ns if not suc(es, n)}
        keep = [n for n in ns if any((n, e) in r for e in ends)]
        es = {(a, b) for a, b in es if a in keep and b in keep}
        d = sdom(keep, es)
        hits = {(n, m): sum((s, m) in d for s in suc(es, n)) for n in keep for m in keep if n != m}
        return {(n, m) for (n, m), hit in hits.items() if 0 < hit < len(suc(es, n))}

    assert got(control.classic(g), "n", "m") == every(want)


def test_timing_dependence_in_tasks(g, monkeypatch):
    """Small graphs are cut at each node inside tasks; a few columns at a time give the same."""
    _refuse(monkeypatch, timing, "reach", "timing_dominance")
    want = got(timing.dependence(g), "n", "m")
    monkeypatch.setattr(timing, "CUT_NODES", 1)
    assert want == got(timing.dependence(g), "n", "m") and any(want.values())


def test_correction_in_tasks(g, monkeypatch):
    """Longest ways of small graphs take no rounds of tables; then dominance takes fixed times but where two nodes come in either order."""
    _refuse(monkeypatch, timing, "slowest")
    mended = timing.correction(g, flow.edge_costs(g.edges))
    timed, dom = got(timing.timing_dominance(g, mended), "y", "x"), every(mdom)
    for k in GRAPHS:
        assert timed[k] <= dom[k]
        assert dom[k] - timed[k] <= {(y, x) for y, x in dom[k] for z in GRAPHS[k][0] if z != x and (x, z) in dom[k] and (z, x) in dom[k]}


def test_weak_order_dependence_in_tasks(g, monkeypatch):
    """Small graphs are cut at each node inside tasks; a few branches at a time give the same."""
    _refuse(monkeypatch, order, "cut_at_each")
    want = [got(of(g), "m1", "m2", "n") for of in (order.weak, order.weak_reachable)]
    monkeypatch.setattr(order, "CUT_BITS", 1)
    assert want == [got(of(g), "m1", "m2", "n") for of in (order.weak, order.weak_reachable)] and any(want[0].values())
