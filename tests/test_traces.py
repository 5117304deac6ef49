"""Runs that end or loop, what their observers see, and corrected timing, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql.readwriter import DataFrameWriter
from test_graphs import GRAPHS, K, g, got  # noqa: F401

from tributary.operators import dominance, order, timing, traces
from tributary.plans.fixpoint import written
from tributary.sources import flowgraphs as flow

INPUTS = {}
for key in range(40):
    r = random.Random(key)
    n = r.randint(1, 7)
    INPUTS[key] = [{v: r.randrange(n) for v in range(n) if r.random() < 0.85} for _ in range(4)]


def run(to):
    seen, at = [], 0
    while at is not None and at not in seen:
        seen.append(at)
        at = to.get(at)
    return seen, seen.index(at) if at is not None else None


@pytest.fixture(scope="module")
def table(spark):
    steps = [(k, i, v, w) for k, inputs in INPUTS.items() for i, to in enumerate(inputs) for v, w in to.items()]
    starts = [(k, i, 0) for k in INPUTS for i in range(4)]
    return written(traces.runs(spark.createDataFrame(steps, "graph_id long, input int, node long, to long"), spark.createDataFrame(starts, "graph_id long, input int, node long"), K))


def test_runs(table):
    want = set()
    for k, inputs in INPUTS.items():
        for i, to in enumerate(inputs):
            seen, loop = run(to)
            want |= {(k, i, p, v, len(seen) - loop if loop is not None and p >= loop else None) for p, v in enumerate(seen)}
    rows = table.collect()
    assert {tuple(x) for x in rows} == want and len(rows) == len(want)


def word(to, observed, size=60):
    """What is seen of a long stretch of a run, with times; and whether the run loops where nothing is seen."""
    seen, loop = run(to)
    turns = list(itertools.chain(seen, *[seen[loop:]] * size)) if loop is not None else seen
    return [(v, t) for t, v in enumerate(turns) if v in observed], loop is not None and not set(seen[loop:]) & observed


def test_compared(spark, table):
    observed = {k: {v for v in range(7) if random.Random(k * 7 + v).random() < 0.5} for k in INPUTS}
    rows = traces.compared(table, spark.createDataFrame([(k, v) for k, vs in observed.items() for v in vs], "graph_id long, node long"), K).collect()
    found = {(x.graph_id, x.a, x.b): (x.equal, x.weakly, x.timed) for x in rows}
    want = {}
    for k, inputs in INPUTS.items():
        for i, j in itertools.combinations(range(4), 2):
            (x, slow_x), (y, slow_y) = word(inputs[i], observed[k]), word(inputs[j], observed[k])
            a, b = [v for v, _ in x], [v for v, _ in y]
            both = min(len(a), len(b), 50)  # of words that go on for ever, both are cut
            equal = a[:both] == b[:both] and (len(a) == len(b) or min(len(a), len(b)) > 40)
            weakly = equal or slow_x and b[: len(a)] == a or slow_y and a[: len(b)] == b
            times = lambda w, v: [t for u, t in w if u == v]
            timed = all(p == q for v in observed[k] for p, q in zip(times(x, v), times(y, v)))
            want[k, i, j] = (equal, weakly, timed)
    assert found == want and len(set(want.values())) > 3


def test_corrected_costs_make_dominance_timed(g):  # noqa: F811
    costs = flow.edge_costs(g.edges)
    new = written(timing.correction(g, costs))
    old, raised = got(costs, "src", "dst", "cost"), got(new, "src", "dst", "cost")
    for k in GRAPHS:
        was = {x[:2]: x[2] for x in old[k]}
        assert {x[:2] for x in raised[k]} == set(was) and all(c >= was[a, b] for a, b, c in raised[k])
    timed, dom, either = got(timing.timing_dominance(g, new), "y", "x"), got(dominance.max_dominance(g), "y", "x"), got(order.sensitive(g), "m1", "m2", "n")
    assert all(timed[k] <= dom[k] and (timed[k] == dom[k] or either[k]) for k in GRAPHS) and sum(not either[k] for k in GRAPHS) > 30
    before = got(timing.timing_dominance(g, costs), "y", "x")
    assert any(timed[k] > before[k] for k in GRAPHS)
    assert any(raised[k] != old[k] for k in GRAPHS)


def test_walks_double(spark, monkeypatch):
    """A run of 700 nodes that ends, and one that loops: as many rounds as the length has bits."""
    steps = [(0, 0, v, v + 1) for v in range(700)] + [(0, 1, v, v + 1) for v in range(500)] + [(0, 1, 500, 480)]
    calls, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **kw: calls.append(1) or write(self, *a, **kw))
    table = spark.createDataFrame(steps, "graph_id long, input int, node long, to long")
    starts = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "graph_id long, input int, node long")
    rows = {(r.input, r.pos): (r.node, r.period) for r in traces.runs(table, starts, K).collect()}
    assert rows == {(0, v): (v, None) for v in range(701)} | {(1, v): (v, 21 if v >= 480 else None) for v in range(501)}
    assert len(calls) <= 4 + 2 * 10
