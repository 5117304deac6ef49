"""Tables that grow with the input aren't sent through the driver, and small programs take no tables a round."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import procedures, programs
from tributary.plans import bits, fixpoint

from test_interprocedural import PROGRAMS, got, killed, p, system  # noqa: F401


@pytest.fixture
def joins(spark, monkeypatch):
    """The plans of tables that are written, before any has run; however small, none needs to be sent to everyone."""
    plans = []

    def written(df, w=fixpoint.written):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return w(df)

    for module in (bits, fixpoint, procedures, programs):
        monkeypatch.setattr(module, "written", written, raising=False)
        monkeypatch.setattr(module, "least_fixpoint", lambda *_, **__: pytest.fail("ran as tables"), raising=False)
    return plans


def _sent(plans):
    return [x for x in plans if "BroadcastHashJoin" in x]


def test_system_dependence_in_tasks(p, joins):  # noqa: F811
    found = got(programs.system_dependence(p), "src", "dst", "kind")
    assert joins and not _sent(joins)
    for g in PROGRAMS:
        assert {x for x in found[g] if x[2] == "data"} == {x for x in system(g) if x[2] == "data"}


def test_slices_in_tasks(spark, p, joins):  # noqa: F811
    goals = {g: max(PROGRAMS[g][5]) for g in PROGRAMS}
    found = got(programs.slice_of(p, spark.createDataFrame(list(goals.items()), "graph_id long, node long")), "node")
    assert joins and not _sent(joins)
    for g in PROGRAMS:
        seen, es = {str(goals[g])}, system(g)
        for kinds in (procedures.UPWARDS, procedures.DOWNWARDS):
            while more := {a for a, b, k in es if b in seen and k in kinds} - seen:
                seen |= more
        assert {x for x, in found[g]} == seen


def test_must_kill_of_all_names_at_once(p, joins, monkeypatch):  # noqa: F811
    """A graph for each name, sent or as a table, is for large programs; both ways agree."""
    with monkeypatch.context() as m:
        m.setattr(programs, "spread", lambda keys, *a, w=programs.spread, **k: w(keys, *a, **k) if keys == ("graph_id", "proc") else pytest.fail("a graph for each name"))
        found = got(programs.must_kill(p), "proc", "name")
    assert joins and not _sent(joins) and found == {g: killed(g) for g in PROGRAMS}
    everywhere = got(programs.may_keep(p), "node", "name")
    solved = bits.solved
    monkeypatch.setattr(bits, "solved", lambda rows, keys, solve, names, large, most=None: solved(rows, keys, solve, names, large, 12 if solve is programs._keeping else most))
    assert got(programs.must_kill(p), "proc", "name") == found
    assert got(programs.may_keep(p), "node", "name") == everywhere


def test_strong_definitions_arent_sent(p, joins):  # noqa: F811
    found = got(programs.strong_reaching_definitions(p), "node", "name", "origin")
    assert joins and not _sent(joins)
    # A call that must overwrite a name, its callee's last doing, is all that passes it.
    for g, (_, _, calls, defines, _, _) in PROGRAMS.items():
        must, after = killed(g), {back: call for call, back, _ in calls}
        for call, back, callee in calls:
            if not any(b == back for _, b in PROGRAMS[g][1]):
                assert {o for n, v, o in found[g] if n == back and (callee, v) in must} <= {after[back]}
