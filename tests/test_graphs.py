"""Graph operators against plain fixpoints on many random graphs at once, and known small graphs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__
from tributary.operators import control, dataflow, dominance, order, paths, slicing, structure, timing
from tributary.sources import flowgraphs as flow

K = ("graph_id",)


def random_graphs(n=60, seed=3):
    r = random.Random(seed)
    out = {}
    for g in range(n):
        size = r.randint(1, 7) if g % 10 else r.randint(12, 16)
        out[g] = (list(range(size)), {(a, b) for a in range(size) for b in range(size) if r.random() < r.choice([0.12, 0.25, 0.4]) * min(1, 6 / size) and r.random() < 0.9})
    known = {
        100: {(1, 2), (1, 3), (2, 3), (3, 2)},
        101: {(1, 2), (1, 3), (2, 4), (2, 5), (3, 5), (4, 5)},
        102: {(0, 4), (1, 2), (1, 3), (2, 3), (3, 4), (4, 1), (4, 2)},
    }
    return out | {g: (sorted({x for e in es for x in e}), es) for g, es in known.items()}


GRAPHS = random_graphs()


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(k, n) for k, (ns, _) in GRAPHS.items() for n in ns]
    edges = [(k, a, b) for k, (_, es) in GRAPHS.items() for a, b in es for _ in range(2)]
    return flow.graph(spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame(edges, "graph_id long, src long, dst long"))


def got(df, *columns):
    rows = df.select("graph_id", *columns).collect()
    assert len(rows) == len(set(rows))
    out = {k: set() for k in GRAPHS}
    for x in rows:
        out[x[0]].add(tuple(x[1:]) if len(columns) > 1 else x[1])
    return out


def every(f):
    return {k: f(ns, es) for k, (ns, es) in GRAPHS.items()}


def suc(es, n):
    return {b for a, b in es if a == n}


def reach(ns, es):
    out = {(n, n) for n in ns} | set(es)
    while True:
        more = out | {(a, d) for a, b in out for c, d in es if b == c}
        if more == out:
            return out
        out = more


def sink_nodes(ns, es):
    r = reach(ns, es)
    return {n: frozenset(m for m in ns if (n, m) in r) for n in ns if all((m, n) in r for m in ns if (n, m) in r)}


def sdom(ns, es):
    """Greatest fixpoint of D(y) = {y} ∪ ⋂ D(successors), from reachability."""
    r = reach(ns, es)
    d = {y: {x for x in ns if (y, x) in r} for y in ns}
    return _iterate(d, ns, es)


def mdom(ns, es):
    return _iterate({y: set() for y in ns}, ns, es)


def _iterate(d, ns, es):
    while True:
        new = {y: {y} | (set.intersection(*(d[x] for x in suc(es, y))) if suc(es, y) else set()) for y in ns}
        if new == d:
            return {(y, x) for y in ns for x in d[y]}
        d = new


def cd(ns, es, dom):
    d = dom(ns, es)
    return {(n, m) for n in ns for m in ns if m != n and 0 < sum((x, m) in d for x in suc(es, n)) < len(suc(es, n))}


def one(d):
    return {(z, x) for z, y in d for y2, x in d if y2 == y and x != y and (z, x) in d}


def backward(pairs, crit, triples=()):
    s = set(crit)
    while True:
        new = s | {n for n, m in pairs if m in s} | {n for m1, m2, n in triples if m1 in s and m2 in s}
        if new == s:
            return s
        s = new


def test_structure(g):
    r = structure.reach(g)
    assert got(r, "a", "b") == every(reach)
    scc = structure.components(g, r)
    assert got(scc, "node", "scc") == every(lambda ns, es: {(n, min(m for m in ns if (n, m) in reach(ns, es) and (m, n) in reach(ns, es))) for n in ns})
    assert got(structure.sinks(g, scc), "node", "sink") == every(lambda ns, es: {(n, min(s)) for n, s in sink_nodes(ns, es).items()})
    assert got(structure.reach_from(g, g.nodes.where("node = 1")), "node") == every(lambda ns, es: {b for a, b in reach(ns, es) if a == 1})

    def branch(ns, es):
        out = set()
        for n in ns:
            at, seen = n, set()
            while len(suc(es, at)) == 1 and at not in seen:
                seen.add(at)
                (at,) = suc(es, at)
            if len(suc(es, at)) > 1:
                out.add((n, at))
        return out

    assert got(structure.next_branch(g), "node", "branch") == every(branch)
    red = structure.transitive_reduction(g, r, scc)
    q = structure.quotient(g, scc.select("graph_id", "node", F.col("scc").alias("cls")))
    small = got(structure.reach(flow.FlowGraph(q.nodes, red)), "a", "b")
    assert small == got(structure.reach(q), "a", "b")
    assert got(structure.chop(r, K, g.nodes.where("node = 0"), g.nodes.where("node = 2")), "node") == every(lambda ns, es: {n for n in ns if (0, n) in reach(ns, es) and (n, 2) in reach(ns, es)})


@pytest.mark.parametrize("ours,theirs", [(dominance.sink_dominance, sdom), (dominance.max_dominance, mdom)])
def test_dominance(g, ours, theirs):
    d = ours(g)
    assert got(d, "y", "x") == every(theirs)
    assert got(dominance.one_dominance(d, K), "y", "x") == every(lambda ns, es: one(theirs(ns, es)))

    def imm(ns, es):
        dd = theirs(ns, es)
        o = one(dd)
        return {(z, x) for z, x in o if all((x, x2) in dd for z2, x2 in o if z2 == z)}

    assert got(dominance.immediate_dominance(d, K), "y", "x") == every(imm)

    def df(ns, es):
        dd = theirs(ns, es)
        return {(x, y) for x in ns for y in ns for p in suc(es, y) if (p, x) in dd and (y, x) not in one(dd)}

    assert got(dominance.frontier(g, d), "x", "y") == every(df)


def test_control_dependence(g):
    assert got(control.insensitive(g), "n", "m") == every(lambda ns, es: cd(ns, es, sdom))
    assert got(control.sensitive(g), "n", "m") == every(lambda ns, es: cd(ns, es, mdom))
    known = got(control.sensitive(g), "n", "m")
    assert known[100] == set() and known[101] == {(1, 2), (1, 3), (2, 4)} and known[102] == {(1, 2), (4, 1), (4, 2)}


def before(ns, es, dom, m1, m2, x):
    return m1 != m2 and (x, m1) in dom(ns, {e for e in es if e[0] != m2})


def od(ns, es, dom, decisive=False):
    d = dom(ns, es)
    out = set()
    for n in ns:
        s = suc(es, n)
        if len(s) > 1:
            sure = [m for m in ns if m != n and all((x, m) in d for x in s)]
            for m1 in sure:
                for m2 in sure:
                    if m1 != m2:
                        a, b = (sum(before(ns, es, dom, p, q, x) for x in s) for p, q in ((m1, m2), (m2, m1)))
                        if (a > 0 and b > 0) if decisive else 0 < a < len(s):
                            out.add((m1, m2, n))
    return out


def test_order_dependence(g):
    assert got(order.insensitive(g), "m1", "m2", "n") == every(lambda ns, es: od(ns, es, sdom))
    assert got(order.sensitive(g), "m1", "m2", "n") == every(lambda ns, es: od(ns, es, mdom))
    assert got(order.decisive(g), "m1", "m2", "n") == every(lambda ns, es: od(ns, es, mdom, True))


def test_slices(g):
    crit = g.nodes.where("node in (1, 3)")
    own = lambda ns: {n for n in ns if n in (1, 3)}
    assert got(slicing.control_slice(g, crit), "node") == every(lambda ns, es: backward(cd(ns, es, sdom), own(ns)))
    # Cutting the criterion gives the closure under control and order dependence, and so do immediate dominators.
    want = every(lambda ns, es: backward(cd(ns, es, sdom), own(ns), od(ns, es, sdom)))
    assert got(slicing.order_slice(g, crit), "node") == want
    assert got(slicing.backward(control.insensitive(g), crit, K, order.insensitive(g)), "node") == want
    assert got(slicing.by_immediate(g, crit), "node") == want
    assert got(slicing.order_slice(g, crit, control.sensitive), "node") == every(lambda ns, es: backward(cd(ns, es, mdom), own(ns), od(ns, es, mdom)))


def test_weak_closure(g):
    """The least set around the criterion outside which no node meets two of its nodes first."""
    crit = g.nodes.where("node in (1, 3)")

    def first(ns, es, s):
        cut = {e for e in es if e[0] not in s}
        r = reach(ns, cut)
        return {n: {m for m in s if (n, m) in r} for n in ns}

    def closure(ns, es):
        s = {n for n in ns if n in (1, 3)}
        while True:
            obs = first(ns, es, s)
            new = {n for n in ns if n not in s and len({frozenset(obs[x]) for x in suc(es, n) if obs[x]}) > 1}
            if not new:
                return s
            s |= new

    assert got(slicing.weak_slice(g, crit), "node") == every(closure)
    assert got(slicing.next_observable(g, crit), "node", "first") == every(lambda ns, es: {(n, m) for n, ms in first(ns, es, {x for x in ns if x in (1, 3)}).items() for m in ms})
    closed = {x.graph_id for x in slicing.weakly_closed(g, crit).where("closed").collect()}
    assert closed == {k for k, (ns, es) in GRAPHS.items() if all(len(v) <= 1 for n, v in first(ns, es, {x for x in ns if x in (1, 3)}).items() if n not in (1, 3))}


@pytest.mark.parametrize("costed", [False, True])
def test_timing(g, costed):
    cost = lambda a, b: 1 + (a * 7 + b * 3) % 32 if costed else 1

    def td(ns, es):
        t = {y: set() for y in ns}
        while True:
            new = {}
            for y in ns:
                each = [{(m, k + cost(y, x)) for m, k in t[x]} for x in suc(es, y)]
                new[y] = {(y, 0)} | ({p for p in set.intersection(*each) if p[0] != y} if each else set())
            if new == t:
                return t
            t = new

    costs = flow.edge_costs(g.edges) if costed else None
    assert got(timing.timing_dominance(g, costs), "y", "x", "steps") == every(lambda ns, es: {(y, m, k) for y, ps in td(ns, es).items() for m, k in ps})

    def dep(ns, es):
        t = td(ns, es)
        out = set()
        for n in ns:
            each = [{(m, k + cost(n, x)) for m, k in t[x]} for x in suc(es, n)]
            out |= {(n, m) for s in each for m, k in s if any((m, k) not in s2 for s2 in each)}
        return out

    assert got(timing.timing_sensitive(g, costs), "n", "m") == every(dep)


def test_dataflow(g, spark):
    names = g.nodes.select("graph_id", "node", F.concat(F.lit("v"), F.pmod("node", F.lit(2))).alias("name")).where("node <> 4")
    name = lambda n: f"v{n % 2}" if n != 4 else None

    def rd(ns, es):
        out = {(b, name(a), a) for a, b in es if name(a)}
        while True:
            new = out | {(c, v, o) for n, v, o in out for b, c in es if b == n and name(n) != v}
            if new == out:
                return out
            out = new

    r = dataflow.reaching_definitions(g, names)
    assert got(r, "node", "name", "origin") == every(rd)
    assert got(dataflow.data_dependence(r, names, K), "n", "m") == every(lambda ns, es: {(o, n) for n, v, o in rd(ns, es) if name(n) == v})
    weak = g.nodes.select("graph_id").distinct().withColumn("name", F.lit("v1"))
    free = got(dataflow.reaching_definitions(g, names, weak), "node", "name", "origin")
    assert all(free[k] >= v for k, v in got(r, "node", "name", "origin").items())


def test_balanced_reachability(g):
    mark = lambda a, b: ("(", b % 2) if b > a + 1 else (")", a % 2) if b < a else None
    kind = F.when(F.col("dst") > F.col("src") + 1, "(").when(F.col("dst") < F.col("src"), ")")
    parens = g.edges.withColumn("paren", kind).where("paren is not null").withColumn("site", F.when(F.col("paren") == "(", F.pmod("dst", F.lit(2))).otherwise(F.pmod("src", F.lit(2))))

    def balanced(ns, es):
        out = {(n, n) for n in ns} | {e for e in es if not mark(*e)}
        while True:
            new = out | {(a, d) for a, b in out for c, d in out if b == c}
            for a, b in es:
                for c, d in es:
                    if mark(a, b) and mark(c, d) and mark(a, b)[0] == "(" and mark(c, d)[0] == ")" and mark(a, b)[1] == mark(c, d)[1] and (b, c) in out:
                        new.add((a, d))
            if new == out:
                return out
            out = new

    assert got(dataflow.balanced_reach(g, parens), "a", "b") == every(balanced)


def big_graph(size=10_000, seed=5):
    """One graph of many nodes: chains with jumps on and back, cut now and then."""
    r = random.Random(seed)
    edges = set()
    for n in range(1, size + 1):
        kind = r.randrange(6)
        to = {n + 1} if kind else set()
        to |= {n + 3} if kind == 1 else {max(1, n - 2)} if kind == 2 else set()
        edges |= {(n, m) for m in to if m <= size}
    return list(range(1, size + 1)), edges


def test_one_large_graph(spark):
    ns, es = big_graph()
    g = flow.graph(spark.createDataFrame([(1, n) for n in ns], "graph_id long, node long"), spark.createDataFrame([(1, *e) for e in es], "graph_id long, src long, dst long"))
    out = {n: [] for n in ns}
    for a, b in es:
        out[a].append(b)
    d = {}
    for n in ns:  # reachable nodes, then the greatest fixpoint
        seen, todo = {n}, [n]
        while todo:
            for m in out[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        d[n] = seen
    changed = True
    while changed:
        changed = False
        for n in reversed(ns):
            new = {n} | (set.intersection(*(d[m] for m in out[n])) if out[n] else set())
            if new != d[n]:
                d[n], changed = new, True
    want = {(n, m) for n in ns for m in {x for s in out[n] for x in d[s]} if m != n and any(m not in d[s] for s in out[n])}
    assert {(x.n, x.m) for x in control.insensitive(g).collect()} == want


def test_ladder(spark):
    g = flow.ladder(spark, 2)
    edges = {(r.src, r.dst) for r in g.edges.collect()}
    assert edges == {(0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (4, 6)}
    cds = {(r.n, r.m) for r in control.insensitive(g).collect()}
    assert cds == {(0, 1), (0, 2), (0, 3), (0, 5)} - {(0, 2)} | {(0, 2)} | {(2, 3), (2, 4), (2, 5), (4, 5), (4, 6)}


def test_empty(spark):
    g = flow.graph(spark.createDataFrame([], "graph_id long, node long"), spark.createDataFrame([], "graph_id long, src long, dst long"))
    assert control.insensitive(g).count() == 0 and order.sensitive(g).count() == 0 and structure.reach(g).count() == 0


def test_graph_tables(spark, g, tmp_path):
    flow.write_graph(g, str(tmp_path / "g"), 2)
    back = flow.read_graph(spark, str(tmp_path / "g"))
    assert got(back.edges, "src", "dst") == got(g.edges, "src", "dst")


def test_words_are_composed_in_as_many_rounds_as_their_length_has_bits(spark, monkeypatch):
    """Words of 1 to 300 letters; one of another letter, one with a gap. a's, then b and at once c, then anything."""
    texts = {n: "a" * (n - 2) + "bc" for n in (2, 3, 64, 65, 300)} | {1: "b", 7: "aaabac", 8: "aaaabcab", 9: "aabbccc"}
    rows = [(w, i, c) for w, text in texts.items() for i, c in enumerate(text)] + [(90, 0, "a"), (90, 1, "b"), (90, 3, "c"), (91, 0, "a"), (91, 2, "b"), (91, 3, "c")]
    t = spark.createDataFrame([(0, 0, "only", "a"), (0, 1, "only", "b"), (1, 2, "only", "c"), (2, 3, "free", None), (3, 3, "all", None)], "src int, dst int, kind string, letter string")
    state = lambda s: spark.createDataFrame([(s,)], "state int")
    calls, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **kw: calls.append(1) or write(self, *a, **kw))
    got = paths.accepted(spark.createDataFrame(rows, "word_id long, pos int, letter string"), state(0), state(3), t)
    assert sorted(r.word_id for r in got.collect()) == [2, 3, 8, 64, 65, 300]
    assert len(calls) <= 20


def test_distances_agree_with_their_sql_on_long_ways(spark, tmp_path):
    """80 events of a user, whose ways cost more than 400, with jumps on and back; one who buys at once."""
    duckdb = pytest.importorskip("duckdb")
    kinds = ["view", "click", "signup", "error", "view", "view", "signup"]
    rows = [(1, kinds[i % 7], i) for i in range(80)] + [(2, "purchase", 100), (2, "view", 101)]
    spark.createDataFrame(rows, "user_id long, event_type string, event_id long").selectExpr("*", "timestamp_seconds(event_id) as ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = set(c.execute(__spark_entry__.oracle_sql()["distances"]).fetchall())
    assert {tuple(r) for r in __spark_entry__.queries()["distances"](spark, str(tmp_path)).collect()} == want
    assert max(w[3] for w in want) > 432
