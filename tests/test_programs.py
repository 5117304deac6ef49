"""Threads, procedures, paths and automata against plain fixpoints on random graphs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_graphs import GRAPHS, K, every, got, reach, suc

from tributary.operators import classification, dataflow, paths, procedures, structure, threads, timing
from tributary.sources import flowgraphs as flow


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(k, n) for k, (ns, _) in GRAPHS.items() for n in ns]
    edges = [(k, a, b) for k, (_, es) in GRAPHS.items() for a, b in es]
    return flow.graph(spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame(edges, "graph_id long, src long, dst long"))


def spawn(a, b):
    return b == a + 2


def thread_map(ns, es):
    out = {(0, 0)} if 0 in ns else set()
    while True:
        new = out | {(b, b if spawn(a, b) else t) for n, t in out for a, b in es if a == n}
        if new == out:
            return out
        out = new


def apart(ns, es):
    r = reach(ns, es)
    left = {(x, y) for n, a in es if spawn(n, a) for b in suc(es, n) if not spawn(n, b) for a2, x in r if a2 == a for b2, y in r if b2 == b}
    return left | {(b, a) for a, b in left}


def mhp(ns, es):
    t = thread_map(ns, es)
    r = reach(ns, es)
    live = {n for n, _ in t}
    many = {b for a, b in es if spawn(a, b) and a in live and (any(m != a and (a, m) in r and (m, a) in r for m in ns) or sum(d == b for _, d in es) > 1)}
    while True:
        new = many | {b for a, b in es if a in many}
        if new == many:
            break
        many = new
    of = {n: {x for m, x in t if m == n} for n in ns}
    same = {(a, b) for a in ns for b in ns if of[a] == of[b] and len(of[a]) == 1}
    return {p for p in same if p[0] in many} | (apart(ns, es) - same)


def test_threads(g):
    spawns, entry = g.edges.where("dst = src + 2"), g.nodes.where("node = 0")
    assert got(threads.threads_of(g, spawns, entry), "node", "thread") == every(thread_map)
    assert got(threads.spawned_apart(g, spawns), "a", "b") == every(apart)
    pairs = threads.parallel(g, spawns, entry)
    assert got(pairs, "a", "b") == every(mhp)
    names = g.nodes.select("graph_id", "node", F.pmod("node", F.lit(2)).cast("string").alias("name"))
    uses = g.nodes.select("graph_id", "node", F.pmod("node", F.lit(3)).cast("string").alias("name"))
    assert got(threads.between_threads(pairs, names, uses, K), "n", "m") == every(lambda ns, es: {(a, b) for a, b in mhp(ns, es) if a % 2 == b % 3})
    assert got(threads.conflicts(pairs, names, uses, K), "n", "m") == every(lambda ns, es: {(a, b) for a, b in mhp(ns, es) if a % 2 in (b % 3, b % 2)})


def test_two_phases(g):
    kinds = ["control", "data", "call", "summary", "spawn", "threads", "in", "out"]
    of = lambda a, b: kinds[(3 * a + b) % 8]
    edges = g.edges.withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(3 * F.col("src") + F.col("dst"), F.lit(8)) + 1).cast("int")))

    def back(es, s, allowed):
        while True:
            new = s | {a for a, b in es if b in s and of(a, b) in allowed}
            if new == s:
                return s
            s = new

    want = every(lambda ns, es: back(es, back(es, {n for n in ns if n == 3}, procedures.UPWARDS), procedures.DOWNWARDS))
    assert got(procedures.two_phase(edges, g.nodes.where("node = 3"), K), "node") == want


def test_summary_edges(spark):
    """A call of a procedure whose input reaches its output, through a call of another."""
    rows = [(0, 10, 11, "data"), (0, 20, 21, "data"), (0, 12, 13, "control"), (0, 1, 2, "data")]
    edges = spark.createDataFrame(rows, "graph_id long, src long, dst long, kind string")
    # Procedure P: formal-in 10 → 11, an actual-in of call c2; 12 is its actual-out → formal-out 13. Procedure Q: 20 → 21. Call c1 of P: 2, 3.
    ins = spark.createDataFrame([(0, 2, 10, 1), (0, 11, 20, 2)], "graph_id long, actual long, formal long, call long")
    outs = spark.createDataFrame([(0, 3, 13, 1), (0, 12, 21, 2), (0, 99, 13, 3)], "graph_id long, actual long, formal long, call long")
    found = {(r.src, r.dst) for r in procedures.summary_edges(edges, ins, outs, K).collect()}
    assert found == {(11, 12), (2, 3)}
    assert procedures.with_summaries(edges, ins, outs, K).count() == 6


def test_balanced_chop(spark):
    """main: 1 -(a→ 10 -> 11 -a)→ 2 -(b→ 10, 11 -b)→ 3; chops don't leave by the other call's return."""
    edges = [(1, 10), (10, 11), (11, 2), (2, 10), (11, 3), (3, 4)]
    g = flow.graph(spark.createDataFrame([(0, n) for n in {x for e in edges for x in e}], "graph_id long, node long"), spark.createDataFrame([(0, *e) for e in edges], "graph_id long, src long, dst long"))
    parens = spark.createDataFrame([(0, 1, 10, "(", 1), (0, 11, 2, ")", 1), (0, 2, 10, "(", 2), (0, 11, 3, ")", 2)], "graph_id long, src long, dst long, paren string, site int")
    balanced = dataflow.balanced_reach(g, parens)
    assert {(r.a, r.b) for r in balanced.where("a <> b").collect()} == {(10, 11), (1, 2), (2, 3), (3, 4), (1, 3), (1, 4), (2, 4)}
    at = lambda n: g.nodes.where(F.col("node") == n)
    chop = lambda s, t: {r.node for r in procedures.balanced_chop(g, parens, balanced, at(s), at(t)).collect()}
    assert chop(1, 2) == {1, 10, 11, 2} and chop(1, 4) == {1, 2, 3, 4, 10, 11} and chop(3, 4) == {3, 4} and chop(4, 1) == set()
    assert chop(10, 2) == {10, 11, 2} and chop(2, 11) == {2, 10, 11}


def test_paths(g):
    cost = lambda a, b: 1 + (a * 7 + b * 3) % 32

    def dist(ns, es):
        d = {0: 0} if 0 in ns else {}
        for _ in ns:
            for a, b in es:
                if a in d:
                    d[b] = min(d.get(b, 10**9), d[a] + cost(a, b))
        return set(d.items())

    assert got(paths.distances(g, flow.edge_costs(g.edges), g.nodes.where("node = 0")), "node", "distance") == every(dist)

    def walks(ns, es):
        out = {(0, 0)} if 0 in ns else set()
        for k in range(3):
            out |= {(b, k + 1) for n, s in out if s == k for a, b in es if a == n}
        return out

    assert got(paths.within(g, g.nodes.where("node = 0"), 3), "node", "steps") == every(walks)
    parents = g.edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.min("dst").alias("parent"))

    def root(ns, es):
        up, out = {n: min(suc(es, n)) for n in ns if suc(es, n)}, set()
        for n in up:
            at, d = n, 0
            while at in up and d <= len(ns):
                at, d = up[at], d + 1
            if at not in up:
                out.add((n, at, d))
        return out

    assert got(paths.roots(parents, K), "node", "root", "depth") == every(root)


def test_automaton(spark):
    r = random.Random(2)
    words = {i: "".join(r.choice("abc") for _ in range(r.randint(1, 9))) for i in range(80)}
    rows = [(i, p, x) for i, w in words.items() for p, x in enumerate(w)]
    t = spark.createDataFrame([(0, 0, "all", None), (0, 1, "only", "a"), (1, 2, "free", None), (2, 2, "only", "b"), (2, 3, "only", "c")], "src int, dst int, kind string, letter string")
    state = lambda *s: spark.createDataFrame([(x,) for x in s], "state int")
    got_ = {x.word_id for x in paths.accepted(spark.createDataFrame(rows, "word_id int, pos int, letter string"), state(0), state(3), t).collect()}
    assert got_ == {i for i, w in words.items() if re.fullmatch("[abc]*ab*c", w)}


def test_reducing_cycles(g):
    pairs = structure.reach(g).select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    assert structure.is_transitive(pairs, K).where("not transitive").count() == 0


def test_timing_dependence(g):
    def timdom(ns, es):
        t = {y: {(y, 0)} for y in ns}
        while True:
            new = {}
            for y in ns:
                each = [{(m, k + 1) for m, k in t[x]} for x in suc(es, y)]
                new[y] = {(y, 0)} | ({p for p in set.intersection(*each) if p[0] != y} if each else set())
            if new == t:
                return t
            t = new

    def dep(ns, es):
        r, out = reach(ns, es), set()
        for m in ns:
            to = [n for n in ns if (n, m) in r]
            t = timdom(to, {(a, b) for a, b in es if a in to and b in to and a != m})
            out |= {(n, m) for n in to if n != m and all(x == n for x, _ in t[n])}
        return out

    assert got(timing.dependence(g), "n", "m") == every(dep)


def test_common_dominators_and_classes(g):
    """Of pairs n, n + 1 as if parallel: the nearest common dominator from node 0 that is parallel to neither."""
    entry = g.nodes.where("node = 0")
    pairs = lambda ns: {(a, b) for a in ns for b in ns if abs(a - b) == 1}
    x, y = g.nodes.withColumnRenamed("node", "a"), g.nodes.withColumnRenamed("node", "b")
    mhp = x.join(y, "graph_id").where("abs(a - b) = 1")

    def doms(ns, es):
        live = {b for a, b in reach(ns, es) if a == 0 and 0 in ns}
        return {n: {x for x in live if x == n or (0, n) not in reach([v for v in ns if v != x], {e for e in es if x not in e}) or x == 0} for n in live}

    def common(ns, es):
        d, out = doms(ns, es), {}
        for a, b in pairs(ns):
            if a in d and b in d:
                ok = [c for c in d[a] & d[b] if (c, a) not in pairs(ns) and (c, b) not in pairs(ns)]
                if ok:
                    out[a, b] = max(ok, key=lambda c: len(d[c]))
        return {(a, b, c) for (a, b), c in out.items()}

    c = classification.common_dominators(classification.dominators(g, entry), mhp, K)
    assert got(c, "a", "b", "dom") == every(common)
    deps = g.edges.select("graph_id", F.col("src").alias("n"), F.col("dst").alias("m")).where("m > n + 1")
    high = g.nodes.where("node = 1")

    def minimal(ns, es):
        r, s = reach(ns, es), {n for n in ns if n == 1}
        edges = {(a, b) for a, b in es if b > a + 1} | {(x, a) for a, _, c in common(ns, es) for x in ns if (c, x) in r and (x, a) in r}
        while True:
            new = s | {b for a, b in edges if a in s}
            if new == s:
                return s
            s = new

    assert got(classification.minimal(deps, c, structure.reach(g), high, K), "node") == every(minimal)
    low = g.nodes.where("node = 3")

    def secure(ns, es):
        s = {n for n in ns if n in (1, 5)}
        while (new := s | {b for a, b in es if b > a + 1 and a in s}) != s:
            s = new
        return 3 not in ns or (3 not in s)

    got_ = {r.graph_id: r.secure for r in classification.low_security(g, deps, mhp, g.nodes.where("node = 5"), high, low).collect()}
    assert got_ == every(secure)


def test_balanced_chop_in_tasks(spark, monkeypatch):
    """Random graphs with calls of calls: chopped inside tasks without tables of pairs, and the same as by tables."""
    r = random.Random(11)
    nodes, edges, parens = [], [], []
    for k in range(6):
        nodes += [(k, n) for n in range(9)]
        for a, b in sorted({(r.randrange(9), r.randrange(9)) for _ in range(13)}):
            edges.append((k, a, b))
            paren = r.choice(["", "(", ")"])
            if paren:
                parens.append((k, a, b, paren, r.randrange(2)))
    g = flow.graph(spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame(edges, "graph_id long, src long, dst long"))
    marks = spark.createDataFrame(parens, "graph_id long, src long, dst long, paren string, site int")
    chop = lambda: {tuple(x) for x in procedures.balanced_chop(g, marks, dataflow.balanced_reach, g.nodes.where("node < 3"), g.nodes.where("node > 5")).collect()}
    with monkeypatch.context() as m:
        m.setattr(procedures, "least_fixpoint", lambda *_: pytest.fail("ran as tables"))
        m.setattr(procedures, "SPLIT", 3)
        found = chop()
    monkeypatch.setattr(procedures, "MOST_CHOP", 1)
    assert found == chop() and found
