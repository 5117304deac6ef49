"""Matched calls and returns, saturation, automata, weak order dependence and reducibility, against plain loops on random graphs."""

import itertools
import random

import pytest

from tributary.operators import automata, balanced, dataflow, order, slicing, structure
from tributary.sources import flowgraphs as flow

K = ("graph_id",)


def random_graph(r):
    n = r.randint(1, 6)
    edges = {(a, b) for a in range(n) for b in range(n) if r.random() < 0.3}
    return n, edges, {e: (r.choice("()"), r.randrange(2)) for e in edges if r.random() < 0.5}


GRAPHS = {k: random_graph(random.Random(k)) for k in range(80)}
GRAPHS[100] = (8, {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 2), (3, 6), (6, 7)}, {(0, 1): ("(", 0), (1, 2): ("(", 1), (3, 4): (")", 1), (5, 2): ("(", 2), (3, 6): (")", 2), (6, 7): (")", 0)})


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(k, v) for k, (n, _, _) in GRAPHS.items() for v in range(n)]
    return flow.graph(spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame([(k, *e) for k, (_, es, _) in GRAPHS.items() for e in es], "graph_id long, src long, dst long"))


@pytest.fixture(scope="module")
def parens(spark):
    return spark.createDataFrame([(k, *e, *m) for k, (_, _, ms) in GRAPHS.items() for e, m in ms.items()], "graph_id long, src long, dst long, paren string, site long")


def got(df, *columns):
    rows = df.select("graph_id", *columns).collect()
    assert len(rows) == len(set(rows))
    out = {k: set() for k in GRAPHS}
    for x in rows:
        out[x[0]].add(tuple(x[1:]))
    return out


def closed(pairs, nodes):
    out = {(n, n) for n in nodes} | set(pairs)
    while True:
        new = out | {(a, d) for a, b in out for c, d in out if b == c}
        if new == out:
            return out
        out = new


def classes(pairs):
    return {a: min(b for c, b in pairs if c == a and (b, a) in pairs) for a, _ in pairs}


def test_same_level_components(g, parens):
    def brute(n, es, ms):
        out = {(v, v) for v in range(n)} | {e for e in es if e not in ms}
        while True:
            new = out | {(a, d) for a, b in out for c, d in out if b == c}
            new |= {(a, d) for (a, x), (p, s) in ms.items() if p == "(" for (y, d), (q, t) in ms.items() if q == ")" and s == t and (x, y) in out}
            if new == out:
                return set(classes(out).items())
            out = new

    found = got(balanced.same_level_components(dataflow.balanced_reach(g, parens), K), "node", "scc")
    assert found == {k: brute(*v) for k, v in GRAPHS.items()}


def test_two_pass_folding(g, parens):
    table, folded = balanced.two_pass_folding(g, parens)
    found, edges = got(table, "node", "first", "cls"), got(folded.edges, "src", "dst")
    for k, (n, es, ms) in GRAPHS.items():
        first = classes(closed({e for e in es if ms.get(e, "(")[0] == "("}, range(n)))
        second = classes(closed({(first[a], first[b]) for a, b in es if ms.get((a, b), ")")[0] == ")"}, set(first.values())))
        assert found[k] == {(v, first[v], second[first[v]]) for v in range(n)}
        of = {v: second[first[v]] for v in range(n)}
        assert edges[k] == {(of[a], of[b]) for a, b in es if of[a] != of[b]}


def test_valid_dominance(spark, g, parens):
    """The greatest solution, from above."""
    dom = balanced.valid_dominance(g, parens, g.nodes.where("node = 0"))
    found, short = got(dom, "y", "x"), got(balanced.reduced(dom, K), "y", "x")
    for k, (n, es, ms) in GRAPHS.items():
        calls = {s: {a for (a, _), (p, t) in ms.items() if p == "(" and t == s} for s in range(3)}
        now = {v: set(range(n)) if v else {0} for v in range(n)}
        while True:
            new = {0: {0}}
            for v in range(1, n):
                ways = []
                for a, b in es:
                    if b == v:
                        p, s = ms.get((a, b), ("", 0))
                        ways.append(now[a].union(*(now[c] for c in calls[s])) if p == ")" else now[a])
                new[v] = {v} | (set.intersection(*ways) if ways else set(range(n)))
            if new == now:
                break
            now = new
        assert found[k] == {(v, x) for v in now for x in now[v]}, k
        pairs = {(v, x) for v in now for x in now[v] if x != v}
        assert short[k] == {(v, x) for v, x in pairs if not any((v, j) in pairs and (j, x) in pairs and x != v for j in now)}


def test_saturation_accepts_what_leads_to_it(spark):
    """All stacks of up to three nodes, by steps with stacks of up to eight."""
    rules, want = [], {}
    for k in range(12):
        r = random.Random(k)
        nodes = range(6)
        plain = {(a, b) for a in range(3) for b in nodes if r.random() < 0.3}
        calls = {(a, r.randrange(6), r.randrange(6)) for a in (3, 4) if r.random() < 0.8}
        exits = {x for x in (4, 5) if r.random() < 0.7}
        goal = r.randrange(6)
        rules.append((k, plain, calls, exits, goal))

        def leads(stack, plain=plain, calls=calls, exits=exits, goal=goal):
            seen, todo = {stack}, [stack]
            while todo:
                s = todo.pop()
                if s and s[0] == goal:
                    return True
                if not s:
                    continue
                after = [(b, *s[1:]) for a, b in plain if a == s[0]] + [(e, b, *s[1:]) for a, e, b in calls if a == s[0]] + ([s[1:]] if s[0] in exits else [])
                for t in after:
                    if len(t) <= 8 and t not in seen:
                        seen.add(t)
                        todo.append(t)
            return False

        want[k] = {s for size in (1, 2, 3) for s in itertools.product(nodes, repeat=size) if leads(s)}
    table = lambda rows, s: spark.createDataFrame(rows, "graph_id long, " + s)
    start = [(k, 0, goal, 1) for k, *_, goal in rules] + [(k, 1, v, 1) for k, *_ in rules for v in range(6)]
    out = balanced.pre_star(
        table([(k, *e) for k, p, *_ in rules for e in p], "node long, next long"), table([(k, *c) for k, _, cs, *_ in rules for c in cs], "node long, entry long, back long"),
        table([(k, x) for k, _, _, xs, _ in rules for x in xs], "node long"), table(start, "src long, symbol long, dst long"), K,
    )
    edges = {}
    for x in out.collect():
        edges.setdefault((x.graph_id, x.src, x.symbol), set()).add(x.dst)

    def accepts(k, stack):
        at = {0}
        for v in stack:
            at = set().union(*(edges.get((k, s, v), set()) for s in at))
        return 1 in at

    for k in want:
        assert {s for size in (1, 2, 3) for s in itertools.product(range(6), repeat=size) if accepts(k, s)} == want[k], k


def random_automaton(r):
    n = r.randint(1, 4)
    t = {(a, b, k, r.choice("xy") if k == "only" else None) for a in range(n) for b in range(n) if r.random() < 0.4 for k in [r.choice(["all", "only", "only", "free"])]}
    return {s for s in range(n) if r.random() < 0.5}, {s for s in range(n) if r.random() < 0.5}, t


def words_of(initial, final, t, most=4):
    def close(states):
        while True:
            new = states | {b for a, b, k, _ in t if a in states and k == "free"}
            if new == states:
                return states
            states = new

    out = set()
    for size in range(most + 1):
        for w in itertools.product("xy", repeat=size):
            at = close(set(initial))
            for c in w:
                at = close({b for a, b, k, x in t if a in at and (k == "all" or x == c)})
            if at & set(final):
                out.add(w)
    return out


def test_product_and_trimming(spark):
    pairs = {k: (random_automaton(random.Random(k)), random_automaton(random.Random(1000 + k))) for k in range(60)}

    def tables(i):
        rows = lambda f: [(k, *x) for k, p in pairs.items() for x in f(p[i])]
        states = "graph_id long, state long"
        return automata.Automata(
            spark.createDataFrame(rows(lambda a: {(s,) for s in a[0]}), states), spark.createDataFrame(rows(lambda a: {(s,) for s in a[1]}), states),
            spark.createDataFrame(rows(lambda a: a[2]), "graph_id long, src long, dst long, kind string, letter string"),
        )

    both = automata.product(tables(0), tables(1))
    short = automata.trimmed(both)
    for x in (both, short):
        parts = [{k: set() for k in pairs} for _ in range(3)]
        for part, df in zip(parts, (x.initial, x.final, x.transitions)):
            for row in df.collect():
                part[row.graph_id].add(tuple(row[1:]))
        for k, (a, b) in pairs.items():
            start, end, t = ({s for s, in parts[0][k]}, {s for s, in parts[1][k]}, parts[2][k])
            assert words_of(start, end, t) == words_of(*a) & words_of(*b)
            if x is short:
                ends = closed({e[:2] for e in t}, {s for e in t for s in e[:2]} | start | end)
                assert all(any((s, e[0]) in ends for s in start) and any((e[1], f) in ends for f in end) for e in t)


def dominated(n, es, x):
    """Nodes from which every maximal path meets x."""
    out = {x}
    while True:
        new = out | {v for v in range(n) if (to := {b for a, b in es if a == v}) and to <= out}
        if new == out:
            return out
        out = new


def weak_triples(n, es, after):
    cut = {c: {e for e in es if e[0] != c} for c in range(n)}
    may = {(v, m1, m2) for m2 in range(n) for v, m1 in closed(cut[m2], range(n)) if m1 != m2}
    out = set()
    for p in range(n):
        to = {b for a, b in es if a == p}
        for m1, m2 in itertools.permutations(range(n), 2):
            if len(to) > 1 and (p, m1, m2) in may and (p, m2, m1) in may and any(after(x, m1, m2, cut) or after(x, m2, m1, cut) for x in to):
                out.add((m1, m2, p))
    return out


def test_weak_order_dependence(g):
    found = got(order.weak(g), "m1", "m2", "n")
    assert found == {k: weak_triples(n, es, lambda x, a, b, cut: x in dominated(n, cut[b], a)) for k, (n, es, _) in GRAPHS.items()}


def test_weak_order_dependence_by_reachability_gives_the_weak_slices(spark, g):
    triples = got(order.weak_reachable(g), "m1", "m2", "n")
    for k, (n, es, _) in GRAPHS.items():
        reach = closed(es, range(n))
        assert triples[k] == weak_triples(n, es, lambda x, a, b, cut: (x, a) in reach and (x, b) not in closed(cut[a], range(n)))
    goals = {k: set(random.Random(k).sample(range(n), min(n, 2))) for k, (n, _, _) in GRAPHS.items()}
    slices = got(slicing.weak_slice(g, spark.createDataFrame([(k, v) for k, vs in goals.items() for v in vs], "graph_id long, node long")), "node")
    for k, vs in goals.items():
        out = set(vs)
        while True:
            new = out | {p for a, b, p in triples[k] if a in out and b in out}
            if new == out:
                break
            out = new
        assert {v for v, in slices[k]} == out


def test_reducible(g):
    found = {x.graph_id: (x.left, x.reducible) for x in structure.reducible(g, g.nodes.where("node = 0")).collect()}

    def brute(n, es):
        live = {b for a, b in closed(es, range(n)) if a == 0}
        es = {e for e in es if set(e) <= live}
        while True:
            es = {(a, b) for a, b in es if a != b}
            one = next((v for v in sorted(live) if v and len({a for a, b in es if b == v}) == 1), None)
            if one is None:
                return len(live), len(live) == 1
            into = next(a for a, b in es if b == one)
            es = {tuple(into if v == one else v for v in e) for e in es}
            live -= {one}

    want = {k: brute(n, es) for k, (n, es, _) in GRAPHS.items()}
    assert found == want and len({v[1] for v in want.values()}) == 2


@pytest.mark.parametrize("most", [4096, 30, 0])
def test_valid_dominance_in_tasks(g, parens, spark, most, monkeypatch):
    """Small graphs take no rounds of tables, large ones do; all agree. Marks may stand on no edge, twice on one, or have no site."""
    odd = parens.union(spark.createDataFrame([(0, 0, 1, "(", None), (1, 0, 1, ")", None), (2, 1, 2, None, 1), (3, 7, 8, "(", 0), (4, 8, 7, ")", 1)], parens.schema))
    odd = odd.union(parens.where("src % 3 = 0").select("graph_id", "src", "dst", balanced.F.translate("paren", "()", ")(").alias("paren"), "site"))
    start = g.nodes.where("node = 0")
    want = [got(balanced._valid_by_tables(g, marks, start), "y", "x") for marks in (parens, odd)]
    assert want[0] != want[1]
    monkeypatch.setattr(balanced.bits, "MOST", most)
    if most == 4096:
        monkeypatch.setattr(balanced, "_valid_by_tables", lambda *_: pytest.fail("ran as tables"))
    assert want == [got(balanced.valid_dominance(g, marks, start), "y", "x") for marks in (parens, odd)]
