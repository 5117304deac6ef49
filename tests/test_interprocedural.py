"""Analyses with lattices and across procedures, against plain fixpoints in Python on many random programs at once."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import dataflow, programs
from tributary.plans.fixpoint import lattice_fixpoint
from tributary.sources import flowgraphs as flow
from tributary.sources.programs import Program

NAMES = ("x", "y", "z")


def random_program(r):
    """procs {proc: (entry, exit)}, flow, calls [(call, back, callee)], defines, uses; some procedures don't end or aren't called."""
    procs, flow_, calls, defines, uses, owner = {}, set(), [], set(), set(), {}
    at, count = 0, r.randint(1, 4)
    for p in range(count):
        n = r.randint(0, 4)
        entry, exit_ = at, at + n + 1
        body = list(range(at + 1, exit_))
        procs[p] = (entry, exit_)
        owner |= dict.fromkeys(range(entry, exit_ + 1), p)
        at = exit_ + 1
        chain = [entry, *body, exit_]
        for a, b in zip(chain, chain[1:]):
            if r.random() < 0.25 and a != entry:
                back, at = at, at + 1
                owner[back] = p
                calls.append((a, back, r.randrange(count)))
                flow_.add((back, b))
                if r.random() < 0.3:
                    flow_.add((back, r.choice(chain[1:])))
            else:
                if r.random() < 0.95:
                    flow_.add((a, b))
                if r.random() < 0.4:
                    flow_.add((a, r.choice(chain[1:])))
    for n in owner:
        for v in NAMES:
            if r.random() < 0.2 and n not in {e for pair in procs.values() for e in pair}:
                defines.add((n, v))
            if r.random() < 0.2:
                uses.add((n, v))
    return procs, flow_, calls, defines, uses, owner


PROGRAMS = {k: random_program(random.Random(k)) for k in range(60)}


@pytest.fixture(scope="module")
def p(spark):
    rows = {t: [] for t in ("nodes", "edges", "procs", "defines", "uses")}
    for g, (procs, flow_, calls, defines, uses, owner) in PROGRAMS.items():
        rows["nodes"] += [(g, n, q) for n, q in owner.items()]
        rows["edges"] += [(g, a, b, "flow") for a, b in flow_] + [x for c, b, q in calls for x in ((g, c, procs[q][0], "call"), (g, procs[q][1], b, "return"), (g, c, b, "across"))]
        rows["procs"] += [(g, q, a, b) for q, (a, b) in procs.items()]
        rows["defines"] += [(g, *x) for x in defines]
        rows["uses"] += [(g, *x) for x in uses]
    kinds = {"nodes": "node long, proc long", "edges": "src long, dst long, kind string", "procs": "proc long, entry long, exit long", "defines": "node long, name string", "uses": "node long, name string"}
    return programs.cut_lineage(Program(*(spark.createDataFrame(rows[t], "graph_id long, " + kinds[t]) for t in kinds)))


def got(df, *columns):
    out = {g: set() for g in PROGRAMS}
    rows = df.select("graph_id", *columns).collect()
    assert len(rows) == len(set(rows))
    for x in rows:
        out[x[0]].add(tuple(x[1:]))
    return out


def variables(g):
    return {v for _, v in PROGRAMS[g][3] | PROGRAMS[g][4]}


def killed(g):
    """The greatest fixpoint by its definition: from all (procedure, variable), as long as some path keeps one."""
    procs, flow_, calls, defines, _, _ = PROGRAMS[g]
    now = {(q, v) for q in procs for v in variables(g)}
    while True:
        after = set()
        for q, (entry, exit_) in procs.items():
            seen, todo = {entry}, [entry]
            while todo:
                n = todo.pop()
                for m in [b for a, b in flow_ if a == n] + [b for c, b, _ in calls if c == n]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            if exit_ not in seen:
                continue
            for v in variables(g):
                kept, todo = {entry}, [entry]
                while todo:
                    n = todo.pop()
                    if (n, v) in defines:
                        continue
                    for m in [b for a, b in flow_ if a == n] + [b for c, b, z in calls if c == n and (z, v) not in now]:
                        if m not in kept:
                            kept.add(m)
                            todo.append(m)
                if exit_ not in kept or (exit_, v) in defines:
                    after.add((q, v))
        if after == now:
            return now
        now &= after


def test_must_kill(p):
    found = got(programs.must_kill(p), "proc", "name")
    want = {g: killed(g) for g in PROGRAMS}
    assert found == want and sum(map(len, want.values())) > 30


def test_strong_reaching_definitions(p):
    def brute(g):
        procs, flow_, calls, defines, _, _ = PROGRAMS[g]
        kill, v_ = killed(g), variables(g)
        out = {(e, v, e) for e, _ in procs.values() for v in v_} | {(b, v, c) for c, b, _ in calls for v in v_}
        while True:
            new = set(out)
            for a, b, callee in [(a, b, None) for a, b in flow_] + calls:
                new |= {(b, v, a) for n, v in defines if n == a and (callee, v) not in kill}
                new |= {(b, v, o) for n, v, o in out if n == a and (a, v) not in defines and (callee, v) not in kill}
            if new == out:
                return out
            out = new

    assert got(programs.strong_reaching_definitions(p), "node", "name", "origin") == {g: brute(g) for g in PROGRAMS}


def system(g):
    """Edges by kind, by reaching definitions on the flow graph with parameter nodes put in as a chain."""
    procs, flow_, calls, defines, uses, owner = PROGRAMS[g]
    v_ = sorted(variables(g))
    edges, defs, use = set(), {(str(n), v) for n, v in defines}, {(str(n), v) for n, v in uses}
    first, last = {str(n): str(n) for n in owner}, {str(n): str(n) for n in owner}  # where edges come in and leave

    def put(n, kind, key, after):
        chain = [f"{kind}:{key}:{v}" for v in v_]
        for x, v in zip(chain, v_):
            (defs if kind in ("fi", "ao") else use).add((x, v))
        edges.update(zip(chain, chain[1:]))
        if chain and after:
            edges.add((last[n], chain[0]))
            last[n] = chain[-1]
        elif chain:
            edges.add((chain[-1], first[n]))
            first[n] = chain[0]

    for q, (entry, exit_) in procs.items():
        put(str(entry), "fi", q, True)
        put(str(exit_), "fo", q, False)
    for c, b, _ in calls:
        put(str(c), "ai", c, True)
        put(str(b), "ao", c, False)
    edges |= {(last[str(a)], first[str(b)]) for a, b in flow_}
    reach = set()
    while True:
        new = reach | {(b, v, a) for a, b in edges for x, v in defs if x == a} | {(b, v, o) for a, b in edges for n, v, o in reach if n == a and (a, v) not in defs}
        if new == reach:
            break
        reach = new
    out = {(o, n, "data") for n, v, o in reach if (n, v) in use}
    for q, (entry, exit_) in procs.items():
        own = {n for n, z in owner.items() if z == q}
        body = {(a, b) for a, b in flow_ if a in own} | {(c, b) for c, b, _ in calls if c in own} | {(entry, exit_)}
        ends = {n for n in own if not any(a == n for a, _ in body)}  # each leads on to a common end

        def to_end(without):
            seen = ends - {without}
            while True:
                new = seen | {a for a, b in body if b in seen and a != without}
                if new == seen:
                    return seen
                seen = new

        live = to_end(None)
        dom = {x: {y for y in live if y not in to_end(x)} for x in live}
        for n in live:
            to = {b for a, b in body if a == n and b in live} | ({None} if n in ends else set())
            out |= {(str(n), str(m), "control") for m in live if n != m and 0 < len(to & dom[m]) < len(to)}
        out.add((str(entry), str(exit_), "control"))
    ins = {(f"ai:{c}:{v}", f"fi:{q}:{v}") for c, _, q in calls for v in v_}
    outs = {(f"fo:{q}:{v}", f"ao:{c}:{v}") for c, _, q in calls for v in v_}
    out |= {(str(c), str(procs[q][0]), "call") for c, _, q in calls} | {(*x, "in") for x in ins} | {(*x, "out") for x in outs}
    # Balanced paths: inside a procedure, over calls whose parameters go in and come out.
    same = {(n, n) for e in out for n in e[:2]} | {e[:2] for e in out if e[2] in ("data", "control")}
    summary = set()
    while True:
        new = same | {(a, d) for a, b in same for c, d in same if b == c}
        more = {(ai, ao) for ai, fi in ins for fo, ao in outs if ai.split(":")[1] == ao.split(":")[1] and (fi, fo) in new}
        if new | more == same:
            break
        same, summary = new | more, more
    return out | {(*x, "summary") for x in summary}


def test_system_dependence(p):
    found = got(programs.system_dependence(p), "src", "dst", "kind")
    want = {g: system(g) for g in PROGRAMS}
    assert found == want and sum(e[2] == "summary" for es in want.values() for e in es) > 30


def test_program_slices(spark, p):
    """By paths whose parameters come out only to the call that they went in by: first up into callers, then down."""
    goals = {g: max(PROGRAMS[g][5]) for g in PROGRAMS}
    found = got(programs.program_slice(programs.system_dependence(p), spark.createDataFrame(list(goals.items()), "graph_id long, node long")), "node")
    for g in PROGRAMS:
        es = system(g)

        def back(seen, kinds):
            while True:
                new = seen | {a for a, b, k in es if b in seen and k in kinds}
                if new == seen:
                    return seen
                seen = new

        up = back({str(goals[g])}, {"data", "control", "summary", "call", "in"})
        assert {x for x, in found[g]} == back(up, {"data", "control", "summary", "out"})


@pytest.fixture(scope="module")
def graphs(spark):
    r = random.Random(9)
    out = {g: {(a, b, r.randrange(6)) for a in range(n) for b in range(n) if r.random() < 0.25} for g, n in ((g, r.randint(1, 8)) for g in range(100))}
    nodes = [(g, n) for g in out for n in range(8)]
    df = flow.FlowGraph(spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame([(g, *e) for g, es in out.items() for e in es], "graph_id long, src long, dst long, bit int"))
    return out, df


def test_analyses_of_five_lattices_in_one_run(graphs):
    edges, g = graphs
    start = g.nodes.where("node = 0")
    bit = F.expr("shiftleft(1L, bit)")
    one = start.withColumn("value", F.lit(0))
    out = dataflow.analysis(
        g,
        some=dataflow.Analysis(dataflow.SOME, lambda v: v.bitwiseOR(bit)),
        every=dataflow.Analysis(dataflow.EVERY, lambda v: v.bitwiseOR(bit), one),
        high=dataflow.Analysis(dataflow.HIGHEST, lambda v: F.when(F.col("bit") == 5, F.lit(0)).otherwise(F.greatest(v, F.col("bit")))),
        near=dataflow.Analysis(dataflow.NEAREST, lambda v: v + F.col("bit") + 1, one),
        sets=dataflow.Analysis(dataflow.UNION, lambda v: F.array_union(v, F.array(F.col("bit").cast("long")))),
    )
    found = {(x.graph_id, x.node): (x.some, x.every, x.high, x.near, set(x.sets)) for x in out.collect()}

    def brute(es):
        now = {n: (0, 0 if n == 0 else -1, 0, 0 if n == 0 else None, set()) for n in range(8)}
        while True:
            new = dict(now)
            for a, b, k in es:
                s, e, h, d, u = now[a]
                t = (s | 1 << k, e | 1 << k, 0 if k == 5 else max(h, k), None if d is None else d + k + 1, u | {k})
                o = new[b]
                new[b] = (o[0] | t[0], o[1] & t[1], max(o[2], t[2]), min((x for x in (o[3], t[3]) if x is not None), default=None), o[4] | t[4])
            if new == now:
                return now
            now = new

    assert found == {(g_, n): v for g_, es in edges.items() for n, v in brute(es).items()}


def test_rows_of_a_lattice_are_replaced_and_put_together(spark):
    """A long chain: more rounds than versions that are kept."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    seed = spark.createDataFrame([(i, 0) for i in range(71)], "a long, v long")
    out = lattice_fixpoint(seed, lambda d: d.join(edges, "a").select(F.col("b").alias("a"), (F.col("v") + 1).alias("v")), {"v": lambda c: F.max(c)}, hops=2)
    assert {(x.a, x.v) for x in out.collect()} == {(i, i) for i in range(71)}
