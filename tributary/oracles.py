"""DuckDB SQL for the graph queries: the definitions stated plainly, over all pairs and triples."""

from __future__ import annotations

EVENTS = """
en AS (SELECT user_id AS graph_id, event_type AS event, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS node FROM events),
mx AS (SELECT graph_id, max(node) AS last FROM en GROUP BY graph_id),
e0 AS (SELECT graph_id, node AS src, node + 1 AS dst FROM en WHERE event <> 'purchase'
       UNION SELECT graph_id, node, node + 3 FROM en WHERE event = 'click'
       UNION SELECT graph_id, node, greatest(node - 2, 1) FROM en WHERE event = 'error'),
n AS (SELECT graph_id, node FROM en),
e AS (SELECT DISTINCT graph_id, src, dst FROM e0 JOIN mx USING (graph_id) WHERE dst <= last)"""

ORDERS = """
ln AS (SELECT l_orderkey AS graph_id, l_returnflag AS flag,
              CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS node FROM lineitem),
mx AS (SELECT graph_id, max(node) AS last FROM ln GROUP BY graph_id),
e0 AS (SELECT graph_id, node AS src, node + 1 AS dst FROM ln
       UNION SELECT graph_id, node, greatest(node - 1, 1) FROM ln WHERE flag = 'R'
       UNION SELECT graph_id, node, node + 2 FROM ln WHERE flag = 'A'),
n AS (SELECT graph_id, node FROM ln),
e AS (SELECT DISTINCT graph_id, src, dst FROM e0 JOIN mx USING (graph_id) WHERE dst <= last)"""

NAMES = """
defs AS (SELECT graph_id, node, event AS name FROM en),
uses AS (SELECT graph_id, node, name FROM (SELECT graph_id, node, lag(event) OVER (PARTITION BY graph_id ORDER BY node) AS name FROM en) WHERE name IS NOT NULL),
rd AS (SELECT graph_id, dst AS node, name, src AS origin FROM defs JOIN (SELECT graph_id, src AS node, src, dst FROM e) USING (graph_id, node)
       UNION SELECT graph_id, dst, name, origin FROM (SELECT * FROM rd ANTI JOIN defs USING (graph_id, node, name)) JOIN (SELECT graph_id, src AS node, dst FROM e) USING (graph_id, node)),
dd AS (SELECT DISTINCT graph_id, origin AS n, node AS m FROM rd JOIN uses USING (graph_id, node, name))"""


def closure(p: str = "", nodes: str = "n", edges: str = "e", k: str = "graph_id") -> str:
    """Reachability, components, sinks and out-degrees, their names beginning with p."""
    return f"""
{p}r AS (SELECT {k}, node AS a, node AS b FROM {nodes} UNION SELECT {k}, a, dst FROM {p}r JOIN (SELECT {k}, src AS b, dst FROM {edges}) USING ({k}, b)),
{p}scc AS (SELECT {k}, a AS node, min(b) AS scc, count(*) AS size FROM {p}r JOIN (SELECT {k}, a AS b, b AS a FROM {p}r) USING ({k}, a, b) GROUP BY {k}, a),
{p}leave AS (SELECT DISTINCT {k}, scc FROM {edges} JOIN (SELECT {k}, node AS src, scc FROM {p}scc) USING ({k}, src) JOIN (SELECT {k}, node AS dst, scc AS other FROM {p}scc) USING ({k}, dst) WHERE scc <> other),
{p}sink AS (SELECT {k}, node, scc AS sink FROM {p}scc ANTI JOIN {p}leave USING ({k}, scc)),
{p}deg AS (SELECT {k}, src AS node, count(*) AS outdegree FROM {edges} GROUP BY {k}, src)"""


def dominance(p: str = "", nodes: str = "n", edges: str = "e", k: str = "graph_id") -> str:
    """sdom and mdom (y, x): by what is reachable around x."""
    return f"""{closure(p, nodes, edges, k)},
{p}av AS (SELECT {k}, x, y, y AS b FROM (SELECT {k}, node AS x FROM {nodes}) JOIN (SELECT {k}, node AS y FROM {nodes}) USING ({k}) WHERE x <> y
          UNION SELECT {k}, x, y, dst FROM {p}av JOIN (SELECT {k}, src AS b, dst FROM {edges}) USING ({k}, b) WHERE dst <> x),
{p}sbad AS (SELECT DISTINCT {k}, x, y FROM {p}av JOIN (SELECT {k}, node AS b, sink FROM {p}sink) USING ({k}, b) LEFT JOIN (SELECT {k}, node AS x, sink AS own FROM {p}sink) USING ({k}, x) WHERE own IS DISTINCT FROM sink),
{p}sdom AS (SELECT {k}, y, x FROM (SELECT {k}, a AS y, b AS x FROM {p}r) ANTI JOIN {p}sbad USING ({k}, x, y)),
{p}turn AS (SELECT {k}, x, b FROM (SELECT {k}, x, y AS c, b FROM {p}av) JOIN (SELECT {k}, src AS b, dst AS c FROM {edges}) USING ({k}, b, c)
            UNION SELECT {k}, x, y AS b FROM {p}av ANTI JOIN (SELECT {k}, node AS y FROM {p}deg) USING ({k}, y)),
{p}mbad AS (SELECT DISTINCT {k}, x, y FROM {p}av JOIN {p}turn USING ({k}, x, b)),
{p}mdom AS (SELECT {k}, y, x FROM (SELECT {k}, node AS x FROM {nodes}) JOIN (SELECT {k}, node AS y FROM {nodes}) USING ({k}) ANTI JOIN {p}mbad USING ({k}, x, y))"""


def cd(name: str, dom: str, p: str = "", edges: str = "e", k: str = "graph_id") -> str:
    return f"""
{name} AS MATERIALIZED (SELECT DISTINCT {k}, n, m FROM (SELECT {k}, src AS n, x AS m, count(*) AS hit FROM {edges} JOIN (SELECT {k}, y AS dst, x FROM {dom}) USING ({k}, dst) GROUP BY {k}, src, x)
           JOIN (SELECT {k}, node AS n, outdegree FROM {p}deg) USING ({k}, n) WHERE hit < outdegree AND n <> m)"""


def immediate(dom: str) -> str:
    return f"""
one AS (SELECT DISTINCT graph_id, a.y, b.x FROM {dom} a JOIN (SELECT graph_id, y AS m, x FROM {dom}) b USING (graph_id) WHERE a.x = b.m AND b.x <> b.m AND EXISTS (SELECT 1 FROM {dom} c WHERE c.graph_id = a.graph_id AND c.y = a.y AND c.x = b.x)),
imm AS (SELECT * FROM one o WHERE NOT EXISTS (SELECT 1 FROM one p WHERE p.graph_id = o.graph_id AND p.y = o.y AND NOT EXISTS (SELECT 1 FROM {dom} c WHERE c.graph_id = o.graph_id AND c.y = o.x AND c.x = p.x)))"""


def slice_(pairs: str, criterion: str, name: str = "sl") -> str:
    return f"""
{name} AS (SELECT graph_id, node FROM {criterion} UNION SELECT graph_id, n FROM {name} JOIN (SELECT graph_id, n, m AS node FROM {pairs}) USING (graph_id, node))"""


def ordered(dom: str) -> str:
    """cnt (n, m1, m2, outdegree, first): of each branch whose successors m1 and m2 dominate, the successors that see m1 first:
    those from which m1 dominates in the graph without the edges that leave m2."""
    k = "graph_id, m2"
    return f"""{dominance()},
hits AS (SELECT graph_id, src AS n, x AS m, count(*) AS hit FROM e JOIN (SELECT graph_id, y AS dst, x FROM {dom}) USING (graph_id, dst) GROUP BY graph_id, src, x),
sure AS (SELECT graph_id, n, m, outdegree FROM hits JOIN (SELECT graph_id, node AS n, outdegree FROM deg WHERE outdegree > 1) USING (graph_id, n) WHERE hit = outdegree AND n <> m),
pr AS MATERIALIZED (SELECT graph_id, n, s.m AS m1, t.m AS m2, s.outdegree FROM sure s JOIN sure t USING (graph_id, n) WHERE s.m <> t.m),
want AS MATERIALIZED (SELECT DISTINCT graph_id, m2, m1 AS x, dst AS y FROM pr JOIN (SELECT graph_id, src AS n, dst FROM e) USING (graph_id, n)),
second AS (SELECT DISTINCT graph_id, m2 FROM pr),
cn AS MATERIALIZED (SELECT graph_id, m2, node FROM n JOIN second USING (graph_id)),
ce AS MATERIALIZED (SELECT graph_id, m2, src, dst FROM e JOIN second USING (graph_id) WHERE src <> m2),
{closure('c', 'cn', 'ce', k).lstrip()},
cav AS (SELECT {k}, x, y, y AS b FROM want WHERE x <> y UNION SELECT {k}, x, y, dst FROM cav JOIN (SELECT {k}, src AS b, dst FROM ce) USING ({k}, b) WHERE dst <> x),
csbad AS (SELECT DISTINCT {k}, x, y FROM cav JOIN (SELECT {k}, node AS b, sink FROM csink) USING ({k}, b) LEFT JOIN (SELECT {k}, node AS x, sink AS own FROM csink) USING ({k}, x) WHERE own IS DISTINCT FROM sink),
around AS (SELECT DISTINCT {k}, x, b AS c, b FROM cav UNION SELECT {k}, x, c, dst FROM around JOIN (SELECT {k}, src AS b, dst FROM ce) USING ({k}, b) WHERE dst <> x),
turn_ AS (SELECT {k}, x, b FROM around JOIN (SELECT {k}, src AS b, dst AS c FROM ce) USING ({k}, b, c) UNION SELECT {k}, x, b FROM cav ANTI JOIN (SELECT {k}, node AS b FROM cdeg) USING ({k}, b)),
cmbad AS (SELECT DISTINCT {k}, x, y FROM cav JOIN turn_ USING ({k}, x, b)),
first_ AS (SELECT {k}, x, y FROM want JOIN (SELECT {k}, a AS y, b AS x FROM cr) USING ({k}, x, y) ANTI JOIN c{dom[0]}bad USING ({k}, x, y)),
cnt AS (SELECT graph_id, n, m1, m2, outdegree, count(*) AS first FROM pr JOIN (SELECT graph_id, src AS n, dst AS y FROM e) USING (graph_id, n) JOIN (SELECT {k}, x AS m1, y FROM first_) USING ({k}, m1, y) GROUP BY graph_id, n, m1, m2, outdegree)"""


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


EXIT = "\nexits AS (SELECT graph_id, max(node) AS node FROM en GROUP BY graph_id)"


def kind(name: str, event: str) -> str:
    return f"\n{name} AS (SELECT graph_id, node FROM en WHERE event = '{event}')"


def cut(criterion: str, nodes: str = "n", edges: str = "e") -> str:
    return f"\nke AS (SELECT graph_id, src, dst FROM {edges} ANTI JOIN (SELECT graph_id, node AS src FROM {criterion}) USING (graph_id, src))"


def oracle_sql() -> dict[str, str]:
    dom = dominance()
    two = {"sink": "sdom", "max": "mdom"}
    out = {
        "event_flow": query(EVENTS, select="SELECT * FROM e"),
        "order_flow": query(ORDERS, select="SELECT * FROM e"),
        "reachability": query(EVENTS, closure(), select="SELECT * FROM r"),
        "order_reachability": query(ORDERS, closure(), select="SELECT * FROM r"),
        "strong_components": query(EVENTS, closure(), select="SELECT * FROM scc"),
        "control_sinks": query(EVENTS, closure(), select="SELECT * FROM sink"),
        "cyclic_nodes": query(EVENTS, closure(), select="SELECT graph_id, node FROM scc WHERE size > 1"),
        "join_nodes": query(EVENTS, select="SELECT graph_id, dst AS node, count(*) AS n_in FROM e GROUP BY graph_id, dst HAVING count(*) > 1"),
        "branch_nodes": query(EVENTS, closure(), select="SELECT * FROM deg WHERE outdegree > 1"),
        "next_branch": query(
            EVENTS, closure(), "\nch AS (SELECT graph_id, node, node AS z FROM n UNION SELECT graph_id, node, dst FROM ch JOIN (SELECT graph_id, src AS z, dst FROM e JOIN (SELECT graph_id, node AS src FROM deg WHERE outdegree = 1) USING (graph_id, src)) USING (graph_id, z))",
            select="SELECT graph_id, node, z AS branch FROM ch JOIN (SELECT graph_id, node AS z FROM deg WHERE outdegree > 1) USING (graph_id, z)",
        ),
        "condensation": query(EVENTS, closure(), select="SELECT DISTINCT graph_id, a.scc AS src, b.scc AS dst FROM e JOIN (SELECT graph_id, node AS src, scc FROM scc) a USING (graph_id, src) JOIN (SELECT graph_id, node AS dst, scc FROM scc) b USING (graph_id, dst) WHERE a.scc <> b.scc"),
        "transitive_reduction": query(
            EVENTS, closure(), "\nq AS (SELECT DISTINCT graph_id, a.scc AS s, b.scc AS t FROM e JOIN (SELECT graph_id, node AS src, scc FROM scc) a USING (graph_id, src) JOIN (SELECT graph_id, node AS dst, scc FROM scc) b USING (graph_id, dst) WHERE a.scc <> b.scc)",
            "\nqr AS (SELECT graph_id, s, t FROM q UNION SELECT graph_id, s, u FROM qr JOIN (SELECT graph_id, s AS t, t AS u FROM q) USING (graph_id, t))",
            select="SELECT graph_id, s AS src, t AS dst FROM q WHERE NOT EXISTS (SELECT 1 FROM q a JOIN qr b ON a.graph_id = b.graph_id AND a.t = b.s WHERE a.graph_id = q.graph_id AND a.s = q.s AND b.t = q.t)",
        ),
        "chop": query(EVENTS, closure(), kind("s", "click"), kind("t", "purchase"), select="SELECT graph_id, node FROM (SELECT graph_id, b AS node FROM r JOIN (SELECT graph_id, node AS a FROM s) USING (graph_id, a)) INTERSECT SELECT graph_id, a FROM r JOIN (SELECT graph_id, node AS b FROM t) USING (graph_id, b)"),
        "nticd": query(EVENTS, dom, cd("res", "sdom"), select="SELECT * FROM res"),
        "ntscd": query(EVENTS, dom, cd("res", "mdom"), select="SELECT * FROM res"),
        "order_nticd": query(ORDERS, dom, cd("res", "sdom"), select="SELECT * FROM res"),
        "nticd_slice": query(EVENTS, dom, cd("res", "sdom"), EXIT, slice_("res", "exits"), select="SELECT * FROM sl"),
        "ntscd_slice": query(EVENTS, dom, cd("res", "mdom"), EXIT, slice_("res", "exits"), select="SELECT * FROM sl"),
        "nticd_ntiod_slice": query(EVENTS, EXIT, cut("exits"), dominance("k", "n", "ke"), cd("res", "ksdom", "k", "ke"), slice_("res", "exits"), select="SELECT * FROM sl"),
        "ntscd_ntsod_slice": query(EVENTS, EXIT, cut("exits"), dominance("k", "n", "ke"), cd("res", "kmdom", "k", "ke"), slice_("res", "exits"), select="SELECT * FROM sl"),
        "next_observable": query(EVENTS, kind("o", "signup"), cut("o"), closure("k", "n", "ke"), select="SELECT graph_id, a AS node, b AS first FROM kr JOIN (SELECT graph_id, node AS b FROM o) USING (graph_id, b)"),
        "weakly_closed": query(
            EVENTS, kind("o", "signup"), cut("o"), closure("k", "n", "ke"), "\nbad AS (SELECT graph_id, a FROM kr JOIN (SELECT graph_id, node AS b FROM o) USING (graph_id, b) GROUP BY graph_id, a HAVING count(*) > 1)",
            select="SELECT graph_id, graph_id NOT IN (SELECT graph_id FROM bad) AS closed FROM (SELECT DISTINCT graph_id FROM n)",
        ),
        "coarse_timing_dependence": query(EVENTS, closure(), select="SELECT DISTINCT graph_id, x.src AS n, a.b AS m FROM e x JOIN e y USING (graph_id) JOIN r a USING (graph_id) JOIN r b USING (graph_id) WHERE x.src = y.src AND x.dst < y.dst AND a.a = x.dst AND b.a = y.dst AND a.b = b.b"),
        "reaching_definitions": query(EVENTS, NAMES, select="SELECT * FROM rd"),
        "data_dependence": query(EVENTS, NAMES, select="SELECT * FROM dd"),
        "ntiod": query(EVENTS, ordered("sdom"), select="SELECT graph_id, m1, m2, n FROM cnt WHERE first < outdegree"),
        "ntsod": query(EVENTS, ordered("mdom"), select="SELECT graph_id, m1, m2, n FROM cnt WHERE first < outdegree"),
        "dod": query(EVENTS, ordered("mdom"), select="SELECT graph_id, m1, m2, n FROM cnt a WHERE EXISTS (SELECT 1 FROM cnt b WHERE b.graph_id = a.graph_id AND b.n = a.n AND b.m1 = a.m2 AND b.m2 = a.m1)"),
        "pairs_from_ntiod": query(EVENTS, ordered("sdom"), select="SELECT graph_id, n, m1 AS m FROM cnt WHERE first < outdegree UNION SELECT graph_id, n, m2 FROM cnt WHERE first < outdegree"),
        "value_arithmetic": """SELECT l_orderkey, CAST(sum((l_partkey + l_linenumber) % 256) AS BIGINT) AS plus, CAST(sum((l_partkey - l_linenumber + 25600) % 256) AS BIGINT) AS minus, CAST(sum((l_partkey * l_linenumber) % 256) AS BIGINT) AS times,
            CAST(sum((l_partkey % 256) // l_linenumber) AS BIGINT) AS quotient, CAST(sum((l_partkey % 256) % l_linenumber) AS BIGINT) AS remainder, CAST(sum((l_partkey % 256) & l_linenumber) AS BIGINT) AS both,
            CAST(sum((l_partkey % 256) | l_linenumber) AS BIGINT) AS either, CAST(sum(xor(l_partkey % 256, l_linenumber)) AS BIGINT) AS differ FROM lineitem GROUP BY l_orderkey""",
        "level_join": query(EVENTS, select="SELECT graph_id, CAST(max(event = 'signup') AS INTEGER) AS \"join\", CAST(min(event = 'signup') AS INTEGER) AS meet FROM en GROUP BY graph_id"),
        "g_test": """WITH c AS (SELECT user_id % 2 AS half, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT half, sum(n) AS a FROM c GROUP BY half), k AS (SELECT event_type, sum(n) AS b FROM c GROUP BY event_type)
            SELECT round(sum(2 * n * ln(n * (SELECT sum(n) FROM c) / (a * b))), 6) AS g, (count(DISTINCT half) - 1) * (count(DISTINCT event_type) - 1) AS df FROM c JOIN r USING (half) JOIN k USING (event_type)""",
    }
    for name, d in two.items():
        out[f"{name}_dominance"] = query(EVENTS, dom, select=f"SELECT * FROM {d}")
        out[f"immediate_{name}_dominance"] = query(EVENTS, dom, immediate(d), select="SELECT * FROM imm")
        out[f"{name}_frontier"] = query(EVENTS, dom, immediate(d), select=f"SELECT DISTINCT graph_id, x, src AS y FROM e JOIN (SELECT graph_id, y AS dst, x FROM {d}) USING (graph_id, dst) ANTI JOIN (SELECT graph_id, x, y AS src FROM one) USING (graph_id, x, src)")
        out[f"nodes_between_{name}"] = query(
            EVENTS, dom, immediate(d),
            "\nbt AS (SELECT graph_id, src AS n, dst AS m FROM e UNION SELECT graph_id, n, dst FROM (SELECT graph_id, n, m FROM bt ANTI JOIN (SELECT graph_id, y AS n, x AS m FROM imm) USING (graph_id, n, m)) JOIN (SELECT graph_id, src AS m, dst FROM e) USING (graph_id, m))",
            select="SELECT graph_id, n, m FROM bt ANTI JOIN (SELECT graph_id, y AS n, x AS m FROM imm) USING (graph_id, n, m) WHERE n <> m",
        )
    for name, cost in (("", "1"), ("_cost", "1 + (src * 7 + dst * 3) % 32")):
        walks = f"""
ec AS (SELECT graph_id, src, dst, CAST({cost} AS BIGINT) AS cost FROM e),
wk AS (SELECT graph_id, node AS y, node AS x, CAST(0 AS BIGINT) AS steps FROM n
       UNION SELECT graph_id, src, x, steps + cost FROM wk JOIN (SELECT graph_id, src, dst AS y, cost FROM ec) USING (graph_id, y) SEMI JOIN (SELECT graph_id, y AS src, x FROM mdom) USING (graph_id, src, x) WHERE src <> x),
td AS (SELECT graph_id, y, x, min(steps) AS steps FROM wk GROUP BY graph_id, y, x HAVING min(steps) = max(steps)),
res AS MATERIALIZED (SELECT DISTINCT graph_id, n, m FROM (SELECT graph_id, src AS n, x AS m, steps + cost AS z, count(*) AS hit FROM ec JOIN (SELECT graph_id, y AS dst, x, steps FROM td) USING (graph_id, dst) GROUP BY ALL)
        JOIN (SELECT graph_id, node AS n, outdegree FROM deg) USING (graph_id, n) WHERE hit < outdegree)"""
        out[f"timing_dominance{name}"] = query(EVENTS, dom, walks, select="SELECT * FROM td")
        out[f"tscd{name}"] = query(EVENTS, dom, walks, select="SELECT * FROM res")
        if not name:
            out["tscd_slice"] = query(EVENTS, dom, walks, EXIT, slice_("res", "exits"), select="SELECT * FROM sl")
    common = "\nco AS (SELECT graph_id, src AS a, dst AS b, p.x AS lca FROM e JOIN sdom p USING (graph_id) JOIN sdom q USING (graph_id) WHERE p.y = src AND q.y = dst AND p.x = q.x AND graph_id IN (SELECT graph_id FROM deg WHERE outdegree > 1))"
    out["nearest_common_dominator"] = query(EVENTS, dom, common, select="SELECT * FROM co c WHERE NOT EXISTS (SELECT 1 FROM co o WHERE o.graph_id = c.graph_id AND o.a = c.a AND o.b = c.b AND NOT EXISTS (SELECT 1 FROM sdom s WHERE s.graph_id = c.graph_id AND s.y = c.lca AND s.x = o.lca))")
    halves = "WITH c AS (SELECT event_type, sum(CAST(user_id % 2 = 0 AS INTEGER)) AS a, sum(CAST(user_id % 2 = 1 AS INTEGER)) AS b FROM events GROUP BY event_type), s AS (SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2 FROM c) "
    out["equivalence_distance"] = halves + "SELECT round(sum((a / n1 - b / n2) * (a / n1 - b / n2)), 10) AS d2, n1, n2 FROM c, s GROUP BY n1, n2"
    out["two_sample_test"] = halves + "SELECT round(sum((a * sqrt(n2 / n1) - b * sqrt(n1 / n2)) * (a * sqrt(n2 / n1) - b * sqrt(n1 / n2)) / (a + b)), 6) AS chi2, count(*) - 1 AS df FROM c, s"
    pdg = "\npdg AS MATERIALIZED (SELECT * FROM res UNION SELECT * FROM dd)"
    base = (EVENTS, NAMES, dom, cd("res", "sdom"), pdg)
    flow = "\nfl AS (SELECT graph_id, node FROM hi UNION SELECT graph_id, m FROM fl JOIN (SELECT graph_id, n AS node, m FROM pdg) USING (graph_id, node))"
    out["program_dependence"] = query(*base, select="SELECT * FROM pdg")
    out["program_slice"] = query(*base, EXIT, slice_("pdg", "exits"), select="SELECT * FROM sl")
    out["information_flow"] = query(*base, kind("hi", "signup"), flow, select="SELECT * FROM fl")
    out["insecure_nodes"] = query(*base, kind("hi", "signup"), kind("lw", "purchase"), flow, select="SELECT * FROM fl SEMI JOIN lw USING (graph_id, node)")
    back = "\nto_c AS (SELECT DISTINCT graph_id, a AS node FROM r JOIN (SELECT graph_id, node AS b FROM o) USING (graph_id, b))"
    inner = "\nhe AS (SELECT graph_id, src, dst FROM e SEMI JOIN (SELECT graph_id, node AS src FROM to_c) USING (graph_id, src) SEMI JOIN (SELECT graph_id, node AS dst FROM to_c) USING (graph_id, dst))"
    out["weak_order_slice"] = query(EVENTS, closure(), kind("o", "signup"), back, inner, cut("o", "to_c", "he"), dominance("k", "to_c", "ke"), cd("res", "ksdom", "k", "ke"), slice_("res", "o"), select="SELECT * FROM sl")
    fwd = "\nfrom_c AS (SELECT DISTINCT graph_id, b AS node FROM hr JOIN (SELECT graph_id, node AS a FROM o) USING (graph_id, a))"
    inner2 = "\nge AS (SELECT graph_id, src, dst FROM he SEMI JOIN (SELECT graph_id, node AS src FROM from_c) USING (graph_id, src) SEMI JOIN (SELECT graph_id, node AS dst FROM from_c) USING (graph_id, dst))"
    out["weak_control_closure"] = query(EVENTS, closure(), kind("o", "signup"), back, inner, closure("h", "to_c", "he"), fwd, inner2, cut("o", "from_c", "ge"), dominance("k", "from_c", "ke"), cd("res", "ksdom", "k", "ke"), slice_("res", "o"), select="SELECT * FROM sl")
    sp = "\nsp AS (SELECT graph_id, src, dst FROM e WHERE dst = src + 3)"
    th = "\nth AS (SELECT graph_id, node, node AS thread FROM n WHERE node = 1 UNION SELECT graph_id, dst, CASE WHEN dst = src + 3 THEN dst ELSE thread END FROM th JOIN (SELECT graph_id, src AS node, src, dst FROM e) USING (graph_id, node))"
    apart = "\nlf AS (SELECT DISTINCT sp.graph_id, p.b AS a, q.b AS b FROM sp JOIN e x ON x.graph_id = sp.graph_id AND x.src = sp.src AND x.dst <> x.src + 3 JOIN r p ON p.graph_id = sp.graph_id AND p.a = sp.dst JOIN r q ON q.graph_id = sp.graph_id AND q.a = x.dst),\nap AS (SELECT graph_id, a, b FROM lf UNION SELECT graph_id, b, a FROM lf)"
    many = "\nmn AS (SELECT graph_id, dst AS node FROM sp SEMI JOIN (SELECT graph_id, node AS src FROM th) USING (graph_id, src) WHERE (graph_id, src) IN (SELECT (graph_id, node) FROM scc WHERE size > 1) OR (graph_id, dst) IN (SELECT (graph_id, dst) FROM e GROUP BY graph_id, dst HAVING count(*) > 1) UNION SELECT graph_id, dst FROM mn JOIN (SELECT graph_id, src AS node, dst FROM e) USING (graph_id, node))"
    par = "\nst AS (SELECT graph_id, node, min(thread) AS thread FROM th GROUP BY graph_id, node HAVING count(*) = 1),\nsa AS (SELECT x.graph_id, x.node AS a, y.node AS b FROM st x JOIN st y USING (graph_id, thread)),\nmhp AS (SELECT graph_id, a, b FROM sa WHERE (graph_id, a) IN (SELECT (graph_id, node) FROM mn) UNION ALL SELECT graph_id, a, b FROM ap ANTI JOIN sa USING (graph_id, a, b))"
    threads = (EVENTS, closure(), sp, th, apart, many, par)
    out["threads_of"] = query(EVENTS, th, select="SELECT * FROM th")
    out["spawned_apart"] = query(EVENTS, closure(), sp, apart, select="SELECT * FROM ap")
    out["parallel_nodes"] = query(*threads, select="SELECT * FROM mhp")
    out["data_conflicts"] = query(*threads, NAMES, "\ntu AS (SELECT * FROM uses UNION SELECT * FROM defs)", select="SELECT DISTINCT graph_id, a AS n, b AS m FROM mhp JOIN (SELECT graph_id, node AS a, name FROM defs) USING (graph_id, a) JOIN (SELECT graph_id, node AS b, name FROM tu) USING (graph_id, b, name)")
    out["inter_thread_dependence"] = query(*threads, NAMES, select="SELECT DISTINCT graph_id, a AS n, b AS m FROM mhp JOIN (SELECT graph_id, node AS a, name FROM defs) USING (graph_id, a) JOIN (SELECT graph_id, node AS b, name FROM uses) USING (graph_id, b, name)")
    timed = "\npdg AS MATERIALIZED (SELECT graph_id, n, m FROM res UNION SELECT graph_id, n, m FROM dd UNION SELECT graph_id, src, dst FROM e WHERE (graph_id, dst) IN (SELECT (graph_id, a) FROM mhp))"
    out["timed_classification"] = query(EVENTS, NAMES, dom, cd("res", "sdom"), sp, th, apart, many, par, timed, kind("hi", "signup"), flow, select="SELECT * FROM fl")
    kinds = "\nkd AS (SELECT graph_id, src, dst, CASE WHEN dst = src + 3 THEN 'in' WHEN dst < src THEN 'out' ELSE 'data' END AS kind FROM e)"
    back_by = lambda name, seed, kinds_: f"\n{name} AS (SELECT graph_id, node FROM {seed} UNION SELECT graph_id, src FROM {name} JOIN (SELECT graph_id, src, dst AS node FROM kd WHERE kind IN ({kinds_})) USING (graph_id, node))"
    out["two_phase_slice"] = query(EVENTS, EXIT, kinds, back_by("p1", "exits", "'in', 'data'"), back_by("p2", "p1", "'out', 'data'"), select="SELECT * FROM p2")
    out["within_chop"] = query(
        EVENTS, EXIT, kinds, kind("vw", "view"), back_by("p1", "exits", "'data'"), "\np2 AS (SELECT graph_id, node FROM vw UNION SELECT graph_id, dst FROM p2 JOIN (SELECT graph_id, dst, src AS node FROM kd WHERE kind = 'data') USING (graph_id, node))",
        select="SELECT * FROM p1 SEMI JOIN p2 USING (graph_id, node)",
    )
    # A node's row is replaced while a shorter way is found, so no bound on costs is needed.
    shorter = """
c AS (SELECT graph_id, src, dst, 1 + (src * 7 + dst * 3) % 32 AS cost FROM e),
ds(graph_id, node, d) USING KEY (graph_id, node) AS (SELECT graph_id, node, CAST(0 AS BIGINT) FROM n WHERE node = 1
    UNION SELECT w.graph_id, c.dst, min(w.d + c.cost) FROM ds w JOIN c ON c.graph_id = w.graph_id AND c.src = w.node
          LEFT JOIN recurring.ds o ON o.graph_id = w.graph_id AND o.node = c.dst WHERE o.d IS NULL OR w.d + c.cost < o.d GROUP BY w.graph_id, c.dst)"""
    out["distances"] = query(EVENTS, shorter, select="SELECT graph_id, CAST(1 AS BIGINT) AS origin, node, d AS distance FROM ds")
    out["bounded_walks"] = query(EVENTS, "\nwk AS (SELECT graph_id, node AS origin, node, 0 AS steps FROM n WHERE node = 1 UNION SELECT graph_id, origin, dst, steps + 1 FROM wk JOIN (SELECT graph_id, src AS node, dst FROM e) USING (graph_id, node) WHERE steps < 5)", select="SELECT * FROM wk")
    out["chain_roots"] = query(EVENTS, "\npa AS (SELECT graph_id, src AS node, max(dst) AS parent FROM e GROUP BY graph_id, src HAVING max(dst) > src),\nup AS (SELECT graph_id, node, parent AS z, 1 AS depth FROM pa UNION ALL SELECT graph_id, up.node, pa.parent, depth + 1 FROM up JOIN pa USING (graph_id) WHERE pa.node = up.z)", select="SELECT graph_id, node, arg_max(z, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY graph_id, node")
    out["accepted_words"] = query(EVENTS, select="SELECT DISTINCT a.graph_id AS word_id FROM en a JOIN en b ON a.graph_id = b.graph_id AND b.node = a.node + 1 WHERE a.event = 'click' AND b.event IN ('error', 'purchase')")
    itd = "\nitd AS (SELECT DISTINCT graph_id, a AS n, b AS m FROM mhp JOIN (SELECT graph_id, node AS a, name FROM defs) USING (graph_id, a) JOIN (SELECT graph_id, node AS b, name FROM uses) USING (graph_id, b, name))"
    cpdg = "\ncpdg AS MATERIALIZED (SELECT graph_id, n, m FROM res UNION SELECT graph_id, n, m FROM dd UNION SELECT graph_id, n, m FROM itd UNION SELECT graph_id, src, dst FROM sp)"
    whole = (EVENTS, NAMES, dom, cd("res", "sdom"), sp, th, apart, many, par.replace("mhp AS (", "mhp AS MATERIALIZED ("), itd, cpdg)
    fdom = """
fav AS (SELECT graph_id, node AS x, CAST(1 AS BIGINT) AS b FROM n WHERE node <> 1 UNION SELECT graph_id, x, dst FROM fav JOIN (SELECT graph_id, src AS b, dst FROM e) USING (graph_id, b) WHERE dst <> x),
fdom AS MATERIALIZED (SELECT graph_id, y, x FROM (SELECT graph_id, b AS y FROM r WHERE a = 1) JOIN (SELECT graph_id, b AS x FROM r WHERE a = 1) USING (graph_id) ANTI JOIN (SELECT graph_id, x, b AS y FROM fav) USING (graph_id, x, y)),
cdom AS MATERIALIZED (SELECT graph_id, a, b, arg_max(dom, size) AS dom FROM mhp JOIN (SELECT graph_id, y AS a, x AS dom FROM fdom) USING (graph_id, a) JOIN (SELECT graph_id, y AS b, x AS dom FROM fdom) USING (graph_id, b, dom)
         JOIN (SELECT graph_id, y AS dom, count(*) AS size FROM fdom GROUP BY ALL) USING (graph_id, dom) ANTI JOIN (SELECT graph_id, a AS dom, b AS a FROM mhp) USING (graph_id, dom, a) ANTI JOIN (SELECT graph_id, a AS dom, b FROM mhp) USING (graph_id, dom, b) GROUP BY graph_id, a, b)"""

    def tdep(edges: str, p: str = "t") -> str:
        k = "graph_id, m"
        return f"""
{p}n AS MATERIALIZED (SELECT graph_id, b AS m, a AS node FROM {p}0r),
{p}e AS MATERIALIZED (SELECT graph_id, m, src, dst FROM {edges} JOIN (SELECT graph_id, m, node AS src FROM {p}n) USING (graph_id, src) JOIN (SELECT graph_id, m, node AS dst FROM {p}n) USING (graph_id, m, dst) WHERE src <> m),
{dominance(p, p + 'n', p + 'e', k).lstrip()},
{p}wk AS (SELECT {k}, node AS y, node AS x, 0 AS steps FROM {p}n UNION SELECT {k}, src, x, steps + 1 FROM {p}wk JOIN (SELECT {k}, src, dst AS y FROM {p}e) USING ({k}, y) SEMI JOIN (SELECT {k}, y AS src, x FROM {p}mdom) USING ({k}, src, x) WHERE src <> x),
{p}td AS (SELECT {k}, y FROM (SELECT {k}, y, x FROM {p}wk WHERE y <> x GROUP BY {k}, y, x HAVING min(steps) = max(steps)) GROUP BY ALL),
{p}dep AS MATERIALIZED (SELECT graph_id, node AS n, m FROM {p}n ANTI JOIN (SELECT {k}, y AS node FROM {p}td) USING ({k}, node) WHERE node <> m)"""

    alone = (closure("t0").lstrip(), tdep("e").lstrip())
    out["timing_dependence"] = query(EVENTS, *alone, select="SELECT * FROM tdep")
    for name, d in two.items():
        out[f"nt{'i' if name == 'sink' else 's'}cd_timing_slice"] = query(EVENTS, *alone, dom, cd("res", d), "\nctd AS MATERIALIZED (SELECT * FROM res UNION SELECT * FROM tdep)", EXIT, slice_("ctd", "exits"), select="SELECT * FROM sl")
    for name, cost in (("", "1"), ("_cost", "1 + (src * 7 + dst * 3) % 32")):
        out[f"timing_frontier{name}"] = query(
            EVENTS, dom, f"\nec AS (SELECT graph_id, src, dst, CAST({cost} AS BIGINT) AS cost FROM e)",
            "\nwk AS (SELECT graph_id, node AS y, node AS x, CAST(0 AS BIGINT) AS steps FROM n UNION SELECT graph_id, src, x, steps + cost FROM wk JOIN (SELECT graph_id, src, dst AS y, cost FROM ec) USING (graph_id, y) SEMI JOIN (SELECT graph_id, y AS src, x FROM mdom) USING (graph_id, src, x) WHERE src <> x)",
            "\ntd AS MATERIALIZED (SELECT graph_id, y, x FROM wk GROUP BY graph_id, y, x HAVING min(steps) = max(steps))", immediate("td").split(",\nimm AS")[0],
            select="SELECT DISTINCT graph_id, x, src AS y FROM e JOIN (SELECT graph_id, y AS dst, x FROM td) USING (graph_id, dst) ANTI JOIN (SELECT graph_id, x, y AS src FROM one) USING (graph_id, x, src)",
        )
    out["tscd_cost_slice"] = out["tscd_slice"].replace("CAST(1 AS BIGINT) AS cost", "CAST(1 + (src * 7 + dst * 3) % 32 AS BIGINT) AS cost")
    out["ternary_slice"] = out["immediate_slice"] = out["nticd_ntiod_slice"]
    out["concurrent_dependence"] = query(*whole, select="SELECT * FROM cpdg")
    out["common_dominator"] = query(*threads, fdom, select="SELECT * FROM cdom")
    hi, lw = kind("hi", "signup"), kind("lw", "purchase")
    high = lambda pairs, name="fl", seed="hi": f"\n{name} AS (SELECT graph_id, node FROM {seed} UNION SELECT graph_id, m FROM {name} JOIN (SELECT graph_id, n AS node, m FROM {pairs}) USING (graph_id, node))"
    inside = "\nal AS MATERIALIZED (SELECT * FROM cpdg UNION SELECT c.graph_id, p.b, c.a FROM (SELECT DISTINCT graph_id, dom, a FROM cdom) c JOIN r p ON p.graph_id = c.graph_id AND p.a = c.dom JOIN r q ON q.graph_id = c.graph_id AND q.a = p.b AND q.b = c.a)"
    out["minimal_classification"] = query(*whole, fdom, inside, hi, high("al"), select="SELECT * FROM fl")
    plain = "\nne AS MATERIALIZED (SELECT graph_id, src, dst FROM e WHERE dst <> src + 3)"
    spawned = "\ntdp AS MATERIALIZED (SELECT * FROM tdep UNION SELECT t.graph_id, t.n, r.b FROM tdep t JOIN sp ON sp.graph_id = t.graph_id AND sp.src = t.m JOIN r ON r.graph_id = t.graph_id AND r.a = sp.dst)"
    timed_by = "\ntb AS MATERIALIZED (SELECT DISTINCT c.graph_id, c.a, c.b, t.n AS x FROM cdom c JOIN tdp t ON t.graph_id = c.graph_id AND (t.m = c.a OR t.m = c.b) JOIN r ON r.graph_id = c.graph_id AND r.a = c.dom AND r.b = t.n)"
    cf = "\ntu AS (SELECT * FROM uses UNION SELECT * FROM defs),\ncf AS MATERIALIZED (SELECT DISTINCT graph_id, a AS n, b AS m FROM mhp JOIN (SELECT graph_id, node AS a, name FROM defs) USING (graph_id, a) JOIN (SELECT graph_id, node AS b, name FROM tu) USING (graph_id, b, name))"
    races = "\nal AS MATERIALIZED (SELECT * FROM cpdg UNION SELECT graph_id, x, b FROM tb SEMI JOIN (SELECT graph_id, n AS a, m AS b FROM cf) USING (graph_id, a, b))"
    levels = "\ntl AS (SELECT DISTINCT graph_id, a, b FROM tb SEMI JOIN (SELECT graph_id, node AS x FROM fl) USING (graph_id, x))"
    clocks = (*whole, fdom, plain, closure("t0", "n", "ne"), tdep("ne"), spawned, timed_by, cf, races, hi, high("al"), levels)
    secure = lambda bad: f"SELECT graph_id, graph_id NOT IN ({bad}) AS secure FROM (SELECT DISTINCT graph_id FROM n)"
    low_pairs = "SEMI JOIN (SELECT graph_id, node AS a FROM lw) USING (graph_id, a) SEMI JOIN (SELECT graph_id, node AS b FROM lw) USING (graph_id, b)"
    out["timing_classification"] = query(*clocks, select="SELECT * FROM fl")
    out["timing_levels"] = query(*clocks, select="SELECT * FROM tl")
    out["timing_security"] = query(*clocks, lw, select=secure(f"SELECT graph_id FROM fl SEMI JOIN lw USING (graph_id, node) UNION SELECT graph_id FROM tl {low_pairs}"))
    for name, racing in (("lsod", "SELECT graph_id, n FROM cf UNION SELECT graph_id, m FROM cf"), ("rlsod", "SELECT graph_id, m FROM itd UNION SELECT graph_id, b FROM mhp JOIN (SELECT graph_id, node AS a, name FROM defs) USING (graph_id, a) JOIN (SELECT graph_id, node AS b, name FROM defs) USING (graph_id, b, name)")):
        out[name] = query(*whole, cf, hi, lw, f"\nsd AS (SELECT * FROM hi UNION {racing})", high("cpdg", "fl", "sd"), select=secure(f"SELECT graph_id FROM fl SEMI JOIN lw USING (graph_id, node) UNION SELECT graph_id FROM mhp {low_pairs}"))
    exit_ = "\nxn AS (SELECT * FROM n UNION SELECT DISTINCT graph_id, CAST(-1 AS BIGINT) FROM n),\nxe AS (SELECT * FROM e UNION SELECT graph_id, node, CAST(-1 AS BIGINT) FROM n ANTI JOIN (SELECT graph_id, src AS node FROM e) USING (graph_id, node))"
    live = "\nyn AS (SELECT graph_id, a AS node FROM xr WHERE b = -1),\nye AS (SELECT graph_id, src, dst FROM xe SEMI JOIN (SELECT graph_id, node AS src FROM yn) USING (graph_id, src) SEMI JOIN (SELECT graph_id, node AS dst FROM yn) USING (graph_id, dst))"
    out["classic_control_dependence"] = query(EVENTS, exit_, closure("x", "xn", "xe"), live, dominance("y", "yn", "ye"), cd("res", "ysdom", "y", "ye"), select="SELECT * FROM res WHERE m <> -1")
    return out
