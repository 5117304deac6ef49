"""DuckDB SQL for the queries over programs. Recursion that needs two rows of its result reads the whole of it as recurring."""

from __future__ import annotations

from .oracles import EVENTS, EXIT, ORDERS, cd, closure, dominance, immediate, query

PROGRAMS = """
pe AS (SELECT graph_id, node AS i, event, lag(event) OVER (PARTITION BY graph_id ORDER BY node) AS before, (node - 1) // 8 AS proc, max(node) OVER (PARTITION BY graph_id) AS fin FROM en),
pg AS (SELECT *, proc * 8 + 1 AS first, least((proc + 1) * 8, fin) AS last, i * 4 + CASE WHEN event = 'click' THEN 1 ELSE 0 END AS leaves, (proc + 1) % ((fin - 1) // 8 + 1) AS callee FROM pe),
procs AS (SELECT DISTINCT graph_id, proc, first * 4 - 1 AS entry, last * 4 + 2 AS exit FROM pg),
flow AS MATERIALIZED (SELECT graph_id, leaves AS src, CASE WHEN event = 'purchase' OR i = last THEN last * 4 + 2 ELSE i * 4 + 4 END AS dst FROM pg UNION SELECT graph_id, leaves, greatest(i - 2, first) * 4 FROM pg WHERE event = 'error'
         UNION SELECT graph_id, leaves, i * 4 + 8 FROM pg WHERE event = 'view' AND i + 2 <= last UNION SELECT graph_id, i * 4 - 1, i * 4 FROM pg WHERE i = first),
calls AS MATERIALIZED (SELECT pg.graph_id, i * 4 AS call, i * 4 + 1 AS back, pg.callee, entry, exit FROM pg JOIN procs ON pg.graph_id = procs.graph_id AND pg.callee = procs.proc WHERE event = 'click'),
pd AS MATERIALIZED (SELECT graph_id, leaves AS node, event AS name FROM pg),
pu AS (SELECT graph_id, i * 4 AS node, before AS name FROM pg WHERE before IS NOT NULL),
pv AS MATERIALIZED (SELECT graph_id, name FROM pd UNION SELECT graph_id, name FROM pu)"""

KILLED = """
br AS (SELECT graph_id, entry AS node FROM procs UNION SELECT graph_id, dst FROM br JOIN (SELECT graph_id, src AS node, dst FROM flow UNION ALL SELECT graph_id, call, back FROM calls) USING (graph_id, node)),
dead AS (SELECT graph_id, exit FROM procs ANTI JOIN (SELECT graph_id, node AS exit FROM br) USING (graph_id, exit)),
kp(graph_id, node, name) USING KEY (graph_id, node, name) AS (SELECT graph_id, entry, name FROM procs JOIN pv USING (graph_id)
   UNION (SELECT graph_id, dst, name FROM (SELECT * FROM recurring.kp ANTI JOIN pd USING (graph_id, node, name)) JOIN (SELECT graph_id, src AS node, dst FROM flow) USING (graph_id, node)
          UNION SELECT a.graph_id, c.back, a.name FROM (SELECT * FROM recurring.kp ANTI JOIN pd USING (graph_id, node, name)) a JOIN calls c ON c.graph_id = a.graph_id AND c.call = a.node
                JOIN (SELECT * FROM recurring.kp ANTI JOIN pd USING (graph_id, node, name) UNION SELECT graph_id, exit, name FROM dead JOIN pv USING (graph_id)) b ON b.graph_id = a.graph_id AND b.node = c.exit AND b.name = a.name)),
mk AS MATERIALIZED (SELECT graph_id, proc, name FROM procs JOIN pv USING (graph_id) ANTI JOIN dead USING (graph_id, exit) ANTI JOIN (SELECT graph_id, node AS exit, name FROM kp ANTI JOIN pd USING (graph_id, node, name)) USING (graph_id, exit, name))"""

STRONG = """
nx AS MATERIALIZED (SELECT graph_id, src AS node, dst, CAST(NULL AS BIGINT) AS callee FROM flow UNION ALL SELECT graph_id, call, back, callee FROM calls),
sr AS (SELECT graph_id, entry AS node, name, entry AS origin FROM procs JOIN pv USING (graph_id) UNION SELECT graph_id, back, name, call FROM calls JOIN pv USING (graph_id)
       UNION SELECT graph_id, dst, name, node FROM pd JOIN nx USING (graph_id, node) ANTI JOIN (SELECT graph_id, proc AS callee, name FROM mk) USING (graph_id, callee, name)
       UNION SELECT graph_id, dst, name, origin FROM (SELECT * FROM sr ANTI JOIN pd USING (graph_id, node, name)) JOIN nx USING (graph_id, node) ANTI JOIN (SELECT graph_id, proc AS callee, name FROM mk) USING (graph_id, callee, name))"""

SYSTEM = """
fn AS MATERIALIZED (SELECT graph_id, proc, entry, exit, name, 'fi:' || proc || ':' || name AS fi, 'fo:' || proc || ':' || name AS fo FROM procs JOIN pv USING (graph_id)),
an AS MATERIALIZED (SELECT graph_id, call, back, callee AS proc, name, 'ai:' || call || ':' || name AS ai, 'ao:' || call || ':' || name AS ao FROM calls JOIN pv USING (graph_id)),
own AS MATERIALIZED (SELECT graph_id, node, name, node::VARCHAR AS origin FROM pd UNION SELECT graph_id, entry, name, fi FROM fn),
nf AS (SELECT graph_id, src AS node, dst FROM flow),
rp AS (SELECT graph_id, dst AS node, name, origin FROM own JOIN nf USING (graph_id, node) UNION SELECT graph_id, back, name, ao FROM an
       UNION SELECT graph_id, dst, name, origin FROM (SELECT * FROM rp ANTI JOIN pd USING (graph_id, node, name)) JOIN nf USING (graph_id, node)),
lv AS (SELECT graph_id, node, name, origin FROM rp ANTI JOIN pd USING (graph_id, node, name) UNION SELECT * FROM own),
ddp AS (SELECT graph_id, origin AS src, node::VARCHAR AS dst FROM rp JOIN pu USING (graph_id, node, name) UNION SELECT graph_id, origin, fo FROM rp JOIN (SELECT graph_id, exit AS node, name, fo FROM fn) USING (graph_id, node, name)
        UNION SELECT graph_id, origin, ai FROM lv JOIN (SELECT graph_id, call AS node, name, ai FROM an) USING (graph_id, node, name)),
be AS MATERIALIZED (SELECT graph_id, src, dst FROM flow UNION SELECT graph_id, call, back FROM calls UNION SELECT graph_id, entry, exit FROM procs),
pb AS MATERIALIZED (SELECT graph_id, exit AS node, exit FROM procs UNION SELECT graph_id, src, exit FROM pb JOIN (SELECT graph_id, src, dst AS node FROM be) USING (graph_id, node)),
away AS (SELECT a.graph_id, a.node AS x, a.exit AS y FROM pb a WHERE a.node <> a.exit UNION SELECT graph_id, x, src FROM away JOIN (SELECT graph_id, src, dst AS y FROM be) USING (graph_id, y) WHERE src <> x),
pdom AS MATERIALIZED (SELECT a.graph_id, a.node AS y, b.node AS x FROM pb a JOIN pb b ON a.graph_id = b.graph_id AND a.exit = b.exit ANTI JOIN away w ON w.graph_id = a.graph_id AND w.x = b.node AND w.y = a.node),
le AS MATERIALIZED (SELECT graph_id, src, dst FROM be SEMI JOIN (SELECT graph_id, node AS dst FROM pb) USING (graph_id, dst)),
cdp AS (SELECT graph_id, n::VARCHAR AS src, m::VARCHAR AS dst FROM (SELECT graph_id, src AS n, x AS m, count(*) AS hit FROM le JOIN (SELECT graph_id, y AS dst, x FROM pdom) USING (graph_id, dst) GROUP BY ALL)
        JOIN (SELECT graph_id, src AS n, count(*) AS deg FROM le GROUP BY ALL) USING (graph_id, n) WHERE hit < deg AND n <> m UNION SELECT graph_id, entry::VARCHAR, exit::VARCHAR FROM procs),
inn AS MATERIALIZED (SELECT graph_id, src, dst FROM ddp UNION SELECT graph_id, src, dst FROM cdp),
rs(graph_id, node, fo) USING KEY (graph_id, node, fo) AS (SELECT graph_id, fo, fo FROM fn
   UNION (SELECT graph_id, src, fo FROM recurring.rs JOIN (SELECT graph_id, src, dst AS node FROM inn) USING (graph_id, node)
          UNION SELECT a.graph_id, x.ai, b.fo FROM recurring.rs a JOIN fn f ON f.graph_id = a.graph_id AND f.fi = a.node JOIN fn o ON o.graph_id = a.graph_id AND o.fo = a.fo JOIN an x ON x.graph_id = a.graph_id AND x.proc = f.proc AND x.name = f.name
                JOIN an y ON y.graph_id = a.graph_id AND y.proc = o.proc AND y.name = o.name AND y.call = x.call JOIN recurring.rs b ON b.graph_id = a.graph_id AND b.node = y.ao)),
su AS (SELECT DISTINCT a.graph_id, x.ai AS src, y.ao AS dst FROM rs a JOIN fn f ON f.graph_id = a.graph_id AND f.fi = a.node JOIN fn o ON o.graph_id = a.graph_id AND o.fo = a.fo JOIN an x ON x.graph_id = a.graph_id AND x.proc = f.proc AND x.name = f.name
       JOIN an y ON y.graph_id = a.graph_id AND y.proc = o.proc AND y.name = o.name AND y.call = x.call),
sys AS MATERIALIZED (SELECT *, 'data' AS kind FROM ddp UNION ALL SELECT *, 'control' FROM cdp UNION ALL SELECT graph_id, call::VARCHAR, entry::VARCHAR, 'call' FROM calls UNION ALL SELECT graph_id, ai, fi, 'in' FROM an JOIN fn USING (graph_id, proc, name)
        UNION ALL SELECT graph_id, fo, ao, 'out' FROM an JOIN fn USING (graph_id, proc, name) UNION ALL SELECT *, 'summary' FROM su)"""


PARENS = "\nop AS MATERIALIZED (SELECT *, CASE WHEN dst = src + 2 THEN '(' WHEN dst < src THEN ')' END AS paren, src % 2 AS site FROM e)"

BALANCED = """
ba(graph_id, a, b) USING KEY (graph_id, a, b) AS (SELECT graph_id, node, node FROM n UNION SELECT graph_id, src, dst FROM op WHERE paren IS NULL
   UNION (SELECT x.graph_id, x.a, y.b FROM recurring.ba x JOIN recurring.ba y ON x.graph_id = y.graph_id AND x.b = y.a
          UNION SELECT x.graph_id, o.src, c.dst FROM recurring.ba x JOIN op o ON o.graph_id = x.graph_id AND o.dst = x.a AND o.paren = '(' JOIN op c ON c.graph_id = x.graph_id AND c.src = x.b AND c.paren = ')' AND c.site = o.site))"""

SUMMARIES = """
kd AS MATERIALIZED (SELECT graph_id, src, dst, CASE WHEN dst = src + 3 THEN 'in' WHEN dst < src THEN 'out' ELSE 'data' END AS kind FROM e),
si AS MATERIALIZED (SELECT graph_id, src AS actual, dst AS formal, src % 2 AS call FROM kd WHERE kind = 'in'),
so AS MATERIALIZED (SELECT graph_id, dst AS actual, src AS formal, dst % 2 AS call FROM kd WHERE kind = 'out'),
rc(graph_id, node, fo) USING KEY (graph_id, node, fo) AS (SELECT DISTINCT graph_id, formal, formal FROM so
   UNION (SELECT graph_id, src, fo FROM recurring.rc JOIN (SELECT graph_id, src, dst AS node FROM kd WHERE kind = 'data') USING (graph_id, node)
          UNION SELECT a.graph_id, i.actual, b.fo FROM recurring.rc a JOIN si i ON i.graph_id = a.graph_id AND i.formal = a.node JOIN so o ON o.graph_id = a.graph_id AND o.formal = a.fo AND o.call = i.call JOIN recurring.rc b ON b.graph_id = a.graph_id AND b.node = o.actual)),
sm AS MATERIALIZED (SELECT DISTINCT a.graph_id, i.actual AS src, o.actual AS dst FROM rc a JOIN si i ON i.graph_id = a.graph_id AND i.formal = a.node JOIN so o ON o.graph_id = a.graph_id AND o.formal = a.fo AND o.call = i.call)"""

#: What doesn't dominate: on one way into y neither its begin nor, of a return, any of its calls has x.
VALID = """
sc AS MATERIALIZED (SELECT graph_id, site, src AS call FROM op WHERE paren = '('),
vb(graph_id, y, x) USING KEY (graph_id, y, x) AS (SELECT graph_id, CAST(1 AS BIGINT), node FROM n WHERE node <> 1
   UNION SELECT op.graph_id, op.dst, b.x FROM op JOIN recurring.vb b ON b.graph_id = op.graph_id AND b.y = op.src WHERE op.dst <> 1 AND op.dst <> b.x
         AND (op.paren IS DISTINCT FROM ')' OR NOT EXISTS (SELECT 1 FROM sc WHERE sc.graph_id = op.graph_id AND sc.site = op.site AND NOT EXISTS (SELECT 1 FROM recurring.vb c WHERE c.graph_id = sc.graph_id AND c.y = sc.call AND c.x = b.x)))),
vd AS MATERIALIZED (SELECT n.graph_id, n.node AS y, m.node AS x FROM n JOIN n m USING (graph_id) ANTI JOIN vb ON vb.graph_id = n.graph_id AND vb.y = n.node AND vb.x = m.node)"""

PASSES = """
f1 AS MATERIALIZED (SELECT graph_id, src, dst FROM op WHERE paren IS DISTINCT FROM ')'),
{first},
f2 AS MATERIALIZED (SELECT DISTINCT op.graph_id, x.scc AS src, y.scc AS dst FROM op JOIN pscc x ON x.graph_id = op.graph_id AND x.node = op.src JOIN pscc y ON y.graph_id = op.graph_id AND y.node = op.dst WHERE op.paren IS DISTINCT FROM '(' AND x.scc <> y.scc),
n2 AS MATERIALIZED (SELECT DISTINCT graph_id, scc AS node FROM pscc),
{second},
tp AS MATERIALIZED (SELECT graph_id, p.node, p.scc AS first, q.scc AS cls FROM pscc p JOIN (SELECT graph_id, node AS scc_, scc FROM qscc) q USING (graph_id) WHERE p.scc = q.scc_)"""

PUSHDOWN = """
ps(graph_id, src, symbol, dst) USING KEY (graph_id, src, symbol, dst) AS (SELECT graph_id, CAST(0 AS BIGINT), node, CAST(1 AS BIGINT) FROM pd WHERE name = 'purchase' UNION SELECT graph_id, 1, back, 1 FROM calls UNION SELECT graph_id, 0, exit, 0 FROM procs
   UNION (SELECT f.graph_id, CAST(0 AS BIGINT), f.src, r.dst FROM flow f JOIN recurring.ps r ON r.graph_id = f.graph_id AND r.src = 0 AND r.symbol = f.dst
          UNION SELECT c.graph_id, 0, c.call, t.dst FROM calls c JOIN recurring.ps r ON r.graph_id = c.graph_id AND r.src = 0 AND r.symbol = c.entry JOIN recurring.ps t ON t.graph_id = c.graph_id AND t.src = r.dst AND t.symbol = c.back))"""

PRODUCT = """
lt(s, d, kind, letter) AS (VALUES (0, 0, 'all', NULL), (0, 1, 'only', 'click'), (1, 2, 'only', 'error'), (1, 2, 'only', 'purchase'), (2, 3, 'free', NULL), (3, 3, 'all', NULL)),
ut AS MATERIALIZED (SELECT DISTINCT a.graph_id, a.event AS s, b.event AS d FROM en a JOIN en b ON a.graph_id = b.graph_id AND b.node = a.node + 1 UNION SELECT graph_id, 'start', event FROM en WHERE node = 1),
uf AS (SELECT graph_id, event AS s FROM en SEMI JOIN (SELECT graph_id, last AS node FROM mx) USING (graph_id, node)),
mv AS MATERIALIZED (SELECT graph_id, us.s AS a, lt.s AS b, us.s AS c, lt.d AS d, 'free' AS kind, CAST(NULL AS VARCHAR) AS letter FROM (SELECT graph_id, s FROM ut UNION SELECT graph_id, d FROM ut) us, lt WHERE lt.kind = 'free'
       UNION ALL SELECT graph_id, ut.s, lt.s, ut.d, lt.d, 'only', ut.d FROM ut JOIN lt ON lt.kind = 'all' OR (lt.kind = 'only' AND lt.letter = ut.d)),
fw AS (SELECT DISTINCT graph_id, 'start' AS a, 0 AS b FROM en UNION SELECT graph_id, c, d FROM fw JOIN mv USING (graph_id, a, b)),
bw AS (SELECT graph_id, s AS c, 3 AS d FROM uf UNION SELECT graph_id, a, b FROM bw JOIN mv USING (graph_id, c, d)),
ok AS MATERIALIZED (SELECT graph_id, a, b FROM fw SEMI JOIN (SELECT graph_id, c AS a, d AS b FROM bw) USING (graph_id, a, b))"""

#: cn and ce: a graph for each node whose out-edges are cut; may: m1 can be reached from n before m2.
CUTS = """
cn AS MATERIALIZED (SELECT graph_id, n.node AS cut, m.node FROM n JOIN n m USING (graph_id)),
ce AS MATERIALIZED (SELECT e.graph_id, node AS cut, src, dst FROM e JOIN n ON n.graph_id = e.graph_id WHERE src <> node)"""
EITHER = """
may AS MATERIALIZED (SELECT graph_id, a AS n, b AS m1, cut AS m2 FROM cr SEMI JOIN (SELECT graph_id, src AS a FROM e GROUP BY ALL HAVING count(*) > 1) USING (graph_id, a) WHERE b <> cut),
ei AS MATERIALIZED (SELECT graph_id, n, m1, m2 FROM may SEMI JOIN (SELECT graph_id, n, m2 AS m1, m1 AS m2 FROM may) USING (graph_id, n, m1, m2))"""


def bits(names: dict[str, int], column: str = "event") -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + " ELSE 0 END"


def oracle_sql() -> dict[str, str]:
    from .program_queries import BITS, GRAVE

    types = f"\nty AS (SELECT graph_id, node, event, CAST({bits(BITS)} AS BIGINT) AS bit, CAST({bits(GRAVE)} AS BIGINT) AS grave FROM en)"
    before = "\nbf AS (SELECT graph_id, node AS a, dst AS b FROM n JOIN (SELECT graph_id, src AS node, dst FROM e) USING (graph_id, node) UNION SELECT graph_id, a, dst FROM bf JOIN (SELECT graph_id, src AS b, dst FROM e) USING (graph_id, b))"
    since = "\nsi AS (SELECT graph_id, src AS a, dst AS b FROM e UNION SELECT graph_id, a, dst FROM (SELECT * FROM si ANTI JOIN (SELECT graph_id, node AS b FROM en WHERE event = 'purchase') USING (graph_id, b)) JOIN (SELECT graph_id, src AS b, dst FROM e) USING (graph_id, b))"
    around = "\nar AS (SELECT DISTINCT graph_id, t.bit, CAST(1 AS BIGINT) AS node FROM en, (SELECT DISTINCT bit FROM ty) t UNION SELECT graph_id, bit, dst FROM (SELECT * FROM ar ANTI JOIN (SELECT graph_id, node, bit FROM ty) USING (graph_id, node, bit)) JOIN (SELECT graph_id, src AS node, dst FROM e) USING (graph_id, node))"
    away = "\ndi AS (SELECT graph_id, node, 0 AS k FROM n WHERE node = 1 UNION SELECT graph_id, dst, k + 1 FROM di JOIN (SELECT graph_id, src AS node, dst FROM e) USING (graph_id, node) WHERE k < 120)"
    out = {
        "dataflow_analysis": query(
            EVENTS, types, closure(), before, since, around, away,
            "\nreached AS (SELECT graph_id, b AS node FROM r WHERE a = 1)",
            "\nmiss AS (SELECT graph_id, node, sum(bit) AS missed FROM ar GROUP BY ALL)",
            select="""SELECT graph_id, n.node, CAST(coalesce(met, 0) AS BIGINT) AS met, CAST(CASE WHEN reached.node IS NULL THEN -1 ELSE 31 - coalesce(missed, 0) END AS BIGINT) AS always, CAST(coalesce(gravest, 0) AS BIGINT) AS gravest, CAST(steps AS BIGINT) AS steps
FROM n LEFT JOIN (SELECT graph_id, b AS node, bit_or(bit) AS met FROM bf JOIN (SELECT graph_id, node AS a, bit FROM ty) USING (graph_id, a) GROUP BY ALL) USING (graph_id, node)
LEFT JOIN (SELECT graph_id, b AS node, max(grave) AS gravest FROM si JOIN (SELECT graph_id, node AS a, grave FROM ty WHERE event <> 'purchase') USING (graph_id, a) GROUP BY ALL) USING (graph_id, node)
LEFT JOIN reached USING (graph_id, node) LEFT JOIN miss USING (graph_id, node) LEFT JOIN (SELECT graph_id, node, min(k) AS steps FROM di GROUP BY ALL) USING (graph_id, node)""",
        ),
        "live_events": query(EVENTS, types, closure(), select="SELECT graph_id, a AS node, bit_or(bit) AS meets FROM r JOIN (SELECT graph_id, node AS b, bit FROM ty) USING (graph_id, b) GROUP BY ALL"),
        "must_kill": query(EVENTS, PROGRAMS, KILLED, select="SELECT * FROM mk"),
        "strong_reaching_definitions": query(EVENTS, PROGRAMS, KILLED, STRONG, select="SELECT * FROM sr"),
        "sdg": query(EVENTS, PROGRAMS, SYSTEM, select="SELECT * FROM sys"),
        "sdg_slice": query(
            EVENTS, PROGRAMS, SYSTEM,
            "\nup AS (SELECT graph_id, node::VARCHAR AS node FROM pd WHERE name = 'purchase' UNION SELECT graph_id, src FROM up JOIN (SELECT graph_id, src, dst AS node FROM sys WHERE kind <> 'out') USING (graph_id, node))",
            "\ndown AS (SELECT * FROM up UNION SELECT graph_id, src FROM down JOIN (SELECT graph_id, src, dst AS node FROM sys WHERE kind NOT IN ('in', 'call')) USING (graph_id, node))",
            select="SELECT * FROM down",
        ),
    }
    folds = PASSES.format(first=closure("p", "n", "f1").lstrip(), second=closure("q", "n2", "f2").lstrip())
    both = "SELECT graph_id, m1, m2, n FROM af UNION SELECT graph_id, m2, m1, n FROM af"
    k = "graph_id, cut"
    cuts = (ORDERS, CUTS, dominance("c", "cn", "ce", k), EITHER)
    entry = "\nfav AS (SELECT graph_id, node AS x, CAST(1 AS BIGINT) AS b FROM n WHERE node <> 1 UNION SELECT graph_id, x, dst FROM fav JOIN (SELECT graph_id, src AS b, dst FROM e) USING (graph_id, b) WHERE dst <> x)"
    # Without the edges that lead to a dominator of their begin no cycle is left.
    forward = "\nfe AS MATERIALIZED (SELECT e.graph_id, src, dst FROM e SEMI JOIN (SELECT graph_id, b AS src FROM r WHERE a = 1) USING (graph_id, src) WHERE src <> dst AND EXISTS (SELECT 1 FROM fav WHERE fav.graph_id = e.graph_id AND fav.x = e.dst AND fav.b = e.src) AND dst <> 1)"
    slowest = """
ec AS (SELECT graph_id, src, dst, 1 + (src * 7 + dst * 3) % 32 AS cost FROM e),
wl AS (SELECT graph_id, node AS y, node AS x, CAST(0 AS BIGINT) AS steps FROM n UNION SELECT graph_id, src, x, steps + cost FROM wl JOIN (SELECT graph_id, src, dst AS y, cost FROM ec) USING (graph_id, y) SEMI JOIN (SELECT graph_id, y AS src, x FROM mdom) USING (graph_id, src, x) WHERE src <> x),
lo AS MATERIALIZED (SELECT graph_id, y, x, max(steps) AS steps FROM wl GROUP BY ALL),
nr AS (SELECT graph_id, y, min(steps) AS whole, arg_min(x, steps) AS x FROM lo WHERE y <> x GROUP BY ALL)"""
    walked = """
st AS (SELECT graph_id, src AS node, 0 AS input, min(dst) AS dst FROM e GROUP BY ALL UNION ALL SELECT graph_id, src, 1, max(dst) FROM e GROUP BY ALL),
wa AS (SELECT DISTINCT graph_id, CAST(unnest([0, 1]) AS INTEGER) AS input, CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS pos FROM n UNION SELECT graph_id, input, dst, pos + 1 FROM wa JOIN st USING (graph_id, input, node) WHERE pos < 250),
vi AS (SELECT graph_id, input, node, min(pos) AS pos, count(*) > 1 AS again FROM wa GROUP BY ALL),
ru AS MATERIALIZED (SELECT graph_id, input, pos, node, CASE WHEN pos >= min(pos) FILTER (WHERE again) OVER w THEN max(pos) OVER w + 1 - min(pos) FILTER (WHERE again) OVER w END AS period FROM vi WINDOW w AS (PARTITION BY graph_id, input))"""
    seen = """
ob AS MATERIALIZED (SELECT graph_id, input, string_agg(node, ',' ORDER BY pos) AS word, coalesce(string_agg(node, ',' ORDER BY pos) FILTER (WHERE period IS NULL), '') AS before, count(period) > 0 AS shows FROM ru SEMI JOIN (SELECT graph_id, node FROM en WHERE event = 'view') USING (graph_id, node) GROUP BY ALL),
sides AS (SELECT graph_id, input, coalesce(word, '') AS word, coalesce(before, '') AS before, coalesce(shows, false) AS shows, loops FROM (SELECT graph_id, input, count(period) > 0 AS loops FROM ru GROUP BY ALL) LEFT JOIN ob USING (graph_id, input))"""
    told = """SELECT a.graph_id, a.input AS a, b.input AS b, a.word = b.word AND a.before = b.before AS equal,
a.word = b.word AND a.before = b.before OR a.loops AND NOT a.shows AND starts_with(b.word || ',', CASE WHEN a.word = '' THEN '' ELSE a.word || ',' END) OR b.loops AND NOT b.shows AND starts_with(a.word || ',', CASE WHEN b.word = '' THEN '' ELSE b.word || ',' END) AS weakly,
NOT EXISTS (SELECT 1 FROM ru x JOIN ru y ON x.graph_id = y.graph_id AND x.node = y.node JOIN en ON en.graph_id = x.graph_id AND en.node = x.node AND event = 'view' WHERE x.graph_id = a.graph_id AND x.input = 0 AND y.input = 1 AND (x.pos <> y.pos OR x.period <> y.period)) AS timed
FROM sides a JOIN sides b ON a.graph_id = b.graph_id AND a.input < b.input"""
    out |= {
        "same_level_components": query(ORDERS, PARENS, BALANCED, select="SELECT graph_id, x.a AS node, min(x.b) AS scc, count(*) AS size FROM ba x JOIN ba y USING (graph_id) WHERE x.a = y.b AND x.b = y.a GROUP BY ALL"),
        "two_pass_folding": query(ORDERS, PARENS, folds, select="SELECT * FROM tp"),
        "folded_graph": query(ORDERS, PARENS, folds, select="SELECT DISTINCT e.graph_id, x.cls AS src, y.cls AS dst FROM e JOIN tp x ON x.graph_id = e.graph_id AND x.node = e.src JOIN tp y ON y.graph_id = e.graph_id AND y.node = e.dst WHERE x.cls <> y.cls"),
        "valid_dominance": query(ORDERS, PARENS, VALID, select="SELECT * FROM vd"),
        "valid_immediate_dominance": query(ORDERS, PARENS, VALID, select="SELECT graph_id, y, x FROM vd WHERE y <> x AND NOT EXISTS (SELECT 1 FROM vd a JOIN vd b ON a.graph_id = b.graph_id AND a.x = b.y WHERE a.graph_id = vd.graph_id AND a.y = vd.y AND b.x = vd.x AND a.x <> a.y AND b.x <> b.y)"),
        "pushdown_saturation": query(EVENTS, PROGRAMS, PUSHDOWN, select="SELECT * FROM ps"),
        "automata_product": query(EVENTS, PRODUCT, select="SELECT graph_id, a || ':' || b AS src, c || ':' || d AS dst, kind, letter FROM mv SEMI JOIN ok USING (graph_id, a, b) SEMI JOIN (SELECT graph_id, a AS c, b AS d FROM ok) USING (graph_id, c, d)"),
        "order_wod": query(*cuts, f"\naf AS (SELECT DISTINCT ei.graph_id, n, m1, m2 FROM ei JOIN e ON e.graph_id = ei.graph_id AND e.src = ei.n SEMI JOIN cmdom d ON d.graph_id = e.graph_id AND d.cut = m2 AND d.y = e.dst AND d.x = m1)", select=both),
        "order_wod_reachable": query(*cuts, closure(), "\naf AS (SELECT DISTINCT ei.graph_id, n, m1, m2 FROM ei JOIN e ON e.graph_id = ei.graph_id AND e.src = ei.n SEMI JOIN r ON r.graph_id = e.graph_id AND r.a = e.dst AND r.b = m1 ANTI JOIN cr ON cr.graph_id = e.graph_id AND cr.cut = m1 AND cr.a = e.dst AND cr.b = m2)", select=both),
        "reducible": query(EVENTS, closure(), entry, forward, "\nfr AS (SELECT graph_id, src AS a, dst AS b FROM fe UNION SELECT graph_id, a, dst FROM fr JOIN (SELECT graph_id, src AS b, dst FROM fe) USING (graph_id, b))", select="SELECT graph_id, graph_id NOT IN (SELECT graph_id FROM fr WHERE a = b) AS reducible FROM (SELECT DISTINCT graph_id FROM n)"),
        "dominator_forest": query(EVENTS, dominance(), immediate("sdom"), select="SELECT graph_id, y, x FROM imm"),
        "forest_nticd": query(EVENTS, dominance(), cd("res", "sdom"), select="SELECT * FROM res"),
        "order_forest_nticd": query(ORDERS, dominance(), cd("res", "sdom"), select="SELECT * FROM res"),
        "forest_lca": query(
            EVENTS, dominance(), "\ncm AS MATERIALIZED (SELECT e.graph_id, src AS a, dst AS b, p.x AS lca FROM e JOIN sdom p ON p.graph_id = e.graph_id AND p.y = src JOIN sdom q ON q.graph_id = e.graph_id AND q.y = dst AND q.x = p.x)",
            select="SELECT * FROM cm WHERE NOT EXISTS (SELECT 1 FROM cm o WHERE o.graph_id = cm.graph_id AND o.a = cm.a AND o.b = cm.b AND NOT EXISTS (SELECT 1 FROM sdom d WHERE d.graph_id = cm.graph_id AND d.y = cm.lca AND d.x = o.lca))",
        ),
        "timing_correction": query(ORDERS, dominance(), slowest, select="""SELECT e.graph_id, e.src, e.dst, CAST(coalesce(nr.whole - lo.steps, e.cost) AS BIGINT) AS cost FROM ec e LEFT JOIN nr ON nr.graph_id = e.graph_id AND nr.y = e.src
LEFT JOIN lo ON lo.graph_id = e.graph_id AND lo.y = e.dst AND lo.x = nr.x"""),
        "corrected_timing_dominance": query(
            ORDERS, dominance(), slowest, "\nnc AS MATERIALIZED (SELECT e.graph_id, e.src, e.dst, coalesce(nr.whole - lo.steps, e.cost) AS cost FROM ec e LEFT JOIN nr ON nr.graph_id = e.graph_id AND nr.y = e.src LEFT JOIN lo ON lo.graph_id = e.graph_id AND lo.y = e.dst AND lo.x = nr.x)",
            "\nwc AS (SELECT graph_id, node AS y, node AS x, CAST(0 AS BIGINT) AS steps FROM n UNION SELECT graph_id, src, x, steps + cost FROM wc JOIN (SELECT graph_id, src, dst AS y, cost FROM nc) USING (graph_id, y) SEMI JOIN (SELECT graph_id, y AS src, x FROM mdom) USING (graph_id, src, x) WHERE src <> x)",
            select="SELECT graph_id, y, x FROM wc GROUP BY ALL HAVING min(steps) = max(steps)",
        ),
        "runs": query(EVENTS, walked, select="SELECT graph_id, input, pos, node, period FROM ru"),
        "low_equivalence": query(EVENTS, walked, seen, select=told),
        "balanced_reachability": query(EVENTS, PARENS.replace("src + 2", "src + 3"), BALANCED, select="SELECT * FROM ba"),
        "summary_edges": query(EVENTS, SUMMARIES, select="SELECT * FROM sm"),
        "summary_slice": query(
            EVENTS, SUMMARIES, EXIT, "\nks AS MATERIALIZED (SELECT * FROM kd UNION ALL SELECT graph_id, src, dst, 'summary' FROM sm)",
            "\nup AS (SELECT graph_id, node FROM exits UNION SELECT graph_id, src FROM up JOIN (SELECT graph_id, src, dst AS node FROM ks WHERE kind <> 'out') USING (graph_id, node))",
            "\ndown AS (SELECT * FROM up UNION SELECT graph_id, src FROM down JOIN (SELECT graph_id, src, dst AS node FROM ks WHERE kind <> 'in') USING (graph_id, node))",
            select="SELECT * FROM down",
        ),
    }
    return out
