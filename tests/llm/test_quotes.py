import random
import re

from tributary.llm import quotes as Q

MARK = re.compile(r"^(?:[ \t]*>)+")


def normal(s):
    return re.sub(r"\s+", " ", s).strip(" ").lower()


def parse(text):
    body, runs = [], []
    for line in re.split(r"\r?\n", text or ""):
        m = MARK.match(line)
        n = m[0].count(">") if m else 0
        plain = re.sub(MARK.pattern + "[ \t]?", "", line)
        if not n:
            body.append(line)
        if runs and runs[-1][0] == n:
            runs[-1][1].append(plain)
        else:
            runs.append((n, [plain]))
    return re.sub(r"^(?:[ \t]*\n)+|\s+$", "", "\n".join(body)), [(n, "\n".join(ls)) for n, ls in runs if normal("\n".join(ls))]


def keys(text):
    return [(0, normal(text))] + [(1, normal(x)) for x in text.split("\n") if normal(x)]


def brute(rows):
    """Rows (conv, turn, role, text) with unique turns."""
    data = {(c, t): (r, *parse(x)) for c, t, r, x in rows}
    first = {}
    for (c, t), (_, _, runs) in sorted(data.items()):
        for n, p in runs:
            if not n:
                for _, k in keys(p):
                    first.setdefault((c, k), t)
    out, reply = {}, {}
    for (c, t), (role, body, runs) in data.items():
        found = [(n, rank, i, first[c, k]) for i, (n, p) in enumerate(runs) if n for rank, k in keys(p) if first.get((c, k), t) < t]
        reply[c, t] = min(found)[3] if found else None
        out[c, t] = [role, body, sum(n > 0 for n, _ in runs), len({f[2] for f in found})]
    for c, t in out:
        depth, at = 0, t
        while reply[c, at] is not None:
            at, depth = reply[c, at], depth + 1
        out[c, t] += [reply[c, t], at, depth]
    for c in {c for c, _ in out}:
        for i, k in enumerate(sorted((k for k in out if k[0] == c), key=lambda k: (out[k][5], k[1]))):
            out[k].append(i)
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, row string, place int")


def result(df):
    return {(r.conv_id, r.turn): [r.role, r.body, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth, r.position] for r in df.collect()}


def test_matches_brute_force(spark, monkeypatch):
    r = random.Random(7)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(r.randint(1, 40)):
            lines = []
            for _ in range(r.randint(0, 3)):
                if texts and r.random() < 0.7:
                    src = r.choice(texts).split("\n")
                    a = r.randrange(len(src))
                    lines += [r.choice(["> ", ">", " > ", ">> "]) + x.upper() + "  " for x in src[a : a + r.randint(1, 4)]]
                lines += [f"word{r.randrange(60)}  said  {r.randrange(3)}" for _ in range(r.randint(0, 3))]
            texts.append("\n".join(lines))
            rows.append((conv, turn * 3, r.choice(["user", "assistant"]), r.choice(["", "\n"]) + texts[-1]))
    rows += [(99, 0, "user", None), (99, 1, "user", "")]
    monkeypatch.setattr(Q, "BLOCK", 8)
    linked = Q.link_quotes(made(spark, rows).repartition(4))
    got, want = result(linked), brute(rows)
    assert got == want and sum(v[4] is not None for v in want.values()) > 30
    chunks = {(x.conv_id, x.chunk): [(m.role, m.body) for m in x.messages] for x in Q.conversations(linked, 5).collect()}
    for c in {c for c, _ in want}:
        order = sorted((k for k in want if k[0] == c), key=lambda k: want[k][7])
        assert sum((chunks[c, i] for i in range((len(order) + 4) // 5)), []) == [(want[k][0], want[k][1]) for k in order]


def test_nested_levels(spark):
    rows = [(1, 0, "a", "first words"), (1, 1, "b", "> first words\nsecond words"), (1, 2, "c", ">> first words\n> second words\nthird"), (1, 3, "d", "other"), (1, 4, "e", "> unknown\nx")]
    got = result(Q.link_quotes(made(spark, rows)))
    assert [got[1, t][4:7] for t in range(5)] == [[None, 0, 0], [0, 0, 1], [1, 0, 2], [None, 3, 0], [None, 4, 0]]
    assert got[1, 2][1:4] == ["third", 2, 2]


def test_nulls_ties_and_empty(spark):
    rows = [(None, 1, "a", "x"), (1, None, "a", "> x"), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "> x"), (1, 1, None, "> x")]
    got = Q.link_quotes(made(spark, rows)).collect()
    assert len(got) == 6 and sorted(r.position for r in got if r.position is not None) == [0, 1, 2, 3]
    assert [r.reply_to for r in got if r.turn == 1 and r.conv_id == 1] == [0]
    assert Q.link_quotes(made(spark, [])).count() == 0


def test_many_lines(spark):
    rows = [(1, 0, "a", "\n".join(f"line {i}" for i in range(20000))), (1, 1, "b", "\n".join(f"> line {i}\nno" for i in range(5000)))]
    got = result(Q.link_quotes(made(spark, rows)))
    assert got[1, 1][2:5] == [5000, 5000, 0]


def test_control_characters_are_kept(spark):
    rows = [("c", 0, "user", "a\x1eb\x1fc\n > no quote > of it"), ("c", 1, "assistant", "> a\x1eb\x1fc\nyes\x1e")]
    got = {r.turn: r for r in Q.link_quotes(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert got[0].body == "a\x1eb\x1fc" and got[1].body == "yes\x1e" and got[1].reply_to == 0 and got[1].n_linked == 1
