import hashlib
import re

from brute import documents, empty

from tributary.llm import pii as P

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in RULES:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "no data here 12 3.4", "mail me a.b+c@x-y.example.org, or b@c.d.e_f@g.h now", "@ @@ a@b c@d.", "1.2.3.4 256.1.1.1 0001.02.3.255 1.2.3.4.5.6.7.8 99999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111111111",
    "+1 (476) 555-6291 +123 +1-2-3-4-5-6-7-8 tel +44 20 7946 0958.", "\U0001f600é a@b.co \U0001f600 +12345678", "5500005555555559\n5500 0055 5555 5559x@y.z", "x" * 3000 + "@y.z", "1 " * 6000, "a@b" + ".c" * 4000, "(476) 555-6291 bob (at) example (dot) com", "+" + "1 " * 4000, "'; \\ a@b.c",
]


def test_base_spans_match_the_patterns(spark):
    rows = [(i, t, "x", "y", len(t or ""), "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, spans string")
    got = {r.doc_id: r for r in P.report(docs).collect()}
    for i, t in enumerate(TEXTS):
        base = brute(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (i, line, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in P.KINDS]
        assert {x for x in line.split(",") if x} <= set(r.spans.split(","))


def test_base_spans_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.base_sha256 for r in P.report(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text)).encode()).hexdigest()


def test_trees_agree_with_their_columns(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [({f: r.randrange(n) for f, n in P.BINS.items()}, float(r.random() < 0.5), 1.0) for _ in range(300)]
    rows = [(x, 3.0 * (x["n_digits"] > 9 and x["kind"] == 2), n) for x, _, n in rows]
    model = P.boost(rows, rows, rounds=8, precision=0.7)
    df = spark.createDataFrame([(x,) for x, _, _ in rows], f"f struct<{','.join(f'{k}:int' for k in P.BINS)}>")
    for (x, _, _), got in zip(rows, df.select(model.column(F.col("f")).alias("s")).collect()):
        assert abs(model.score(x) - got.s) < 1e-9
    assert model.thresholds[2] is not None and model.thresholds[0] is None


def planted(n=1500):
    """Texts with personal data in base forms and, in some, in other notations, or decoys: (id, text, spans to add)."""
    import random

    r = random.Random(11)

    def card(ok):
        body = "".join(r.choice("0123456789") for _ in range(15))
        return next(body + c for c in "0123456789" if luhn(body + c) == ok)

    def groups(number, by):
        return by.join(number[i : i + 4] for i in range(0, 16, 4))

    out = []
    for i in range(n):
        email, ip = f"user{r.randrange(999)}@mail{r.randrange(99)}.example.com", ".".join(str(r.randrange(256)) for _ in range(4))
        area, line = f"({r.randrange(200, 999)})", f"{r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
        cue = r.choice(["write to", "server", "call", "card", "it was", "and then", "see"])
        base = [f"{cue} {email}", f"{cue} {ip} is up", f"{cue} +1 {area} {line} now", f"{cue} {groups(card(True), r.choice(['', ' ', '-']))} paid", f"{cue} {card(False)} sent", f"{cue} {r.randrange(300, 999)}.{r.randrange(99)}.{r.randrange(99)}.1 out", "nothing in it 12 345"]
        more = [("email", email.replace("@", " (at) ")), ("ip", ip.replace(".", "[.]")), ("phone", f"{area} {line}"), ("card", groups(card(True), "."))]
        decoys = [groups(card(False), "."), "1,2,3,4", f"{r.randrange(300, 999)}[.]1[.]2[.]3", "2024-05-17", "meet @ 5.30"]
        text, add = r.choice(base), set()
        if i % 5 == 0:
            kind, x = r.choice(more)
            add, text = {(kind, len(text) + 5, len(text) + 5 + len(x))}, f"{text} and {x} there"
        elif i % 5 == 1:
            text = f"{text} and {r.choice(decoys)} there"
        out.append((i, text, add))
    return out


def test_other_notations_are_added_and_decoys_are_not(spark):
    rows = planted()
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in P.report(docs).collect()}
    right = wrong = missed = 0
    for i, text, add in rows:
        spans = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x)}
        more = spans - set(brute(text))
        assert got[i].n_added == len(more) and set(brute(text)) <= spans
        right, wrong, missed = right + len(more & add), wrong + len(more - add), missed + len(add - more)
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.9, (right, wrong, missed)


def test_added_spans_on_documents(spark):
    """What the model adds to documents is sound: numbers that the base match swallowed with their neighbours."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts, n = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in P.report(docs).where("n_added > 0").collect():
        for k, a, b in (x.split(":") for x in r.spans.split(",")):
            if (k, int(a), int(b)) not in brute(texts[r.doc_id]):
                d, n = re.sub("[^0-9]", "", texts[r.doc_id][int(a) : int(b)]), n + 1
                assert luhn(d) and 13 <= len(d) <= 19 if k == "card" else k == "phone" and 8 <= len(d) <= 15
    assert n > 0


def test_long_texts_and_clashing_names(spark):
    long = " ".join(f"u{i}@m{i}.example.com" for i in range(60_000))  # 1.5 MB
    rows = [(None, long, "p", "k", 1), (None, "a@b.co", "p", "k", 2), (7, "a@b.co", "p", "k", 3), (7, "a@b.co", "p", "k", 3), (7, "clean", "p", "k", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, key string, _row int")
    got = P.redact(docs)
    assert got.columns == docs.columns
    got = sorted(tuple(r)[1:] for r in got.collect())
    assert got == sorted([(" ".join(["<EMAIL>"] * 60_000), "p", "k", 1), ("<EMAIL>", "p", "k", 2), ("<EMAIL>", "p", "k", 3), ("<EMAIL>", "p", "k", 3), ("clean", "p", "k", 4)])
    assert sorted(r.n_email for r in P.report(docs).collect()) == [0, 1, 1, 1, 60_000]


def test_redaction(spark):
    rows = [(1, "a@b.co and é +1 (476) 555-6291.", 31), (2, "nothing", 7), (3, None, None), (4, "+12345678@x.yz", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.redact(docs).collect()}
    assert got[1] == ("<EMAIL> and é <PHONE>.", 22) and got[2] == ("nothing", 7) and got[3] == (None, None) and got[4] == ("<EMAIL>", 7)
    assert P.redact(docs).columns == docs.columns
    assert P.redact(empty(spark)).count() == 0 and P.report(empty(spark)).count() == 0
    assert P.report(documents(spark)[0]).count() == 60


def runs(n=900):
    """Texts with long runs: (id, text, the run's span if it is a secret)."""
    import random

    r = random.Random(5)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    out = []
    for i in range(n):
        head = r.choice(["we saw", "été: oui", "then", "in short"])
        run = hexes(40)
        before, secret = [(' token = "', True), (" api_key: '", True), (' passwd="', True), (" commit ", False), (" under ", False), (" ", False)][i % 6]
        if i % 60 == 2:
            before = ' bearer = "'  # the labels don't know it
        if i % 6 == 5:
            run = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))
        text = f"{head}{before}{run}" + (before[-1] if secret else "") + " and on."
        at = len(head) + len(before)
        out.append((i, text, {("secret", at, at + len(run))} if secret else set()))
    return out


def test_secrets_are_told_by_form_and_context(spark):
    """Names of credentials label runs; the model, which sees none, also takes those with a name it doesn't know, and
    leaves hashes of the same form that nothing is assigned to, where the form alone (sound) would take them."""
    rows = runs()
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    got = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)} for r in P.report(docs, secrets=True).collect()}
    right = sum(len(got[i] & want) for i, _, want in rows)
    assert right >= 0.95 * sum(len(want) for _, _, want in rows) and right >= 0.95 * sum(map(len, got.values()))
    found = P.candidates(docs, secrets=True)
    model = P.train(found)

    def used(t):
        return set() if t.left is None else {t.feature} | used(t.left) | used(t.right)

    assert "cue" in set().union(*map(used, model.trees))
    decoys = found.where(f"kind = {P.SECRET} and f.sound = 1 and f.cue = 0 and free")
    assert decoys.count() >= 250 and decoys.where(model.takes(decoys["f"])).count() == 0
    assert P.report(docs).where("n_added > 0").count() == 0


def test_secrets_of_documents(spark):
    """Every run that a credential's name is assigned to is found, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts, right, wrong, want = {r.doc_id: r.text or "" for r in docs.collect()}, 0, 0, 0
    name = re.compile(r"(?i)(token|secret|password|api_key)\s*[=:]\s*[\"']([A-Za-z0-9_+/=-]{16,})")
    want = sum(len(name.findall(t)) for t in texts.values())
    for r in P.report(docs, secrets=True).where("n_added > 0").collect():
        for k, a, b in (x.split(":") for x in r.spans.split(",")):
            if k == "secret":
                hit = any(m.span(2) == (int(a), int(b)) for m in name.finditer(texts[r.doc_id]))
                right, wrong = right + hit, wrong + (not hit)
    assert want > 100 and right >= 0.95 * want and wrong <= 0.1 * right, (right, wrong, want)


def test_labels_are_not_features(spark):
    """Numbers of the right form that a failing match has swallowed are not learned from; the failing match itself is wrong."""
    rows = [(1, "4111 1111 1111 1111 2222 3333 x"), (2, "4111111111111112 x"), (3, "4111111111111111 x"), (4, "(476) 555-6291 x")]
    got = P.candidates(spark.createDataFrame(rows, "doc_id long, text string")).where("kind in (2, 3)").selectExpr("doc_id", "kind", "loose", "f.sound as sound", "label").collect()
    assert {r.label for r in got if r.doc_id == 1 and r.kind == 2 and r.loose and r.sound} == {None}
    assert {r.label for r in got if r.doc_id == 2 and r.kind == 2} == {0}
    assert {r.label for r in got if r.doc_id == 3 and r.kind == 2} == {1}
    assert {r.label for r in got if r.doc_id == 4 and r.kind == 3} == {None}


def test_redacts_secrets(spark):
    rows = [(x[0], x[1], len(x[1])) for x in runs(240)] + [(1000, None, None), (1001, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.redact(docs, secrets=True).collect()}
    for i, text, want in runs(240):
        new = text
        for _, a, b in want:
            new = text[:a] + "<SECRET>" + text[b:]
        assert got[i] == (new, len(new))
    assert got[1000] == (None, None) and got[1001] == ("", 0)
    assert P.redact(empty(spark), secrets=True).count() == 0


def test_long_texts_of_secrets(spark):
    """Texts above 1 MB: many secrets, one run without end, runs that are a character too short; repeated and null ids, clashing names."""
    runs_ = (hashlib.sha1(str(i).encode()).hexdigest() for i in range(20_100))
    runs_ = [x for x in runs_ if not brute(x)][:20_000]  # a run that meets a base span, as a card in it, isn't added
    many = " ".join(f'token = "{x}"' for x in runs_)
    short = " ".join("abcdefghijklmn1" for _ in range(80_000))
    rows = [(1, many, "s"), (1, many, "s"), (None, many, "t"), (2, "x" * 1_500_000 + " 1", "u"), (3, short, "v"), (4, "a@b.co", None)]
    rows += [(10 + i, f'see token = "{hashlib.sha1(b"%d" % i).hexdigest()}"', "w") for i in range(50)]
    plain = " and then it goes on as it did before: ".join(["abcdefghijklmnopqrstuvwx"] * 100)  # runs to learn from that are none
    rows += [(100 + i, plain, "p") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = P.redact(docs, secrets=True)
    assert got.columns == docs.columns
    done = " ".join(['token = "<SECRET>"'] * 20_000)
    want = [(1, done, "s"), (1, done, "s"), (None, done, "t"), (2, "x" * 1_500_000 + " 1", "u"), (3, short, "v"), (4, "<EMAIL>", None)]
    want += [(10 + i, 'see token = "<SECRET>"', "w") for i in range(50)]
    want += [(100 + i, plain, "p") for i in range(60)]
    # What the run without end is taken for isn't defined here: it is unlike all that was learned from.
    got, rows_2 = [tuple(r) for r in got.collect()], {(2, "x" * 1_500_000 + " 1", "u"), (2, "<SECRET> 1", "u")}
    assert len(set(got) & rows_2) == 1
    assert sorted(map(str, set(got) - rows_2)) == sorted(map(str, set(want) - rows_2)) and len(got) == len(want)
