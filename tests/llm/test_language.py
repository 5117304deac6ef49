import math
import random
from collections import Counter

from brute import documents, empty

from tributary.llm import language as L

D = "/root/testdata/sf0.01"


def test_finds_wrong_and_missing_tags(spark):
    """Tags are changed for a tenth of the documents and missing from another; the text and the rest set them right."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    spoilt = docs.selectExpr("doc_id", "text", "source", "lang as truth", "case when doc_id % 10 = 3 then 'de' when doc_id % 10 = 7 then null else lang end as lang", "'x' as host", "1 as score")
    got = L.identify(L.from_documents(spoilt)).join(spoilt.select("doc_id", "truth", "lang"), "doc_id").toPandas()
    lang = got.iloc[:, 1]
    assert (lang == got["truth"]).mean() > 0.97
    assert got["accepted"].mean() > 0.97


def trigrams(text):
    b = [x + 32 if 65 <= x < 91 else x if 97 <= x < 123 or x > 127 else 32 for x in (text or "").encode()]
    return Counter((x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D & 0xFFFFFFFF) >> 18 for x, y, z in zip(b, b[1:], b[2:]) if y != 32)


def fused(rows):
    """The fusion in plain loops: of (text, declared, suffix, host, domain) the language, its confidence and the text's own."""
    names = sorted({r[1] for r in rows if r[1]})
    grams = [trigrams(r[0]) for r in rows]
    seen = {x: Counter() for x in names}
    for r, g in zip(rows, grams):
        if r[1]:
            seen[r[1]].update(g)
    ll, votes = [], []
    for r, g in zip(rows, grams):
        score = []
        for x in names:
            own = g if r[1] == x else Counter()
            total = 0.5 * L.FEATURES + sum(seen[x].values()) - sum(own.values())
            score.append(L.TEMPER * sum(n * math.log((seen[x][f] + 0.5 - own[f]) / total) for f, n in g.items()))
        ll.append(score)
        votes.append(names[score.index(max(score))] if g else None)
    overall, out = Counter(v for v in votes if v), []

    def counts(key, value, own):
        c = Counter(v for r, v in zip(rows, votes) if v and r[key] == value) if value is not None else Counter()
        return (c - Counter([own] if own else []), bool(c))

    for r, v, score in zip(rows, votes, ll):
        p = {x: (overall[x] + 1) / (sum(overall.values()) + len(names)) for x in names}
        for key in (4, 3):
            c, any_ = counts(key, r[key], v)
            if any_:
                p = {x: (c[x] + L.SMOOTH * p[x]) / (sum(c.values()) + L.SMOOTH) for x in names}
        total = [s + math.log(p[x]) for s, x in zip(score, names)]
        for key in (1, 2):
            c, any_ = counts(key, r[key], v)
            if any_:
                total = [t + math.log((c[x] + 0.5) / (overall[x] - (x == v) + 0.5 * (len(names) + 1))) for t, x in zip(total, names)]
        best = max(total)
        out.append((names[total.index(best)], 1 / sum(math.exp(t - best) for t in total), v) if sum(trigrams(r[0]).values()) else ("und", 0.0, "und"))
    return out


def test_fusion_matches_brute_force(spark):
    r = random.Random(6)
    words = {"en": ["the", "and", "that", "house", "with"], "de": ["der", "und", "dass", "haus", "mit"], "fr": ["le", "et", "que", "maison", "avec"]}
    rows = [(None, "en", ".com", "h1", "d"), ("", None, None, None, None), ("12 3", "de", ".de", "h2", "d"), ("x" * 5000, "fr", None, "h1", "d")]
    for _ in range(120):
        own = r.choice(list(words))
        text = " ".join(r.choice(words[own if r.random() < 0.8 else r.choice(list(words))]) for _ in range(r.choice([1, 2, 5, 40])))
        host = r.choice([None, f"h{own}", "h1", "h2"])
        rows.append((text, r.choice([own, own, "en", None]), r.choice([None, ".com", f".{own}"]), host, "d" if host else None))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, declared string, suffix string, host string, domain string")
    got = {x.doc_id: x for x in L.identify(df).collect()}
    for i, (lang, confidence, own) in enumerate(fused(rows)):
        x = got[i]
        assert (x.lang, x.text_lang) == (lang, own), (i, rows[i], x)
        assert abs(x.confidence - confidence) < 1e-9 and x.accepted == (confidence >= L.ACCEPT)


def test_evidence_of_documents(spark):
    docs = spark.createDataFrame([(1, "see a.b@mail.example.fr now", "en-US", "src7"), (2, "no address", None, "a.b.example.org"), (3, None, "??", None)], "doc_id long, text string, lang string, source string")
    got = [(x.declared, x.suffix, x.host, x.domain) for x in L.from_documents(docs).orderBy("doc_id").collect()]
    assert got == [("en", ".fr", "src7", "src"), (None, None, "a.b.example.org", "example.org"), (None, None, None, None)]


def test_pages(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 3}.example.{s}/{s}/x", f'<html lang="{s}-XX"><script>var the;</script><p>{t}</p>') for i in range(40) for s, t in [("en", "the cat and the dog of that house"), ("de", "der hund und die katze ist nicht da")]], "page_id long, url string, html string"
    )
    rows = L.from_pages(pages)
    r = rows.first()
    assert (r.declared, r.suffix, r.host, r.domain) == ("en", "/en", "h0.example.en", "example.en") and "var" not in r.text
    got = L.identify(rows).groupBy("lang").count().collect()
    assert {(x.lang, x["count"]) for x in got} == {("en", 40), ("de", 40)}


def test_nulls_and_empty(spark):
    docs, rows = documents(spark)
    got = {r.doc_id: r for r in L.identify(L.from_documents(docs)).collect()}
    assert len(got) == len(rows) and not got[0].accepted and got[0].lang == "und" and not got[3].accepted
    assert L.keep_identified(docs).columns == docs.columns
    none = spark.createDataFrame([(1, "abc def", None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [r.accepted for r in L.identify(L.from_documents(none)).collect()] == [False, False]
    assert L.identify(L.from_documents(empty(spark))).count() == 0
    repeated = spark.createDataFrame([(1, "abc def", "en", None)] * 3, "doc_id long, text string, lang string, source string")
    assert [r.lang for r in L.identify(L.from_documents(repeated)).collect()] == ["en"] * 3


def test_languages_in_blocks(spark, monkeypatch):
    """More languages than a block of the model has: each is still told, as with one block."""
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(300)
    rows = L.from_documents(docs)
    want = sorted(map(tuple, L.identify(rows).collect()))
    monkeypatch.setattr(L, "LANGUAGES", 2)
    got = sorted(map(tuple, L.identify(rows).collect()))
    assert len({x[1] for x in want} - {"und"}) == 4
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_many_languages(spark):
    """Seventy languages, each with words of its own."""
    rows = [(i * 10 + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7 + j) % 26)}{chr(97 + k % 26)}" for j in range(60)), f"{chr(97 + i % 26)}{chr(97 + i // 26)}", None) for i in range(70) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang for r in L.identify(L.from_documents(docs)).collect()}
    assert all(got[x[0]] == x[2] for x in rows)
