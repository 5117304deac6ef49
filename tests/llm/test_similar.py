import random

from brute import AZ, SPACE, documents, empty

from tributary.llm import similar as S


def shingles(text):
    w = SPACE.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def edited(r, text, share):
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


def made(seed=8):
    """Originals, copies with a few words changed, and unlike documents that share a passage."""
    r = random.Random(seed)
    some = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage, rows = some(60), []
    for i in range(40):
        rows.append((i, some(r.randint(80, 600))))
    for i in range(60):
        rows.append((100 + i, edited(r, rows[i % 40][1], 0.012)))
    for i in range(60):
        rows.append((300 + i, some(60) + " " + passage + " " + some(80)))
    return rows


def test_finds_similar_documents(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: shingles(t) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(min(r.a, r.b), max(r.a, r.b)): r.similarity for r in S.similar_pairs(docs).collect()}
    assert set(got) <= near and all(abs(v - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-9 for (a, b), v in got.items())
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    want = {i for i in sets if find(i) == i}
    assert len(near) > 40 and kept == want
    assert set(range(300, 360)) <= kept


def test_awkward_documents(spark):
    docs, rows = documents(spark)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert S.keep_one(empty(spark)).count() == 0
    text = " ".join(f"w{i}" for i in range(90))
    nulls = spark.createDataFrame([(None, text), (None, None), (3, text), (3, text), (5, text + " z"), (7, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in S.keep_one(nulls).collect()) == ["3", "3", "7", "None", "None"]


def links(sets):
    """The smallest id of each document's component, over all pairs."""
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i for i in sets if find(i) == i}


def exactly(spark, rows):
    """The kept ids are those of all pairs compared; SimHash may link more, but not of these texts."""
    sets = {i: shingles(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in S.keep_one(docs).collect()} == links(sets)
    return sets


def test_third_document_quotes_both(spark):
    """Whatever a pair shares, a smaller id that is unlike both has, too."""
    r = random.Random(3)
    rows = []
    for k in range(30):
        text = " ".join(f"w{r.randrange(3000)}" for _ in range(120))
        rows += [(k, text + " " + " ".join(f"v{r.randrange(3000)}" for _ in range(200))), (100 + k, text), (200 + k, edited(r, text, 0.02))]
    sets = exactly(spark, rows)
    assert len(links(sets)) < 75


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    test_third_document_quotes_both(spark)


def test_short_and_few_words(spark):
    """One word added to texts of 10 or 20 words, and edits of texts over few words."""
    r = random.Random(5)
    rows = []
    for k in range(40):
        text = " ".join(f"w{r.randrange(3000)}" for _ in range(10 if k % 2 else 20))
        rows += [(k, text), (100 + k, text + " more")]
    for k in range(20):
        text = [f"x{r.randrange(3 + k % 4)}" for _ in range(300)]
        rows += [(200 + k, " ".join(text)), (300 + k, " ".join([*text[:150], "new", *text[151:]]))]
    sets = {i: shingles(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    assert kept <= links(sets) and not {100 + k for k in range(40)} & kept
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in S.similar_pairs(docs).collect()}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in found)


def test_bits_lose_no_pair():
    r = random.Random(7)
    for _ in range(300):
        n = r.randint(1, 300)
        shared = [r.getrandbits(64) for _ in range(n)]
        x, y = (shared + [r.getrandbits(64) for _ in range(r.randint(0, n // 4))] for _ in range(2))

        def bits(v):
            m = 64
            while m < 2 * len(v):
                m *= 2
            out = [0] * (m // 64)
            for h in v:
                out[(h & (m - 1)) // 64] |= 1 << (h & 63)
            return b"".join(w.to_bytes(8, "little") for w in out)

        if n >= 0.8 * (len(x) + len(y) - n):
            assert S.within_bits(bits(x), bits(y), len(x), len(y), 0.8)
