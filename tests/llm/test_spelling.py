import random
import re
import zlib
from collections import Counter

import numpy as np
from brute import AZ, documents, empty

from tributary.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    out = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n):
    form, links = {}, {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def typo(r, w):
    i = r.randrange(len(w))
    return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abzéü×") + w[i:], w[:i] + r.choice("abyÿ") + w[i + 1 :]])


def corpus(seed=4, n=260):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde") for _ in range(r.randint(6, 9))) for _ in range(60)] + ["Übergangé", "aaaaaaaa", "aaaaaaa", "abababab", "Wednesday", "b" * 400]
    rows = []
    for i in range(n):
        w = [r.choice(base[: 1 + int(len(base) * r.random() ** 3)]) if r.random() < 0.7 else typo(r, r.choice(base)) for _ in range(r.randint(0, 80))]
        rows.append((r.choice([i, None]) if i % 9 == 0 else i, " ".join(x.upper() if r.random() < 0.1 else x for x in w) + r.choice(["", ", 12x", "\n"])))
    rows += [(1000 + i, "international " * 40 + "internationel " * 3 + "internatiomel" * (i < 2)) for i in range(12)]  # a chain of forms
    return rows + [(3, None), (4, ""), (5, "7 _ 中文")]


def test_words_forms_and_roots(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = expected(counted(rows))
    assert got(S.spelling_variants(docs)) == want
    assert sum(x[1] is not None for x in want) > 30 and any(x[1] is not None and x[1] != x[2] for x in want) and max(x[4] for x in want) > 5


def test_crowded_groups_are_halved(spark):
    rows = corpus(7)
    n = counted(rows) | {"prefixed" + w: 5 for w in counted(rows)}  # a long common beginning
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    links = [(x.word, x.near, x.near_n) for x in S.near_words(df, most=6, bin_=40).collect()]
    assert len(links) == len(set(links)) and set(links) == {(a, b, n[b]) for a in n for b in n if a != b and near(a, b)}
    held = S.grouped(df, 6).groupBy("key", "c", "lo", "hi").count().where("count > 6").selectExpr("max(hi - lo)").first()[0]
    assert held in (None, 1)


def test_awkward_documents(spark):
    docs, rows = documents(spark)
    assert got(S.spelling_variants(docs)) == expected(counted(rows))
    assert got(S.spelling_variants(empty(spark))) == []
    long = "x" * 300_000 + " " + "x" * 299_999  # in two documents: both words count twice
    out = got(S.spelling_variants(spark.createDataFrame([(1, long), (2, long.upper()), (2, long)], "doc_id long, text string")))
    assert [(len(x[0]), x[4]) for x in out if len(x[0]) == 300_000] == [(300_000, 1)]


def test_wavelet_tree():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 100):
        v = r.permutation(n)
        a, b = np.sort(r.integers(0, n + 1, (2, 50)), axis=0)
        c, d = np.sort(r.integers(0, n + 1, (2, 50)), axis=0)
        q, x = S.WaveletTree(v).report(a, b, c, d)
        want = {(k, y) for k in range(50) for y in v[a[k] : b[k]].tolist() if c[k] <= y < d[k]}
        assert set(zip(q.tolist(), x.tolist())) == want and len(q) == len(want)
