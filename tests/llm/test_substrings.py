import random

import pytest
from brute import SPACE, documents, empty, sha

from tributary.llm import substrings as S


def brute(rows, n):
    first, docs = {}, {i: SPACE.findall(t or "") for i, t in rows}
    for i in sorted(docs):
        w = docs[i]
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (i, s))
    out = {}
    for i, w in docs.items():
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (i, s):
                gone |= set(range(s, s + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, sha(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("n,hot", [(20, 1000), (20, 2), (6, 3), (3, 1000)])
def test_matches_brute_force(spark, n, hot):
    docs, rows = documents(spark, 90)
    assert result(S.remove_repeats(docs.repartition(5), n, hot)) == brute(rows, n)


def test_small_alphabet(spark):
    """Windows that overlap themselves and one another in every way."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n in (4, 8):
        assert result(S.remove_repeats(docs, n)) == brute(rows, n)


def test_automaton():
    r = random.Random(3)
    for _ in range(60):
        a, texts = S.SuffixAutomaton(), [[r.choice("abc") for _ in range(r.randint(1, 14))] for _ in range(4)]
        for t in texts[:3]:
            a.add(t)
        runs = {tuple(t[i:j]) for t in texts[:3] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        t = texts[3]
        want = [max([k for k in range(1, j + 1) if tuple(t[j - k : j]) in runs], default=0) for j in range(1, len(t) + 1)]
        assert list(a.statistics(t)) == want


def test_nulls_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(docs).collect()), key=str)
    assert got == [(2, 0, 0), (5, 30, 0), (5, 30, 0), (9, 30, 30), (None, 30, 30)]
    assert S.remove_repeats(empty(spark)).count() == 0
