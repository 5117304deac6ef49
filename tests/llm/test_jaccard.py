"""Components at a Jaccard similarity of 0.9 of three-word shingles, and the signature trees alone, against all pairs."""

import random

import numpy as np
import pyarrow as pa
from brute import AZ, SPACE, documents, empty

from tributary.llm import similar as S


def shingles(text):
    w = SPACE.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()), key=str)


def family(r, words, sizes, copies, edits):
    """Originals and copies of them, some near the similarity asked for, with a passage that all of them share."""
    passage = " ".join(f"p{r.randrange(words)}" for _ in range(40))
    out = []
    for n in sizes:
        text = [f"w{r.randrange(words)}" for _ in range(n)]
        for _ in range(copies):
            t = list(text)
            for _ in range(r.randint(0, edits)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], [f"n{r.randrange(10**6)}"], [t[k], "in"]])
            out.append(" ".join(t) + (" " + passage if r.random() < 0.5 else ""))
    return out


def corpus(seed):
    r = random.Random(seed)
    texts = family(r, 3000, [60, 200, 210, 600], 14, 8) + family(r, 4, [80, 90], 10, 3) + ["A b C d", "a B c d", "a b", "A B", "a", None, "", " \n"] * 2
    r.shuffle(texts)
    return [(3 * i, t) for i, t in enumerate(texts)]


def test_components(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(rows)
    assert got(S.components(docs, 0.9, 3)) == want
    assert len({x[2] for x in want}) < 0.8 * len(want) and max(x[1] for x in want) > 500


def test_crowded_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    monkeypatch.setattr(S, "HUBS", 0)
    monkeypatch.setattr(S, "LEAF_BITS", 64)
    rows = corpus(2)
    assert got(S.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 0.9, 3)) == expected(rows)


def test_awkward_documents(spark):
    docs, rows = documents(spark)
    assert got(S.components(docs.withColumn("key", docs["doc_id"]), 0.9, 3)) == expected(rows)
    assert got(S.components(empty(spark), 0.9, 3)) == []
    long = " ".join(f"w{i % 7919}" for i in range(300_000))  # over 1 MB
    rows = [(None, "x y z"), (None, "x y z"), (4, "X y z"), (4, "other words here"), (4, "other words here"), (9, long), (2, long + " end"), (None, None), (11, "alone"), (None, "nobody has this")]
    assert got(S.components(spark.createDataFrame(rows, "doc_id long, text string"), 0.9, 3)) == expected(rows)
    named = [("b", "x y z w"), ("a", "x y z w"), ("c", "v")]
    assert got(S.components(spark.createDataFrame(named, "doc_id string, text string"), 0.9, 3)) == [("a", 2, "a"), ("b", 2, "a"), ("c", 1, "c")]


def test_trees_lose_no_pair():
    r = random.Random(4)
    for similarity, width in ((0.9, 64), (0.8, 256), (0.5, 64)):
        sets, group = [], []
        for k in range(6):
            base = [[r.getrandbits(64) for _ in range(r.randint(1, 60))] for _ in range(3)]
            for _ in range(r.choice([1, 2, 9, 40])):
                b = r.choice(base)
                sets.append(frozenset([*r.sample(b, max(1, len(b) - r.randint(0, 4))), *(r.getrandbits(64) for _ in range(r.randint(0, 3)))]))
                group.append(k)
        order = sorted(range(len(sets)), key=lambda i: (group[i], len(sets[i])))
        sets, group = [sets[i] for i in order], np.array([group[i] for i in order])
        n = np.array([len(s) for s in sets])
        comp = np.array([r.randrange(3) for _ in sets])

        def bits(s):
            m = 64
            while m < min(width, 4 * len(s)):
                m *= 2
            out = [0] * (m // 64)
            for h in s:
                out[(h & (m - 1)) // 64] |= 1 << (h & 63)
            return b"".join(w.to_bytes(8, "little") for w in out)

        zero = np.zeros(len(sets), np.int64)
        found = set()
        for a, b in S.similar_in(group, n, zero, comp, zero, zero, zero.astype(bool), S.Bits.of(pa.array([bits(s) for s in sets]), n), similarity):
            found |= set(zip(a.tolist(), b.tolist()))
        every = {(a, b) for b in range(len(sets)) for a in range(b) if group[a] == group[b] and comp[a] != comp[b]}
        similar = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
        assert similar <= found <= every and similar and (similarity < 0.8 or len(found) < 0.6 * len(every))
