import random

import xxhash
from brute import AZ, SPACE, documents, empty

from tributary.llm import simhash as S


def fingerprint(text, n=3):
    w = SPACE.findall((text or "").translate(AZ))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def group(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(spark):
    docs, rows = documents(spark, 120)
    fps = {i: fingerprint(t) for i, t in rows}
    comp = group(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(least.values())


def test_no_link_is_lost(spark):
    """Chains, balls and random errors, all within the radius."""
    r = random.Random(1)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    ball = r.getrandbits(64)
    fps |= {ball ^ 1 << i ^ 1 << j for i in range(40) for j in range(i)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {x.fp % (1 << 64): x.comp for x in S.components(spark.createDataFrame(signed, "fp long")).collect()}
    want = group(fps)
    pairs = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert pairs(got) == pairs(want)


def test_golay_code_is_perfect():
    code, error = S.golay_tables()
    assert len(set(error.tolist())) == 2048
    import numpy as np

    assert (np.bincount(code.astype(np.int64)) == 2048).all()


def test_empty(spark):
    assert S.near_duplicates(empty(spark)).count() == 0
    null = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "z y x w v")], "doc_id long, text string")
    assert sorted(map(tuple, S.near_duplicates(null).select("doc_id", "component_id").collect()), key=str) == [(4, 4), (4, 4), (None, 4), (None, None)]
