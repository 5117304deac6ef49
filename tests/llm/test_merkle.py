import random
import zlib
from collections import defaultdict

from brute import documents, empty, sha
from pyspark.sql import functions as F

from tributary.llm import merkle as M


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """All levels of a list of nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        s = i - i % 3
        out.append((level[s:i], level[i + 1 : s + 3]))
        i //= 3
    return out


def expected(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    leaf = lambda r: sha("".join(map(field, r)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = up([leaf(r) for r in groups[s]])
    top = up([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            h = leaf((*r[:4], text))
            for left, right in path:
                h = sha("".join([*left, h, *right]))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(x for p in path for side in p for x in side)), h, h == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_documents_with_clashing_columns(spark):
    docs, _ = documents(spark, 90)
    docs = docs.withColumns({"g": F.lit(1), "h": F.lit("x"), "path": F.lit("y"), "rank": F.lit(2)}).repartition(5)
    assert got(M.verify_without_lines(docs)) == expected([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert got(M.verify_without_lines(empty(spark))) == []


def test_nulls_ties_repeats_and_far_ids(spark):
    r = random.Random(2)
    ids = [None, None, 0, -1, 1, -(2**63), 2**63 - 1, 5, 5, 5] + [r.randrange(-(2**63), 2**63) for _ in range(60)] + [7] * 40
    rows = [(i, r.choice([None, "", "a", "ab", "é", "zz\x00"]), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "x\ny", "line\n" * 3, "long\n" * 50000])) for i in ids]
    rows += [(9, "a", "en", 1, "same\nrow")] * 30
    assert got(M.verify_without_lines(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_sizes_of_a_source(spark):
    """Cells and chunks of several levels."""
    rows = [(i * 3 - 50, f"s{n}", "en", i, f"text {i}\n") for n in (1, 2, 3, 4, 27, 28, 729, 730, 2300) for i in range(n)]
    assert got(M.verify_without_lines(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_many_sources(spark):
    rows = [(i, f"source {i % 800}", None, None, str(i)) for i in range(900)]
    assert got(M.verify_without_lines(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_crowded_cells_are_counted_by_their_next_digits(spark):
    rows = [("", f"{i:07x}", 1, i) for i in range(500)] + [("", f"f{i:06x}", 2, i) for i in range(20)]
    out = {r.key: (r.rank, r.total) for r in M.ranked(spark.createDataFrame(rows, "g string, key string, n long, x long"), cell=8, digits=1).collect()}
    before, want = 0, {}
    for _, key, n, _ in sorted(rows, key=lambda r: r[1]):
        want[key], before = (before, 540), before + n
    assert out == want


def test_string_ids_and_a_changed_document(spark):
    rows = [("b", "s", "en", 1, "x"), ("ba", "s", "en", 1, "y"), ("a", "s", "en", 1, "z"), ("", "s", "en", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, lang string, n_chars long, text string")
    out = M.manifest(docs).collect()
    by = sorted(rows)
    assert {r.doc_id: r.root for r in out} == dict.fromkeys([r[0] for r in rows], up(["".join(up([sha("".join(map(field, r))) for r in by])[-1])])[-1][0])
    proofs = M.manifest(docs)
    assert proofs.where(M.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert proofs.where(M.folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("path")) == F.col("root")).count() == 0
