import pytest
from brute import AZ, PUNCT, documents, empty, sha

from tributary.llm import decontaminate as D


def brute(docs, items, window=13):
    words = lambda t: PUNCT.findall((t or "").translate(AZ))
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(window, len(iw))
            for j in range(len(iw) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == iw[j : j + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out[doc_id] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_matches_brute_force(spark, block):
    docs, rows = documents(spark)
    items = [(2, rows[6][1]), (10, rows[7][1][:90].upper()), (1, "two words"), (3, None), (4, ""), (5, rows[5][1][100:900]), (5, "w1 w2"), (6, "nothing like it in any of the texts at all, none whatever, really none")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(D.contamination(docs, bench, block_bytes=block)) == brute(rows, items)
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in brute(rows, items).items() if not v[4]}


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e f"), (2, "a b c"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "q A, b c d zz")], "item_id long, text string")
    got = {tuple(r) for r in D.matches(docs.coalesce(1), bench, 3).collect()}
    assert ("7", 1, 1, 2, 4) in got and ("7", 2, 1, 3, 3) not in got  # three words, below the shared first words of four


def test_empty(spark):
    docs, rows = documents(spark, 12)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(v[1:3] == (0, 0) and not v[4] for v in result(D.contamination(docs, none)).values())
    assert D.contamination(empty(spark), none).count() == 0
