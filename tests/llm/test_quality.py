import numpy as np
from brute import SPACE, documents, empty

from tributary.llm import quality as Q


def brute(text):
    t = text or ""
    w = SPACE.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_statistics_match_brute_force(spark):
    docs, rows = documents(spark)
    got = {r.doc_id: tuple(r[c] for c in [*Q.STATISTICS, "base_failed"]) for r in Q.judge(docs, []).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert Q.judge(empty(spark), []).count() == 0


def test_learns_a_planted_conjunction():
    r = np.random.default_rng(0)
    x = {"a": r.random(4000), "b": r.random(4000), "c": r.random(4000)}
    bad = (x["a"] > 0.6) & (x["b"] <= 0.3) | (x["c"] > 0.9)
    rules = Q.learn(x, bad)
    hit = np.any([rule.matches(x) for rule in rules], axis=0)
    assert hit[bad].mean() > 0.85 and hit[~bad].mean() < 0.02
    assert Q.learn(x, np.zeros(4000, bool)) == [] and Q.learn(x, np.ones(4000, bool)) == []


def test_expression_agrees_with_the_rules(spark):
    docs, _ = documents(spark)
    rules = [Q.Rule((("n_words", ">", 60.0), ("mean_chars", "<=", 4.0))), Q.Rule((("repeat_share", ">", 0.2),))]
    rows = Q.features(Q.statistics(docs)).withColumn("rule", Q.verdict(rules)).toPandas()
    x = {f: rows[f].to_numpy(float) for f in Q.FEATURES}
    want = np.where(rules[0].matches(x), 1, np.where(rules[1].matches(x), 2, 0))
    assert (rows["rule"].to_numpy() == want).all()


def test_held_out_accuracy(spark):
    """Trained on one half of the labels, judged on the other."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = Q.train(docs, labels.where("doc_id % 2 = 0"))
    rows = Q.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").select("rule", "quality").toPandas()
    bad = rows["quality"] == 0
    assert ((rows["rule"] > 0) & ~bad).sum() <= 0.05 * (~bad).sum()
    assert Q.train(docs, labels.where("false")) == []


def test_rules_find_bad_documents(spark):
    """On labels that weren't learned from, an empty list would find none and a careless one would drop good documents."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = Q.train(docs, labels.where("doc_id % 2 = 0"))
    rows = Q.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").select("rule", "base_failed", "kept", "quality").toPandas()
    bad, dropped = rows["quality"] == 0, rows["rule"] > 0
    assert (~rows["kept"] == rows["base_failed"] | dropped).all()
    assert rules and (dropped & bad).sum() >= 0.9 * bad.sum() and (dropped & ~bad).sum() <= 0.02 * (~bad).sum()
