"""The stages on a small fixture with planted cases, held against the plain statements of the operators."""

import importlib
import random
import re
from pathlib import Path

from brute import documents

from tributary.llm import decontaminate, language, pii, similar


def sf_dir(spark, tmp_path, docs, items):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def fixture():
    r = random.Random(11)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    item = some(40)
    rows = [(i, some(120), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]  # exact copies
    rows += [(200, some(30) + " " + item + " " + some(30), "en", "s1"), (201, "1234 5678 !!", "en", "s1"), (202, None, "en", "s1"), (203, "mail me at a.b@c.org or +1 (476) 555-6291 " + some(80), "en", "s2")]
    return [(*x, len(x[1] or "")) for x in rows], [(1, item)]


def test_stages(spark, tmp_path):
    from test_decontaminate import brute as contaminated
    from test_simhash import fingerprint, group

    pipeline = importlib.import_module("corpus_pipeline")
    rows, items = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    d = sf_dir(spark, tmp_path, docs, items)
    texts = {r[0]: r[1] for r in rows}
    got, at = [], spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, at, d).write.parquet(f"{d}/out{k}")
        at = spark.read.parquet(f"{d}/out{k}")
        assert name == "bpe" or at.columns == docs.columns
        got.append({r.doc_id: r.text for r in at.collect()})
    assert set(texts) - set(got[0]) == {201, 202}
    comp = group({fingerprint(t) for t in got[0].values()})
    least = {}
    for i in sorted(got[0], reverse=True):
        least[comp[fingerprint(got[0][i])]] = i
    assert set(got[1]) == set(least.values()) and not set(got[1]) & set(range(100, 105))
    bad = {i for i, v in contaminated(got[1].items(), items).items() if v[4]}
    assert bad == {200} and set(got[2]) == set(got[1]) - bad
    assert {i for i in got[2] if got[2][i] != got[3][i]} == {203} and got[3][203].startswith("mail me at <EMAIL> or <PHONE> word")
    assert got[4] == got[3]
    whole = {r.doc_id: r.text for r in pipeline.run(spark, d).collect()}
    assert whole == got[4]


def test_awkward_documents(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, rows = documents(spark)
    d = sf_dir(spark, tmp_path, docs, [(1, rows[6][1]), (None, None)])
    out = pipeline.run(spark, d).collect()
    assert 0 < len(out) < len(rows) and all(r.n_tokens == len(r.ids) // 4 for r in out)
    none = tmp_path / "none"
    none.mkdir()
    assert pipeline.run(spark, sf_dir(spark, none, docs.limit(0), [])).count() == 0


def test_modules_do_not_hide_errors():
    """The guard against missing modules is in the entry file alone."""
    root = Path(__file__).parents[2]
    for path in [root / "corpus_pipeline.py", *(root / "tributary" / "llm").glob("*.py")]:
        assert not re.search(r"except[^\n]*(Import|ModuleNotFound)Error|suppress\([^\n]*(Import|ModuleNotFound)Error", path.read_text()), path


def test_rows_that_share_an_id_and_clashing_names(spark):
    """Verdicts reach the row that they are about, whatever else has its id, and odd columns come through."""
    r = random.Random(3)
    some = lambda k: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "tau", "phi", "chi"]) + str(r.randrange(9)) for _ in range(k))
    item, clean, other = some(40), some(60), some(60)
    rows = [(7, clean), (7, "12 34 !!"), (7, item), (None, other), (None, "56 78"), (None, item + " mail a@b.co")]
    docs = spark.createDataFrame([(*x, "en", "s", 1, "h", "r", 2) for x in rows], "doc_id long, text string, lang string, source string, key int, hit string, row string, _key int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    told = language.keep_identified(docs)
    assert told.columns == docs.columns and {x.text for x in told.collect()} == {t for _, t in rows} - {"12 34 !!", "56 78"}
    left = decontaminate.remove_contaminated(told, bench)
    assert left.columns == docs.columns and {x.text for x in left.collect()} == {clean, other}
    red = pii.redact(docs)
    assert red.columns == docs.columns and {x.text for x in red.collect()} == {t for _, t in rows[:-1]} | {item + " mail <EMAIL>"}
    assert similar.keep_one(docs).columns == docs.columns
