"""Language ID by fusing evidence: text, declared markup language, address suffix and host.

The text likelihood is a naive Bayes model of byte trigrams, counted over all
documents with a declared language; a row's own trigrams are taken out of the counts
of the language that it declares, so no text vouches for its own tag.  The other evidence is counted against the
language that the text alone suggests, by grouped aggregation over all rows:
how often texts of a language are declared as another, how often they stand at an
address with a suffix, and how the languages of a host are spread.  A host's
prior is smoothed towards its domain's, and that towards the global one; a row's
own vote is taken out of its host's and domain's counts.  Logarithms are added
and normalised over the languages.

Every declared language is told apart.  The model is collected and broadcast in blocks
of LANGUAGES x FEATURES counts, one after another; the scores are carried over the
blocks with the texts, and the evidence is joined.

Defined results: a text without letters, or with none of the languages likely
enough, is rejected (lang 'und' if nothing is known).  Null declared languages,
addresses and hosts are no evidence.  Without any declared language there are no
languages and every row is rejected.  Each row gives a row; extra columns aren't
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, table, text_pieces, trimmed, without
from .words import LOWER, text_bytes

#: Languages of a block of the model.
LANGUAGES = 64
FEATURES = 1 << 14
#: Trigrams overlap, so their log-likelihoods count in part only.
TEMPER = 0.3
SMOOTH = 10.0
ACCEPT = 0.6

FOLD = LOWER.copy()
FOLD[:0x61] = np.where((LOWER[:0x61] >= 0x61), LOWER[:0x61], 0x20)
FOLD[0x7B:0x80] = 0x20


def declared(column: Column) -> Column:
    """The primary subtag of a language tag, or null."""
    tag = F.regexp_extract(F.lower(F.trim(column.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


#: The last label of the host in a text's first address.
ADDRESS = r"(?:@|://)(?:[A-Za-z0-9-]+\.)+([A-Za-z]{2,})(?![A-Za-z0-9.-]*[A-Za-z0-9])"


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence of documents: their language tag, the suffix of the first address in the text, their source as host, and as
    its domain the last two labels of a dotted source or the stem of a numbered one."""
    source = docs["source"].cast("string")
    suffix = F.when(docs["text"].contains("@") | docs["text"].contains("://"), F.lower(F.regexp_extract(docs["text"], ADDRESS, 1)))
    domain = F.when(source.contains("."), F.substring_index(source, ".", -2)).otherwise(F.regexp_replace(source, r"[0-9]+$", ""))
    return docs.select("doc_id", "text", declared(docs["lang"]).alias("declared"), F.when(suffix != "", F.concat(F.lit("."), suffix)).alias("suffix"), source.alias("host"), domain.alias("domain"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the html element's lang, the address's language segment or top-level domain, its host and domain."""
    html = F.coalesce("html", F.lit(""))
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    segment = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    return pages.select(
        F.col("page_id").alias("doc_id"), text.alias("text"), declared(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)).alias("declared"),
        F.when(segment != "", F.concat(F.lit("/"), segment)).otherwise(F.concat(F.lit("."), F.substring_index(host, ".", -1))).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
    )


def trigrams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all trigrams around a letter, the place of each, and the documents' byte offsets."""
    data, at = text_bytes(texts)
    b = FOLD[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at
    f = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18)
    ok = b[1:-1] != 0x20
    ends = at[1:]
    ok[np.clip(np.r_[ends - 1, ends - 2], 0, len(ok) - 1)[np.r_[ends - 1, ends - 2] < len(ok)]] = False  # not across documents
    where = np.flatnonzero(ok)
    return f[where].astype(np.int64), where, at


def model(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Half a count more than each trigram has in each language: a row for each language."""
    number = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros(len(languages) * FEATURES, np.int64)
        for batch in batches:
            for piece in text_pieces(batch):
                f, where, at = trigrams(piece.column("text"))
                lang = np.array([number.get(x, -1) for x in piece.column("declared").to_pylist()], np.int64)
                lang = np.repeat(lang, np.diff(at))[where]
                counts += np.bincount((lang * FEATURES + f)[lang >= 0], minlength=len(counts))
        k = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(counts[k])], ["k", "n"])

    got = rows.select("text", "declared").where("declared is not null").mapInArrow(trimmed(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(languages) * FEATURES, 0.5)
    counts[got.column("k").to_numpy()] += got.column("n").to_numpy()
    return counts.reshape(len(languages), FEATURES)


def own_scores(f: np.ndarray, owner: np.ndarray, lang: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts whose number in lang isn't -1: which they are, and the log-likelihood in that language without their own trigrams."""
    live = lang[owner] >= 0
    key, n = np.unique(owner[live].astype(np.uint32) * np.uint32(FEATURES) + f[live].astype(np.uint32), return_counts=True)
    doc, own = (key // FEATURES).astype(np.int64), counts[lang[key // FEATURES], key % FEATURES]
    size = np.bincount(owner[live], minlength=len(lang))
    total = counts.sum(axis=1)[lang[doc]] - size[doc]
    which = np.flatnonzero((lang >= 0) & (size > 0))
    return which, np.bincount(doc, n * np.log((own - n) / total), len(lang))[which]


def likelihoods(rows: DataFrame, counts: np.ndarray, languages: list[str], last: bool = True):
    """The rows with letters (trigrams with one) and the scores of these languages after those in ll."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)
    number = {x: i for i, x in enumerate(languages)}
    before = rows.columns
    kept = ["doc_id", *([] if last else ["text"]), "declared", "suffix", "host", "domain"]

    def run(batches):
        counts = sent.value
        logs = np.log(counts / counts.sum(axis=1, keepdims=True))
        for batch in batches:
            for piece in text_pieces(batch):
                f, where, at = trigrams(piece.column("text"))
                lang = np.array([number.get(x, -1) for x in piece.column("declared").to_pylist()], np.int64)
                cut = np.searchsorted(where, at)
                out = np.empty((piece.num_rows, len(logs)))
                for i, table_ in enumerate(logs):
                    total = np.r_[0.0, np.cumsum(table_[f])]
                    out[:, i] = TEMPER * (total[cut[1:]] - total[cut[:-1]])
                which, own = own_scores(f, np.repeat(np.arange(piece.num_rows), np.diff(cut)), lang, counts)
                out[which, lang[which]] = TEMPER * own
                if "ll" in before:
                    out = np.concatenate([piece.column("ll").flatten().to_numpy().reshape(piece.num_rows, -1), out], axis=1)
                ll = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.record_batch([*(piece.column(c) for c in kept), pa.array(np.diff(cut), pa.int64()), ll], [*kept, "letters", "ll"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(trimmed(run), f"{shape}, letters long, ll array<double>"), sent


def scores(rows: DataFrame, languages: list[str]) -> DataFrame:
    """doc_id, letters, ll (an array for the languages), and the other evidence. Texts are written with
    the scores as long as blocks follow."""
    scored = rows
    for lo in range(0, len(languages), LANGUAGES):
        last = lo + LANGUAGES >= len(languages)
        scored, sent = likelihoods(scored, model(rows, languages[lo : lo + LANGUAGES]), languages[lo : lo + LANGUAGES], last)
        if not last:
            scored = table(scored, "scores")
            sent.unpersist()
    return scored


def identify(rows: DataFrame, languages: list[str] | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, lang, confidence, text_lang (what the text alone suggests), accepted of every row of evidence."""
    if languages is None:
        languages = sorted(r.declared for r in rows.where("declared is not null").select("declared").distinct().collect())
    n = len(languages)
    if not n:
        return rows.select("doc_id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit(False).alias("accepted"))
    names = F.array(*(F.lit(x) for x in languages))
    scored = scores(rows, languages).withColumn("vote", F.when(F.col("letters") > 0, F.array_position("ll", F.array_max("ll")).cast("int")))
    scored = table(scored, "language")

    def counts(key: str) -> DataFrame:
        """Votes for each language, in an array, and for all, of each value of key."""
        each = scored.where(F.col("vote").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_key"), "vote").agg(F.count("*").cast("double").alias("n"))
        votes = each.groupBy(f"{key}_key").agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("votes"), F.sum("n").alias(f"{key}_all"))
        return votes.select(f"{key}_key", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("votes", i), F.lit(0.0))).alias(f"{key}_n"), f"{key}_all")

    overall = [0.0] * n
    for r in scored.where("vote is not null").groupBy("vote").count().collect():
        overall[r.vote - 1] = float(r["count"])
    total = sum(overall)
    prior = F.array(*(F.lit((x + 1) / (total + n)) for x in overall))
    df = scored
    for key in ("declared", "suffix", "host", "domain"):
        df = df.join(counts(key), F.col(key) == F.col(f"{key}_key"), "left")
    own = lambda x, i: x - F.when(F.col("vote") == i + 1, 1.0).otherwise(0.0)  # noqa: E731  without the row's own vote

    def smoothed(key: str, towards: Column) -> Column:
        votes = F.col(f"{key}_n")
        size = F.col(f"{key}_all") - F.when(F.col("vote").isNull(), 0.0).otherwise(1.0)
        return F.when(votes.isNull(), towards).otherwise(F.zip_with(F.transform(votes, own), towards, lambda x, t: (x + SMOOTH * t) / (size + SMOOTH)))

    def evidence(votes: str) -> Column:
        """log P(value | language), with the row's own vote taken out."""
        sizes = F.array(*(F.lit(x) for x in overall))
        none = F.array_repeat(F.lit(0.0), n)
        return F.when(F.col(votes).isNull(), none).otherwise(F.transform(F.col(votes), lambda x, i: F.log((own(x, i) + 0.5) / (own(F.element_at(sizes, i + 1), i) + 0.5 * (n + 1)))))

    df = df.withColumn("by_domain", smoothed("domain", prior)).withColumn("by_host", smoothed("host", F.col("by_domain")))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(add(F.col("ll"), F.transform("by_host", lambda p: F.log(p))), evidence("declared_n")), evidence("suffix_n"))
    df = df.withColumn("score", score).withColumn("best", F.array_max("score"))
    confidence = 1.0 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    known = F.col("letters") > 0
    return df.select(
        "doc_id", F.when(known, F.element_at(names, F.array_position("score", F.col("best")).cast("int"))).otherwise("und").alias("lang"), F.when(known, confidence).otherwise(0.0).alias("confidence"),
        F.when(F.col("vote").isNotNull(), F.element_at(names, F.col("vote"))).otherwise("und").alias("text_lang"), (known & (confidence >= accept)).alias("accepted"),
    )


def keep_identified(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents whose language is told, with their columns. Verdicts are by id and text, so rows that share an id
    or have none are told apart; only rows that may be rejected are shuffled."""
    rows = from_documents(docs).withColumn("doc_id", row_key())
    return without(docs, identify(rows, accept=accept).where("not accepted").select(F.col("doc_id").alias("key")))
