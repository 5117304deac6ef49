"""The corpus pipeline: each stage reads what the one before it kept.

Language ID drops documents whose language can't be told; near-dedup keeps the
document with the smallest id of each component of near-duplicates, by SimHash
fingerprints and by a similarity of 0.8 of five-word shingles;
decontamination drops documents with benchmark passages; personal data is
redacted; the texts are encoded with byte-level BPE and decoded again.

Rows with a null doc_id can't be named by the filters and stay.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bytebpe, decontaminate, language, pii, similar
from tributary.llm.common import shared_dir


#: Bytes of text in a block of BPE: workers hold one beside what the stages before left in executors.
BLOCK_TEXT = 8 << 20


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, secrets=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and text as it is decoded from them."""
    ids = bytebpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, BLOCK_TEXT)
    return ids.selectExpr("doc_id", "n_tokens", "ids", "cast(decoded as string) as text")


STAGES = [("language", identified), ("simhash", distinct), ("decontamination", decontaminated), ("pii", redacted), ("bpe", encoded)]

#: SimHash, the learned language model and redaction, and tokenization can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
