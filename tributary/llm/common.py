"""Helpers shared by the operators: the shared folder, checkpoints, bounded pieces of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task works on so many bytes of text at a time, or on one text if it is longer.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tributary-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def table(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(size.tolist()):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def trimmed(run):
    """run for mapInArrow; when a task ends, its worker gives memory that is free back to the system.
    Workers serve many tasks, and what one needed would else be held beside the next one's."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def map_text(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """f on bounded pieces of df's batches."""

    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, column):
                yield f(piece)

    return df.mapInArrow(trimmed(run), schema)


#: Rows of an Arrow batch; texts may be long, and a batch stands in memory on both sides.
BATCH = "1000"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches of the session are made smaller if they are as Spark sets them."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, "10000") == "10000":
        conf.set(BATCH_KEY, BATCH)
    return df


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so extra columns with clashing names do no harm and the scan is pruned."""
    return small_batches(docs.select(*(docs[c] for c in ("doc_id", *more, "text"))))


#: Bits of a filter of keys: a broadcast of at most 2 ** FILTER_BITS / 64 rows of 12 bytes, whatever the keys are.
FILTER_BITS = 24


def sieve(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df in two: rows that may have a partner in keys by their long column key, and rows that have none.
    Only the first need a shuffle to be joined with keys; the more keys, the more rows they are."""
    bit = F.shiftrightunsigned(key, 64 - FILTER_BITS)
    bits = keys.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).cast("int").alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bits"))
    bits = F.broadcast(table(bits, "sieve"))
    marked = df.join(bits, F.shiftright(bit, 6).cast("int") == F.col("_at"), "left")
    hit = F.coalesce(F.expr(f"getbit(_bits, cast(shiftrightunsigned({key}, {64 - FILTER_BITS}) & 63 as int)) = 1"), F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Names a row by its id and text: rows that agree in both have the same key, null or not."""
    return F.xxhash64(doc_id, text)


def without(docs: DataFrame, gone: DataFrame, key: Column | None = None) -> DataFrame:
    """The documents but those whose key (row_key) is in gone (column key), with all their columns."""
    gone = table(gone.select(F.col("key").alias("_key")).distinct(), "gone")
    columns = docs.columns
    packed = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), (row_key(docs["doc_id"], docs["text"]) if key is None else key).alias("_key"))
    maybe, rest = sieve(packed, gone, "_key")
    return rest.unionByName(maybe.join(gone, "_key", "left_anti")).select(*(F.col("_row")[c].alias(c) for c in columns))
