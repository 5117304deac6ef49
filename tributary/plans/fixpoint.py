"""Least fixpoints as loops of joins over deltas.

Every round's new rows are written once to the shared checkpoint folder, so plans
stay short, a round reads only what it joins, and lost executors cost a task, not
the loop.  Rounds stop when nothing new is found.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tributary-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame) -> DataFrame:
    """df as a table: computed once, then read."""
    path = f"{shared_dir(df.sparkSession)}/plan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df as a table that joins shuffle. Spark would judge it by its files, which hold many times the rows that the driver can
    gather and send to everyone."""
    return written(df).hint("merge")


#: Steps of a round, where a step needs the new rows alone: fewer, larger jobs.
HOPS = 3


def least_fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], hops: int = 1, most: int = 100_000) -> DataFrame:
    """The least set of rows that has the seed and is closed under step.

    step(delta, seen) gives rows that follow from at least one row of delta, the last
    round's new rows, and any of seen, all rows so far (delta included); repeats are dropped.
    A step that doesn't look at seen can be taken several times (hops) before rows are written.
    """
    spark, columns = seed.sparkSession, seed.columns
    base = f"{shared_dir(spark)}/fixpoint-{uuid.uuid4().hex}"
    schema, paths = seed.schema, []
    new = seed.distinct()
    for k in range(most):
        paths.append(f"{base}/{k}")
        new.write.parquet(paths[-1])
        delta = spark.read.schema(schema).parquet(paths[-1])
        seen = spark.read.schema(schema).parquet(*paths)
        if delta.isEmpty():
            return seen
        out = front = step(delta, seen).select(*columns).distinct()
        for _ in range(hops - 1):
            front = step(front, seen).select(*columns).distinct()
            out = out.union(front)
        new = (out.distinct() if hops > 1 else out).join(seen, columns, "left_anti")
    raise RuntimeError(f"no fixpoint after {most} rounds")


#: Rounds after which the versions of a lattice's rows are put together.
COMPACT = 12


def lattice_fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], joins: dict[str, Callable[[Column], Column]], hops: int = 4, most: int = 100_000) -> DataFrame:
    """The least table with one row for each key (the columns of seed but those of joins) whose values are above the
    seed's and closed under step.

    step(delta) gives rows of the same columns that follow from rows of which a value has just risen. joins has the
    lattice's join of each value as an aggregate (max, min, a union or an intersection of sets …), which must give equal
    values for equal sets. Values that rise replace those before them: a round takes several steps (hops) and writes
    the rows that have changed, no others.
    """
    spark, columns, schema = seed.sparkSession, seed.columns, seed.schema
    keys = [c for c in columns if c not in joins]
    base = f"{shared_dir(spark)}/lattice-{uuid.uuid4().hex}"
    typed = lambda df: df.select(*(F.col(c).cast(schema[c].dataType) for c in columns))

    def joined(df: DataFrame) -> DataFrame:
        return typed(df.groupBy(*keys).agg(*(join(F.col(c)).alias(c) for c, join in joins.items())))

    def read(paths: list[str]) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths)

    new, paths = joined(seed), []
    for k in range(most):
        paths.append(f"{base}/{k}")
        new.write.parquet(paths[-1])
        delta = read(paths[-1:])
        if delta.isEmpty():
            return joined(read(paths))
        if len(paths) > COMPACT:
            joined(read(paths)).write.parquet(f"{base}/all-{k}")
            paths = [f"{base}/all-{k}"]
        out = front = typed(step(delta))
        for _ in range(hops - 1):
            front = typed(step(joined(front)))
            out = out.union(front)
        # One aggregation joins what has risen with what stood before, and tells both apart.
        both = out.withColumn("_old", F.lit(False)).union(read(paths).withColumn("_old", F.lit(True)))
        stood = [join(F.when(F.col("_old"), F.col(c))).alias(f"_old_{c}") for c, join in joins.items()]
        both = both.groupBy(*keys).agg(*(join(F.col(c)).alias(c) for c, join in joins.items()), F.max("_old").alias("_stood"), *stood)
        rose = ~F.col("_stood")
        for c in joins:
            rose |= ~F.col(c).cast(schema[c].dataType).eqNullSafe(F.col(f"_old_{c}").cast(schema[c].dataType))
        new = typed(both.where(rose))
    raise RuntimeError(f"no fixpoint after {most} rounds")
