"""Tests on counted outcomes: sums are grouped on the executors, the closed forms are columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, by: str, outcome: str) -> DataFrame:
    """by, outcome, n."""
    return df.groupBy(by, outcome).agg(F.count("*").alias("n"))


def g_test(counts: DataFrame, by: str, outcome: str) -> DataFrame:
    """g, df: the likelihood-ratio statistic of independence and its degrees of freedom, of a table of counts n."""
    rows = counts.groupBy(by).agg(F.sum("n").alias("row"))
    columns = counts.groupBy(outcome).agg(F.sum("n").alias("column"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    each = counts.join(rows, by).join(columns, outcome).join(F.broadcast(total), how="inner", on=F.lit(True)).where("n > 0")
    term = 2 * F.col("n") * F.log(F.col("n") * F.col("total") / (F.col("row") * F.col("column")))
    return each.agg(F.sum(term).alias("g"), ((F.count_distinct(by) - 1) * (F.count_distinct(outcome) - 1)).alias("df"))


def squared_distance(counts: DataFrame, by: str, outcome: str, first, second) -> DataFrame:
    """d2, n1, n2: the squared distance of two groups' outcome shares, the statistic of equivalence tests."""
    a = counts.groupBy(outcome).agg(F.sum(F.when(F.col(by) == first, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col(by) == second, F.col("n")).otherwise(0)).alias("b"))
    sizes = a.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    d = F.col("a") / F.col("n1") - F.col("b") / F.col("n2")
    return a.join(F.broadcast(sizes), how="inner", on=F.lit(True)).agg(F.sum(d * d).alias("d2"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))


def two_sample(counts: DataFrame, by: str, outcome: str, first, second) -> DataFrame:
    """chi2, df: whether two groups' outcomes come from one distribution (two-sample chi-squared)."""
    a = counts.groupBy(outcome).agg(F.sum(F.when(F.col(by) == first, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col(by) == second, F.col("n")).otherwise(0)).alias("b"))
    sizes = a.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    k = F.col("a") * F.sqrt(F.col("n2") / F.col("n1")) - F.col("b") * F.sqrt(F.col("n1") / F.col("n2"))
    return a.join(F.broadcast(sizes), how="inner", on=F.lit(True)).where("a + b > 0").agg(F.sum(k * k / (F.col("a") + F.col("b"))).alias("chi2"), (F.count("*") - 1).alias("df"))
