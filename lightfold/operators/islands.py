"""Runs of neighbouring rows: gaps and islands, run-length codes, compact windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, keys: list[str], t: str, gap: float, name: str = "segment") -> DataFrame:
    """Adds the number of the segment of each row; a step of more than gap starts another."""
    w = Window.partitionBy(*keys).orderBy(t)
    step = F.col(t) - F.lag(t).over(w)
    return df.withColumn(name, F.sum(F.when(step > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def integer_runs(df: DataFrame, keys: list[str], value: str, *extra: Column) -> DataFrame:
    """One row for each run of consecutive whole numbers: first, last, length and extra aggregates."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return df.withColumn("_island", F.col(value) - rank).groupBy(*keys, "_island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("length"), *extra).drop("_island")


def longest_run(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """The longest run of each key, the latest of equals, cut to its last `most` numbers."""
    runs = integer_runs(df.select(*keys, value).distinct(), keys, value)
    best = F.max(F.struct(F.least("length", F.lit(most)).alias("n"), F.col("last").alias("last"))).alias("best")
    return runs.groupBy(*keys).agg(best).select(*keys, (F.col("best.last") - F.col("best.n") + 1).alias("first"), F.col("best.last").alias("last"), F.col("best.n").alias("n"))


def encode_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """spans: the sorted [first, last] runs of each key's whole numbers."""
    runs = integer_runs(df.select(*keys, value).distinct(), keys, value)
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def decode_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, F.explode("spans").alias("s")).select(*keys, F.explode(F.sequence("s.first", "s.last")).alias(value))


def compact_window(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """first and last of the k distinct values that lie closest together, the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(value)
    far = df.select(*keys, value).distinct().withColumn("_far", F.lead(value, k - 1).over(w)).filter("_far is not null")
    best = F.min(F.struct((F.col("_far") - F.col(value)).alias("span"), F.col(value).alias("first"), F.col("_far").alias("last"))).alias("best")
    return far.groupBy(*keys).agg(best).select(*keys, "best.first", "best.last", "best.span")
