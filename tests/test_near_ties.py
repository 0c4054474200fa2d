"""Near ties are all kept, however many there are."""

from pyspark.sql import functions as F

from lightfold.operators import boxsearch as b
from lightfold.plans import catalog


def test_all_peaks(spark):
    rows = [(1, g, 1.05**g, 9.0 - g / 1000, 0.0, 0.0, 0.0, 0.0) for g in range(90)]
    got = b.distinct_peaks(spark.createDataFrame(rows, "star long, " + b.POWERS), most=None).orderBy("rank").collect()
    assert [(r["grid"], r["rank"]) for r in got] == [(g, g + 1) for g in range(90)]


def test_query_keeps_more_than_five(spark, tmp_path):
    """A series with many trial periods of about the same power."""
    spark.range(4000).select(
        F.col("id").alias("event_id"), F.expr("timestampadd(SECOND, id * 648, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.concat(F.lit("s"), F.col("id") % 12).alias("event_type"), (10 + F.pmod(F.xxhash64("id"), F.lit(101)) / 100.0).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["star"], r["rank"]) for r in catalog.QUERIES["lc_near_ties"](spark, str(tmp_path)).collect()}
    all_ = b.distinct_peaks(_powers(spark, str(tmp_path))).filter(F.col("share") >= 0.8).collect()
    assert got == {(r["star"], r["rank"]) for r in all_} and max(rank for _, rank in got) > 5


def _powers(spark, path):
    from lightfold.plans import search_queries

    return search_queries._powers(spark, path)
