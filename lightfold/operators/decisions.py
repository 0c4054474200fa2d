"""Choices that follow from ordered rules: follow-up queues, sectors, files, and what moved between two campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import ranked


def followup_queue(results: DataFrame, key: str = "star", least: int = 50) -> DataFrame:
    """Results whose priority reaches `least`, with their rank from 1: highest priority first, then the smaller id."""
    r = results.filter(F.col("priority") >= least).withColumn("_order", -F.col("priority"))
    return ranked(r, ["_order", key]).withColumn("rank", F.col("place") + 1).drop("place", "_order")


def choose_sectors(discovery: Column, available: Column, most: int = 2) -> Column:
    """The first discovery sector, then up to `most` others: later than all discovery sectors first, each lot from the latest; null without a discovery."""
    free = F.array_except(available, discovery)
    top = F.array_max(discovery)
    fall = lambda a: F.sort_array(a, asc=False)
    others = F.concat(fall(F.filter(free, lambda x: x > top)), fall(F.filter(free, lambda x: x <= top)))
    return F.when(F.size(discovery) > 0, F.concat(F.array(F.get(discovery, F.lit(0))), F.slice(others, 1, most)))


def select_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(request, place, entry, lo, hi) of the files to read for asked (request, sectors) from files (entry, lo, hi).

    One file of just that sector for each sector asked, in order, then the narrowest one of several
    sectors that covers all of them (of equal ones the earliest entry). Files are met through their
    ranges, some of which many requests share, so both sides shrink to different ranges first.
    """
    kinds = files.groupBy("lo", "hi").agg(F.min("entry").alias("entry"))
    single = kinds.filter("lo = hi").select(F.col("lo").alias("sector"), "entry")
    each = asked.select("request", F.explode(F.array_distinct("sectors")).alias("sector")).join(single, "sector")
    one = each.select("request", F.col("sector").alias("place"), "entry", F.col("sector").alias("lo"), F.col("sector").alias("hi"))
    span = asked.select("request", F.array_min("sectors").alias("a"), F.array_max("sectors").alias("z")).filter("a IS NOT NULL")
    # each file range is listed at every start it can cover, so that the join is an equality
    wide = kinds.filter("lo < hi").select("lo", "hi", "entry", F.explode(F.sequence("lo", "hi")).alias("a"))
    reach = span.select("a", "z").distinct().join(wide, "a").filter(F.col("hi") >= F.col("z"))
    best = reach.groupBy("a", "z").agg(F.min_by(F.struct("entry", "lo", "hi"), F.struct(F.col("hi") - F.col("lo"), "entry")).alias("b"))
    many = span.join(best, ["a", "z"]).select("request", F.lit(1 << 40).alias("place"), "b.entry", "b.lo", "b.hi")
    return one.union(many)


def compare_campaigns(old: DataFrame, new: DataFrame, fields: list[str], key: str = "tic") -> DataFrame:
    """(before, after, cause, n) over the stars of both campaigns.

    A status that changed while all detection fields are the same to the last bit (nulls equal
    nulls) is a change of verdict only, else the detection moved.
    """
    a = old.select(key, F.struct("status", *fields).alias("a"))
    both = a.join(new.select(key, F.struct("status", *fields).alias("b")), key)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    cause = F.when(F.col("a.status").eqNullSafe(F.col("b.status")), "unchanged").when(same, "verdict_only").otherwise("detection_moved")
    return both.groupBy(F.col("a.status").alias("before"), F.col("b.status").alias("after"), cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))
