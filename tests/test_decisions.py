"""Choices by ordered rules, on the cases that the rules tell apart."""

import pytest
from pyspark.sql import functions as F

from lightfold.operators import decisions


@pytest.mark.parametrize(
    "discovery,available,want",
    [([5], [5, 7, 9, 11], [5, 11, 9]), ([5, 8], [1, 2, 5, 8, 9], [5, 9, 2]), ([9], [1, 2, 3], [9, 3, 2]), ([9], [9], [9]), ([], [1], None), ([4, 2], [3, 1, 4], [4, 3, 1])],
)
def test_sectors(spark, discovery, available, want):
    df = spark.createDataFrame([(discovery, available)], "d array<long>, a array<long>")
    assert df.select(decisions.choose_sectors(F.col("d"), F.col("a")).alias("x")).first()["x"] == want


def test_queue_ranks_ties_by_id(spark):
    rows = [(3, 60), (1, 60), (2, 99), (4, 49), (5, 50)]
    got = decisions.followup_queue(spark.createDataFrame(rows, "star long, priority int").repartition(3)).orderBy("rank").collect()
    assert [(r["star"], r["rank"]) for r in got] == [(2, 1), (1, 2), (3, 3), (5, 4)]


def test_files(spark):
    files = spark.createDataFrame([(1, 5, 5), (2, 5, 5), (3, 6, 6), (4, 1, 9), (5, 4, 8), (6, 5, 9)], "entry long, lo long, hi long")
    asked = spark.createDataFrame([(1, [6, 5, 6]), (2, [7]), (3, [1, 20]), (4, [])], "request long, sectors array<long>")
    got = sorted((r["request"], r["entry"]) for r in decisions.select_files(asked, files).collect())
    assert got == [(1, 1), (1, 3), (1, 5), (2, 5)]


def test_campaigns(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", None), (4, "a", None), (5, "a", 1.0)], "tic long, status string, period double")
    new = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0), (3, "b", None), (4, "b", 1.0), (6, "a", 1.0)], "tic long, status string, period double")
    got = {(r["before"], r["after"], r["cause"]): r["n"] for r in decisions.compare_campaigns(old, new, ["period"]).collect()}
    assert got == {("a", "a", "unchanged"): 1, ("a", "b", "verdict_only"): 2, ("a", "b", "detection_moved"): 1}
