"""Joins on nearness against all pairs, at poles and over 0 degrees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightfold.functions import tails
from lightfold.operators import catalogue, joins


@pytest.mark.parametrize("radius", [0.05, 1.0, 7.0, 60.0])
def test_sky_join_equals_all_pairs(spark, radius):
    r = np.random.default_rng(int(radius * 100))
    near = np.minimum(90, np.maximum(-90, np.concatenate((r.uniform(-90, 90, 60), r.choice([89.9, -89.95, 90.0, 0.0], 20)))))
    a = np.concatenate((r.uniform(0, 360, 60), r.choice([0.01, 359.99, 180.0], 20)))
    left = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, near))]
    right = [(i, float((x + r.normal(0, radius)) % 360), float(np.clip(y + r.normal(0, radius), -90, 90))) for i, x, y in left]
    got = joins.sky_join(spark.createDataFrame(left, "i long, ra double, dec double"), spark.createDataFrame(right, "j long, ra2 double, dec2 double"), radius, ("ra", "ra2"), ("dec", "dec2"))

    def apart(p, q):
        x, d, y, e = (math.radians(v) for v in (p[1], p[2], q[1], q[2]))
        h = math.sin((e - d) / 2) ** 2 + math.cos(d) * math.cos(e) * math.sin((y - x) / 2) ** 2
        return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))

    want = sorted((p[0], q[0]) for p in left for q in right if apart(p, q) <= radius)
    assert sorted((x["i"], x["j"]) for x in got.collect()) == want and want


def test_sky_pairs_of_one_small_part_are_made_in_all_tasks(spark):
    left = spark.range(200).select(F.col("id").alias("tic"), (F.col("id") * 1.7).alias("ra"), (F.col("id") * 0.8 - 80).alias("dec"), F.lit(0.0).alias("target_magnitude")).coalesce(1)
    right = left.select(F.col("tic").alias("identifier"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), F.lit(1.0).alias("magnitude"))
    pairs = joins.sky_join(left, right, 2.0, ("ra", "ra2"), ("dec", "dec2"), cells=True)
    ranked = catalogue.rank_counterparts(pairs.withColumn("separation_arcsec", F.col("separation_deg")), within=joins.CELLS)
    where = ranked.select("tic", "rank", F.spark_partition_id().alias("p")).collect()
    assert len({x["p"] for x in where}) == 4
    by = {}
    for x in where:
        by.setdefault(x["tic"], []).append(x["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and len(by) == 200


def test_nearest_within_a_fraction(spark):
    left = spark.createDataFrame([(1, 0, 10.0), (2, 0, 5.0), (3, 1, 10.0)], "k long, slot long, a double")
    right = spark.createDataFrame([(0, 10.4, "x"), (0, 9.7, "y"), (0, 9.6, "z"), (1, 20.0, "w")], "slot long, b double, name string")
    got = {r["k"]: r["name"] for r in joins.nearest(left, right, ["slot"], "k", "a", "b", 0.05, ["b", "name"]).collect()}
    assert got == {1: "y", 2: None, 3: None}


def test_tails_of_repeated_and_null_arguments(spark):
    rows = [(3.0, 1.5), (3.0, 1.5), (None, 1.5), (0.0, 2.0), (32.0, 3.32)]
    got = [r["p"] for r in spark.createDataFrame(rows, "k double, m double").coalesce(1).select(tails.poisson_upper(F.col("k"), F.col("m")).alias("p")).collect()]
    assert got[0] == got[1] == pytest.approx(1 - sum(math.exp(-1.5) * 1.5**i / math.factorial(i) for i in range(3)))
    assert got[2] is None and got[3] == 1.0 and got[4] == pytest.approx(7.249058e-21, rel=1e-5)
