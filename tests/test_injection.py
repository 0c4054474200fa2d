"""Planted transits against direct integration, wanted depths, transfer through preparation, variants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightfold.operators import boxsearch, injection, series

SCHEMA = "star long, t double, y double"


def test_lost_light_against_a_fine_grid():
    g = (np.arange(1500) + 0.5) / 1500 * 2 - 1
    x, y = np.meshgrid(g, g)
    r2 = x * x + y * y
    for u1, u2 in ((0.35, 0.25), (0.0, 0.0)):
        mu = np.sqrt(np.clip(1 - r2, 0, 1))
        light = np.where(r2 < 1, 1 - u1 * (1 - mu) - u2 * (1 - mu) ** 2, 0)
        for z, k in ((0.0, 0.1), (0.5, 0.1), (0.95, 0.1), (1.05, 0.1), (0.2, 0.4), (0.05, 0.3), (1.3, 0.1), (0.0, 0.0001 + 0.5)):
            want = light[(x - z) ** 2 + y * y <= k * k].sum() / light.sum()
            assert injection.lost_light(z, k, u1, u2) == pytest.approx(want, abs=1e-4)  # the grid itself is that coarse
    assert injection.lost_light(np.array([0.3]), np.array([0.2]), 0.0, 0.0)[0] == pytest.approx(0.04, abs=1e-9)


def test_wanted_depths_are_met_also_by_grazing_discs():
    r = np.random.default_rng(1)
    depth, impact = 10 ** r.uniform(-5, -1.3, 400), np.concatenate((r.uniform(0, 0.9, 300), r.uniform(0.95, 0.9999, 100)))
    ratio, found = injection.ratio_of_depth(depth, impact, np.full(400, 0.35), np.full(400, 0.25))
    got = injection.lost_light(impact[found], ratio[found], 0.35, 0.25)
    assert np.abs(got - depth[found]).max() < 1e-6 and found[:300].all()
    none = injection.ratio_of_depth(np.array([0.99]), np.array([0.99]), np.array([0.3]), np.array([0.2]))
    assert not none[1][0] and np.isnan(none[0][0])


def test_planning_and_planting(spark):
    plan = spark.createDataFrame([(1, 3.0, 1.0, 0.001, 0.3, 1.0, 1.0, 5700.0), (2, 3.0, 1.0, 0.99, 0.99, 1.0, None, None), (3, 0.01, 1.0, 0.001, 0.3, 2.0, 0.1, 5000.0), (4, -1.0, 1.0, 0.001, 0.3, 1.0, 1.0, 5700.0), (5, 3.0, 1.0, 0.001, 0.3, None, 1.0, 5700.0)], "star long, period double, epoch double, depth double, impact double, radius double, mass double, teff double")
    p = injection.planned(plan)
    got = {r["star"]: r for r in p.collect()}
    assert [got[i]["state"] for i in range(1, 6)] == ["planted", "depth_unreachable", "orbit_within_star", "value_out_of_range", "value_out_of_range"]
    assert got[1]["a_over_r"] == pytest.approx(8.77, abs=0.05) and 2.0 < got[1]["duration"] * 24 < 3.0
    t = np.arange(0, 12, 0.005)
    lc = spark.createDataFrame([(s, float(x), 2.0) for s in (1, 2) for x in t], SCHEMA)
    out = injection.plant(lc, p).toPandas()
    assert set(out["star"]) == {1}
    assert out["loss"].max() == pytest.approx(0.001, abs=2e-7) and (out["y"] == 2.0 * (1 - out["loss"])).all()
    off = np.abs((out["t"] - 1.0 + 1.5) % 3.0 - 1.5)
    assert (out["loss"][off > got[1]["duration"] / 2 + 0.002] == 0).all() and (out["loss"][off < got[1]["duration"] / 2 - 0.01] > 0).all()


def test_depth_transfer(spark):
    r = np.random.default_rng(2)
    t = np.arange(0, 20, 0.02)
    lc = spark.createDataFrame([(1, float(a), float(1 + 0.01 * math.sin(a) + r.normal(0, 1e-4))) for a in t], SCHEMA)
    eph = spark.createDataFrame([(1, 2.5, 1.0, 0.2, 0.005)], "star long, period double, epoch double, duration double, depth double")
    from lightfold.operators.events import injected

    same = injection.depth_transfer(lc, injected(lc, eph), lambda x: x, eph).collect()[0]
    assert same["status"] == "measured" and same["input_depth"] == pytest.approx(0.005, rel=0.05) and same["bias"] == pytest.approx(0, abs=1e-12)
    worn = injection.depth_transfer(lc, injected(lc, eph), lambda x: series.step_detrend(x, 0.1), eph).collect()[0]
    assert worn["bias"] > 0.2  # a filter as short as the event eats it
    up = injection.depth_transfer(lc, injected(lc, eph.withColumn("depth", -F.col("depth"))), lambda x: x, eph).collect()[0]
    assert up["status"] == "nonpositive_input_depth" and up["bias"] is None
    few = injection.depth_transfer(lc.limit(15), injected(lc.limit(15), eph), lambda x: x, eph).collect()[0]
    assert few["status"] == "insufficient_fixed_ephemeris_samples"


def test_variants_equal_runs_one_by_one(spark):
    r = np.random.default_rng(4)
    t = np.arange(0, 25, 0.03)
    lc = spark.createDataFrame([(s, float(a), float(1 + r.normal(0, 3e-4))) for s in (1, 2) for a in t], SCHEMA)
    s = boxsearch.Periodic(low=1.0, high=5.0, hours=(4.0, 8.0), factor=8.0)
    grid = injection.recovery_grid(lc, [1.7, 3.1], [0.0, 0.004], 0.6, 0.2, s)
    got = {(r["star"], r["planted_period"], r["planted_depth"]): r for r in grid.collect()}
    assert len(got) == 8 and all(got[k, p, 0.004]["status"] == "exact" for k in (1, 2) for p in (1.7, 3.1))
    alone = injection.variant_search({"x": lc}, s).collect()
    assert {r["star"]: r["period"] for r in alone} == {k: got[k, 1.7, 0.0]["found"] for k in (1, 2)}
