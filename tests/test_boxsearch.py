"""The periodic searches: planted signals, parts against wholes, direct sums, and the choice among peaks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightfold.operators import boxsearch as b
from lightfold.operators import kernels, series

S = b.Periodic(low=1.0, high=6.0, hours=(2.0, 4.0, 8.0), factor=20.0)
SCHEMA = "star long, t double, y double"


def star(i, period=None, epoch=0.7, depth=0.004, hours=4.0, days=27.0, noise=3e-4, shape="box", step=1 / 72):
    r = np.random.default_rng(i)
    t = np.arange(0, days, step) + r.uniform(0, step / 9, int(math.ceil(days / step)))
    y = 1 + r.normal(0, noise, len(t))
    if period:
        x = np.abs(np.mod(t - epoch + period / 2, period) - period / 2) / (hours / 24)
        if shape == "box":
            y -= np.where(x <= 0.5, depth, 0)
        else:
            mu = np.sqrt(np.clip(1 - (2 * x) ** 2, 0, 1))
            y -= np.where(x <= 0.5, depth * (1 - 0.35 * (1 - mu) - 0.23 * (1 - mu) ** 2), 0)
    return [(i, float(a), float(c)) for a, c in zip(t, y)]


@pytest.fixture(scope="module")
def lc(spark):
    return spark.createDataFrame(star(1, 3.3) + star(2) + star(3, 2.1, depth=0.002) + star(4, 4.7, epoch=2.0, hours=8.0), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def found(lc):
    return b.powers(lc, S).cache()


def test_grid(lc):
    f = {r["star"]: r for r in b.facts(lc, S).collect()}[1]
    p = b.trial_periods(1.0, f["step"], f["trials"])
    assert p[0] == 1.0 and abs(p[-1] - 6.0) < 0.2 and np.allclose(np.diff(1 / p), -f["step"])
    assert f["step"] == pytest.approx(20.0 * (2 / 24) / f["span"] ** 2)
    few = {r["star"]: r for r in b.facts(lc, b.Periodic(low=1.0, high=6.0, hours=(2.0,), factor=0.001, most=1000)).collect()}[1]
    assert few["trials"] <= 1001
    assert S.widths == [10, 20, 40] and b.Periodic(low=0.1, hours=(1.0, 2.0, 4.0)).widths == [10, 20]
    with pytest.raises(ValueError):
        b.Periodic(low=0.01, hours=(1.0,)).days


def test_planted_periods_are_found(lc):
    got = {r["star"]: r for r in b.search_transits(lc, S).collect()}
    for i, (period, epoch, depth) in {1: (3.3, 0.7, 4000), 3: (2.1, 0.7, 2000), 4: (4.7, 2.0, 4000)}.items():
        r = got[i]
        assert abs(r["period"] - period) / period < 0.01
        assert abs((r["epoch"] - epoch + period / 2) % period - period / 2) < 0.1
        assert abs(r["depth_ppm"] - depth) < 0.2 * depth and r["snr"] > 20 and r["events"] >= 5 and r["floor_met"]
        assert r["odd_even_sigma"] is None or r["odd_even_sigma"] < 5
    assert got[2]["snr"] < 12


def test_blocks_add_up_to_the_whole(lc, found):
    parts = b.powers(lc, S, block=500)
    a = {(r["star"], r["grid"]): r for r in found.collect()}
    c = {(r["star"], r["grid"]): r for r in parts.collect()}
    assert a.keys() == c.keys() and len(a) > 200
    for k, x in a.items():
        assert x["power"] == pytest.approx(c[k]["power"], rel=1e-9)
        assert x["depth"] == pytest.approx(c[k]["depth"], rel=1e-6)


def test_box_against_a_direct_sum():
    r = np.random.default_rng(1)
    t, y = np.sort(r.uniform(0, 20, 300)), r.normal(0, 1, 300)
    side, widths = 0.1, [2, 5]
    for period in (1.0, 2.34, 7.77):
        k, s = b.fold(t, y, period, side)
        assert k.sum() == 300 and s.sum() == pytest.approx(y.sum())
        got = b.scan(k, s, 300, y.sum(), 0.5, widths)
        best = 0.0
        bins = len(k)
        at = np.minimum((np.mod(t, period) / side).astype(int), bins - 1)
        for w in widths:
            for j in range(bins):
                inside = np.isin(at, [(j + i) % bins for i in range(w)])
                if 0 < inside.sum() < 300:
                    depth = y[~inside].mean() - y[inside].mean()
                    if depth >= 0:
                        best = max(best, 0.5 * inside.sum() * (depth / 0.5) ** 2)
        assert got[0] == pytest.approx(best)


def test_shape_against_a_direct_fit():
    r = np.random.default_rng(2)
    t, y = np.sort(r.uniform(0, 20, 400)), r.normal(0, 1, 400)
    side, period, w = 0.1, 2.3, 7
    shape = b.profile(w)
    assert shape.argmax() == 3 and shape[3] == pytest.approx(1.0) and (shape[:3] < shape[1:4]).all() and shape[0] == pytest.approx(shape[-1])
    k, s = b.fold(t, y, period, side)
    got = b.scan(k, s, 400, y.sum(), 0.5, [w], {w: shape})
    bins, best = len(k), 0.0
    at = np.minimum((np.mod(t, period) / side).astype(int), bins - 1)
    for j in range(bins):
        m = np.zeros(400)
        for i in range(w):
            m[at == (j + i) % bins] = shape[i]
        if (m > 0).any():
            depth = -(m * y).sum() / (m**2).sum()  # least squares of y = -depth * m
            if depth >= 0:
                gain = ((y**2).sum() - ((y + depth * m) ** 2).sum()) / (2 * 0.5**2)
                best = max(best, gain)
    assert got[0] == pytest.approx(best)


def test_shape_ranks_a_rounded_transit_above_the_box(spark):
    lc = spark.createDataFrame(star(9, 3.3, hours=8.0, shape="round", depth=0.003) + star(10, 3.3, hours=8.0, depth=0.003), SCHEMA)
    s = b.Periodic(low=1.0, high=6.0, hours=(8.0,), factor=20.0)
    best = {(shape, r["star"]): r["p"] for shape in ("box", "transit") for r in b.powers(lc, s, shape=shape).groupBy("star").agg(F.max("power").alias("p")).collect()}
    assert best["transit", 9] > best["box", 9]
    assert best["transit", 9] / best["box", 9] > best["transit", 10] / best["box", 10]


def test_template_decision(spark, lc):
    box = b.search_transits(lc, S).select("star", "period")
    got = {r["star"]: r for r in b.template_decision(lc, box, S, 5.0).collect()}
    assert all(got[i]["agrees"] and got[i]["passes"] for i in (1, 3, 4))
    assert not got[2]["passes"] or got[2]["sde"] < 8
    wrong = b.template_decision(lc, box.withColumn("period", F.col("period") * 1.234), S, 5.0).collect()
    assert not any(r["passes"] for r in wrong if r["star"] in (1, 3, 4))
    double = {r["star"]: r for r in b.template_decision(lc, box.withColumn("period", F.col("period") * 2), S, 5.0).collect()}
    assert double[1]["ratio"] == 0.5 and double[1]["passes"]


def test_distinct_peaks(spark):
    rows = [(1, g, p, w, 0.0, 0.0, 0.0, 0.0) for g, (p, w) in enumerate([(1.0, 5.0), (1.01, 9.0), (1.5, 9.0), (1.515, 8.0), (2.0, 1.0), (3.0, float("nan"))])]
    got = b.distinct_peaks(spark.createDataFrame(rows, "star long, " + b.POWERS)).orderBy("rank").collect()
    assert [(r["period"], r["rank"]) for r in got] == [(1.01, 1), (1.5, 2), (2.0, 3)]
    assert got[2]["share"] == pytest.approx(1 / 9)


def test_near_ties_go_to_agreeing_depths_and_unseen_fits_are_replaced(spark):
    """A peak as strong whose events agree wins; a fit without observed events gives way to one that has them."""
    t = np.arange(0, 20, 0.02)
    y = 1 - np.where(np.abs(np.mod(t - 0.5 + 1.5, 3.0) - 1.5) <= 0.1, 0.01, 0) + np.random.default_rng(0).normal(0, 1e-4, len(t))
    lc = spark.createDataFrame([(i, float(a), float(c)) for i in (1, 2) for a, c in zip(t, y)], SCHEMA)
    peaks = [(1, 0, 2.2, 10.0, 0.01, 0.001, 0.2, 0.5, 1, 1.0), (1, 1, 3.0, 9.9999, 0.01, 0.001, 0.2, 0.5, 2, 0.99999), (1, 2, 4.0, 9.0, 0.01, 0.001, 0.2, 0.5, 3, 0.9)]
    peaks += [(2, 0, 50.0, 10.0, 0.2, 0.001, 0.2, 40.0, 1, 1.0), (2, 1, 60.0, 9.0, 0.01, 0.001, 0.2, 45.0, 2, 0.9), (2, 2, 3.0, 5.0, 0.01, 0.001, 0.2, 0.5, 3, 0.5)]
    got = {r["star"]: r for r in b.chosen(lc, spark.createDataFrame(peaks, "star long, " + b.POWERS + ", rank int, share double")).collect()}
    assert got[1]["period"] == 3.0 and got[1]["ties"] == 2 and not got[1]["replaced"]
    assert got[2]["period"] == 3.0 and got[2]["replaced"] and got[2]["floor_met"] and got[2]["rank"] == 3
    none = b.chosen(lc, spark.createDataFrame([p for p in peaks if p[0] == 2][:2], "star long, " + b.POWERS + ", rank int, share double")).collect()[0]
    assert none["period"] == 50.0 and not none["floor_met"]


@pytest.mark.parametrize("factor", [1.0, 2.0, 3.0, 0.5])
def test_alias_ladder(spark, factor):
    """A true period is kept; a reported multiple or fraction of it is led back to it."""
    rows = star(5, 2.4, days=40.0, depth=0.01)
    lc = spark.createDataFrame(rows, SCHEMA)
    eph = spark.createDataFrame([(5, 2.4 * factor, 0.7, 4 / 24)], "star long, period double, epoch double, duration double")
    got = b.alias_ladder(lc, eph, series.point_noise(lc)).collect()
    pick = [r for r in got if r["chosen"]]
    assert len(pick) == 1 and pick[0]["period"] == pytest.approx(2.4)
    assert all(r["period"] <= 20 for r in got)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert b.search_transits(empty, S).collect() == []
    short = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.5, 1.1), (1, 0.9, 0.9)], SCHEMA)
    assert b.powers(short, S).collect() == []
    assert kernels.pieces(np.array([0.0]), 1.0) == [slice(0, 1)]


def test_named_series_in_blocks(spark, lc):
    named = lc.select(F.concat(F.lit("s"), F.col("star").cast("string")).alias("star"), "t", "y")
    whole = {(r["star"], r["grid"]): r["power"] for r in b.powers(named, S).collect()}
    parts = {(r["star"], r["grid"]): r["power"] for r in b.powers(named, S, block=500).collect()}  # no series is short
    assert whole.keys() == parts.keys() and len(whole) > 200
    assert all(parts[k] == pytest.approx(p, rel=1e-9) for k, p in whole.items())
