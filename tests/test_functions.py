import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lightfold.functions import ephemeris as ep
from lightfold.functions import sky, tails, text
from lightfold.operators import boxsearch, calibration, kernels, ranking


def test_tails():
    assert math.isclose(tails.poisson_tail(32, 3.32), 7.249058e-21, rel_tol=1e-6)
    assert math.isclose(tails.poisson_tail(90, 3.57), 1.084290e-90, rel_tol=1e-6)
    assert tails.poisson_tail(0, 2.0) == 1.0
    assert math.isclose(tails.binomial_tail(2, 3, 0.5), 0.5)
    assert math.isclose(tails.gaussian_tail(0.0), 0.5)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("ratio, name", [(1.0, "exact"), (0.5, "half_period_alias"), (2.0, "double_period_alias"), (1 / 3, "one_third_period_alias"), (1.05, "none")])
def test_period_relation(spark, ratio, name):
    r = one(spark, ep.period_relation(F.lit(3.0 * ratio), F.lit(3.0)).alias("r"))["r"]
    assert r["relation"] == name


def test_period_relation_without_period(spark):
    r = one(spark, ep.period_relation(F.lit(None).cast("double"), F.lit(3.0)).alias("r"))["r"]
    assert r["relation"] == "none" and r["factor"] is None


def test_cycle_rounds_half_to_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (-2.5,)], "t double").select(ep.cycle("t", F.lit(0.0), F.lit(1.0)).alias("n")).collect()
    assert [r["n"] for r in got] == [0, 2, -2]


def test_sky(spark):
    r = one(spark, sky.separation_deg(F.lit(10.0), F.lit(0.0), F.lit(11.0), F.lit(0.0)).alias("a"), sky.galactic_xyz(F.lit(266.405), F.lit(-28.936), F.lit(1.0)).alias("g"), sky.moved(F.lit(10.0), F.lit(89.95), F.lit(1.0), F.lit(1.0), F.lit(2000.0), F.lit(2001.0))["basis"].alias("b"))
    assert abs(r["a"] - 1.0) < 1e-9
    assert r["g"]["x"] > 0.9999
    assert r["b"] == "declination_only_near_pole"


def test_text(spark):
    r = one(spark, text.sectors(F.lit("[36; 37;x;37, 5]")).alias("s"), text.cohort_key(F.lit(3), F.lit(None).cast("int"), F.lit(2)).alias("c"), text.lenient_double(F.lit("inf")).alias("d"), text.export_label(F.lit("known_eb-host")).alias("l"))
    assert r["s"] == [5, 36, 37] and r["c"] == "s3-camunknown-ccd2" and r["d"] is None and r["l"] == "Known eb host"


def test_peaks_and_points(spark):
    rows = [(1, g, p, w) for g, (p, w) in enumerate([(1.0, 3.0), (1.01, 2.9), (2.0, 1.0)])]
    got = boxsearch.distinct_peaks(spark.createDataFrame(rows, "star long, grid long, period double, power double"), 0.02, 5)
    assert [r["grid"] for r in got.orderBy("rank").collect()] == [0, 2]
    assert ranking.farthest_points(np.array([[0.0], [1.0], [10.0], [11.0]]), 2) == [0, 3]


def test_periodogram_finds_a_box():
    rng = np.random.default_rng(1)
    t = np.arange(0, 27, 10 / 1440)
    y = 1 + rng.normal(0, 5e-4, len(t))
    y[np.abs((t - 1.0 + 1.5) % 3.0 - 1.5) < 0.06] -= 0.003
    periods = 1 / np.linspace(1 / 1.5, 1 / 5.0, 3000)
    found = [boxsearch.scan(*boxsearch.fold(t, y - 1, p, 0.008), len(t), (y - 1).sum(), 5e-4, [10, 15, 25]) for p in periods]
    best = int(np.argmax([f[0] for f in found]))
    assert abs(periods[best] - 3.0) < 0.02 and abs(found[best][1] - 0.003) < 0.0008


def test_trends():
    t = np.linspace(0, 10, 500)
    y = 1 + 0.01 * np.sin(t)
    # windows are one-sided at the ends, so only inner points are held to the curve
    assert np.abs(kernels.biweight_trend(t, y, 0.5, 1.0) - y)[25:-25].max() < 2e-4
    assert np.abs(kernels.savgol_trend(y, 51) - y).max() < 1e-3
    assert kernels.biweight_location(np.array([1.0, 1.0, 1.0, 50.0])) == 1.0


def test_transit_model_depth():
    m = kernels.transit_model(np.array([0.0, 1.5]), 3.0, 0.0, 0.1, 10.0, 0.0)
    assert m[1] == 1.0 and 0.009 < 1 - m[0] < 0.013


def test_gates_need_measurements(spark):
    cols = "inverted_rate double, scrambled_rate double, baseline_rate double, median_bias double, edge_gap double, epoch_enrichment double"
    got = calibration.gates(spark.createDataFrame([(0.0, 0.0, 0.01, 0.0, 0.0, 1.0), (0.0, None, 0.01, 0.0, 0.0, 1.0)], cols)).collect()
    assert [r["released"] for r in got] == [True, False]


def test_signatures():
    from lightfold.functions import signatures

    a = signatures.scientific("c1", "p", "t")
    assert a == signatures.scientific("c1", "p", "t") != signatures.scientific("c2", "p", "t")
    rows = [(2, "b"), (1, "a")]
    assert signatures.campaign("t", {"x": 1, "execution": 4}, rows) == signatures.campaign("t", {"x": 1, "storage_retention": 2}, rows[::-1])
    assert signatures.positions([(1.0000000001, 2.0)]) == signatures.positions([(1.0, 2.0)])


def test_biweight_of_many_windows_equals_one_by_one():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 70, 900):
        t, y = np.sort(r.uniform(0, 30, n)), r.normal(100, 5, n)
        y[::7], y[: n // 3] = 100.0, 50.0  # windows without scatter too
        for window, gap in ((3.0, 2.0), (0.5, 0.1), (3.0, np.inf)):
            want = np.concatenate([[kernels.biweight_location(y[s][np.abs(t[s] - x) <= window / 2]) for x in t[s]] for s in kernels.pieces(t, gap)])
            assert np.allclose(kernels.biweight_trend(t, y, window, gap), want, rtol=1e-12, atol=0)
            assert np.allclose(kernels.biweight_trend(t, y, window, gap, last=4), want[-4:], rtol=1e-12, atol=0)


def test_edge_bias_is_that_of_whole_trends(spark):
    t = np.linspace(0, 30, 400)
    y = np.random.default_rng(2).normal(100, 5, 400)
    got = kernels.edge_bias(spark.createDataFrame(pd.DataFrame({"star": 1, "t": t, "y": y})), 3.0, 2, 7).collect()
    rng, want = kernels.seeded(7, 1), []
    whole = kernels.biweight_trend(t, y, 3.0, np.inf)
    for _ in range(2):
        n = int(rng.integers(200, 400))
        part = kernels.biweight_trend(t[:n], y[:n], 3.0, np.inf)
        want += [part[n - b] / whole[n - b] - 1 for b in range(1, 6)]
    assert np.allclose([r["bias"] for r in got], want, rtol=1e-9, atol=1e-12) and [r["from_edge"] for r in got] == [1, 2, 3, 4, 5] * 2
