"""Resampled centroids against expanding every resample, on pixels that are ragged, doubled and in orders of their own."""

import hashlib

import numpy as np
import pytest

from lightfold.operators import pixelchecks as pc

PX = "star string, t double, row long, col long, flux double"
EPH = "star string, period double, epoch double, duration double"


def given():
    r = np.random.default_rng(4)
    rows = []
    for s in ("a", "a rather long name of a star that needs a second block of the hash"):
        for k in range(70):
            t = round(k * 0.093, 3)
            inside = abs((t - 0.5 + 1.0) % 2.0 - 1.0) <= 0.2
            for i in range(3):
                for j in range(3):
                    if (k + i + j) % 11:
                        rows.append((s, t, i, j, None if (k * i) % 23 == 22 else float(50 + r.normal(0, 2) - 20 * (inside and (i, j) == (1, 2)))))
                    if (k, i, j) == (8, 1, 1):
                        rows.append((s, t, i, j, 7.5))
    return rows


def direct(rows, samples, seed):
    draw = lambda s, t, k: sum((int(hashlib.md5(f"{seed}|{s}|{round(t * 1e6)}|{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 > p for p in pc.POISSON)
    at = []
    for k in range(samples):
        light = {}
        for s, t, i, j, y in rows:
            off = abs((t - 0.5 + 1.0) % 2.0 - 1.0)
            if y is not None and (off <= 0.2 or 0.6 <= off <= 2.0):
                light.setdefault((i, j), ([], []))[off <= 0.2].extend([y] * draw(s, t, k))
        lost = {p: np.median(o) - np.median(n) for p, (o, n) in light.items() if o and n}
        m = np.median(list(lost.values())) if lost else 0
        w = {p: max(x - m, 0) for p, x in lost.items()}
        if sum(w.values()) > 0:
            at.append([sum(p[a] * x for p, x in w.items()) / sum(w.values()) for a in (0, 1)])
    at = np.array(at)
    return [len(at), *at.mean(0), *at.std(0, ddof=1)]


def test_resamples_against_expanding_them(spark):
    rows = given()
    px = spark.createDataFrame(rows, PX).repartition(3)
    eph = spark.createDataFrame([(s, 2.0, 0.5, 0.4) for s in {x[0] for x in rows}], EPH)
    got = pc.bootstrap_centroids(px, eph, 30, 5).collect()
    assert len(got) == 2
    for r in got:
        want = direct([x for x in rows if x[0] == r["star"]], 30, 5)
        assert [r["samples"], r["row"], r["col"], r["row_error"], r["col_error"]] == pytest.approx(want, rel=1e-9)


def test_draws_are_no_columns_of_pixels(spark):
    """The draws of a cadence were carried by the rows of all its pixels, and hashed one by one."""
    px, eph = spark.createDataFrame(given(), PX), spark.createDataFrame([("a", 2.0, 0.5, 0.4)], EPH)
    plan = pc.bootstrap_centroids(px, eph, 30, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and plan.count("FlatMapGroups") == 1
    w = pc.drawn(5, 30, "a", np.array([0.25, 1.0000005]))
    assert w.tolist() == [[spark.range(1).select(pc.draw(5, pc.F.lit(i), pc.F.lit("a"), pc.F.lit(t))).first()[0] for i in range(30)] for t in (0.25, 1.0000005)]


def test_stars_with_too_few_cadences_have_no_row(spark):
    rows = [("few", 0.1 * k, 1, 1, 5.0) for k in range(9)] + [("dark", 0.1 * k, 1, 1, None) for k in range(40)]
    eph = spark.createDataFrame([("few", 2.0, 0.5, 0.4), ("dark", 2.0, 0.5, 0.4)], EPH)
    got = pc.bootstrap_centroids(spark.createDataFrame(rows, PX), eph, 8, 5).collect()
    assert [(r["star"], r["samples"], r["row"], r["verdict"]) for r in got] == [("dark", 0, None, "not_evaluable")]


def test_query_draws_all_resamples(spark):
    from lightfold.plans import catalog

    got = catalog.QUERIES["bootstrap_centroid"](spark, "/root/testdata/sf0.001").agg({"samples": "max"}).first()[0]
    assert got > 200 and "range(256)" in catalog.ORACLES["bootstrap_centroid"] and "range(24)" not in catalog.ORACLES["bootstrap_centroid"]
