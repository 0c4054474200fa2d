"""Ranks, bands and sharers against all pairs, crowded periods included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lightfold.operators import sweep

SCHEMA = "campaign string, tic long, period double, epoch double, tolerance double, camera long, ccd long, ra double, dec double"


def fits(n, crowd, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        p = 6.85 if i < crowd else float(r.uniform(1, 10))
        rows.append(("a" if i % 3 else "b", i, p, float(r.uniform(0, 0.2) if i % 2 else r.uniform(0, 27)), float(r.uniform(0.02, 0.1)), int(r.integers(1, 5)) if i % 7 else None, int(r.integers(1, 5)) if i % 5 else None, float(r.uniform(0, 360)), float(r.uniform(-89, 89))))
    return rows


def brute(rows):
    out = {}
    for c, tic, p, e, tol, *_, ra, dec in rows:
        near = [o for o in rows if o[0] == c and o[1] != tic and p * (1 - 0.02) <= o[2] <= p * (1 + 0.02)]
        hit = []
        for o in near:
            off = np.mod(o[3] - e, p)
            off = off - p if off > p / 2 else off
            if abs(off) <= tol:
                hit.append(o)
        sep = []
        for o in hit:
            a, d, b, f = np.radians([ra, dec, o[7], o[8]])
            h = np.sin((f - d) / 2) ** 2 + np.cos(d) * np.cos(f) * np.sin((b - a) / 2) ** 2
            sep.append(float(np.degrees(2 * np.arcsin(np.sqrt(min(1.0, h))))))
        sep.sort()
        out[tic] = (len(near), len(hit), len({o[5] for o in hit} - {None}), len({(o[5], o[6]) for o in hit if o[5] is not None and o[6] is not None}), sep[-1] if sep else None, sep[len(sep) // 2] if sep else None)
    return out


def test_sharers_equal_all_pairs_across_tiles(spark):
    rows = fits(300, 120, 1)
    shared = sweep.sharers(spark.createDataFrame(rows, SCHEMA).repartition(3), ["campaign"], 0.02, tile=32)
    mid = {r["rank"]: r["median"] for r in sweep.median_separation(shared, tile=32).collect()}
    want = brute(rows)
    for r in shared.withColumn("c", F.bit_count("cameras")).withColumn("d", F.bit_count("detectors")).collect():
        near, hit, cameras, detectors, spread, median = want[r["tic"]]
        assert (r["neighbours"], r["sharers"], r["c"], r["d"]) == (near, hit, cameras, detectors)
        if hit:
            assert abs(r["spread"] - spread) < 1e-9 and abs(mid[r["rank"]] - median) < 1e-6
        else:
            assert r["spread"] is None and r["rank"] not in mid


@pytest.mark.parametrize("wide", [1, 2, 64])
def test_medians_whole_and_by_rounds(spark, wide):
    """Tiles that meet all blocks at once and those that meet them one by one give the same."""
    rows = fits(300, 120, 2)
    shared = sweep.sharers(spark.createDataFrame(rows, SCHEMA), ["campaign"], 0.02, tile=32)
    mid = {r["rank"]: r["median"] for r in sweep.median_separation(shared, tile=32, wide=wide).collect()}
    want = brute(rows)
    for r in shared.collect():
        assert (r["rank"] in mid) == (want[r["tic"]][1] > 0) and (r["rank"] not in mid or abs(mid[r["rank"]] - want[r["tic"]][5]) < 1e-6)


def test_only_pairs_in_phase_are_looked_at(monkeypatch):
    """All fits of one period, spread over its phases: looked at are those near in phase, not all."""
    n = 2000
    x = pd.DataFrame({"rank": np.arange(n), "low": 0, "high": n, "period": 5.0, "epoch": np.random.default_rng(1).uniform(0, 30, n), "tolerance": 0.02})
    seen = []
    repeat = np.repeat
    monkeypatch.setattr(sweep.np, "repeat", lambda *a, **k: seen.append(len(out := repeat(*a, **k))) or out)
    pairs = sum(len(i) for i, _ in sweep._sharing(x, x))
    off = np.mod(x["epoch"].to_numpy()[None, :] - x["epoch"].to_numpy()[:, None], 5.0)
    assert pairs == (np.minimum(off, 5.0 - off) <= 0.02).sum() - n
    assert sum(seen) < n * n / 10
    for odd in ({"period": 0.01}, {"period": 1e-5}, {"tolerance": 3.0}, {"epoch": np.nan}):
        y = x.iloc[:50].assign(high=50, **odd)
        e, p = y["epoch"].to_numpy(), y["period"].to_numpy()[:, None]
        off = np.mod(e[None, :] - e[:, None], p)
        near = np.abs(np.where(off > p / 2, off - p, off)) <= y["tolerance"].to_numpy()[:, None]
        np.fill_diagonal(near, False)
        got = [(a, b) for i, j in sweep._sharing(y, y) for a, b in zip(i, j)]
        assert sorted(got) == sorted(zip(*np.nonzero(near)))


def test_rows_of_a_crowded_period_stay_linear(spark):
    """Four times the fits of one period make four times the rows, not sixteen."""
    made = []
    for n in (200, 800):
        rows = [("a", i, 5.0, 0.1, 0.05, 1, 1, 10.0, 10.0 + i * 1e-4) for i in range(n)]
        shared = sweep.sharers(spark.createDataFrame(rows, SCHEMA), ["campaign"], 0.02)
        got = shared.collect()
        assert {r["sharers"] for r in got} == {n - 1}
        made.append(len(got))
    assert made == [200, 800]


def test_running_count_over_ties(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("v"), F.col("id"), F.lit(1).alias("one")).repartition(5)
    got = sorted((r["v"], r["id"], r["c"]) for r in sweep.running_count(rows, [F.col("v"), F.col("id")], "one", "c").collect())
    assert [c for _, _, c in got] == list(range(1, 1001))


def test_no_fits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    shared = sweep.sharers(empty, ["campaign"], 0.02)
    assert shared.collect() == [] and sweep.median_separation(shared).collect() == []
