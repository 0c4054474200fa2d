"""Work on groups as arrays: whole groups, any key, as many tasks as a shuffle has, and no pandas frame a group."""

import numpy as np

from lightfold.operators import boxsearch, groups, rolling


def test_groups_are_whole(spark):
    rows = [(k, None if i % 7 == 3 else f"s{i % 3}", float(i)) for k in (None, 1, 2**60 + 1) for i in range(9000 if k == 1 else 30)]
    got = groups.mapped(spark.createDataFrame(rows, "k long, s string, y double").repartition(5), ["k", "s"], ["y"], ["k", "s"], ["y"], lambda g: ([0], [len(g["y"])], [float(g["y"].sum())]), "n long, total double")
    want: dict = {}
    for k, s, y in rows:
        n, t = want.get((k, s), (0, 0.0))
        want[k, s] = n + 1, t + y
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*k, *v)) for k, v in want.items())
    assert got.rdd.getNumPartitions() == 4
    assert got.filter("n < 0").collect() == []


def test_no_frame_a_star(spark):
    lc = spark.createDataFrame([(s, i * 0.5, 1 - 0.1 * (i == 40)) for s in range(3) for i in range(80)], "star long, t double, y double")
    e = rolling.event_candidates(lc, [2.0], 0.1, 1.0)
    peaks = boxsearch.distinct_peaks(spark.createDataFrame([(1, 0, 2.0, 5.0)], "star long, grid long, period double, power double"))
    for df in (e, rolling.single_events(e), peaks):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
        assert df.rdd.getNumPartitions() == 4


def test_periods_scanned_together(monkeypatch):
    rng = np.random.default_rng(4)
    for cells in (1, 700, 1 << 19):
        monkeypatch.setattr(boxsearch, "CELLS", cells)
        for n in (1, 2, 60):
            t, y, widths = np.sort(rng.uniform(0, 30, n)), rng.normal(size=n), [1, 4, 21]
            periods = boxsearch.trial_periods(1.0, 0.0167, 51)
            one = [boxsearch.scan(*boxsearch.fold(t, y, p, 0.1), n, y.sum(), 0.7, widths) for p in periods]
            assert one == list(zip(*boxsearch.box_scans(t, y, periods, 0.7, 0.1, widths)))


def test_scatter_of_some_rows():
    rng = np.random.default_rng(5)
    for n in (5, 40, 300):
        y = rng.normal(size=n).round(1)
        y[rng.random(n) < 0.2] = np.nan
        y[: n // 3] = 2.0
        for at in (np.arange(n), np.arange(2, n, 5)):
            got = rolling.local_scatter(y, at, 9)
            for i, s in zip(at, got):
                w = y[max(0, i - 9) : i + 10]
                w = w[~np.isnan(w)]
                mad = 1.4826 * np.median(np.abs(w - np.median(w))) if len(w) else 0.0
                want = mad if mad > 0 else w.std() if len(w) else 0.0
                assert np.isclose(s, want, rtol=1e-12) if want > 0 else np.isnan(s)
