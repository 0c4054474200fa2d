"""Trial periods dealt into tasks give what a search by one task gives."""

import numpy as np
import pytest

from lightfold.operators import boxsearch as b
from lightfold.plans import search_queries as q

S = b.Periodic(low=1.0, high=6.0, hours=(2.0, 4.0, 8.0), factor=20.0)


@pytest.mark.parametrize("shape", ["box", "transit"])
def test_shares_of_trials_against_the_whole(spark, shape):
    r = np.random.default_rng(3)
    rows = [(name, float(t), float(1 + r.normal(0, 3e-4) - 0.002 * (t % 3.3 < 0.15))) for name, n in (("a", 2500), ("b", 700)) for t in np.sort(r.uniform(0, 27, n))]
    lc = spark.createDataFrame(rows, "star string, t double, y double").repartition(3)
    whole, parts = (b.powers(lc, S, shape=shape, **k).collect() for k in ({}, {"block": 400, "most_bins": 9_000}))
    assert len(whole) == len(parts)
    whole, parts = ({(x["star"], x["grid"]): x for x in f} for f in (whole, parts))
    assert whole.keys() == parts.keys() and len(whole) > 200
    for k, x in whole.items():
        assert parts[k]["period"] == pytest.approx(x["period"], rel=1e-12) and parts[k]["power"] == pytest.approx(x["power"], rel=1e-9) and parts[k]["depth"] == pytest.approx(x["depth"], rel=1e-6)


def test_sorted_folds():
    r = np.random.default_rng(1)
    t, y = np.sort(r.uniform(3, 20, 9000)), r.normal(0, 1, 9000)
    for period in (1.0, 2.34, 7.77, 40.0):
        for got, want in zip(b.fold_sorted(t, np.concatenate(([0.0], np.cumsum(y))), period, 0.1), b.fold(t, y, period, 0.1)):
            assert got == pytest.approx(want, abs=1e-9)


def test_template_decision_searches_the_whole_grid(spark, monkeypatch):
    """Its grid had some 60 trial periods, a coarse step and three durations."""
    seen, powers = [], b.powers
    monkeypatch.setattr(b, "powers", lambda x, s, *a, **k: seen.append(s) or powers(x, s, *a, **k))
    q.lc_template_decision(spark, "/root/testdata/sf0.001")
    assert seen == [b.Periodic(), b.Periodic()]
