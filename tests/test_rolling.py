"""Row windows and single events in blocks, against whole series."""

import numpy as np
import pytest

from lightfold.operators import rolling

SCHEMA = "star long, t double, y double"


def curve(star, n, seed, gaps=(), dips=()):
    r = np.random.default_rng(seed)
    t = np.arange(n) * 0.02 + r.uniform(0, 0.004, n)
    for at, wide in gaps:
        t[at:] += wide
    y = 1 + r.normal(0, 5e-4, n)
    for c, d, depth in dips:
        y -= depth * rolling.shape((t - t[c]) / d)
    return [(star, float(a), float(b)) for a, b in zip(t, y)]


ROWS = curve(1, 700, 1, gaps=[(300, 0.5)], dips=[(150, 0.3, 0.006), (296, 0.2, 0.02), (500, 0.5, 0.004), (511, 0.2, 0.004)]) + curve(2, 64, 2) + curve(3, 5, 3) + curve(4, 400, 4, dips=[(200, 0.3, 0.09)])


def brute_scatter(y, half):
    out = []
    for i in range(len(y)):
        w = y[max(0, i - half) : i + half + 1]
        w = y if len(w) < 8 else w
        s = 1.4826 * np.median(np.abs(w - np.median(w)))
        s = s if s > 0 else w.std()
        out.append(s if s > 0 else np.nan)
    return np.array(out)


@pytest.mark.parametrize("half", [7, 12, 40])
def test_rolling_scatter_across_block_edges(spark, half):
    got = {}
    for r in rolling.rolling_scatter(spark.createDataFrame(ROWS, SCHEMA).repartition(4), half, block=64).collect():
        got.setdefault(r["star"], {})[r["i"]] = (r["t"], r["scatter"])
    for star in (1, 2, 3, 4):
        t, y = (np.array(x) for x in zip(*[(a, b) for s, a, b in ROWS if s == star]))
        want = brute_scatter(y, half)
        assert sorted(got[star]) == list(range(len(y)))
        assert np.allclose([got[star][i][0] for i in range(len(y))], t) and np.allclose([got[star][i][1] for i in range(len(y))], want)


def brute_events(t, y, durations, threshold, gap):
    n, cad = len(t), np.median(np.diff(t))
    edges = [0, n - 1] + [e for i in range(n - 1) if t[i + 1] - t[i] > gap for e in (i, i + 1)]
    out = []
    for d in durations:
        span = int(round(d / cad))
        if span < 3:
            continue
        half = max(span // 2, 1)
        for c in range(half, n - half, max(span // 3, 1)):
            s = slice(c - half, c + half + 1)
            x = rolling.shape((t[s] - t[c]) / d)
            w = y[max(0, c - 6 * span) : c + 6 * span + 1]
            sigma = 1.4826 * np.median(np.abs(w - np.median(w)))
            depth = (x * (1 - y[s])).sum() / (x * x).sum()
            sig = depth * np.sqrt((x * x).sum()) / sigma
            if sig >= threshold:
                a, z = t[c - half], t[c + half]
                out.append((d, c, round(sig, 6), round(depth, 9), int((x > 0.5).sum()), int(((t < a) & (t > a - d)).sum()), int(((t > z) & (t < z + d)).sum()), any(abs(c - e) <= span for e in edges)))
    return sorted(out)


@pytest.mark.parametrize("block", [64, 100, 1 << 14])
def test_event_candidates_equal_whole_series(spark, block):
    durations = [0.04, 0.1, 0.2, 0.3, 0.5]
    got = {}
    for r in rolling.event_candidates(spark.createDataFrame(ROWS, SCHEMA).repartition(3), durations, 6.0, 0.1, block).collect():
        got.setdefault(r["star"], []).append((r["duration"], r["i"], round(r["significance"], 6), round(r["depth"], 9), r["points"], r["before"], r["after"], r["edge"]))
    for star in (1, 4):
        t, y = (np.array(x) for x in zip(*[(a, b) for s, a, b in ROWS if s == star]))
        assert sorted(got[star]) == brute_events(t, y, durations, 6.0, 0.1)
    assert 3 not in got  # fewer than 50 rows


def test_planted_events_survive_and_walls_are_vetoed(spark):
    e = rolling.event_candidates(spark.createDataFrame(ROWS, SCHEMA), [0.2, 0.3, 0.5], 8.0)
    got = rolling.single_events(rolling.vetoes(e)).orderBy("star", "rank").collect()
    one = [r for r in got if r["star"] == 1]
    times = [t for s, t, _ in ROWS if s == 1]
    clean = [r for r in one if not r["vetoes"]]
    assert any(abs(r["t"] - times[150]) < 0.06 for r in clean) and any(abs(r["t"] - times[500]) < 0.15 for r in clean)
    assert all("adjacent_to_segment_edge_or_gap" in r["vetoes"] for r in one if abs(r["t"] - times[296]) < 0.1)
    assert all("depth_over_5_percent" in r["vetoes"] for r in got if r["star"] == 4 and r["rank"] == 1)
    for star in (1, 4):
        mine = [r for r in got if r["star"] == star]
        assert all(abs(a["t"] - b["t"]) >= max(a["duration"], b["duration"]) for a in mine for b in mine if a is not b)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rolling.rolling_scatter(empty, 5).collect() == [] and rolling.event_candidates(empty, [0.2]).collect() == []
