"""Sequential estimators of one series, as Arrow groups: trends, single events, resampling."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scatter(x: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(x - np.median(x)))) if len(x) > 1 else float("nan")


def biweight_location(x: np.ndarray, rounds: int = 10, c: float = 5.0) -> float:
    """Tukey's biweight location, from the median."""
    mid = float(np.median(x))
    for _ in range(rounds):
        s = float(np.median(np.abs(x - mid)))
        if s == 0:
            return mid
        u = (x - mid) / (c * s)
        w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0.0)
        new = float((w * x).sum() / w.sum())
        if abs(new - mid) < 1e-10:
            return new
        mid = new
    return mid


def pieces(t: np.ndarray, gap: float) -> list[slice]:
    cut = np.flatnonzero(np.diff(t) > gap) + 1
    edges = [0, *cut.tolist(), len(t)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


CELLS = 1 << 20  # values of windows looked at together


def _medians(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the first n of each row of v, whose other places hold infinity. NaN among the first n gives NaN."""
    v = np.sort(v, axis=1)  # infinities, then NaN come last
    row = np.arange(len(v))
    mid = np.where(n % 2, v[row, n // 2], (v[row, np.maximum(n // 2 - 1, 0)] + v[row, n // 2]) / 2)
    return np.where(np.isnan(v[:, -1]), np.nan, mid)


def biweight_locations(y: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 10, c: float = 5.0) -> np.ndarray:
    """biweight_location of y[lo:hi] for many windows; windows of like length go together, as rows of an array."""
    n, out = hi - lo, np.empty(len(lo))
    order = np.argsort(n, kind="stable")
    a = 0
    while a < len(order):
        z = a + max(1, int(np.searchsorted(n[order[a:]] * np.arange(1, len(order) - a + 1), CELLS)))
        own = order[a:z]
        a = z
        k = n[own]
        at = np.arange(k[-1])[None, :]
        inside = at < k[:, None]
        x = np.where(inside, y[np.minimum(lo[own][:, None] + at, len(y) - 1)], np.inf)
        mid, live = _medians(x, k), np.arange(len(own))
        for _ in range(rounds):
            part, m = x[live], mid[live][:, None]
            away = np.abs(part - m)
            s = _medians(away, k[live])
            go = s != 0
            live, part, m, away, s = live[go], part[go], m[go], away[go], s[go]
            if not len(live):
                break
            u = (part - m) / (c * s[:, None])
            with np.errstate(invalid="ignore", over="ignore"):
                w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0.0)
            new = (w * np.where(w > 0, part, 0.0)).sum(1) / w.sum(1)
            moved = ~(np.abs(new - m[:, 0]) < 1e-10)
            mid[live] = new
            live = live[moved]
        out[own] = mid
    return out


def biweight_trend(t: np.ndarray, y: np.ndarray, window: float, gap: float, last: int | None = None) -> np.ndarray:
    """Biweight location of the points within half a window of each point and no gap from it; only of the `last` points, if given."""
    out = []
    for s in pieces(t, gap):
        ts, ys = t[s], y[s]
        at = ts[max(0, len(t) - last - s.start) :] if last is not None else ts
        lo, hi = np.searchsorted(ts, at - window / 2), np.searchsorted(ts, at + window / 2, side="right")
        out.append(biweight_locations(ys, lo, hi))
    return np.concatenate(out)


def savgol_trend(y: np.ndarray, width: int, order: int = 2, rounds: int = 3, sigma: float = 3.0) -> np.ndarray:
    """Savitzky-Golay smoothing by least squares, outliers replaced by the trend between rounds."""
    width = min(width | 1, len(y) - 1 | 1 if len(y) % 2 == 0 else len(y))
    if width > len(y):
        width -= 2
    if width <= order:
        return np.full(len(y), np.median(y))
    h = width // 2
    x = np.arange(-h, h + 1)
    v = np.vander(x, order + 1, increasing=True)
    weights = np.linalg.pinv(v)[0]
    given = y.astype(float).copy()
    trend = given
    for _ in range(rounds):
        trend = np.convolve(given, weights[::-1], mode="same")
        for edge in (slice(0, width), slice(len(y) - width, len(y))):
            fit = np.polynomial.polynomial.polyfit(np.arange(width), given[edge], order)
            value = np.polynomial.polynomial.polyval(np.arange(width), fit)
            if edge.start == 0:
                trend[:h] = value[:h]
            else:
                trend[-h:] = value[-h:]
        r = y - trend
        s = _scatter(r)
        if not s > 0:
            break
        given = np.where(np.abs(r) > sigma * s, trend, y)
    return trend


def detrended(lc: DataFrame, window: float, gap: float, method: str = "biweight", key: str = "star") -> DataFrame:
    """y over its trend."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, y = pdf["t"].to_numpy(), pdf["y"].to_numpy()
        if method == "biweight":
            trend = biweight_trend(t, y, window, gap)
        else:
            trend = np.empty(len(t))
            for s in pieces(t, gap):
                step = np.median(np.diff(t[s])) if s.stop - s.start > 1 else 1.0
                trend[s] = savgol_trend(y[s], int(window / step) | 1) if s.stop - s.start > 2 else y[s]
        return pd.DataFrame({key: k[0], "t": t, "y": np.where(trend != 0, y / trend, np.nan), "trend": trend})

    kind = lc.schema[key].dataType.simpleString()
    return lc.select(key, "t", "y").groupBy(key).applyInPandas(one, f"{key} {kind}, t double, y double, trend double")


def seeded(seed: int, *key: object) -> np.random.Generator:
    """A generator that the key fixes, whatever the partitions."""
    return np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())])


def scrambled(lc: DataFrame, gap: float, seed: int, key: str = "star") -> DataFrame:
    """Each segment's y shifted circularly by a number of points that seed, star and segment fix."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, y = pdf["t"].to_numpy(), pdf["y"].to_numpy().copy()
        for i, s in enumerate(pieces(t, gap)):
            n = s.stop - s.start
            if n > 1:
                y[s] = np.roll(y[s], int(seeded(seed, k[0], i).integers(1, n)))
        return pd.DataFrame({key: k[0], "t": t, "y": y})

    kind = lc.schema[key].dataType.simpleString()
    return lc.select(key, "t", "y").groupBy(key).applyInPandas(one, f"{key} {kind}, t double, y double")


def bootstrap_medians(rows: DataFrame, value: str, resamples: int, seed: int, key: str = "star") -> DataFrame:
    """Spread of a group's median over seeded resamples."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy())
        draws = seeded(seed, k[0]).integers(0, len(x), (resamples, len(x)))
        mids = np.median(x[draws], axis=1)
        return pd.DataFrame({key: [k[0]], "n": [len(x)], "median": [float(np.median(x))], "error": [float(mids.std())]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, value).groupBy(key).applyInPandas(one, f"{key} {kind}, n long, median double, error double")


def edge_bias(lc: DataFrame, window: float, cuts: int, seed: int, key: str = "star") -> DataFrame:
    """Difference of the trend near an edge made by truncation from the trend of the whole series."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, y = pdf["t"].to_numpy(), pdf["y"].to_numpy()
        rng = seeded(seed, k[0])
        rows = []
        for _ in range(cuts):
            n = int(rng.integers(len(t) // 2, len(t)))
            # no other points of either trend are looked at
            edge = np.arange(max(n - 5, 1), n)
            part = biweight_trend(t[:n], y[:n], window, np.inf, last=len(edge))
            whole = biweight_locations(y, np.searchsorted(t, t[edge] - window / 2), np.searchsorted(t, t[edge] + window / 2, side="right"))
            for back in range(1, min(6, n)):
                rows.append((k[0], back, float(part[-back] / whole[-back] - 1) if whole[-back] else 0.0))
        return pd.DataFrame(rows, columns=[key, "from_edge", "bias"])

    kind = lc.schema[key].dataType.simpleString()
    return lc.select(key, "t", "y").groupBy(key).applyInPandas(one, f"{key} {kind}, from_edge long, bias double")


def transit_model(t: np.ndarray, period: float, epoch: float, ratio: float, a_over_r: float, impact: float, u1: float = 0.35, u2: float = 0.25) -> np.ndarray:
    """Relative brightness of a small dark disc over a limb-darkened star (small-planet approximation)."""
    x = np.mod(t - epoch + period / 2, period) - period / 2
    z = np.sqrt((a_over_r * np.sin(2 * np.pi * x / period)) ** 2 + (impact * np.cos(2 * np.pi * x / period)) ** 2)
    front = np.cos(2 * np.pi * x / period) > 0
    mu = np.sqrt(np.clip(1 - z**2, 0, 1))
    light = (1 - u1 * (1 - mu) - u2 * (1 - mu) ** 2) / (1 - u1 / 3 - u2 / 6)
    covered = np.clip((1 + ratio - z) / (2 * ratio), 0, 1)
    return 1 - np.where(front, ratio**2 * light * covered, 0.0)


def posterior(lc: DataFrame, eph: DataFrame, steps: int, seed: int, key: str = "star") -> DataFrame:
    """Metropolis sampling of radius ratio and impact parameter at each star's ephemeris."""

    def one(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[key, "ratio", "ratio_error", "impact", "accepted"])
        t, y, e = left["t"].to_numpy(), left["y"].to_numpy(), right.iloc[0]
        s = _scatter(y) or 1.0
        rng = seeded(seed, k[0])

        def log(p):
            if not (0.001 < p[0] < 0.5 and 0 <= p[1] < 1):
                return -np.inf
            return -0.5 * float((((y - transit_model(t, e["period"], e["epoch"], p[0], e["a_over_r"], p[1])) / s) ** 2).sum())

        now = np.array([0.05, 0.3])
        at, chain, taken = log(now), [], 0
        for _ in range(steps):
            new = now + rng.normal(0, [0.01, 0.1])
            then = log(new)
            if np.log(rng.random()) < then - at:
                now, at, taken = new, then, taken + 1
            chain.append(now)
        c = np.array(chain[steps // 3 :])
        return pd.DataFrame({key: [k[0]], "ratio": [c[:, 0].mean()], "ratio_error": [c[:, 0].std()], "impact": [c[:, 1].mean()], "accepted": [taken / steps]})

    kind = lc.schema[key].dataType.simpleString()
    right = eph.select(F.col(key).alias("_k"), "period", "epoch", "a_over_r")
    return lc.select(key, "t", "y").groupBy(key).cogroup(right.groupBy("_k")).applyInPandas(one, f"{key} {kind}, ratio double, ratio_error double, impact double, accepted double")
