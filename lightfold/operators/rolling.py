"""Work on a series by row offsets, in blocks of consecutive rows that overlap, and single events found so.

Rows get their number within the star from a sort by ranges over all stars. A block is BLOCK rows
and reads `halo` rows on either side, so a long series is many tasks and no group holds it whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import mapped
from .series import differences
from .sweep import running_count

BLOCK = 1 << 14


def numbered(lc: DataFrame, key: str = "star") -> DataFrame:
    """(star, t, y, i, n): rows numbered from 0 in order of time (then y), and how many the star has."""
    c = running_count(lc.select(key, "t", "y", F.lit(1).alias("_one")), [F.col(key), F.col("t"), F.col("y")], "_one", "_c")
    per = c.groupBy(key).agg(F.min("_c").alias("_first"), F.count(F.lit(1)).alias("n"))
    return c.join(per, key).select(key, "t", "y", (F.col("_c") - F.col("_first")).alias("i"), "n")


def blockwise(rows: DataFrame, halo, work: Callable[[dict[str, np.ndarray], int, int], tuple], schema: str, block: int = BLOCK, key: str = "star", extra: tuple[str, ...] = ()) -> DataFrame:
    """work(rows of a block and its halo in order, first row of its own, one past the last) for every block: a tuple of columns.

    rows: star, t, y, i, n and the extra columns; halo is a number or column of rows.
    """
    h = F.lit(halo) if isinstance(halo, int) else halo
    last = F.floor((F.col("n") - 1) / block)
    first = F.greatest(F.lit(0), F.floor((F.col("i") - h) / block))
    dealt = rows.withColumn("_b", F.explode(F.sequence(first, F.least(last, F.floor((F.col("i") + h) / block)))))

    def one(g: dict[str, np.ndarray]) -> tuple:
        lo, hi = np.searchsorted(g["i"], [g["_b"][0] * block, (g["_b"][0] + 1) * block])
        out = work(g, int(lo), int(hi))
        return (np.zeros(len(out[0]), np.int64), *out)

    return mapped(dealt, [key, "_b"], ["i"], [key], ["_b", "t", "y", "i", "n", *extra], one, schema)


def medians(w: np.ndarray) -> np.ndarray:
    """Median of each row, nan left out."""
    w = np.sort(w, axis=1)  # nan comes last
    n, rows = np.count_nonzero(~np.isnan(w), axis=1), np.arange(len(w))
    return (w[rows, (n - 1) // 2] + w[rows, n // 2]) / 2


def local_scatter(y: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """Robust scatter of up to half rows on either side of the rows `at` (rising), the deviation where that is 0.

    Windows are cut off at the ends of y. A series of under 8 rows has that of all its rows.
    """
    if half < 7:
        raise ValueError("windows at the ends need 8 rows")  # 8 rows or more in each, or all of a short series
    half = min(half, len(y))
    # rows that see the same part of y have the same scatter
    ends = np.stack((np.maximum(at - half, 0), np.minimum(at + half, len(y))))
    new = np.append(True, (ends[:, 1:] != ends[:, :-1]).any(0))[: len(at)]
    one = at[new]
    wide = np.concatenate((np.full(half, np.nan), y, np.full(half, np.nan)))
    out = np.empty(len(one))
    step = max(1, 4_000_000 // (2 * half + 1))
    for s in range(0, len(one), step):
        w = wide[one[s : s + step, None] + np.arange(2 * half + 1)]
        mad = 1.4826 * medians(np.abs(w - medians(w)[:, None]))
        flat = ~(mad > 0)
        if flat.any():
            none = np.isnan(w[flat]).all(1)
            w[np.flatnonzero(flat)[none]] = 0.0
            mad[flat] = np.nanstd(w[flat], axis=1)
        out[s : s + step] = mad
    return np.where(out > 0, out, np.nan)[np.cumsum(new) - 1]


def rolling_scatter(lc: DataFrame, half: int, block: int = BLOCK, key: str = "star") -> DataFrame:
    """(star, i, t, scatter): robust scatter of the rows within half rows of each."""

    def work(g: dict[str, np.ndarray], lo: int, hi: int) -> tuple:
        return g["i"][lo:hi], g["t"][lo:hi], local_scatter(g["y"], np.arange(lo, hi), half)

    return blockwise(numbered(lc, key), half, work, "i long, t double, scatter double", block, key)


def shape(x: np.ndarray, impact: float = 0.0, u1: float = 0.35, u2: float = 0.23) -> np.ndarray:
    """Dip of a transit at offsets in durations: quadratic limb darkening along the chord, 1 at the middle, 0 beyond half a duration."""
    r2 = np.minimum(1.0, impact**2 + 4 * x * x * max(1 - impact**2, 1e-12))
    light = lambda mu: 1 - u1 * (1 - mu) - u2 * (1 - mu) ** 2
    return np.where(np.abs(x) <= 0.5, light(np.sqrt(1 - r2)) / light(np.sqrt(max(1 - impact**2, 0.0))), 0.0)


EVENTS = "duration double, i long, t double, depth double, error double, significance double, points long, before long, after long, edge boolean"
REACH = 6  # half width of the scatter's window, in durations


def event_candidates(lc: DataFrame, durations: list[float], threshold: float = 8.0, gap: float = 0.1, block: int = BLOCK, key: str = "star") -> DataFrame:
    """Every trial centre whose transit-shaped dip is significant, at each duration (days), with what may veto it.

    A duration spans a number of rows by the star's median cadence, three at least; centres are a
    third of it apart. The dip below 1 is fitted by least squares with the local scatter of 6
    durations on either side. before and after count rows within one duration outside the window
    (as far as the block's halo reaches); edge tells of a gap or end within one span.
    """
    cadence = differences(lc, key).groupBy(key).agg(F.median("dt").alias("cadence")).filter("cadence > 0")
    longest = F.rint(F.lit(max(durations)) / F.col("cadence")).cast("long")
    rows = numbered(lc, key).filter("n >= 50").join(cadence, key)

    def work(g: dict[str, np.ndarray], lo: int, hi: int) -> tuple:
        t, y, base, n, step0 = g["t"], g["y"], int(g["i"][0]), int(g["n"][0]), float(g["cadence"][0])
        cuts = np.flatnonzero(np.diff(t) > gap)
        edges = np.unique(np.concatenate((cuts, cuts + 1, [-base, n - 1 - base])))
        found = [np.zeros((10, 0))]
        for d in durations:
            span = int(np.rint(d / step0))
            if span < 3:
                continue
            half, step = max(span // 2, 1), max(span // 3, 1)
            # centres are half, half + step, ... of the whole series
            start = max(lo + base, half)
            start += (half - start) % step
            at = np.arange(start, min(hi + base, n - half), step) - base
            if not len(at):
                continue
            sigma = local_scatter(y, at, REACH * span)
            near = at[:, None] + np.arange(-half, half + 1)[None, :]
            dip = shape((t[near] - t[at][:, None]) / d)
            weight = (dip**2).sum(1) / sigma**2
            depth = (dip * (1 - y[near])).sum(1) / np.maximum((dip**2).sum(1), 1e-300)
            sure = depth * np.sqrt(weight)
            c = np.flatnonzero((weight > 0) & (sure >= threshold) & (depth > 0))
            a, z = t[at[c] - half], t[at[c] + half]
            edge = np.searchsorted(edges, at[c] + span + 1) > np.searchsorted(edges, at[c] - span)
            before = np.searchsorted(t, a) - np.searchsorted(t, a - d, side="right")
            after = np.searchsorted(t, z + d) - np.searchsorted(t, z, side="right")
            # whole numbers are far below 2^53
            found.append(np.stack((np.full(len(c), d), at[c] + base, t[at[c]], depth[c], 1 / np.sqrt(weight[c]), sure[c], (dip[c] > 0.5).sum(1), before, after, edge)))
        out = np.concatenate(found, axis=1)
        whole = {1: np.int64, 6: np.int64, 7: np.int64, 8: np.int64, 9: bool}
        return tuple(x.astype(whole.get(j, float)) for j, x in enumerate(out))

    # a row's halo: the scatter's window and the event's own half beyond it
    return blockwise(rows, (REACH + 2) * longest + 8, work, EVENTS, block, key, ("cadence",))


def vetoes(e: DataFrame, depth_max: float = 0.05) -> DataFrame:
    """Adds vetoes: why a candidate is no single event, in order."""
    v = F.array_compact(F.array(
        F.when(F.col("points") < 3, F.lit("fewer_than_minimum_cadences_in_event")), F.when((F.col("before") == 0) | (F.col("after") == 0), F.lit("no_two_sided_local_baseline")),
        F.when(F.col("edge"), F.lit("adjacent_to_segment_edge_or_gap")), F.when(F.col("depth") > depth_max, F.lit("depth_over_5_percent")),
    ))
    return e.withColumn("vetoes", v)


def single_events(candidates: DataFrame, most: int = 20, key: str = "star") -> DataFrame:
    """Candidates by falling significance that lie a duration (the longer one) or more from all kept before, `most` a star.

    Equal significances (to some digits) go to the shorter duration, then to the earlier centre.
    """

    def one(g: dict[str, np.ndarray]) -> tuple:
        at = np.lexsort((g["i"], g["duration"], -g["significance"].round(9)))
        t, d, kept = g["t"][at], g["duration"][at], []
        free = np.ones(len(at), bool)
        while len(kept) < most and free.any():
            k = int(free.argmax())
            kept.append(k)
            free &= np.abs(t - t[k]) >= np.maximum(d, d[k])
        return at[kept], np.arange(1, len(kept) + 1)

    return mapped(candidates, [key], ["i"], candidates.columns, ["i", "t", "duration", "significance"], one, "rank int")
