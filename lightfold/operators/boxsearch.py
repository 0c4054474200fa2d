"""Whole periodic searches: boxes and transit shapes over a frequency grid of each star's own.

A trial period folds a series into phase bins; bins hold counts and sums, so those of parts of a
series add up. Series of up to BLOCK points are searched by one task each. Longer ones are dealt
into blocks, each block folds its own points at every trial period, and Spark adds the bins of
all blocks before they are scanned: no task ever holds such a series. Where a grid has more phase
bins than DEALT, its trial periods are dealt into tasks instead, each of which reads the whole
series in the order of time, a block at a time, and holds the bins of its own trials.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALIAS_RATIOS, SEARCH
from ..session import discard, keep, shuffled
from .events import ephemeris_support, event_depths
from .groups import mapped
from .series import differences, mad, point_noise

BLOCK = 1 << 18
DIGITS = 9
CELLS = 1 << 19  # points or bins of trial periods that are folded at once
DEALT = 1 << 22  # bins of trial periods, of all grids with more of which a task gets a share


@dataclass(frozen=True)
class Periodic:
    """Bounds and density of a search. Periods and durations in days; hours as reported."""

    low: float = 0.5
    high: float = 13.5
    hours: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
    factor: float = 8.0
    most: int = 100_000
    oversample: int = 10

    @property
    def days(self) -> list[float]:
        """Durations shorter than the shortest period."""
        found = sorted(h / 24.0 for h in self.hours if 0 < h / 24.0 < self.low)
        if not found:
            raise ValueError("no duration is shorter than the shortest period")
        return found

    @property
    def side(self) -> float:
        """Width of a phase bin in days."""
        return self.days[0] / self.oversample

    @property
    def widths(self) -> list[int]:
        """Durations that are really searched, in bins."""
        return sorted({int(math.floor(d / self.side + 0.5)) for d in self.days})


def facts(lc: DataFrame, s: Periodic, key: str = "star", fallback: bool = True) -> DataFrame:
    """Of each star: points, time range, level, noise of a point, and its grid (top frequency less multiples of step).

    Even steps of factor * shortest duration / span^2, coarser where that would exceed the most
    trial periods. Stars without noise or too short for a period are left out. Without fallback
    the noise is that of successive differences alone, as in the SQL twins: a star most of whose
    points equal the one before has none.
    """
    per = lc.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), (F.max("t") - F.min("t")).alias("span"), F.median("y").alias("level"))
    noise = point_noise(lc, key) if fallback else mad(differences(lc, key), [key], "dy").withColumn("noise", F.col("scatter") / F.sqrt(F.lit(2.0)))
    per = per.join(noise.select(key, "noise"), key).filter(F.col("noise") > 0)
    high = F.least(F.lit(s.high), F.col("span"))
    reach = F.lit(1.0 / s.low) - 1.0 / high
    factor = F.greatest(F.lit(float(s.factor)), reach * F.col("span") * F.col("span") / (s.most * s.days[0]))
    step = factor * s.days[0] / (F.col("span") * F.col("span"))
    per = per.filter(F.col("span") > s.low).withColumn("step", step)
    return per.withColumn("trials", (1 + F.rint(reach / F.col("step"))).cast("long"))


def trial_periods(low: float, step: float, trials: int) -> np.ndarray:
    return 1.0 / (1.0 / low - step * np.arange(trials))


def fold(t: np.ndarray, y: np.ndarray, period: float, side: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the phase bins; the last bin may be narrower."""
    bins = int(math.ceil(period / side))
    at = np.minimum((np.mod(t, period) / side).astype(np.int64), bins - 1)
    return np.bincount(at, minlength=bins).astype(float), np.bincount(at, weights=y, minlength=bins)


def fold_sorted(t: np.ndarray, upto: np.ndarray, period: float, side: float) -> tuple[np.ndarray, np.ndarray]:
    """fold() of rising times whose sums so far are upto (one more, from 0): bins of a cycle are runs of them, whose ends are looked up."""
    bins = int(math.ceil(period / side))
    a, z = int(t[0] // period), int(t[-1] // period)
    place = np.arange(max(0, int((t[0] - a * period) / side) - 1), (z - a) * bins + min(bins, int((t[-1] - z * period) / side) + 2))
    if len(t) < 2 * len(place):
        return fold(t, np.diff(upto), period, side)
    turn, j = np.divmod(place, bins)
    ends = np.append(np.searchsorted(t, (a + turn) * period + j * side), len(t))
    ends[0] = 0
    return np.bincount(j, np.diff(ends), bins), np.bincount(j, np.diff(upto[ends]), bins)


def profile(width: int, impact: float = 0.0, u1: float = 0.35, u2: float = 0.23) -> np.ndarray:
    """A transit of `width` bins over a limb-darkened star (quadratic law along a chord), deepest 1."""
    x = (np.arange(width) + 0.5) / width - 0.5
    r2 = np.minimum(1.0, impact**2 + (2 * x) ** 2 * (1 - impact**2))
    dark = 1 - np.sqrt(np.maximum(0.0, 1 - r2))
    mid = 1 - math.sqrt(1 - impact**2)
    return (1 - u1 * dark - u2 * dark**2) / (1 - u1 * mid - u2 * mid**2)


def scan(k: np.ndarray, s: np.ndarray, n: int, total: float, noise: float, widths: list[int], shapes: dict[int, np.ndarray] | None = None) -> tuple[float, float, float, int, int]:
    """(power, depth, error of depth, width, first bin) of the strongest dip over all widths and phases.

    Without shapes dips are boxes: mean outside less mean inside. With shapes each is fitted by
    least squares against a level of 0. Power is the gain in log likelihood. Of equal powers the
    narrowest comes first, then the earliest phase. Windows run over the end of the phase.
    """
    bins, best = len(k), (0.0, 0.0, 0.0, 0, 0)
    for w in widths:
        if w > bins:
            continue
        kk, ss = (np.concatenate((x, x[: w - 1])) for x in (k, s))
        with np.errstate(divide="ignore", invalid="ignore"):
            if shapes is None:
                ck, cs = np.concatenate(([0.0], np.cumsum(kk))), np.concatenate(([0.0], np.cumsum(ss)))
                inside, sums = ck[w:] - ck[:-w], cs[w:] - cs[:-w]
                depth = (total - sums) / (n - inside) - sums / inside
                power = np.where((inside > 0) & (inside < n) & (depth >= 0), 0.5 * inside * (depth / noise) ** 2, -1.0)
                error = noise * np.sqrt(1 / inside + 1 / (n - inside))
            else:
                weight = np.correlate(kk, shapes[w] ** 2, "valid")
                depth = -np.correlate(ss, shapes[w], "valid") / weight
                power = np.where((weight > 0) & (depth >= 0), 0.5 * weight * (depth / noise) ** 2, -1.0)
                error = noise / np.sqrt(weight)
        j = int(power.argmax())
        if power[j] > best[0]:
            best = (float(power[j]), float(depth[j]), float(error[j]), w, j)
    return best


def box_scans(t: np.ndarray, y: np.ndarray, periods: np.ndarray, noise: float, side: float, widths: list[int]) -> list[np.ndarray]:
    """What scan tells of the boxes at each of many trial periods, as a column each: periods are folded and scanned as rows of one array."""
    n, total, most = len(y), y.sum(), max(widths)
    found = [np.zeros(len(periods), kind) for kind in (float, float, float, np.int64, np.int64)]
    every = np.ceil(periods / side).astype(np.int64)
    step = max(1, CELLS // (max(n, int(every.max())) + most))
    for a in range(0, len(periods), step):
        p, bins = periods[a : a + step, None], every[a : a + step, None]
        rows, wide = np.arange(len(p))[:, None], int(bins.max())
        at = (np.minimum((np.mod(t, p) / side).astype(np.int64), bins - 1) + wide * rows).ravel()
        over, sums = np.arange(min(most - 1, wide)), []
        for x in (np.bincount(at, minlength=wide * len(p)), np.bincount(at, np.broadcast_to(y, (len(p), n)).ravel(), wide * len(p))):
            x = x.reshape(len(p), wide)
            run = np.zeros((len(p), wide + most))  # a row's bins, which run on over the end of the phase, after a 0
            run[:, 1 : wide + 1] = x
            run[rows, 1 + bins + over] = x[:, over]
            sums.append(np.cumsum(run, axis=1))
        ck, cs = sums
        for w in widths:
            inside, within = ck[:, w : w + wide] - ck[:, :wide], cs[:, w : w + wide] - cs[:, :wide]
            with np.errstate(divide="ignore", invalid="ignore"):
                depth = (total - within) / (n - inside) - within / inside
                ok = (np.arange(wide) < bins) & (w <= bins) & (inside > 0) & (inside < n) & (depth >= 0)
                power = np.where(ok, 0.5 * inside * (depth / noise) ** 2, -1.0)
            j = power.argmax(axis=1)
            g = np.flatnonzero(power[rows[:, 0], j] > found[0][a : a + step])
            k = inside[g, j[g]]
            for column, values in zip(found, (power[g, j[g]], depth[g, j[g]], noise * np.sqrt(1 / k + 1 / (n - k)), w, j[g])):
                column[a + g] = values
    return found


POWERS = "grid long, period double, power double, depth double, error double, duration double, epoch double"


def _rows(grid, periods, found: list[np.ndarray], first: float, side: float) -> dict:
    power, depth, error, width, j = found
    return {"grid": grid, "period": periods, "power": power, "depth": depth, "error": error, "duration": width * side, "epoch": first + np.mod((j + width / 2) * side, periods)}


def _nothing(schema: str) -> pd.DataFrame:
    """No rows. Columns are objects: an empty column of numbers cannot be sent as one of names."""
    return pd.DataFrame({c.split()[0]: np.array([], object) for c in schema.split(", ")})


def _shapes(s: Periodic, shape: str) -> dict[int, np.ndarray] | None:
    return {w: profile(w) for w in s.widths} if shape == "transit" else None


def powers(lc: DataFrame, s: Periodic, known: DataFrame | None = None, shape: str = "box", block: int = BLOCK, key: str = "star", most_bins: int = DEALT) -> DataFrame:
    """The strongest dip of each star at each of its trial periods (grid from 0, shortest period first)."""
    known = known if known is not None else facts(lc, s, key)
    kind = lc.schema[key].dataType.simpleString()
    side, widths, shapes, low = s.side, s.widths, _shapes(s, shape), s.low
    points, of = lc.select(F.col(key).alias("star"), "t", "y"), known.withColumnRenamed(key, "star")
    schema, binned = f"star {kind}, {POWERS}", f"star {kind}, grid long, bin long, k double, s double"

    def whole(g: dict[str, np.ndarray]) -> tuple:
        """A star's points come after one row of its facts, with first and level as t and y."""
        if g["part"][0] or len(g["t"]) < 2:
            return ([], *[[]] * 7)
        first, noise = g["t"][0], g["noise"][0]
        t, y = g["t"][1:] - first, g["y"][1:] - g["y"][0]
        periods = trial_periods(low, g["step"][0], int(g["trials"][0]))
        if shapes is None:
            found = box_scans(t, y, periods, noise, side, widths)
        else:
            found = [np.array(x) for x in zip(*(scan(*fold(t, y, p, side), len(y), y.sum(), noise, widths, shapes) for p in periods))]
        rows = _rows(np.arange(len(periods)), periods, found, first, side)
        return (np.zeros(len(periods), np.int64), *rows.values())

    def parts(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _nothing(binned)
        f, out = right.iloc[0], []
        t, y = left["t"].to_numpy() - f["first"], left["y"].to_numpy() - f["level"]
        for g, p in enumerate(trial_periods(low, f["step"], int(f["trials"]))):
            c, x = fold(t, y, p, side)
            at = np.flatnonzero(c)
            out.append(pd.DataFrame({"star": k[0], "grid": g, "bin": at, "k": c[at], "s": x[at]}))
        return pd.concat(out)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                period = 1.0 / (1.0 / low - r.step * r.grid)
                c, x = np.zeros(int(math.ceil(period / side))), np.zeros(int(math.ceil(period / side)))
                for b in r.bins:
                    c[b["bin"]], x[b["bin"]] = b["k"], b["s"]
                found = [np.array([v]) for v in scan(c, x, r.n, x.sum(), r.noise, widths, shapes)]
                yield pd.DataFrame({"star": r.star, **_rows([r.grid], np.array([period]), found, r.first, side)})

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A star's points come in the order of time after a row of its facts, once for each share of its trials."""
        now: dict = {}

        def absorb() -> None:
            if not now["rows"]:
                return
            t, y = (np.concatenate([x[i] for x in now["held"]]) - now[c] for i, c in enumerate(("first", "level")))
            upto = np.concatenate(([0.0], np.cumsum(y)))
            for p, c, x in zip(now["periods"], now["k"], now["s"]):
                for whole_, part in zip((c, x), fold_sorted(t, upto, p, side)):
                    whole_ += part
            now.update(held=[], rows=0)

        def finished() -> pa.RecordBatch:
            absorb()
            found = [np.array(x) for x in zip(*(scan(c, x, now["n"], x.sum(), now["noise"], widths, shapes) for c, x in zip(now["k"], now["s"])))]
            rows = _rows(now["grid"], now["periods"], found, now["first"], side)
            star_ = pa.concat_arrays([now["star"]] * len(now["grid"]))
            return pa.RecordBatch.from_arrays([star_, *(pa.array(v, pa.int64() if c == "grid" else pa.float64()) for c, v in rows.items())], ["star", *rows])

        for b in batches:
            if not b.num_rows:
                continue
            facts_, t, y = b.column("facts"), b.column("t").to_numpy(zero_copy_only=False), b.column("y").to_numpy(zero_copy_only=False)
            starts = sorted({0, *np.flatnonzero(facts_.is_valid().to_numpy(zero_copy_only=False)).tolist()})
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                if facts_[a].is_valid:
                    if now:
                        yield finished()
                    first, level, noise, step, trials, n, shares = facts_[a].as_py()
                    grid = np.arange(b.column("share")[a].as_py(), int(trials), int(shares), dtype=np.int64)
                    periods = 1.0 / (1.0 / low - step * grid)
                    sizes = np.ceil(periods / side).astype(np.int64)
                    k, x = (np.split(np.zeros(sizes.sum()), np.cumsum(sizes)[:-1]) for _ in range(2))
                    now.update(star=b.column("star").slice(a, 1), first=first, level=level, noise=noise, n=int(n), grid=grid, periods=periods, k=k, s=x, held=[], rows=0)
                    a += 1
                if z > a:
                    now["held"].append((t[a:z], y[a:z]))
                    now["rows"] += z - a
                    if now["rows"] >= block:
                        absorb()
        if now:
            yield finished()

    cells = F.log(F.least(F.lit(s.high), F.col("span")) / s.low) / (F.col("step") * side)
    of = of.withColumn("shares", F.greatest(F.lit(1), F.ceil(cells / most_bins)).cast("int"))
    shared, of = of.filter("shares > 1"), of.filter("shares = 1")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    told_once = shared.select("star", every, F.lit(float("-inf")).alias("t"), F.lit(0.0).alias("y"), F.array(*(F.col(c).cast("double") for c in ("first", "level", "noise", "step", "trials", "n", "shares"))).alias("facts"))
    their = points.join(F.broadcast(shared.select("star", "shares")), "star").select("star", every, "t", "y", F.lit(None).cast("array<double>").alias("facts"))
    three = told_once.union(their).repartition(shuffled(lc), "star", "share").sortWithinPartitions("star", "share", "t").mapInArrow(streamed, schema)

    few = of.filter(F.col("n") <= block)
    # series that are searched whole come with a row of facts; of longer ones there are few names
    long_ = F.broadcast(of.filter(F.col("n") > block).select("star").union(shared.select("star")))
    own = points.join(long_, "star", "left_anti").select("star", F.lit(1).alias("part"), "t", "y", *(F.lit(None).cast(kind).alias(c) for c, kind in (("noise", "double"), ("step", "double"), ("trials", "long"))))
    told_ = few.select("star", F.lit(0).alias("part"), F.col("first").alias("t"), F.col("level").alias("y"), "noise", "step", "trials")
    one = mapped(own.union(told_), ["star"], ["part", "t", "y"], ["star"], ["part", "t", "y", "noise", "step", "trials"], whole, POWERS)
    many = of.filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    dealt = points.join(many.select("star", "blocks"), "star").withColumn("block", F.pmod(F.xxhash64("star", "t"), F.col("blocks"))).select("star", "block", "t", "y")
    told = many.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    bins = dealt.groupBy("star", "block").cogroup(told.groupBy("star", "block")).applyInPandas(parts, binned)
    added = bins.groupBy("star", "grid", "bin").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    lists = added.groupBy("star", "grid").agg(F.collect_list(F.struct("bin", "k", "s")).alias("bins"))  # as many as a period has bins
    two = lists.join(many.select("star", "n", "first", "noise", "step"), "star").mapInPandas(joined, schema)
    return one.union(two).union(three).withColumnRenamed("star", key)


def distinct_peaks(found: DataFrame, separation: float = SEARCH.separation, most: int | None = 64, key: str = "star") -> DataFrame:
    """Each star's independent peaks (all, or the strongest of them) with rank (from 1) and share of the best power, strongest first.

    A trial period within `separation` of a stronger one kept belongs to that peak. Powers equal to
    some digits are ties, which go to the earlier trial.
    """
    def one(g: dict[str, np.ndarray]) -> tuple:
        at = np.flatnonzero(np.isfinite(g["power"]))
        at = at[np.lexsort((g["grid"][at], -g["power"][at].round(DIGITS)))]
        period, free, kept = g["period"][at], np.ones(len(at), bool), []
        while (most is None or len(kept) < most) and free.any():
            i = int(free.argmax())
            kept.append(i)
            free &= np.abs(period - period[i]) / np.minimum(period, period[i]) >= separation
        power = g["power"][at[kept]]
        share = power / power[0] if len(power) and power[0] > 0 else np.zeros(len(power))
        return at[kept], np.arange(1, len(kept) + 1), share

    return mapped(found, [key], ["grid"], [key, *(c for c in found.columns if c != key)], ["grid", "period", "power"], one, "rank int, share double")


def consistency(lc: DataFrame, candidates: DataFrame, key: str = "star", floor: float = 1e-12) -> DataFrame:
    """candidates (star, rank, period, epoch, duration) with events seen and how well their depths agree.

    Agreement is the median depth over its standard error; null below two events or where the
    median shows no dip. Depths that are all equal count with the floor as their error.
    """
    name = F.concat_ws("|", F.col(key).cast("string"), F.col("rank").cast("string"))
    c = candidates.withColumn("_id", name)
    points = lc.join(c.select(key, "_id"), key).select("_id", "t", "y")
    depths = event_depths(points, c.select("_id", "period", "epoch", "duration"), key="_id")
    m = mad(depths, ["_id"], "depth")
    error = F.greatest(F.coalesce(F.col("scatter"), F.lit(0.0)) / F.sqrt("n"), F.lit(floor))
    m = m.select("_id", F.col("n").alias("events"), F.when((F.col("n") >= 2) & (F.col("median") > 0), F.col("median") / error).alias("agreement"))
    return c.join(m, "_id", "left").drop("_id").na.fill(0, ["events"])


def chosen(lc: DataFrame, peaks: DataFrame, near: float = SEARCH.near_tie, ties: int = 5, floor: int = SEARCH.min_transits, key: str = "star") -> DataFrame:
    """One fit a star: the strongest peak, unless one as strong agrees better or it is seen too rarely.

    Of peaks within `near` of the best (the first `ties` of them) the one whose events agree best
    on a depth. If fewer than `floor` of its events were observed, the strongest peak that was
    observed so often takes its place; where none was, the fit stays and floor_met is false.
    """
    close = peaks.filter((F.col("rank") <= ties) & ((F.col("rank") == 1) | (F.col("share") >= 1 - near)))
    rated = consistency(lc, close, key)
    every = [c for c in rated.columns if c != key]
    first = F.max_by(F.struct(*every), F.struct(F.coalesce("agreement", F.lit(float("-inf"))), -F.col("rank"))).alias("b")
    now = rated.groupBy(key).agg(first, F.count(F.lit(1)).alias("ties")).select(key, "b.*", "ties")
    poor = now.filter(F.col("events") < floor).select(key, F.col("rank").alias("_r"))
    others = peaks.join(poor, key).filter(F.col("rank") != F.col("_r")).drop("_r")
    seen = consistency(lc, others, key).filter(F.col("events") >= floor)
    swap = seen.groupBy(key).agg(F.min_by(F.struct(*every), "rank").alias("s"))
    both = now.join(swap, key, "left").withColumn("_s", F.col("s").isNotNull())
    take = [F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in every]
    return both.select(key, *take, "ties", F.col("_s").alias("replaced")).withColumn("floor_met", F.col("events") >= floor)


def search_transits(lc: DataFrame, s: Periodic = Periodic(), shape: str = "box", block: int = BLOCK, key: str = "star") -> DataFrame:
    """The whole search of clean series: best fit, its S/N, events, odd and even depths, secondary, ties and floor."""
    from .events import odd_even_sigma, secondary_screen

    # peaks, at most 64 a star, are read three times, and the fit four times
    peaks = keep(distinct_peaks(powers(lc, s, None, shape, block, key), key=key), "peaks")
    fit = keep(chosen(lc, peaks, key=key), "fits")
    discard(peaks)
    eph = fit.select(key, "period", "epoch", "duration")
    parity, second = odd_even_sigma(event_depths(lc, eph, key=key), key), secondary_screen(lc, eph, key)
    out = fit.join(parity, key, "left").join(second, key, "left")
    return out.select(
        key, "period", "epoch", (F.col("duration") * 24).alias("duration_h"), (F.col("depth") * 1e6).alias("depth_ppm"), "power",
        F.when(F.col("error") > 0, F.col("depth") / F.col("error")).alias("snr"), F.sqrt(F.greatest("depth", F.lit(0.0))).alias("radius_ratio"),
        "events", "odd_even_sigma", (F.col("secondary_depth") * 1e6).alias("secondary_ppm"), "secondary_snr", "rank", "ties", "replaced", "floor_met",
    )


def significance(found: DataFrame, known: DataFrame, chi2: DataFrame, key: str = "star") -> DataFrame:
    """Signal detection efficiency of a transit-shape search (Hippke & Heller 2019, without their median filter).

    Residuals chi2 - 2 power of every trial are scaled by the least of them; the efficiency is how
    many deviations the best stands above the mean.
    """
    rest = found.join(chi2, key).withColumn("rest", F.col("chi2") - 2 * F.col("power"))
    ratio = rest.withColumn("sr", F.min("rest").over(Window.partitionBy(key)) / F.col("rest"))  # a join would search twice
    stat = ratio.groupBy(key).agg(F.when(F.stddev_pop("sr") > 0, (1 - F.avg("sr")) / F.stddev_pop("sr")).alias("sde"), F.max_by(F.struct("period", "epoch", "duration", "depth", "error"), F.struct(F.round("power", DIGITS), -F.col("grid"))).alias("b"))
    return stat.join(known.select(key), key).select(key, "sde", "b.*")


def template_decision(lc: DataFrame, box: DataFrame, s: Periodic, least_sde: float, tolerance: float = 0.05, block: int = BLOCK, key: str = "star") -> DataFrame:
    """Second decider: the transit-shape search must be significant and agree with the box period up to an alias."""
    known = facts(lc, s, key)
    chi2 = lc.join(known.select(key, "level", "noise"), key).groupBy(key).agg(F.sum(F.pow((F.col("y") - F.col("level")) / F.col("noise"), F.lit(2.0))).alias("chi2"))
    found = significance(powers(lc, s, known, "transit", block, key), known, chi2, key).join(box.select(key, F.col("period").alias("box_period")), key)
    tries = F.array(*(F.struct((F.abs(F.col("period") - F.col("box_period") * float(r)) / (F.col("box_period") * float(r))).alias("error"), F.lit(float(r)).alias("ratio")) for r in ALIAS_RATIOS))
    found = found.withColumn("_a", F.array_min(tries)).withColumn("agrees", F.col("_a.error") <= tolerance)
    return found.select(
        key, "period", "epoch", (F.col("duration") * 24).alias("duration_h"), "sde", (F.col("sde") >= least_sde).alias("significant"), F.when(F.col("error") > 0, F.col("depth") / F.col("error")).alias("snr"),
        "box_period", F.col("_a.ratio").alias("ratio"), F.col("_a.error").alias("ratio_error"), "agrees", (F.coalesce(F.col("sde") >= least_sde, F.lit(False)) & F.col("agrees")).alias("passes"),
    )


SUB_PHASES = (1 / 3, 1 / 2, 2 / 3, 1 / 4, 3 / 4)


def alias_ladder(lc: DataFrame, eph: DataFrame, noise: DataFrame, ratios: tuple[float, ...] = ALIAS_RATIOS, sigma: float = 3.0, margin: float = SEARCH.alias_margin, key: str = "star") -> DataFrame:
    """Every alias of each star's period that its series can judge, with its score, and which one is chosen.

    An alias needs two durations at least and two cycles within the series. Its score is S/N times
    the share of sampled events with a significant dip, times 1 less the deepest dip (as a share of
    its own) at a phase that a multiple of the true period would step over. A change takes more
    than `margin` times the reported score.
    """
    span = lc.groupBy(key).agg((F.max("t") - F.min("t")).alias("span"), F.min("t").alias("low"), F.max("t").alias("high"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(r)).alias("ratio")) for i, r in enumerate(ratios)))).alias("x")
    tried = eph.select(key, steps, F.col("period").alias("base"), "epoch", "duration").join(span, key)
    tried = tried.select(key, "x.i", "x.ratio", (F.col("base") * F.col("x.ratio")).alias("period"), "epoch", "duration", "span", "low", "high").filter((F.col("period") >= 2 * F.col("duration")) & (F.col("period") <= F.col("span") / 2) & (F.col("period") > 0))
    phases = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("part")) for j, p in enumerate((0.0, *SUB_PHASES))))).alias("q")
    probe = tried.select(key, "i", "ratio", "period", "epoch", "duration", "low", "high", phases).select(F.concat_ws("|", F.col(key).cast("string"), "i", "q.j").alias("_id"), key, "i", "ratio", "period", (F.col("epoch") + F.col("period") * F.col("q.part")).alias("epoch"), "duration", "low", "high", F.col("q.j").alias("j"))
    points = lc.join(probe.select(key, "_id"), key).select("_id", "t", "y")
    level = probe.select("_id", key).join(noise.select(key, "noise"), key).select("_id", "noise")
    got = ephemeris_support(points, probe.select("_id", "period", "epoch", "duration"), level, key="_id").join(probe.select("_id", key, "i", "ratio", "period", "j"), "_id")
    main = got.filter("j = 0 AND sampled").select(key, "i", "ratio", "period", F.col("depth").alias("depth"), "snr")
    side = got.filter("j > 0").select(key, "i", F.when(F.col("sampled"), F.col("depth")).otherwise(0.0).alias("d"))
    worst = side.groupBy(key, "i").agg(F.max("d").alias("deepest"))
    own = probe.filter("j = 0").select("_id", key, "i", "period", "epoch", "duration", "low", "high")
    share = event_share(points.join(own.select("_id"), "_id", "left_semi"), own, sigma).join(own.select("_id", key, "i"), "_id").drop("_id")
    s = main.join(worst, [key, "i"]).join(share, [key, "i"], "left").na.fill(0.0, ["share"])
    skipped = F.when(F.col("depth") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("deepest") / F.col("depth")))).otherwise(1.0)
    s = s.withColumn("skipped", skipped).withColumn("score", F.greatest(F.lit(0.0), F.col("snr")) * F.col("share") * (1 - F.col("skipped")))
    best = s.groupBy(key).agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("best"), F.max("score").alias("top"), F.max(F.when(F.col("ratio") == 1.0, F.col("score"))).alias("own"))
    pick = F.when(F.col("own").isNull() | (F.col("top") > margin * F.col("own")), F.col("best") == F.col("i")).otherwise(F.col("ratio") == 1.0)
    return s.join(best, key).select(key, "ratio", "period", "snr", F.col("share").alias("event_share"), "skipped", "score", pick.alias("chosen"))


def event_share(points: DataFrame, eph: DataFrame, sigma: float) -> DataFrame:
    """(_id, share) of the predicted events within the series, with two points or more, that show a significant dip."""
    from ..functions.ephemeris import cycle, folded_offset

    p = points.join(eph, "_id").withColumn("offset", folded_offset("t", "period", "epoch")).withColumn("cycle", cycle("t", "epoch", "period"))
    base = mad(p.filter(F.col("offset") >= F.col("duration")), ["_id"], "y").filter((F.col("n") >= 20) & (F.col("scatter") > 0)).select("_id", F.col("median").alias("base"), "scatter")
    centre = F.col("epoch") + F.col("cycle") * F.col("period")
    ev = p.filter((F.col("offset") <= F.col("duration") / 2) & centre.between(F.col("low"), F.col("high"))).groupBy("_id", "cycle").agg(F.median("y").alias("level"), F.count(F.lit(1)).alias("k")).filter("k >= 2")
    deep = (F.col("base") - F.col("level")) > sigma * F.col("scatter") / F.sqrt("k")
    return ev.join(base, "_id").groupBy("_id").agg((F.count_if(deep) / F.count(F.lit(1))).alias("share"))
