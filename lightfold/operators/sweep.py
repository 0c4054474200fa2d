"""Comparing each fit with those of nearby period, by ranks and tiles instead of rows of pairs.

Fits get their rank by period (and campaign) from a sort by ranges, and so does each end of their
band. A tile is TILE neighbouring ranks; a tile meets only the tiles that its fits' bands reach,
and numpy compares the two. What leaves a task is a row a fit, never a row a pair, and no task
holds more than WIDE tiles beside its own, however many fits share a period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

TILE = 8192
WIDE = 16  # blocks that a tile meets at once
SUB = 512  # fits whose bands are cut out of a block together
CHUNK = 1 << 18  # pairs compared at a time
BINS = 256


def running_count(rows: DataFrame, order: list[Column], one: str, name: str) -> DataFrame:
    """rows with name: the sum of `one` (0 or 1) over all rows before and at each, in a global order.

    Every task counts one range of the order; the ranges' totals (a row a task) are added up and sent back.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for pdf in batches:
            pdf[name] = seen + pdf[one].cumsum()
            seen = int(pdf[name].iloc[-1]) if len(pdf) else seen
            yield pdf

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_range int", f"{name} long"])
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    held = keep(sorted_.mapInPandas(count, schema), "ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = held.groupBy("_range").agg(F.max(name).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    return held.join(F.broadcast(base), "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")


def banded(fits: DataFrame, campaign: list[str], value: str, fraction: float, key: str) -> DataFrame:
    """fits with rank (from 0, by campaign and value) and the ranks [low, high) of their band, ends included."""
    at = lambda v, kind, one: fits.select(*campaign, key, v.alias("_v"), F.lit(kind).alias("_kind"), F.lit(one).alias("_one"))
    v = F.col(value)
    # of equal values lower ends come before points and upper ends after them
    ends = at(v * (1 - fraction), 0, 0).union(at(v, 1, 1)).union(at(v * (1 + fraction), 2, 0))
    order = [*(F.col(c) for c in campaign), F.col("_v"), F.col("_kind"), F.col(key)]
    counted = running_count(ends, order, "_one", "_c")
    pick = lambda k: F.max(F.when(F.col("_kind") == k, F.col("_c")))
    ranks = counted.groupBy(*campaign, key).agg(pick(0).alias("low"), (pick(1) - 1).alias("rank"), pick(2).alias("high"))
    return fits.join(ranks, [*campaign, key])


def tiled(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, tile: int = TILE, wide: int = WIDE, only: str | None = None) -> DataFrame:
    """work(some fits, fits that their bands may reach) for all tiles that can meet; left is banded, right has rank.

    Both come in order of rank. A tile whose bands reach up to `wide` blocks meets all of them at
    once, so a fit's whole band is there; another meets them one by one. `only`: one of the two kinds.
    """
    own = left.withColumn("_tile", F.floor(F.col("rank") / tile))
    reach = own.groupBy("_tile").agg(F.floor(F.min("low") / tile).alias("_a"), F.floor((F.max("high") - 1) / tile).alias("_b"))
    few = F.col("_b") - F.col("_a") < wide
    reach = reach if only is None else reach.filter(few if only == "near" else ~few)
    meets = reach.select("_tile", F.explode(F.sequence("_a", "_b")).alias("_block"), F.when(few, F.lit(-1)).alias("_once"))
    meets = meets.select("_tile", "_block", F.coalesce(F.col("_once"), F.col("_block")).alias("_group"))
    # both sides come from one table, so they get columns of their own
    a = own.join(meets.select("_tile", "_group").distinct(), "_tile").transform(lambda df: df.toDF(*df.columns))
    b = right.withColumn("_block", F.floor(F.col("rank") / tile)).join(meets, "_block").drop("_block").transform(lambda df: df.toDF(*df.columns))

    def both(_: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return work(x.sort_values("rank", ignore_index=True), y.sort_values("rank", ignore_index=True))

    return a.groupBy("_tile", "_group").cogroup(b.groupBy("_tile", "_group")).applyInPandas(both, schema)


def _sharing(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of the fits of y that lie in the bands of those of x and share their phase, itself left out.

    x and y rise in rank. About CHUNK pairs at a time and all of a fit of x at once; i rises. Fits
    in phase lie around whole periods from a fit's epoch, so they are sought among sorted epochs.
    """
    low, high, rank, period, epoch, tolerance = (x[c].to_numpy() for c in ("low", "high", "rank", "period", "epoch", "tolerance"))
    other, at = y["rank"].to_numpy(), y["epoch"].to_numpy(float)
    for s in range(0, len(x), SUB):
        own = np.arange(s, min(s + SUB, len(x)))
        own = own[(period[own] > 0) & np.isfinite(epoch[own])]
        if not len(own):
            continue
        a, z = np.searchsorted(other, [low[own].min(), high[own].max()])
        near = np.arange(a, z)[np.isfinite(at[a:z])]
        if not len(near):
            continue
        near = near[np.argsort(at[near], kind="stable")]
        t, p, e = at[near], period[own], epoch[own]
        slack = 1e-9 * (1 + max(np.abs(t).max(), np.abs(e).max()))  # the test below decides
        w = tolerance[own] + slack
        first = np.ceil((t[0] - w - e) / p)
        n = np.floor((t[-1] + w - e) / p) - first + 1
        every = (2 * (w + slack) >= p) | (n > len(near))
        n = np.where(every, 1, np.maximum(n, 0)).astype(np.int64)
        who = np.repeat(np.arange(len(own)), n)
        mid = e[who] + (first[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)) * p[who]
        lo = np.where(every[who], 0, np.searchsorted(t, mid - w[who]))
        many = np.where(every[who], len(t), np.searchsorted(t, mid + w[who], side="right")) - lo
        ends, last = np.cumsum(np.bincount(who, weights=many, minlength=len(own)).astype(np.int64)), np.cumsum(n)
        k = 0
        while k < len(own):
            m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right")))
            part = slice(last[k - 1] if k else 0, last[m - 1])
            c = many[part]
            i, j = np.repeat(own[who[part]], c), near[np.repeat(lo[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            band = (other[j] >= low[i]) & (other[j] < high[i]) & (other[j] != rank[i])
            i, j = i[band], j[band]
            q = period[i]
            off = np.mod(at[j] - epoch[i], q)
            ok = np.abs(np.where(off > q / 2, off - q, off)) <= tolerance[i]
            if ok.any():
                yield i[ok], j[ok]
            k = m


def _haversines(x: pd.DataFrame, y: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the haversines between fits i of x and j of y."""
    a, d, b, e = (np.radians(c.to_numpy()) for c in (x["ra"], x["dec"], y["ra"], y["dec"]))
    cd, ce = np.cos(d), np.cos(e)
    return lambda i, j: np.sin((e[j] - d[i]) / 2) ** 2 + cd[i] * ce[j] * np.sin((b[j] - a[i]) / 2) ** 2


def _degrees(h: np.ndarray) -> np.ndarray:
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


def sharers(fits: DataFrame, campaign: list[str], fraction: float, tile: int = TILE, key: str = "tic") -> DataFrame:
    """Of each fit (period, epoch, tolerance, camera, ccd, ra, dec): neighbours in period, sharers of its
    phase, the cameras and detectors these lie on (bit sets), and the largest separation from one of them."""

    def work(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rank, far, out = x["rank"].to_numpy(), _haversines(x, y), []
        bits = [np.where(v.notna(), 1 << v.fillna(0).to_numpy(np.int64), 0) for v in (y["camera"], y["camera"] * 4 + y["ccd"])]
        for i, j in _sharing(x, y):
            who, start, n = np.unique(i, return_index=True, return_counts=True)  # i rises
            cameras, detectors = (np.bitwise_or.reduceat(v[j], start) for v in bits)
            out.append(pd.DataFrame({"rank": rank[who], "n": n, "cameras": cameras, "detectors": detectors, "spread": _degrees(np.maximum.reduceat(far(i, j), start))}))
        return pd.concat(out) if out else pd.DataFrame({"rank": [], "n": [], "cameras": [], "detectors": [], "spread": []})

    b = keep(banded(fits, campaign, "period", fraction, key), "bands")
    right = b.select("rank", "period", "epoch", "camera", "ccd", "ra", "dec")
    left = b.select("rank", "low", "high", "period", "epoch", "tolerance", "ra", "dec")
    told = tiled(left, right, work, "rank long, n long, cameras long, detectors long, spread double", tile)
    got = told.groupBy("rank").agg(F.sum("n").alias("sharers"), F.bit_or("cameras").alias("cameras"), F.bit_or("detectors").alias("detectors"), F.max("spread").alias("spread"))
    out = b.join(got, "rank", "left").na.fill(0, ["sharers", "cameras", "detectors"])
    return out.withColumn("neighbours", F.col("high") - F.col("low") - 1)


def median_separation(shared: DataFrame, tile: int = TILE, rounds: int = 4, wide: int = WIDE) -> DataFrame:
    """(rank, median): the upper median of the separations from a fit's sharers.

    Where a fit's whole band is in one task it is taken there. For crowded periods, to 180 / BINS **
    rounds degrees: each round counts separations in BINS equal bins of the range that holds the
    median and goes on with one of them; what a round adds up is at most BINS counts a fit.
    """
    have = shared.filter("sharers > 0").select("rank", "low", "high", "period", "epoch", "tolerance", "ra", "dec", F.floor(F.col("sharers") / 2).alias("skip"))
    right = shared.select("rank", "period", "epoch", "ra", "dec")

    def whole(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rank, far, out = x["rank"].to_numpy(), _haversines(x, y), []
        for i, j in _sharing(x, y):
            h = far(i, j)
            h = h[np.lexsort((h, i))]
            who, start, n = np.unique(i, return_index=True, return_counts=True)
            out.append(pd.DataFrame({"rank": rank[who], "median": _degrees(h[start + n // 2])}))
        return pd.concat(out) if out else pd.DataFrame({"rank": [], "median": []})

    near = tiled(have.drop("skip"), right, whole, "rank long, median double", tile, wide, "near")
    reach = have.groupBy(F.floor(F.col("rank") / tile).alias("_tile")).agg((F.floor((F.max("high") - 1) / tile) - F.floor(F.min("low") / tile)).alias("_wide"))
    crowded = keep(have.join(reach.filter(F.col("_wide") >= wide), F.floor(F.col("rank") / tile) == F.col("_tile"), "left_semi"), "crowded")
    if crowded.isEmpty():
        return near
    at = crowded.select("rank", F.lit(0.0).alias("a"), F.lit(180.0 * (1 + 1e-12)).alias("z"), "skip")

    def work(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rank, far, low, high, out = x["rank"].to_numpy(), _haversines(x, y), x["a"].to_numpy(), x["z"].to_numpy(), []
        for i, j in _sharing(x, y):
            d, a, z = _degrees(far(i, j)), low[i], high[i]
            here = (d >= a) & (d < z)
            i, bins = i[here], np.minimum(((d - a) / (z - a) * BINS).astype(np.int64), BINS - 1)[here]
            code, n = np.unique(i * BINS + bins, return_counts=True)
            out.append(pd.DataFrame({"rank": rank[code // BINS], "bin": code % BINS, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"rank": [], "bin": [], "n": []})

    for _ in range(rounds):
        left = crowded.drop("skip").join(at.drop("skip"), "rank")
        told = tiled(left, right, work, "rank long, bin long, n long", tile, wide).groupBy("rank", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("rank").orderBy("bin"))
        hit = told.withColumn("upto", upto).join(at, "rank").filter((F.col("upto") > F.col("skip")) & (F.col("upto") - F.col("n") <= F.col("skip")))
        part = (F.col("z") - F.col("a")) / BINS
        at = keep(hit.select("rank", (F.col("a") + F.col("bin") * part).alias("a"), (F.col("a") + (F.col("bin") + 1) * part).alias("z"), (F.col("skip") - F.col("upto") + F.col("n")).alias("skip")), "medians")
    return near.union(at.select("rank", ((F.col("a") + F.col("z")) / 2).alias("median")))
