"""Measurements of a series at a given ephemeris (star, period, epoch, duration in days).

Both sides are joined on star; the ephemeris side holds a few rows a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import VETOES
from ..functions.ephemeris import cycle, folded, folded_offset


def placed(lc: DataFrame, eph: DataFrame, key: str = "star") -> DataFrame:
    """Points with their cycle and absolute offset from the nearest event."""
    return lc.join(eph, key).withColumn("cycle", cycle("t", "epoch", "period")).withColumn("offset", folded_offset("t", "period", "epoch"))


def event_depths(lc: DataFrame, eph: DataFrame, least: int = 2, key: str = "star") -> DataFrame:
    """Depth of each event with enough points: median of all points out of events less the event's median."""
    p = placed(lc, eph, key).withColumn("inside", F.col("offset") <= F.col("duration") / 2)
    base = p.filter("not inside").groupBy(key).agg(F.median("y").alias("baseline"))
    ev = p.filter("inside").groupBy(key, "cycle").agg(F.median("y").alias("level"), F.count(F.lit(1)).alias("points")).filter(F.col("points") >= least)
    return ev.join(base, key).select(key, "cycle", "points", (F.col("baseline") - F.col("level")).alias("depth"))


def ephemeris_support(lc: DataFrame, eph: DataFrame, noise: DataFrame, key: str = "star") -> DataFrame:
    """sampled, depth, S/N, events: points within half a duration against points beyond a whole one."""
    p = placed(lc, eph, key)
    inside, outside = F.col("offset") <= F.col("duration") / 2, F.col("offset") >= F.col("duration")
    got = p.groupBy(key).agg(
        F.count_if(inside).alias("n_in"),
        F.count_if(outside).alias("n_out"),
        F.median(F.when(inside, F.col("y"))).alias("_in"),
        F.median(F.when(outside, F.col("y"))).alias("_out"),
        F.countDistinct(F.when(inside, F.col("cycle"))).alias("_events"),
    )
    ok = (F.col("n_in") >= 3) & (F.col("n_out") >= 20)
    depth = F.col("_out") - F.col("_in")
    return got.join(noise.select(key, "noise"), key).select(
        key, "n_in", "n_out", ok.alias("sampled"),
        F.when(ok, depth).otherwise(0.0).alias("depth"),
        F.when(ok & (F.col("noise") > 0), depth / (F.col("noise") / F.sqrt("n_in"))).otherwise(0.0).alias("snr"),
        F.when(ok, F.col("_events")).otherwise(0).alias("events"),
    )


def odd_even(depths: DataFrame, key: str = "star") -> DataFrame:
    """Median depth of odd and of even events and their counts."""
    odd = F.pmod(F.col("cycle"), F.lit(2)) == 1
    return depths.groupBy(key).agg(F.median(F.when(odd, F.col("depth"))).alias("odd_depth"), F.median(F.when(~odd, F.col("depth"))).alias("even_depth"), F.count_if(odd).alias("n_odd"), F.count_if(~odd).alias("n_even"))


def depth_consistency(depths: DataFrame, key: str = "star") -> DataFrame:
    """median / (scatter / sqrt n) of the events' depths; null below two events or without scatter."""
    from .series import mad

    m = mad(depths, [key], "depth")
    return m.select(key, F.col("n").alias("events"), F.col("median").alias("depth"), F.when(F.col("scatter") > 0, F.col("median") / (F.col("scatter") / F.sqrt("n"))).alias("consistency"))


def secondary(lc: DataFrame, eph: DataFrame, key: str = "star") -> DataFrame:
    """Depth half a period away from the events, against points away from both."""
    half = eph.withColumn("epoch2", F.col("epoch") + F.col("period") / 2)
    p = placed(lc, half, key).withColumn("offset2", folded_offset("t", "period", "epoch2"))
    at, away = F.col("offset2") <= F.col("duration") / 2, (F.col("offset2") >= F.col("duration")) & (F.col("offset") >= F.col("duration"))
    return p.groupBy(key).agg(F.count_if(at).alias("n_secondary"), (F.median(F.when(away, F.col("y"))) - F.median(F.when(at, F.col("y")))).alias("secondary_depth"))


def secondary_scan(lc: DataFrame, eph: DataFrame, scatter: DataFrame, windows: int = 64, key: str = "star") -> DataFrame:
    """The most significant dip away from the events, over windows of one duration half a duration apart.

    Each point joins the windows that hold it by their number, so the work grows with the points.
    """
    p = lc.join(eph, key).withColumn("x", folded("t", "period", "epoch")).filter(F.abs("x") >= VETOES.exclusion * F.col("duration"))
    at = F.floor((F.col("x") + F.col("period") / 2) / (F.col("duration") / 2))
    base = p.groupBy(key).agg(F.median("y").alias("base"))
    w = p.withColumn("slot", F.explode(F.array(at - 1, at))).groupBy(key, "slot").agg(F.median("y").alias("level"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 3)
    snr = (F.col("base") - F.col("level")) / (VETOES.median_factor * F.col("scatter") / F.sqrt("n"))
    s = w.join(base, key).join(scatter.select(key, "scatter"), key).filter("scatter > 0").withColumn("snr", snr)
    best = F.max(F.struct("snr", (-F.col("slot")).alias("w"))).alias("best")
    return s.groupBy(key).agg(best, F.count(F.lit(1)).alias("windows")).select(key, "windows", F.col("best.snr").alias("snr"), (-F.col("best.w")).alias("slot"))


def event_support(lc: DataFrame, eph: DataFrame, key: str = "star") -> DataFrame:
    """Events with points inside and on both sides, and all events with a point near them."""
    p = placed(lc, eph, key).withColumn("x", folded("t", "period", "epoch")).filter(F.abs("x") <= 3 * F.col("duration"))
    d = F.col("duration")
    per = p.groupBy(key, "cycle").agg(F.count_if(F.abs("x") <= d / 2).alias("inside"), F.count_if(F.col("x") <= -d).alias("before"), F.count_if(F.col("x") >= d).alias("after"))
    n = VETOES.per_event
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.count_if((F.col("inside") >= n) & (F.col("before") >= n) & (F.col("after") >= n)).alias("supported"))


def phase_curve(lc: DataFrame, eph: DataFrame, bins: int, key: str = "star") -> DataFrame:
    """Median and count of each phase bin."""
    x = F.pmod(F.col("t") - F.col("epoch") + F.col("period") / 2, F.col("period")) / F.col("period")
    return lc.join(eph, key).withColumn("bin", F.least(F.floor(x * bins), F.lit(bins - 1))).groupBy(key, "bin").agg(F.median("y").alias("level"), F.count(F.lit(1)).alias("points"))


def masked(lc: DataFrame, eph: DataFrame, width: float = 1.0, key: str = "star") -> DataFrame:
    """lc with hit: whether any of the star's ephemerides covers the point, and the first that does."""
    p = lc.join(eph, key, "left").withColumn("_in", folded_offset("t", "period", "epoch") <= F.col("duration") * width / 2)
    return p.groupBy(key, "t").agg(F.first("y").alias("y"), F.coalesce(F.bool_or("_in"), F.lit(False)).alias("hit"), F.min(F.when(F.col("_in"), F.col("seq"))).alias("first"))


def injected(lc: DataFrame, eph: DataFrame, key: str = "star") -> DataFrame:
    """lc with a box dip of the ephemeris' depth."""
    hit = folded_offset("t", "period", "epoch") <= F.col("duration") / 2
    return lc.join(eph, key).select(key, "t", (F.col("y") - F.when(hit, F.col("depth")).otherwise(0.0)).alias("y"))


def odd_even_sigma(depths: DataFrame, key: str = "star") -> DataFrame:
    """odd_even_sigma: difference of the median depths of odd and even events over its robust error.

    Null where one of them has fewer than two events, or where there is no scatter.
    """
    from .series import mad

    m = mad(depths.withColumn("_odd", F.pmod(F.col("cycle"), F.lit(2)) == 1), [key, "_odd"], "depth").filter("n >= 2")
    m = m.select(key, "_odd", "median", (F.col("scatter") / F.sqrt("n")).alias("e"))
    both = m.filter("_odd").select(key, F.col("median").alias("_mo"), F.col("e").alias("_eo")).join(m.filter("NOT _odd").select(key, F.col("median").alias("_me"), F.col("e").alias("_ee")), key)
    error = F.sqrt(F.col("_eo") * F.col("_eo") + F.col("_ee") * F.col("_ee"))
    return both.select(key, F.when(error > 0, F.abs(F.col("_mo") - F.col("_me")) / error).alias("odd_even_sigma"))


def secondary_screen(lc: DataFrame, eph: DataFrame, key: str = "star") -> DataFrame:
    """secondary_depth and secondary_snr half a period from the events, against all points within neither.

    Needs three points there and twenty elsewhere; no S/N without scatter.
    """
    from .series import mad

    p = placed(lc, eph, key).withColumn("_away", F.abs(F.col("offset") - F.col("period") / 2))
    half = F.col("duration") / 2
    at = p.filter(F.col("_away") <= half).groupBy(key).agg(F.median("y").alias("_level"), F.count(F.lit(1)).alias("_k")).filter("_k >= 3")
    base = mad(p.filter((F.col("_away") > half) & (F.col("offset") > half)), [key], "y").filter("n >= 20")
    depth = F.col("median") - F.col("_level")
    return at.join(base, key).select(key, depth.alias("secondary_depth"), F.when(F.col("scatter") > 0, depth / (F.col("scatter") / F.sqrt("_k"))).alias("secondary_snr"))
