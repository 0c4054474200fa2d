"""Box powers over one small grid of periods as a relation, and what is derived from powers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_table(spark, low: float, high: float, count: int) -> DataFrame:
    """A grid of periods even in frequency."""
    step = (1 / low - 1 / high) / (count - 1)
    return spark.range(count).select(F.col("id").alias("grid"), (1.0 / (F.lit(1 / low) - F.col("id") * step)).alias("trial"))


def box_powers(lc: DataFrame, grid: DataFrame, bins: int, key: str = "star") -> DataFrame:
    """Power and depth of a one-bin box at each (star, period, phase bin), Kovacs, Zucker & Mazeh (2002).

    The grid is a table of bounded size (its caller fixes the count), so it is sent to every task;
    each task sums its own points by bin before anything is shuffled.
    """
    total = lc.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    at = F.least(F.floor(F.pmod(F.col("t"), F.col("trial")) / F.col("trial") * bins), F.lit(bins - 1))
    box = lc.crossJoin(F.broadcast(grid)).groupBy(key, "grid", "trial", at.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("b"))
    p = box.join(total, key).filter("n > k")
    depth = (F.col("s") - F.col("b")) / (F.col("n") - F.col("k")) - F.col("b") / F.col("k")
    power = 0.5 * depth * depth / (1.0 / F.col("k") + 1.0 / (F.col("n") - F.col("k")))
    return p.select(key, "grid", "trial", "bin", "k", depth.alias("depth"), power.alias("power")).filter("depth > 0")


def best_box(powers: DataFrame, key: str = "star", digits: int = 9) -> DataFrame:
    """The strongest box of each star; of equal powers (to some digits) the first on the grid."""
    rank = F.struct(F.round("power", digits), -F.col("grid"), -F.col("bin"))
    row = F.max_by(F.struct("grid", "trial", "bin", "k", "depth", "power"), rank).alias("_b")
    return powers.groupBy(key).agg(row).select(key, "_b.*")


def detection_efficiency(powers: DataFrame, key: str = "star") -> DataFrame:
    """(max - mean) / population deviation of each star's powers."""
    p = powers.filter(~F.isnan("power"))
    return p.groupBy(key).agg(F.when(F.stddev_pop("power") > 0, (F.max("power") - F.avg("power")) / F.stddev_pop("power")).alias("sde"))


def without_overlap(events: DataFrame, start: str, stop: str, score: str, most: int, key: str = "star") -> DataFrame:
    """Events kept by falling score when they overlap none kept before, `most` a star."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, start], ascending=[False, True])
        kept: list[tuple[float, float, float]] = []
        for a, b, s in zip(pdf[start], pdf[stop], pdf[score]):
            if all(b < x or y < a for x, y, _ in kept):
                kept.append((a, b, s))
                if len(kept) == most:
                    break
        return pd.DataFrame([(k[0], i + 1, *e) for i, e in enumerate(kept)], columns=[key, "rank", start, stop, score])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, start, stop, score).groupBy(key).applyInPandas(one, f"{key} {kind}, rank long, {start} double, {stop} double, {score} double")


def unique_periods(column, tolerance: float = 0.01):
    """Sorted periods less those within tolerance of the last one kept, as an array expression."""
    empty = F.array().cast("array<double>")
    step = lambda kept, p: F.when((F.size(kept) == 0) | (p > F.element_at(kept, F.lit(-1)) * (1 + tolerance)), F.concat(kept, F.array(p))).otherwise(kept)
    return F.aggregate(F.array_sort(F.filter(column, lambda p: p > 0)), empty, step)


def harmonic_powers(powers: DataFrame, best: DataFrame, window: float = 0.005, key: str = "star", period: str = "period") -> DataFrame:
    """The strongest power near 1/3, 1/2, 2 and 3 times each star's best period, as a share of the best."""
    marks = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).alias("factor")) for n, f in (("third", 1 / 3), ("half", 0.5), ("double", 2.0), ("triple", 3.0))))).alias("m")
    at = best.select(key, F.col(period).alias("_p"), F.col("power").alias("_w"), marks)
    near = powers.join(at, key).filter(F.abs(F.col(period) - F.col("_p") * F.col("m.factor")) <= window * F.col("_p") * F.col("m.factor"))
    return near.groupBy(key, F.col("m.name").alias("harmonic")).agg((F.max("power") / F.first("_w")).alias("share"))


def sensitivity(lc: DataFrame, noise: DataFrame, periods: list[float], depths: list[float], duration: float, least_snr: float, key: str = "star") -> DataFrame:
    """The smallest depth that would be seen at each period: in-event points and noise fix the S/N of a box."""
    p = F.explode(F.array(*map(F.lit, periods))).alias("period")
    pts = lc.select(key, "t", p).groupBy(key, "period").agg(F.count_if(F.abs(F.pmod(F.col("t") + F.col("period") / 2, F.col("period")) - F.col("period") / 2) <= duration / 2).alias("n_in"))
    d = pts.join(noise.select(key, "noise"), key).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    ok = (F.col("n_in") >= 3) & (F.col("noise") > 0) & (F.col("depth") / F.nullif(F.col("noise"), F.lit(0.0)) * F.sqrt("n_in") >= least_snr)
    return d.groupBy(key, "period").agg(F.min(F.when(ok, F.col("depth"))).alias("depth"))
