"""Joins on nearness, as equality joins on buckets with the exact test behind.

Spark has no range join: a plain inequality becomes a nested loop. Each helper gives both sides a
bucket so that rows that can match share one, joins on it, and filters exactly. Skewed buckets
are left to adaptive skew handling, which can split these joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import separation_deg
from ..session import shuffled

CELLS = ("_band", "_cell")


def band_join(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, fraction: float, how: str = "inner") -> DataFrame:
    """Rows with equal `on` and right.b within fraction of left.a, ends included; both positive.

    Buckets are logarithmic and as wide as the band, so a row's matches lie in its own bucket or the next ones.
    """
    width = math.log1p(fraction) - math.log1p(-fraction)
    l = left.withColumn("_bucket", F.explode(F.sequence(F.floor(F.log(F.col(a) * (1 - fraction)) / width) , F.floor(F.log(F.col(a) * (1 + fraction)) / width))))
    r = right.withColumn("_bucket", F.floor(F.log(F.col(b)) / width))
    near = (F.col(b) >= F.col(a) * (1 - fraction)) & (F.col(b) <= F.col(a) * (1 + fraction))
    return l.join(r, [*on, "_bucket"], how).filter(near).drop("_bucket")


def interval_join(points: DataFrame, spans: DataFrame, on: list[str], t: str, start: str, stop: str, width: float) -> DataFrame:
    """Points inside spans, ends included. A span is listed in each bucket of the given width that it touches."""
    p = points.withColumn("_bucket", F.floor(F.col(t) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return p.join(s, [*on, "_bucket"]).filter(F.col(t).between(F.col(start), F.col(stop))).drop("_bucket")


def _sky_cells(band: Column, high: float, radius: float) -> Column:
    """How many cells of right ascension a band of declination has: as wide as two points within the radius can differ there, 1 where fewer than 3 fit."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band * high), F.abs((band + 1) * high)) + radius)
    reach = F.least(F.lit(1.0), math.sin(math.radians(radius) / 2) / F.greatest(F.cos(F.radians(far)), F.lit(1e-12)))
    n = F.floor(2 * math.pi / F.greatest(2 * F.asin(reach), F.lit(1e-9)))
    return F.when(n >= 3, n).otherwise(1)


def sky_join(left: DataFrame, right: DataFrame, radius_deg: float, ra: tuple[str, str], dec: tuple[str, str], cells: bool = False) -> DataFrame:
    """Pairs within radius_deg, with separation_deg.

    Cells are bands of declination as high as the radius, cut in right ascension; the right side is
    listed in the cells around its own, over 0 degrees too, the left side in one. The left side is
    dealt by its cells before it becomes pairs, into as many tasks as a shuffle has: small inputs
    make many pairs. With `cells` the columns of CELLS stay: all pairs of a left row lie in one
    cell, so groupings by these columns and the row's key move nothing.
    """
    slack, dot = math.cos(math.radians(min(radius_deg, 180.0))) - 1e-12, F.col("_x") * F.col("_x2") + F.col("_y") * F.col("_y2") + F.col("_z") * F.col("_z2")

    def placed(df: DataFrame, a: str, d: str, end: str) -> DataFrame:
        a, d = F.radians(a), F.radians(d)
        return df.withColumn(f"_x{end}", F.cos(d) * F.cos(a)).withColumn(f"_y{end}", F.cos(d) * F.sin(a)).withColumn(f"_z{end}", F.sin(d))

    high = max(radius_deg, 1e-6)
    at = lambda a, n: F.least(F.floor(F.pmod(a, F.lit(360.0)) / 360.0 * n), n - 1)
    l = left.withColumn("_band", F.floor(F.col(dec[0]) / high))
    l = l.withColumn("_cell", at(F.col(ra[0]), _sky_cells(F.col("_band"), high, radius_deg)))
    band = F.floor(F.col(dec[1]) / high)
    r = right.withColumn("_band", F.explode(F.array(band - 1, band, band + 1))).withColumn("_n", _sky_cells(F.col("_band"), high, radius_deg))
    own = at(F.col(ra[1]), F.col("_n"))
    r = r.withColumn("_cell", F.explode(F.array_distinct(F.array(*(F.pmod(own + k, F.col("_n")) for k in (-1, 0, 1)))))).drop("_n")
    l = placed(l, ra[0], dec[0], "").repartition(shuffled(left), *CELLS)
    # the product of unit vectors leaves few pairs to the exact test
    near = l.join(placed(r, ra[1], dec[1], "2"), list(CELLS)).filter(dot >= slack).drop("_x", "_y", "_z", "_x2", "_y2", "_z2")
    near = near.withColumn("separation_deg", separation_deg(ra[0], dec[0], ra[1], dec[1])).filter(F.col("separation_deg") <= radius_deg)
    return near if cells else near.drop(*CELLS)


def nearest(left: DataFrame, right: DataFrame, on: list[str], key: str, a: str, b: str, fraction: float, keep: list[str]) -> DataFrame:
    """For each left row (by key) the right row with equal `on` whose b is nearest to a, within fraction of a; both positive."""
    near = band_join(left, right, on, a, b, fraction).withColumn("_d", F.abs(F.col(a) - F.col(b))).filter(F.col("_d") <= fraction * F.col(a))
    best = F.min_by(F.struct(*keep), F.struct("_d", *keep)).alias("_best")
    found = near.groupBy(key).agg(best).select(key, *(F.col("_best")[k].alias(k) for k in keep))
    return left.join(found, key, "left")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that is largest by order, as a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))
