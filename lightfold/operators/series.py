"""Brightness series in long form: one row a point (star, t, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(lc: DataFrame, key: str = "star", least: int = 100) -> DataFrame:
    """Finite points, equal times averaged, y divided by the star's median; short series are left out."""
    ok = F.col("t").isNotNull() & F.col("y").isNotNull() & ~F.isnan("t") & ~F.isnan("y") & (F.abs("t") != float("inf")) & (F.abs("y") != float("inf"))
    points = lc.filter(ok).groupBy(key, "t").agg(F.avg("y").alias("y"))
    per = points.groupBy(key).agg(F.median("y").alias("_m"), F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= least) & (F.col("_m") != 0))
    return points.join(per, key).select(key, "t", (F.col("y") / F.col("_m")).alias("y"))


def mad(df: DataFrame, keys: list[str], value: str, name: str = "scatter") -> DataFrame:
    """Robust scatter 1.4826 median|x - median| of each key; null below two values."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("_mid"))
    off = df.join(mid, keys).select(*keys, F.abs(F.col(value) - F.col("_mid")).alias("_off"), "_mid")
    out = off.groupBy(*keys).agg(F.median("_off").alias("_mad"), F.count("_off").alias("n"), F.first("_mid").alias("median"))
    return out.select(*keys, "n", "median", F.when(F.col("n") >= 2, 1.4826 * F.col("_mad")).alias(name))


def differences(lc: DataFrame, key: str = "star") -> DataFrame:
    w = Window.partitionBy(key).orderBy("t")
    return lc.withColumn("dy", F.col("y") - F.lag("y").over(w)).withColumn("dt", F.col("t") - F.lag("t").over(w)).filter("dy is not null")


def point_noise(lc: DataFrame, key: str = "star") -> DataFrame:
    """Noise of a point: scatter of successive differences over sqrt 2, else the scatter of y."""
    d = mad(differences(lc, key), [key], "dy").select(key, (F.col("scatter") / F.sqrt(F.lit(2.0))).alias("_d"))
    s = mad(lc, [key], "y").select(key, "scatter", "n")
    return s.join(d, key, "left").select(key, "n", F.coalesce(F.when(F.col("_d") > 0, F.col("_d")), F.col("scatter")).alias("noise"))


def noise_over_hours(lc: DataFrame, hours: float = 3.0, key: str = "star") -> DataFrame:
    """Noise of a mean over some hours, in millionths: scatter of differences / sqrt 2 / sqrt points."""
    d = differences(lc, key)
    noise = mad(d, [key], "dy").select(key, (F.col("scatter") / F.sqrt(F.lit(2.0))).alias("noise"))
    step = d.groupBy(key).agg(F.median("dt").alias("cadence"))
    points = F.greatest(F.lit(1.0), F.lit(hours / 24.0) / F.col("cadence"))
    return noise.join(step, key).select(key, "cadence", (F.col("noise") / F.sqrt(points) * 1e6).alias("noise_ppm"))


def edge_safe(segmented: DataFrame, guard: float, key: str = "star") -> DataFrame:
    """Adds keep: whether a point lies at least guard inside both ends of its segment."""
    w = Window.partitionBy(key, "segment")
    return segmented.withColumn("keep", (F.col("t") - F.min("t").over(w) >= guard) & (F.max("t").over(w) - F.col("t") >= guard))


def support(segmented: DataFrame, half: float, key: str = "star") -> DataFrame:
    """Adds around: the points of the segment within half on either side, the point itself included."""
    count = F.expr(f"count(*) over (partition by {key}, segment order by t range between {half!r}d preceding and {half!r}d following)")
    return segmented.withColumn("around", count)


def block_means(df: DataFrame, keys: list[str], order: str, value: str, size: int) -> DataFrame:
    """Means of consecutive blocks of size rows; an incomplete last block is left out."""
    block = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size)
    return df.withColumn("block", block).groupBy(*keys, "block").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).drop("_n")


def step_detrend(lc: DataFrame, width: float, key: str = "star") -> DataFrame:
    """y over the median of its absolute-anchored bin of the given width."""
    b = lc.withColumn("bin", F.floor(F.col("t") / width))
    mid = b.groupBy(key, "bin").agg(F.median("y").alias("_m"))
    return b.join(mid, [key, "bin"]).select(key, "t", F.when(F.col("_m") != 0, F.col("y") / F.col("_m")).alias("y"))
