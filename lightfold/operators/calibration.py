"""Injections, null controls, completeness and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inverted(lc: DataFrame, key: str = "star") -> DataFrame:
    """Every series mirrored about its median: dips become rises."""
    mid = lc.groupBy(key).agg(F.median("y").alias("_m"))
    return lc.join(mid, key).select(key, "t", (2 * F.col("_m") - F.col("y")).alias("y"))


def hash_unit(*parts) -> Column:
    """A number in [0, 1) that the parts fix; SQL engines with SHA-256 agree on it."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def completeness(trials: DataFrame, keys: list[str]) -> DataFrame:
    return trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.count_if("recovered").alias("found"), (F.count_if("recovered") / F.count(F.lit(1))).alias("rate"), F.median("bias").alias("median_bias"))


def bucket(value: str, edges: list[float]) -> Column:
    """Label of the half-open interval that holds the value; beyond the last edge an open one."""
    out = F.when(F.col(value).isNull(), "unknown").when(F.col(value) < edges[0], f"<{edges[0]:g}")
    for a, b in zip(edges, edges[1:]):
        out = out.when(F.col(value) < b, f"{a:g}-{b:g}")
    return out.otherwise(f">={edges[-1]:g}")


def threshold_sweep(events: DataFrame, score: str, star: str, thresholds: list[float]) -> DataFrame:
    """Events and stars at or above each threshold: each event counts for the thresholds below it."""
    at = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: F.col(score) >= x)).alias("threshold")
    return events.select(star, at).groupBy("threshold").agg(F.count(F.lit(1)).alias("events"), F.countDistinct(star).alias("stars"))


def gates(df: DataFrame) -> DataFrame:
    """Release gates over one row of measured rates; what wasn't measured never passes."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    out = df.withColumn("gate_inverted", ok(F.col("inverted_rate") <= 0.001)).withColumn("gate_scrambled", ok(F.col("scrambled_rate") <= 0.001))
    out = out.withColumn("gate_baseline", ok(F.col("baseline_rate").between(0.002, 0.02))).withColumn("gate_bias", ok(F.abs("median_bias") <= 0.05))
    out = out.withColumn("gate_edge", ok(F.abs("edge_gap") <= 0.03)).withColumn("gate_epoch", ok(F.col("epoch_enrichment") < 2.0))
    names = [c for c in out.columns if c.startswith("gate_")]
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    return out.withColumn("released", every)


def empirical_p(observed: Column, null: DataFrame, value: str) -> DataFrame:
    """One-sided p and enrichment of an observed number against drawn ones."""
    return null.agg(((F.count_if(F.col(value) >= observed) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.try_divide(observed, F.avg(value)).alias("enrichment"))
