"""Matching candidates to catalogue rows by period, phase and position, and settling what they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ephemeris import col, period_relation, to_relative_julian

# Object classes by what a match to them means.
PLANETS = ("confirmed_planet", "toi")
BINARIES = ("eclipsing_binary",)
VARIABLES = ("variable_star", "spectroscopic_binary", "astrometric_binary")
RADIUS_ARCSEC = 21.0
MAGNITUDES = 10.0


def epoch_agreement(epoch, duration_h, cat_epoch, cat_period, cat_duration_h, period_error, epoch_error, factor_window: float = 0.5, worst: float = 0.25) -> Column:
    """struct(verdict, offset, tolerance): whether both put transits at one phase of the catalogue's period."""
    ce, p = to_relative_julian(cat_epoch), col(cat_period)
    elapsed = col(epoch) - ce
    offset = F.abs(F.pmod(elapsed + p / 2, p) - p / 2)
    error = F.abs(F.coalesce(col(period_error), p * 0.01) * (elapsed / p)) + F.abs(F.coalesce(col(epoch_error), F.lit(0.0)))
    tolerance = F.greatest(col(duration_h) / 24.0 * factor_window, error, col(cat_duration_h) / 24.0 * factor_window)
    no_c, no_k, wide = col(epoch).isNull(), ce.isNull() | p.isNull() | (p == 0), error > worst * p
    verdict = (
        F.when(no_c, "not_evaluable_no_candidate_epoch").when(no_k, "not_evaluable_no_catalog_epoch")
        .when(wide, "not_evaluable_phase_uncertainty_exceeds_window").when(offset <= tolerance, "agrees").otherwise("disagrees")
    )
    return F.struct(verdict.alias("verdict"), F.when(~(no_c | no_k), offset).alias("offset"), F.when(~(no_c | no_k | wide), tolerance).alias("tolerance"))


def relate(pairs: DataFrame) -> DataFrame:
    """Adds relation, epoch_verdict, match and kills to candidate-row pairs.

    Columns: period, epoch, duration_h; cat_period, cat_epoch, cat_duration_h, cat_period_error,
    cat_epoch_error, host_only.
    """
    # the relation alone: its factor and error would be worked out for each pair too
    r = pairs.withColumn("_r", period_relation("period", "cat_period")["relation"]).withColumn("_e", epoch_agreement("epoch", "duration_h", "cat_epoch", "cat_period", "cat_duration_h", "cat_period_error", "cat_epoch_error"))
    related = F.col("_r") != "none"
    host = F.col("host_only") | ~related | (F.col("_e.verdict") == "disagrees")
    match = F.when(host, "host_match").when(F.col("_e.verdict") == "agrees", "signal_match").otherwise("period_only_match")
    return r.withColumn("relation", F.col("_r")).withColumn("epoch_verdict", F.col("_e.verdict")).withColumn("match", match).withColumn("kills", match == "signal_match").drop("_r", "_e")


def adjudicate(related: DataFrame, key: str = "tic") -> DataFrame:
    """One verdict a star: planet signal, binary signal, binary host, variable, else unresolved; and conflicts."""
    of = lambda kinds: F.col("object_class").isin(*kinds)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    # a hash of the class keeps the aggregate in fixed-width buffers
    matched = F.when(F.col("match") == "signal_match", F.xxhash64("object_class"))
    got = related.groupBy(key).agg(
        any_(F.col("kills") & of(PLANETS)).alias("_planet"),
        any_(F.col("kills") & of(BINARIES)).alias("_eb"),
        any_(of(BINARIES) & F.col("match").isin("host_match", "period_only_match")).alias("_host"),
        any_(of(VARIABLES) & F.col("match").isin("signal_match", "period_only_match")).alias("_var"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.min(matched) != F.max(matched), F.lit(False)).alias("conflict"),
    )
    status = F.when(F.col("_planet"), F.lit(None)).when(F.col("_eb"), "known_eb_rediscovery").when(F.col("_host"), "known_eb_host_residual_review").when(F.col("_var"), "known_variable_star_review").otherwise("unresolved_transit_like_signal")
    return got.select(key, "rows", status.alias("status"), F.col("_planet").alias("blocked"), "conflict")


def rank_counterparts(pairs: DataFrame, key: str = "tic", name: str = "identifier", within: tuple[str, ...] = ()) -> DataFrame:
    """Counterparts by plausible brightness, then separation; ranks from 1. `within`: columns that the key fixes and that pairs are dealt by."""
    plausible = F.coalesce(F.abs(F.col("magnitude") - F.col("target_magnitude")) <= MAGNITUDES, F.lit(True))
    w = Window.partitionBy(*within, key).orderBy(F.col("plausible").desc(), "separation_arcsec", name)
    return pairs.filter(F.col("separation_arcsec") <= RADIUS_ARCSEC).withColumn("plausible", plausible).withColumn("rank", F.row_number().over(w))


def resolve(ranked: DataFrame, targets: DataFrame, key: str = "tic", name: str = "identifier") -> DataFrame:
    """unique, ambiguous or unresolved, with the nearest plausible counterpart as the working one."""
    got = ranked.groupBy(key).agg(F.count_if("plausible").alias("candidates"), F.min_by(F.when(F.col("plausible"), F.col(name)), F.when(F.col("plausible"), F.col("rank"))).alias(name))
    n = F.coalesce(F.col("candidates"), F.lit(0))
    return targets.select(key).join(got, key, "left").select(key, n.alias("candidates"), name, F.when(n == 0, "unresolved").when(n == 1, "unique").otherwise("ambiguous").alias("resolution"))


def context_class() -> Column:
    """First rule that holds, from booleans of a star's context."""
    rules = (("planet_match", "known_planet_rediscovery"), ("eb_match", "known_eb_rediscovery"), ("tce_match", "known_tce_rediscovery"), ("eb_host", "known_eb_host_residual_review"), ("variable_host", "known_variable_star_review"), ("crowded", "crowding_contamination_review"), ("source_error", "context_incomplete"), ("source_missing", "catalog_coverage_gap"))
    out = F.when(F.col(rules[0][0]), rules[0][1])
    for c, name in rules[1:]:
        out = out.when(F.col(c), name)
    return out.otherwise("unresolved_transit_like_signal")


def crowding(neighbours: DataFrame, key: str = "tic") -> DataFrame:
    """Neighbours' light relative to the target's and a risk class."""
    d = F.col("magnitude") - F.col("target_magnitude")
    got = neighbours.groupBy(key).agg(F.count(F.lit(1)).alias("neighbours"), F.sum(F.pow(F.lit(10.0), -0.4 * d)).alias("flux_ratio"), F.count_if(d <= 0).alias("brighter"))
    return got.withColumn("risk", F.when((F.col("brighter") > 0) | (F.col("flux_ratio") >= 0.5), "high").when(F.col("flux_ratio") >= 0.1, "moderate").otherwise("low"))
