"""Screens of the whole population for what unrelated stars share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import POPULATION, VETOES
from ..functions.ephemeris import folded_offset, transit_times
from ..functions.tails import binomial_upper, poisson_upper
from .islands import integer_runs
from .series import mad
from .sweep import sharers

BIN_DAYS = POPULATION.bin_minutes / 1440.0


def dip_flags(lc: DataFrame, least: int = 10, width: float = BIN_DAYS, key: str = "star", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each star's absolute time bins with two points or more, and whether the star dips there."""
    per = mad(lc, [key], "y").filter((F.col("n") >= least) & (F.col("scatter") > 0))
    bins = lc.withColumn("bin", F.floor(F.col("t") / width)).groupBy(key, *keep, "bin").agg(F.median("y").alias("level"), F.count(F.lit(1)).alias("points")).filter("points >= 2")
    deep = (F.col("median") - F.col("level")) / (VETOES.median_factor * F.col("scatter") / F.sqrt("points"))
    return bins.join(per, key).select(key, *keep, "bin", "points", deep.alias("significance"), (deep > POPULATION.sigma).alias("dipped"))


def bin_counts(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Stars seen and stars dipping in each bin; sums of parts give the whole."""
    return flags.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("observed"), F.count_if("dipped").alias("dips"))


def dip_windows(counts: DataFrame, keys: list[str], stars: int = POPULATION.dip_stars, fraction: float = POPULATION.dip_fraction, width: float = BIN_DAYS) -> DataFrame:
    """Runs of bins in which a large share of enough stars dips."""
    bad = counts.filter((F.col("observed") >= stars) & (F.col("dips") / F.col("observed") >= fraction))
    runs = integer_runs(bad, keys, "bin", F.max(F.col("dips") / F.col("observed")).alias("peak"))
    return runs.select(*keys, (F.col("first") * width).alias("start"), ((F.col("last") + 1) * width).alias("stop"), F.col("length").alias("bins"), "peak")


def artifact_bins(counts: DataFrame, keys: list[str], significance: float, stars: int, top: int) -> DataFrame:
    """Bins with more dips than a cohort's background explains, neighbours merged to their peak, top a cohort."""
    back = counts.groupBy(*keys).agg((F.sum("dips") / F.sum("observed")).alias("background"))
    tested = counts.filter(F.col("observed") >= stars).join(back, keys).withColumn("tail", binomial_upper(F.col("dips"), F.col("observed"), F.col("background")))
    share = F.col("dips") / F.col("observed")
    runs = integer_runs(tested.filter(F.col("tail") <= significance), keys, "bin", F.max_by(F.struct(F.col("bin").alias("bin"), share.alias("share"), F.col("tail").alias("tail")), F.struct(share, -F.col("bin"))).alias("p"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p.share"), "p.bin"))
    return runs.withColumn("rank", rank).filter(F.col("rank") <= top).select(*keys, "rank", "p.bin", "p.share", "p.tail", "first", "last")


def shared_ephemerides(eph: DataFrame, campaign: list[str], key: str = "tic") -> DataFrame:
    """For each fit: fits of other stars with its period (within 2 %) and phase, their detectors and spread, verdict.

    Fits are compared tile by tile, so rows grow with the fits even where one period is everybody's.
    """
    ccd = F.col("ccd") if "ccd" in eph.columns else F.lit(None)
    fits = eph.select(*campaign, key, "period", "epoch", "duration_h", F.col("camera").cast("long").alias("camera"), ccd.cast("long").alias("ccd"), "ra", "dec", F.greatest(F.lit(0.02), F.col("duration_h") / 48.0).alias("tolerance"))
    e = sharers(fits, campaign, 0.02, key=key).join(eph.groupBy(*campaign).agg(F.count(F.lit(1)).alias("size")), campaign)
    e = e.withColumn("expected", F.col("neighbours") * F.least(F.lit(1.0), 2 * F.col("tolerance") / F.col("period")))
    e = e.withColumn("enrichment", F.when(F.col("expected") > 0, F.col("sharers") / F.col("expected")).otherwise(F.col("sharers").cast("double")))
    e = e.withColumn("cameras", F.bit_count("cameras")).withColumn("detectors", F.bit_count("detectors"))
    flagged = (F.col("sharers") >= POPULATION.shared) & (F.col("sharers") / (F.col("size") - 1) >= POPULATION.fraction) & (F.col("enrichment") >= POPULATION.enrichment)
    verdict = F.when(~F.coalesce(flagged, F.lit(False)), "independent_timing").when((F.col("cameras") >= 2) | (F.col("spread") >= POPULATION.spread_deg), "common_mode_systematic").otherwise("localized_coincidence")
    return e.select(*campaign, key, "neighbours", "sharers", "cameras", "detectors", "spread", "expected", "enrichment", verdict.alias("verdict"))


def instant_bins(eph: DataFrame, campaign: list[str], width: float = BIN_DAYS, key: str = "tic") -> tuple[DataFrame, DataFrame]:
    """(stars' events by bin, bins by campaign with stars, expectation and number of bins)."""
    span = eph.groupBy(*campaign).agg(F.min("epoch").alias("low"), F.max("epoch").alias("high"), F.sum(F.least(F.lit(1.0), F.lit(width) / F.col("period"))).alias("expected"))
    ev = eph.join(span, campaign).select(*campaign, key, "low", F.explode(transit_times("epoch", "period", F.col("low"), F.col("high"))).alias("t"))
    ev = ev.select(*campaign, key, F.floor((F.col("t") - F.col("low")) / width).alias("bin"))
    counts = ev.groupBy(*campaign, "bin").agg(F.countDistinct(key).alias("stars"))
    return ev, counts.join(span.withColumn("bins", F.floor((F.col("high") - F.col("low")) / width) + 1), campaign)


def instants(bins: DataFrame, alpha: float = POPULATION.alpha) -> DataFrame:
    """Bins in which more stars have events than chance allows over all bins (Bonferroni)."""
    return bins.withColumn("tail", poisson_upper(F.col("stars").cast("double"), F.col("expected"))).withColumn("flagged", F.col("tail") < F.lit(alpha) / F.col("bins"))


def instant_verdicts(events: DataFrame, flagged: DataFrame, campaign: list[str], key: str = "tic") -> DataFrame:
    """The share of each star's events on flagged bins; half or more is a shared instant."""
    hit = events.join(flagged.select(*campaign, "bin").withColumn("hit", F.lit(1)), [*campaign, "bin"], "left")
    got = hit.groupBy(*campaign, key).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    shared = (F.col("hits") > 0) & (F.col("hits") / F.col("events") >= POPULATION.own_events)
    return got.withColumn("verdict", F.when(shared, "shared_instant").otherwise("independent_instants"))


def alignment(eph: DataFrame, epochs: DataFrame, tolerance: float, key: str = "tic") -> DataFrame:
    """Whether an event of each fit falls within tolerance of any of a few epochs (a short list, by definition)."""
    at = epochs.agg(F.collect_list("t").alias("epochs"))
    return eph.crossJoin(F.broadcast(at)).select(key, F.exists("epochs", lambda x: folded_offset(x, "period", "epoch") <= tolerance).alias("aligned"))
