"""Rules over one detection: flags, classes, priorities, vetoes, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEARCH, VETOES
from ..functions.ephemeris import col, expected_duration_hours, stellar_density

# The sentences by which rejections are known.
REASONS = (
    ("snr", "white-noise BLS depth S/N is below 7.1"),
    ("events", "fewer than two transit events are represented"),
    ("odd_even", "odd and even transit depths differ by more than 3 sigma"),
    ("secondary", "a secondary eclipse is detected above 3 sigma"),
    ("duty", "the fitted transit duty cycle exceeds 15 percent"),
    ("deep", "the fitted transit depth exceeds 5 percent"),
)


def flags(df: DataFrame) -> DataFrame:
    """Adds flag_* booleans from snr, events, odd_even_sigma, secondary_snr, duration_h, period, depth_ppm."""
    f = {
        "snr": F.col("snr") < SEARCH.snr_min,
        "events": F.col("events") < SEARCH.min_transits,
        "odd_even": F.coalesce(F.col("odd_even_sigma") > SEARCH.sigma_max, F.lit(False)),
        "secondary": F.coalesce(F.col("secondary_snr") > SEARCH.sigma_max, F.lit(False)),
        "duty": F.col("duration_h") / (F.col("period") * 24.0) > SEARCH.duty_max,
        "deep": F.col("depth_ppm") > SEARCH.depth_max_ppm,
    }
    out = df
    for k, c in f.items():
        out = out.withColumn(f"flag_{k}", c)
    return out


def reasons() -> Column:
    """The raised flags' sentences, in their fixed order."""
    return F.array_compact(F.array(*(F.when(F.col(f"flag_{k}"), F.lit(t)) for k, t in REASONS)))


def classify(df: DataFrame) -> DataFrame:
    """Adds class, tier and priority from the flags, snr, review (a further flag) and eb_lane."""
    n = F.size(reasons())
    over = F.greatest(F.lit(0.0), F.col("snr") - SEARCH.snr_min)
    steps = lambda base, top, by: F.least(F.lit(top), base + F.floor(over / by).cast("int"))
    survivor = n == 0
    single = F.col("flag_events") & (F.col("snr") >= SEARCH.snr_min) & ~(F.col("flag_odd_even") | F.col("flag_secondary") | F.col("flag_duty") | F.col("flag_deep"))
    nothing = F.col("flag_snr") & (n == 1)
    review = F.col("review")
    lane = F.coalesce(F.col("eb_lane"), F.lit(False))
    name = F.when(lane, "eclipsing_binary_signal").when(survivor, "automated_survivor").when(single, "single_event_lead").when(nothing, "no_transit_detected").otherwise("screened_rejected")
    tier = (
        F.when(lane, "eb_lane").when(survivor & review, "needs_manual_review").when(survivor, "high_priority_followup")
        .when(single & review, "fragile_single_event").when(single, "supported_single_event").when(nothing, "deprioritized_for_this_window").otherwise("strongest_signal_rejected")
    )
    priority = (
        F.when(lane, 25).when(survivor & review, steps(55, 79, 4.0)).when(survivor, steps(75, 99, 2.0))
        .when(single & review, steps(50, 69, 5.0)).when(single, steps(65, 94, 3.0)).when(nothing, 5).otherwise(15)
    )
    return df.withColumn("class", name).withColumn("tier", tier).withColumn("priority", priority.cast("int"))


def duration_against_density(period, duration_h, radius, mass) -> Column:
    """pass, flag, kill or not_evaluable by the ratio of the fitted to the expected duration."""
    ratio = col(duration_h) / expected_duration_hours(period, stellar_density(radius, mass))
    lo, hi = VETOES.density_kill
    a, b = VETOES.density_flag
    return F.when(ratio.isNull(), "not_evaluable").when((ratio < lo) | (ratio > hi), "kill").when((ratio < a) | (ratio > b), "flag").otherwise("pass")


def companion_radius(depth_ppm, radius) -> Column:
    """struct(rjup, eb_lane): the radius that a depth implies, in Jupiter radii."""
    r = F.sqrt(F.greatest(col(depth_ppm), F.lit(0.0)) / 1e6) * col(radius) * 9.731
    return F.struct(r.alias("rjup"), (r > VETOES.radius_max_rjup).alias("eb_lane"))


def three_valued_gate(value, floor) -> Column:
    v, f = col(value), col(floor)
    return F.when(v.isNull() | f.isNull(), "not_evaluable").when(v >= f, "passes").otherwise("fails")


def science_disposition(on_target, gate) -> Column:
    """Absence of a measurement is neither a pass nor a failure."""
    a, b = col(on_target), col(gate)
    return F.when(a == F.lit(False), "pixel_offset_contamination").when(b == F.lit(False), "single_sector_unconfirmed").when(a & b, "science_vetted_lead")


def depth_tension(measures: DataFrame, key: str = "star") -> DataFrame:
    """Largest pairwise tension, in sigma, of the depths of different products; agree within 3."""
    m = measures.filter((F.col("error") > 0) & (F.abs(F.col("depth") / F.col("error")) >= 3) & F.col("detrended"))
    a = m.select(key, F.col("product").alias("p"), F.col("depth").alias("d"), F.col("error").alias("e"))
    b = m.select(key, F.col("product").alias("q"), F.col("depth").alias("d2"), F.col("error").alias("e2"))
    t = a.join(b, key).filter("p < q").withColumn("tension", F.abs(F.col("d") - F.col("d2")) / F.sqrt(F.col("e") * F.col("e") + F.col("e2") * F.col("e2")))
    return t.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.max("tension").alias("tension")).withColumn("verdict", F.when(F.col("tension") > 3, "disagree").otherwise("agree"))


def sector_support(sectors: DataFrame, key: str = "star") -> DataFrame:
    """Supporting, objecting and abstaining sectors: an undetected one objects if complete enough."""
    objects = ~F.col("detected") & F.coalesce(F.col("completeness") >= 0.5, F.lit(False))
    got = sectors.groupBy(key).agg(F.count_if("detected").alias("supports"), F.count_if(objects).alias("objects"), F.count_if(~F.col("detected") & ~objects).alias("abstains"))
    return got.withColumn("supported", (F.col("supports") > 0) & (F.col("objects") == 0))


def red_noise(blocks: DataFrame, noise: DataFrame, k: str, key: str = "star") -> DataFrame:
    """factor: scatter of block means over what white noise gives, between 1 and 25; needs 4 blocks."""
    from .series import mad

    m = mad(blocks, [key], "mean").filter("n >= 4").select(key, "scatter")
    white = F.col("noise") / F.sqrt(F.col(k))
    return m.join(noise, key).select(key, F.when(white > 0, F.least(F.lit(25.0), F.greatest(F.lit(1.0), F.col("scatter") / white))).alias("factor"))
