"""What a human is asked to look at: follow-up actions, promotion, packets, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ephemeris import col, cycle, folded_offset


def actions(*rules: tuple[Column, int, str]) -> Column:
    """An ordered list of struct(priority, action) for the rules that hold."""
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(t).alias("action"))) for c, p, t in rules)))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that fails a row, or null for a survivor."""
    out = F.when(rules[0][0], rules[0][1])
    for c, t in rules[1:]:
        out = out.when(c, t)
    return out


def undetrended(measures: DataFrame, key: str = "star") -> DataFrame:
    """The most significant measurement of each star that no trend was taken from."""
    m = measures.filter(~F.col("detrended") & (F.col("error") > 0)).withColumn("sigma", F.col("depth") / F.col("error"))
    return m.groupBy(key).agg(F.max("sigma").alias("sigma"), F.max_by("product", "sigma").alias("product")).withColumn("supported", F.col("sigma") >= 3)


def promotion(df: DataFrame) -> DataFrame:
    """Adds blocking and decision; a common-mode verdict comes before all else."""
    block = F.array_compact(F.array(
        F.when(F.col("common_mode"), F.lit("common_mode")), F.when(~F.coalesce("depths_agree", F.lit(False)), F.lit("depths")),
        F.when(~F.coalesce("sectors_support", F.lit(False)), F.lit("sectors")), F.when(F.coalesce(F.col("stacked_sigma") > 3, F.lit(False)), F.lit("stacked_veto")),
    ))
    return df.withColumn("blocking", block).withColumn("decision", F.when(F.col("common_mode"), "common_mode_systematic").when(F.size("blocking") == 0, "promoted").otherwise("held"))


def missing_sections(present: Column, required: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(present, F.array().cast("array<string>")))


def repaired_reasons(reasons: Column, dropped: tuple[str, ...]) -> Column:
    """A ';'-joined list without some of its entries."""
    parts = F.filter(F.transform(F.split(reasons, ";"), F.trim), lambda x: x != "")
    return F.array_join(F.array_except(parts, F.array(*map(F.lit, dropped))), "; ")


def centre_overlap(found: DataFrame, known: DataFrame, key: str = "tic") -> DataFrame:
    """How many of a fit's event centres lie on a known ephemeris' masked windows: all, none or some.

    found: key, centre, duration (days); known: key, entry, period, epoch, half (days).
    """
    hit = folded_offset("centre", "period", "epoch") <= F.col("half") + F.col("duration") / 2
    got = found.join(known, key).groupBy(key, "entry").agg(F.count(F.lit(1)).alias("centres"), F.count_if(hit).alias("hits"), F.count_if(hit & (F.pmod(cycle("centre", "epoch", "period"), F.lit(2)) == 1)).alias("odd_hits"))
    return got.withColumn("relation", F.when(F.col("hits") == F.col("centres"), "same").when(F.col("hits") == 0, "phase_distinct").otherwise("ambiguous"))


def promotable(new: DataFrame, current: DataFrame, key: str = "tic") -> DataFrame:
    """New verdicts with allowed: never one of a lower stage than the current."""
    return new.join(current.select(key, F.col("stage").alias("current_stage")), key, "left").withColumn("allowed", F.coalesce(F.col("stage") >= F.col("current_stage"), F.lit(True)))


def running_attempts(lines: DataFrame, group: str, order: str, command: str, done: str, text: str = "line") -> DataFrame:
    """Log lines of success with the command line that they belong to: the last one before them.

    Ordered within a file (group), so no file waits for another.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract(F.col(text), command, 1)
    at = F.last(F.when(name != "", name), ignorenulls=True).over(w)
    return lines.withColumn("attempt", at).withColumn("ok", F.regexp_extract(F.col(text), done, 1)).filter("ok <> ''").select(group, order, "attempt", "ok")


def stale(state: Column, idle_minutes: Column, limit: float) -> Column:
    """A live state that idled past the limit was interrupted."""
    return F.when(state.isin("running", "searching", "preparing") & (col(idle_minutes) > limit), "interrupted").otherwise(state)
