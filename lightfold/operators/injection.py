"""Planted transits of a wanted depth, what preparation leaves of them, and variants of a series through one search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ephemeris import limb_darkening, mass_for_injection
from .boxsearch import DIGITS, Periodic, facts, powers
from .events import ephemeris_support, injected

_X, _W = np.polynomial.legendre.leggauss(40)
WIDEST = 0.9  # largest radius ratio tried
#: Gravitational constant, solar mass and radius, seconds of a day.
G, SOLAR_MASS, SOLAR_RADIUS, DAY = 6.67430e-11, 1.98847e30, 6.957e8, 86400.0


def lost_light(z: np.ndarray, k: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Share of a quadratically limb-darkened star's light behind a dark disc of radius k at distance z.

    The star is summed in rings: a ring of radius r is covered over the angle that the disc spans
    there. Nodes crowd towards the ends of the covered radii, where that angle grows as a root.
    """
    z, k, u1, u2 = (np.asarray(v, float)[..., None] for v in np.broadcast_arrays(z, k, u1, u2))
    lo, hi = np.clip(np.abs(z - k), 0, 1), np.clip(z + k, 0, 1)
    light = lambda r: 1 - u1 * (1 - np.sqrt(np.maximum(0, 1 - r * r))) - u2 * (1 - np.sqrt(np.maximum(0, 1 - r * r))) ** 2
    phi = (_X + 1) * math.pi / 2
    r = (lo + hi) / 2 - (hi - lo) / 2 * np.cos(phi)
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.arccos(np.clip(np.where(r * z > 0, (r * r + z * z - k * k) / (2 * r * z), -1.0), -1, 1))
    part = (light(r) * 2 * r * half * (hi - lo) / 2 * np.sin(phi) * _W * math.pi / 2).sum(-1)
    # rings that lie behind the disc as a whole
    full = np.where(k > z, np.clip(k - z, 0, 1), 0.0)[..., 0]
    s = (_X + 1) / 2
    whole = (light(full[..., None] * s) * 2 * math.pi * full[..., None] * s * full[..., None] / 2 * _W).sum(-1)
    return (part + whole) / (math.pi * (1 - u1[..., 0] / 3 - u2[..., 0] / 6))


def ratio_of_depth(depth: np.ndarray, impact: np.ndarray, u1: np.ndarray, u2: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Radius ratios whose transits are as deep as wanted, and whether there is one up to WIDEST; all rows at once."""
    low, high = np.full(len(depth), 1e-6), np.full(len(depth), WIDEST)
    found = lost_light(impact, high, u1, u2) >= depth
    for _ in range(rounds):
        mid = (low + high) / 2
        deep = lost_light(impact, mid, u1, u2) >= depth
        low, high = np.where(deep, low, mid), np.where(deep, mid, high)
    return np.where(found, (low + high) / 2, np.nan), found


def planned(plan: DataFrame) -> DataFrame:
    """plan (star, period, epoch, depth, impact, radius, mass, teff) with the orbit, the ratio and the state of each planting.

    Radius and mass are solar; a missing mass follows from the radius. Not plantable are depths
    that no disc reaches, orbits within the star and values out of range.
    """
    m, dark = mass_for_injection("radius", "mass"), limb_darkening("teff")
    wide = F.pow(F.lit(G * SOLAR_MASS) * m["mass"] * F.pow(F.col("period") * DAY, F.lit(2.0)) / (4 * math.pi**2), F.lit(1 / 3))
    p = plan.withColumn("a_over_r", wide / (F.col("radius") * SOLAR_RADIUS)).withColumn("u1", dark["u1"]).withColumn("u2", dark["u2"]).withColumn("mass_basis", m["basis"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = {c: pdf[c].to_numpy(float) for c in ("period", "depth", "impact", "radius", "a_over_r", "u1", "u2")}
            ok = (v["period"] > 0) & (v["depth"] > 0) & (v["radius"] > 0) & (v["impact"] >= 0) & (v["impact"] < 1)
            orbit = ok & (v["a_over_r"] > 1)
            ratio, found = ratio_of_depth(np.where(orbit, v["depth"], 0.1), np.where(orbit, v["impact"], 0.0), v["u1"], v["u2"])
            pdf["ratio"] = np.where(orbit & found, ratio, np.nan)
            pdf["state"] = np.select([~ok, ~orbit, ~found], ["value_out_of_range", "orbit_within_star", "depth_unreachable"], "planted")
            reach = np.sqrt(np.maximum(0, (1 + np.nan_to_num(pdf["ratio"].to_numpy())) ** 2 - v["impact"] ** 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                tilt = np.sqrt(1 - np.minimum(1, v["impact"] / v["a_over_r"]) ** 2)
                pdf["duration"] = np.where(orbit & found, v["period"] / math.pi * np.arcsin(np.minimum(1, reach / v["a_over_r"] / tilt)), np.nan)
            yield pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema)
    return p.mapInPandas(solve, f"{fields}, ratio double, state string, duration double")


def plant(lc: DataFrame, plan: DataFrame, key: str = "star") -> DataFrame:
    """(star, t, y, loss): series with their planned transits multiplied in; plan comes from planned() with one row a star."""
    p = plan.filter("state = 'planted'").select(key, "period", "epoch", "impact", "a_over_r", "ratio", "u1", "u2", "duration")
    near = F.abs(F.pmod(F.col("t") - F.col("epoch") + F.col("period") / 2, F.col("period")) - F.col("period") / 2) <= F.col("duration") / 2 * 1.01
    rows = lc.select(key, "t", "y").join(p, key).withColumn("_near", near)
    kind = lc.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            loss = np.zeros(len(pdf))
            at = np.flatnonzero(pdf["_near"])
            if len(at):
                v = {c: pdf[c].to_numpy(float)[at] for c in ("t", "period", "epoch", "impact", "a_over_r", "ratio", "u1", "u2")}
                x = 2 * math.pi * (v["t"] - v["epoch"]) / v["period"]
                z = np.sqrt((v["a_over_r"] * np.sin(x)) ** 2 + (v["impact"] * np.cos(x)) ** 2)
                loss[at] = lost_light(z, v["ratio"], v["u1"], v["u2"])
            yield pd.DataFrame({key: pdf[key], "t": pdf["t"], "y": pdf["y"] * (1 - loss), "loss": loss})

    return rows.mapInPandas(work, f"{key} {kind}, t double, y double, loss double")


def tagged(series: dict[str, DataFrame], key: str = "star") -> DataFrame:
    """Several series of each star in one, told apart by their tag: (_id, star, tag, t, y)."""
    out = None
    for tag, lc in series.items():
        one = lc.select(F.concat_ws("|", F.col(key).cast("string"), F.lit(tag)).alias("_id"), key, F.lit(tag).alias("tag"), "t", "y")
        out = one if out is None else out.union(one)
    return out


def depth_transfer(lc: DataFrame, planted: DataFrame, prepare: Callable[[DataFrame], DataFrame], eph: DataFrame, key: str = "star") -> DataFrame:
    """How deep a planted transit is before and after preparation, with what the star shows without it taken off.

    The four series go through one measurement at the planted ephemeris. bias is the share of the
    input depth that preparation changes.
    """
    four = tagged({"raw": lc, "raw_planted": planted, "prepared": prepare(lc), "prepared_planted": prepare(planted)}, key)
    ids = four.select("_id", key, "tag").distinct()
    e = ids.join(eph.select(key, "period", "epoch", "duration"), key).select("_id", "period", "epoch", "duration")
    got = ephemeris_support(four.select("_id", "t", "y"), e, ids.select("_id", F.lit(1.0).alias("noise")), key="_id").join(ids, "_id")
    pick = lambda tag: F.max(F.when((F.col("tag") == tag) & F.col("sampled"), F.col("depth"))).alias(tag)
    p = got.groupBy(key).agg(*(pick(t) for t in ("raw", "raw_planted", "prepared", "prepared_planted")))
    p = p.withColumn("input_depth", F.col("raw_planted") - F.col("raw")).withColumn("prepared_depth", F.col("prepared_planted") - F.col("prepared"))
    whole = F.col("input_depth").isNotNull() & F.col("prepared_depth").isNotNull()
    said = F.when(~whole, "insufficient_fixed_ephemeris_samples").when(F.col("input_depth") <= 0, "nonpositive_input_depth").otherwise("measured")
    return p.select(key, F.when(whole, F.col("input_depth")).alias("input_depth"), F.when(whole, F.col("prepared_depth")).alias("prepared_depth"), F.when(said == "measured", F.abs(F.col("prepared_depth") - F.col("input_depth")) / F.col("input_depth")).alias("bias"), said.alias("status"))


def variant_search(series: dict[str, DataFrame], s: Periodic, key: str = "star", fallback: bool = True) -> DataFrame:
    """The strongest period of every variant of every star, all through one search: (star, tag, grid, period, power, depth)."""
    v = tagged(series, key)
    x = v.select("_id", "t", "y")
    found = powers(x, s, facts(x, s, "_id", fallback), key="_id")
    best = found.groupBy("_id").agg(F.max_by(F.struct("grid", "period", "power", "depth"), F.struct(F.round("power", DIGITS), -F.col("grid"))).alias("b"))
    return best.join(v.select("_id", key, "tag").distinct(), "_id").select(key, "tag", "b.*")


def recovery_grid(lc: DataFrame, periods: list[float], depths: list[float], epoch: float, duration: float, s: Periodic, tolerance: float = 0.01, key: str = "star") -> DataFrame:
    """Each box of a grid planted in each star and searched for: (star, period, depth, found, status).

    status is exact within the tolerance of the period, harmonic_alias within that of a half, a
    third, two or three times it, else miss. All plantings are variants of one search.
    """
    cases = [(i, j, p, d) for i, p in enumerate(periods) for j, d in enumerate(depths)]
    stars = lc.select(key).distinct()
    series = {}
    for i, j, p, d in cases:
        eph = stars.select(key, F.lit(p).alias("period"), F.lit(epoch).alias("epoch"), F.lit(duration).alias("duration"), F.lit(d).alias("depth"))
        series[f"{i},{j}"] = injected(lc, eph, key)
    got = variant_search(series, s, key).withColumn("case", F.split("tag", ","))
    plan = F.array(*(F.lit(float(p)) for p in periods))[F.col("case")[0].cast("int")], F.array(*(F.lit(float(d)) for d in depths))[F.col("case")[1].cast("int")]
    got = got.select(key, plan[0].alias("planted_period"), plan[1].alias("planted_depth"), F.col("period").alias("found"))
    close = lambda f: F.abs(F.col("found") - F.col("planted_period") * f) <= tolerance * F.col("planted_period") * f
    alias = close(0.5) | close(2.0) | close(1 / 3) | close(3.0)
    return got.withColumn("status", F.when(close(1.0), "exact").when(alias, "harmonic_alias").otherwise("miss"))
