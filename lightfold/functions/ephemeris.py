"""Column functions over periods, epochs and durations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALIAS_NAMES, ALIAS_RATIOS, JULIAN_FLOOR, JULIAN_OFFSET, ORBIT_DAYS, ORBIT_RATIOS, SEARCH


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def cycle(t, epoch, period) -> Column:
    """Nearest event number; halves go to the even number."""
    return F.rint((col(t) - col(epoch)) / col(period)).cast("long")


def folded(t, period, epoch) -> Column:
    """Signed time to the nearest event, in [-period/2, period/2)."""
    p = col(period)
    return F.pmod(col(t) - col(epoch) + p / 2, p) - p / 2


def folded_offset(t, period, epoch) -> Column:
    return F.abs(folded(t, period, epoch))


def phase(t, period, epoch) -> Column:
    """Phase in [-0.5, 0.5)."""
    p = col(period)
    return F.pmod(col(t) - col(epoch) + p / 2, p) / p - 0.5


def phase_offset(reference, other, period) -> Column:
    """Signed offset of other from reference, folded on the period, in (-period/2, period/2]."""
    p = col(period)
    o = F.pmod(col(other) - col(reference), p)
    return F.when(o > p / 2, o - p).otherwise(o)


def in_transit(t, period, epoch, duration_days) -> Column:
    return folded_offset(t, period, epoch) <= col(duration_days) / 2


def transit_times(epoch, period, start, end, limit: int = 512) -> Column:
    """Event times in [start, end], the first limit of them; none where the range holds none."""
    e, p = col(epoch), col(period)
    first = F.ceil((col(start) - e) / p).cast("long")
    last = F.least(F.floor((col(end) - e) / p).cast("long"), first + limit - 1)
    times = F.transform(F.sequence(first, last), lambda n: e + n * p)
    return F.when((p > 0) & (last >= first), times).otherwise(F.array().cast("array<double>"))


def to_relative_julian(epoch) -> Column:
    e = col(epoch)
    return F.when(e > JULIAN_FLOOR, e - JULIAN_OFFSET).otherwise(e)


def expected_duration_hours(period, density) -> Column:
    """Central transit of a circular orbit: 13 h at a year and solar density."""
    p, d = col(period), col(density)
    return F.when((p > 0) & (d > 0), 13.0 * F.pow(p / 365.25, F.lit(1 / 3)) * F.pow(d, F.lit(-1 / 3)))


def stellar_density(radius, mass) -> Column:
    r, m = col(radius), col(mass)
    return F.when((r > 0) & (m > 0), m / F.pow(r, F.lit(3.0)))


def density_from_orbit(a_over_r, period) -> Column:
    """Solar densities from the scaled orbit: 3 pi (a/R)^3 / (G P^2)."""
    seconds = col(period) * 86400.0
    scale = 3 * math.pi / 6.67430e-11 / 1408.0
    return F.when((col(a_over_r) > 0) & (col(period) > 0), scale * F.pow(col(a_over_r), F.lit(3.0)) / (seconds * seconds))


def mass_for_injection(radius, mass) -> Column:
    """struct(mass, basis): the catalogue's mass, else the radius power law within bounds."""
    fallback = F.least(F.lit(2.5), F.greatest(F.lit(0.08), F.pow(col(radius), F.lit(0.8))))
    known = col(mass) > 0
    return F.struct(F.when(known, col(mass)).otherwise(fallback).alias("mass"), F.when(known, F.lit("catalog_stellar_mass")).otherwise(F.lit("radius_power_law_fallback")).alias("basis"))


def limb_darkening(teff) -> Column:
    t = col(teff)
    u1 = F.when(t.isNull() | (t < 4000), 0.45).when(t < 6500, 0.35).otherwise(0.25)
    return F.struct(u1.alias("u1"), F.when(t.isNull() | (t < 6500), 0.25).otherwise(0.20).alias("u2"))


def small_planet_merit(radius, magnitude) -> Column:
    """Lower is better."""
    return F.when(col(radius) > 0, 2.0 * F.log10(col(radius)) + 0.2 * col(magnitude)).otherwise(999.0)


def selection_tier(luminosity, radius, teff, max_radius: float = 1.0, max_teff: float = 5500.0) -> Column:
    kind, r, t = F.upper(F.trim(col(luminosity))), col(radius), col(teff)
    small = F.coalesce((r >= 0.1) & (r <= max_radius), F.lit(False))
    warm = F.coalesce((t >= 2500.0) & (t <= max_teff), F.lit(False))
    best = F.coalesce((r >= 0.1) & (r <= 1.5) & (t >= 2500.0) & (t <= min(max_teff, 6500.0)), F.lit(False))
    dwarf = kind == "DWARF"
    return F.when(dwarf & best, 0).when(dwarf & small & warm, 1).when(dwarf, 2).when(~kind.isin("GIANT", "SUBGIANT") & small, 3).when(kind == "SUBGIANT", 4).when(kind == "GIANT", 6).otherwise(5)


def geometric_grid(low, high, points: int) -> Column:
    lo, hi = col(low), col(high)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo * F.pow(hi / lo, i / F.lit(points - 1)))


def duration_grid_hours(min_period, max_period, density) -> Column:
    d = F.when(col(density) > 0, col(density)).otherwise(1.0)
    low = F.greatest(F.lit(SEARCH.duration_hours[0]), SEARCH.duration_span[0] * expected_duration_hours(min_period, d))
    high = SEARCH.duration_span[1] * expected_duration_hours(max_period, d)
    return geometric_grid(low, F.least(F.lit(SEARCH.duration_hours[1]), F.greatest(high, low * 1.5)), SEARCH.duration_points)


def period_bounds(baseline, single_sector, low=None, high=None) -> Column:
    """struct(min_period, max_report, max_search) that a baseline allows."""
    least = F.greatest(F.lit(SEARCH.min_period), col(low)) if low is not None else F.lit(SEARCH.min_period)
    by_length = F.greatest(least * 2, col(baseline) / F.when(col(single_sector), 2).otherwise(3))
    report = F.least(by_length, col(high)) if high is not None else by_length
    return F.struct(least.alias("min_period"), report.alias("max_report"), (report * (1 + SEARCH.overscan)).alias("max_search"))


def period_relation(found, known, ratios=ALIAS_RATIOS, names=ALIAS_NAMES, tolerance: float = SEARCH.alias_tolerance) -> Column:
    """struct(relation, factor, error): the ratio found/known is nearest to; "none" beyond the tolerance.

    factor and error are null unless both periods are positive; of equal errors the first ratio counts.
    """
    p, k = col(found), col(known)
    errors = [F.abs(p - k * r) / (k * r) for r in ratios]
    best = F.least(*errors)
    ok = (p > 0) & (k > 0)

    tried = F.array(*errors)
    at = F.array_position(tried, F.array_min(tried)).cast("int")

    def nearest(values) -> Column:
        return F.element_at(F.array(*values), at)

    ladder = sorted(ratios)
    if all(a * (1 + tolerance) < b * (1 - tolerance) for a, b in zip(ladder, ladder[1:])):
        # no period is within the tolerance of two ratios, so none has to be compared with the others
        relation = F.when(~ok, "none")
        for e, n in zip(errors, names):
            relation = relation.when(e <= tolerance, n)
        relation = relation.otherwise("none")
    else:
        relation = F.when(ok & (best <= tolerance), nearest([F.lit(n) for n in names])).otherwise(F.lit("none"))
    return F.struct(
        relation.alias("relation"),
        F.when(ok, nearest([F.lit(float(r)) for r in ratios])).alias("factor"),
        F.when(ok, best).alias("error"),
    )


def compare_period(found, expected, tolerance: float = 0.02) -> Column:
    """struct(status, relation, error) over five factors; relation names the nearest even on a miss."""
    ratios, names = (1.0, 0.5, 2.0, 1 / 3, 3.0), ("exact", "half_period", "double_period", "one_third_period", "triple_period")
    near = period_relation(found, expected, ratios, names, math.inf)
    hit = near["error"] <= tolerance
    return F.struct(F.when(hit & (near["relation"] == "exact"), "exact").when(hit, "harmonic_alias").otherwise("miss").alias("status"), near["relation"].alias("relation"), near["error"].alias("error"))


def spacecraft_harmonic(period) -> Column:
    """The orbit ratio the period sits on, as text, or null."""
    p = col(period)
    tried = [F.struct((F.abs(p - ORBIT_DAYS * a / b) / (ORBIT_DAYS * a / b)).alias("error"), F.lit(i).alias("i"), F.lit(f"{a}/{b}").alias("ratio")) for i, (a, b) in enumerate(ORBIT_RATIOS)]
    best = F.array_min(F.array(*tried))
    return F.when(best["error"] <= SEARCH.harmonic_tolerance, best["ratio"])


def rail_flag(value, end) -> Column:
    """Whether a fitted value equals the end of its grid within 1e-10 + 1e-6 of it."""
    return F.abs(col(value) - col(end)) <= 1e-10 + 1e-6 * F.abs(col(end))


def same_signal(a, b) -> Column:
    return F.abs(col(a) - col(b)) <= F.greatest(1e-10 * F.greatest(F.abs(col(a)), F.abs(col(b))), F.lit(1e-10))


def worst_uncertainty(up, down) -> Column:
    return F.greatest(F.abs(col(up)), F.abs(col(down)))


def duration_as_hours(value, unit, period) -> Column:
    """Hours from hours, days, or a share of the period."""
    v = col(value)
    return F.when(col(unit) == "hours", v).when(col(unit) == "days", v * 24.0).when(col(unit) == "phase", v * col(period) * 24.0)
