"""Column functions over sky positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ephemeris import col

# The rotation from equatorial (J2000) to Galactic axes.
GALACTIC = ((-0.0548755604, -0.8734370902, -0.4838350155), (0.4941094279, -0.4448296300, 0.7469822445), (-0.8676661490, -0.1980763734, 0.4559837762))
MAS = 3_600_000.0
POLE = 89.9


def separation_deg(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation by the haversine."""
    d1, d2 = F.radians(col(dec1)), F.radians(col(dec2))
    a = F.pow(F.sin((d2 - d1) / 2), F.lit(2.0)) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(col(ra2) - col(ra1)) / 2), F.lit(2.0))
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def galactic_xyz(ra, dec, distance) -> Column:
    """struct(x, y, z), Sun-centred, in the unit of the distance."""
    r, d = F.radians(col(ra)), F.radians(col(dec))
    e = (F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d))
    return F.struct(*((col(distance) * (m[0] * e[0] + m[1] * e[1] + m[2] * e[2])).alias(n) for n, m in zip("xyz", GALACTIC)))


def direction_from_key(key) -> Column:
    """struct(ra, dec): an even direction on the sky that the key's SHA-256 fixes."""
    h = F.sha2(col(key).cast("string"), 256)
    u = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("double") / 4294967296.0
    return F.struct((u(1) * 360.0).alias("ra"), F.degrees(F.asin(u(9) * 2 - 1)).alias("dec"))


def moved(ra, dec, pm_ra, pm_dec, from_year, to_year) -> Column:
    """struct(ra, dec, basis): the position at another epoch and what was done to get it."""
    years = col(to_year) - col(from_year)
    no = col(pm_ra).isNull() | col(pm_dec).isNull()
    pole = F.abs(col(dec)) >= POLE
    dec2 = col(dec) + col(pm_dec) * years / MAS
    ra2 = F.pmod(col(ra) + col(pm_ra) * years / MAS / F.cos(F.radians(col(dec))), F.lit(360.0))
    still = no | (years == 0)
    return F.struct(
        F.when(still | pole, col(ra)).otherwise(ra2).alias("ra"),
        F.when(still, col(dec)).otherwise(dec2).alias("dec"),
        F.when(no, "no_proper_motion_available").when(years == 0, "same_epoch").when(pole, "declination_only_near_pole").otherwise("proper_motion_propagated").alias("basis"),
    )


def tangent_xy(ra, dec, ra0, dec0) -> Column:
    """struct(x, y): gnomonic coordinates in degrees, null on the far side."""
    r, d, d0 = F.radians(col(ra) - col(ra0)), F.radians(col(dec)), F.radians(col(dec0))
    cosc = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(r)
    x = F.degrees(F.cos(d) * F.sin(r) / cosc)
    y = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(r)) / cosc)
    return F.struct(F.when(cosc > 0, x).alias("x"), F.when(cosc > 0, y).alias("y"))


def match_confidence(separation, radius) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - col(separation) / col(radius)))


def dwarf_check(g, colour, parallax) -> Column:
    """Whether a star is far brighter than the main sequence at its colour."""
    absolute = col(g) - 5.0 * F.log10(1000.0 / col(parallax) / 10.0)
    excess = 2.1 + 4.4 * col(colour) - absolute
    able = col(g).isNotNull() & col(colour).isNotNull() & (col(parallax) > 0)
    verdict = F.when(excess > 2.5, "likely_evolved_star").when(excess > 1.0, "possibly_evolved_star").otherwise("consistent_with_main_sequence")
    return F.struct(F.when(able, "measured").otherwise("not_run").alias("state"), F.when(able, excess).alias("excess"), F.when(able, verdict).alias("verdict"))
