"""Hashes of ordered tables, and outlines of position sets on the tangent plane, both from partial results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sweep import running_count

WORDS = 8  # of 32 bits
MOST = 100_000


def list_hash(rows: DataFrame, order: list[Column], line: Column, separator: str = "\n", most: int = MOST) -> str:
    """SHA-256 of a short list's lines in order, byte for byte as they would be written; longer lists are refused.

    For tables of any length there is ordered_hash, which is not this number.
    """
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows, and {most} at most are hashed as one text")
    s = rows.select(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), line.alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return s.agg(F.sha2(F.array_join(lines, separator), 256).alias("h")).first()["h"]


def positions_hash(positions: DataFrame, order: list[Column], most: int = MOST) -> str:
    """Hash of a short list of positions in degrees, to six decimals, as compact JSON."""
    number = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c)), r"(\.\d+?)0+$", "$1")
    n = positions.count()
    if n > most:
        raise ValueError(f"{n} rows, and {most} at most are hashed as one text")
    x = positions.select(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.concat(F.lit("["), number("ra"), F.lit(","), number("dec"), F.lit("]")).alias("p")).alias("x"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), ","), F.lit("]"))
    return x.agg(F.sha2(text, 256).alias("h")).first()["h"]


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their place in the order, from 0; order must tell all rows apart for the places to be fixed."""
    c = running_count(rows.withColumn("_one", F.lit(1)), [F.col(o) for o in order], "_one", "place")
    return c.withColumn("place", F.col("place") - 1).drop("_one")


def ordered_hash(rows: DataFrame, order: list[str], line: Column, first: int | None = None) -> DataFrame:
    """(rows, hash) of a table of any length in its order, or of its first rows: changes with any value and any order.

    Each line is hashed with its place, and the words of all hashes are combined by exclusive or,
    a partial aggregate; so tasks add up in any way. Places come from a sort by ranges.
    """
    r = ranked(rows.select(*order, line.alias("_line")), order)
    r = r if first is None else r.filter(F.col("place") < first)
    h = F.sha2(F.concat_ws("|", F.col("place").cast("string"), F.col("_line")), 256)
    words = r.agg(F.count(F.lit(1)).alias("rows"), *(split(h, i) for i in range(WORDS)))
    return words.select("rows", F.concat(*(F.lpad(F.lower(F.hex(F.coalesce(f"w{i}", F.lit(0)))), 8, "0") for i in range(WORDS))).alias("hash"))


def split(h: Column, i: int) -> Column:
    """The exclusive or of the i-th 32 bits of all hashes."""
    return F.bit_xor(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}")


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of a point set's convex hull, counter-clockwise from the leftmost (then lowest); points on edges are no corners."""
    order = np.lexsort((y, x))
    keep = np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))
    order = order[keep]
    if len(order) < 3:
        return order

    def chain(places) -> list[int]:
        out: list[int] = []
        for p in places:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[p] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[p] - x[out[-2]]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1])


def outlines(positions: DataFrame, group: list[str], salts: int = 64) -> DataFrame:
    """(group, corner, ra, dec, x, y): convex outline of each group's positions on the plane that touches the sphere at their mean.

    Corners run counter-clockwise on that plane, x towards rising right ascension. Tasks keep the
    corners of their own rows, then `salts` parts of a group keep those, then the group: a corner of
    a set is a corner of each part that holds it. Positions a quarter of the sky or more from the
    mean have no place on the plane and are left out, as are groups whose mean has no direction.
    """
    a, d = F.radians("ra"), F.radians("dec")
    p = positions.filter("ra IS NOT NULL AND dec IS NOT NULL").select(*group, "ra", "dec", (F.cos(d) * F.cos(a)).alias("_x"), (F.cos(d) * F.sin(a)).alias("_y"), F.sin(d).alias("_z"))
    mid = p.groupBy(*group).agg(*(F.avg(c).alias(f"{c}0") for c in ("_x", "_y", "_z"))).withColumn("_n", F.sqrt(F.col("_x0") ** 2 + F.col("_y0") ** 2 + F.col("_z0") ** 2)).filter("_n > 1e-9")
    q = p.join(mid, group).withColumn("_ra0", F.atan2("_y0", "_x0")).withColumn("_dec0", F.asin(F.col("_z0") / F.col("_n")))
    c = F.sin("_dec0") * F.sin(d) + F.cos("_dec0") * F.cos(d) * F.cos(a - F.col("_ra0"))
    deg = 180 / math.pi
    q = q.withColumn("_c", c).filter("_c > 1e-6").withColumn("x", deg * F.cos(d) * F.sin(a - F.col("_ra0")) / F.col("_c")).withColumn("y", deg * (F.cos("_dec0") * F.sin(d) - F.sin("_dec0") * F.cos(d) * F.cos(a - F.col("_ra0"))) / F.col("_c"))
    flat = q.select(*group, "ra", "dec", "x", "y")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.groupby(group, dropna=False, sort=False):
                yield g.iloc[hull(g["x"].to_numpy(), g["y"].to_numpy())]

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[hull(pdf["x"].to_numpy(), pdf["y"].to_numpy())].drop(columns="_s")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "ra", "dec"])
        out = pdf.iloc[hull(pdf["x"].to_numpy(), pdf["y"].to_numpy())].copy()
        out["corner"] = np.arange(len(out))
        return out

    parts = flat.mapInPandas(some, kinds).withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.lit(salts)))
    return parts.groupBy(*group, "_s").applyInPandas(part, kinds).groupBy(*group).applyInPandas(whole, kinds + ", corner int")
