"""Ordered hashes against plain text, outlines against brute force."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightfold.operators import identity


def test_ordered_hash_follows_order_and_values_not_partitions(spark):
    rows = [(i, f"t{i * 7 % 50}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v string")
    one = identity.ordered_hash(df, ["k"], F.col("v")).collect()[0]
    acc = [0] * 8
    for i, (_, v) in enumerate(rows):
        h = hashlib.sha256(f"{i}|{v}".encode()).hexdigest()
        acc = [a ^ int(h[8 * j : 8 * j + 8], 16) for j, a in enumerate(acc)]
    assert one["rows"] == 200 and one["hash"] == "".join(f"{a:08x}" for a in acc)
    assert identity.ordered_hash(df.repartition(7), ["k"], F.col("v")).collect()[0] == one
    swapped = df.withColumn("v", F.when(F.col("k") == 3, "t28").when(F.col("k") == 4, "t21").otherwise(F.col("v")))
    assert identity.ordered_hash(swapped, ["k"], F.col("v")).collect()[0]["hash"] != one["hash"]
    some = identity.ordered_hash(df, ["k"], F.col("v"), first=10).collect()[0]
    assert some == identity.ordered_hash(df.filter("k < 10"), ["k"], F.col("v")).collect()[0] and some["rows"] == 10
    assert identity.ordered_hash(df.limit(0), ["k"], F.col("v")).collect()[0]["rows"] == 0


def test_short_lists_hash_byte_for_byte(spark):
    rows = [(2, "b", 20), (1, "a", 10), (3, "c", 30)]
    df = spark.createDataFrame(rows, "k long, target string, tic long")
    want = hashlib.sha256("\n".join(f"{t}|{c}" for _, t, c in sorted(rows)).encode()).hexdigest()
    assert identity.list_hash(df, [F.col("k")], F.concat_ws("|", "target", "tic")) == want
    with pytest.raises(ValueError):
        identity.list_hash(df, [F.col("k")], F.col("target"), most=2)
    at = [(0, 10.0, -5.25), (1, 359.9999996, 0.1234567), (2, 1.5, 89.123456)]
    text = json.dumps([[round(r, 6), round(d, 6)] for _, r, d in at], separators=(",", ":"))
    assert identity.positions_hash(spark.createDataFrame(at, "k long, ra double, dec double"), [F.col("k")]) == hashlib.sha256(text.encode()).hexdigest()


def corners(points):
    """Points that no three others (or two, on an edge) hold between them."""
    pts = sorted(set(points))
    out = set()
    for i, a in enumerate(pts):
        for b in pts[:i] + pts[i + 1 :]:
            side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in pts]
            if all(s >= -1e-12 for s in side):
                on = [c for c, s in zip(pts, side) if abs(s) <= 1e-12]
                key = lambda c: (c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1])
                out |= {min(on, key=key), max(on, key=key)}
    return out


def test_hull_of_random_and_collinear_points():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 60):
        p = r.integers(0, 8, (n, 2)).astype(float)
        got = identity.hull(p[:, 0], p[:, 1])
        assert {tuple(p[i]) for i in got} == (corners([tuple(x) for x in p]) or {tuple(x) for x in p})
        if len(got) > 2:
            q = p[got]
            turn = [(q[i - 1][0] - q[i - 2][0]) * (q[i][1] - q[i - 2][1]) - (q[i - 1][1] - q[i - 2][1]) * (q[i][0] - q[i - 2][0]) for i in range(len(q))]
            assert min(turn) > 0
    line = identity.hull(np.arange(5.0), np.arange(5.0) * 2)
    assert sorted(line) == [0, 4]


def test_outlines_at_the_pole_across_zero_and_by_parts(spark):
    r = np.random.default_rng(2)
    rows = [("pole", float(a), float(d)) for a, d in zip(r.uniform(0, 360, 120), r.uniform(80, 90, 120))]
    rows += [("zero", float(a % 360), float(d)) for a, d in zip(r.uniform(-8, 8, 90), r.uniform(-6, 6, 90))]
    rows += [("one", 10.0, 10.0), ("one", 10.0, 10.0), ("gone", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, ra double, dec double").repartition(6)
    got = {}
    for x in identity.outlines(df, ["g"], 3).orderBy("g", "corner").collect():
        got.setdefault(x["g"], []).append(x)
    assert set(got) == {"pole", "zero", "one"} and len(got["one"]) == 1
    for g in ("pole", "zero"):
        v = np.array([(math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d))) for n, a, d in rows if n == g])
        m = v.mean(0) / np.linalg.norm(v.mean(0))
        east = np.cross([0, 0, 1.0], m)
        east /= np.linalg.norm(east)
        north = np.cross(m, east)
        flat = np.degrees(np.stack([v @ east, v @ north], 1) / (v @ m)[:, None])
        want = {(round(x, 6), round(y, 6)) for x, y in corners([(round(a, 9), round(b, 9)) for a, b in flat])}
        assert {(round(x["x"], 6), round(x["y"], 6)) for x in got[g]} == want
        assert [x["corner"] for x in got[g]] == list(range(len(got[g])))
    assert identity.outlines(df.limit(0), ["g"]).collect() == []
