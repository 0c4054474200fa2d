"""Selections: top rows, quotas, round robin, hash samples, spread, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, keep


def round_robin(df: DataFrame, groups: list[str], order: list, limit: int) -> DataFrame:
    """The first of every group, then the second, until limit rows."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", rank).orderBy("rank", *groups).limit(limit)


def quota_fill(df: DataFrame, groups: list[str], order: list, limit: int, key: str) -> DataFrame:
    """A quarter of each group's even share by rank, then the best of the rest until limit rows."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    n = df.select(*groups).distinct().agg(F.count(F.lit(1)).alias("_g"))
    ranked = df.withColumn("rank", rank).crossJoin(F.broadcast(n))
    quota = F.greatest(F.lit(1), F.floor(F.lit(limit) / (4 * F.col("_g"))))
    return ranked.withColumn("picked", F.when(F.col("rank") <= quota, "quota").otherwise("fill")).orderBy(F.col("picked").desc(), *order, key).limit(limit).drop("_g")


def hash_sample(df: DataFrame, key: str, seed: str, share: float, total: int) -> DataFrame:
    """The ceil(share * total) rows whose hash of seed and key is smallest."""
    return df.withColumn("hash", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("hash", key).limit(int(np.ceil(share * total)))


def within_budget(df: DataFrame, groups: list[str], order: list, size: str, budget: float) -> DataFrame:
    """Oldest rows of each group to remove until the rest fits the budget: sizes before a row fall short of the excess."""
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before).withColumn("excess", F.sum(size).over(w) - budget).withColumn("remove", F.col("before") < F.col("excess"))


def strided(df: DataFrame, groups: list[str], order: list, count: int) -> DataFrame:
    """count rows of each group at even strides through its order."""
    w = Window.partitionBy(*groups)
    at = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(w)
    d = df.withColumn("at", at).withColumn("n", n)
    slot = F.ceil(F.col("at") * count / F.col("n"))
    ok = (F.col("n") <= count) | ((F.floor(slot * F.col("n") / count) == F.col("at")) & (slot < count))
    return d.filter(ok).drop("n")


def farthest_points(rows: np.ndarray, count: int, first: int | None = None) -> list[int]:
    """Greedy k-centre order over standardised rows: farthest from the origin, then from all chosen.

    For samples of bounded size that already are on the driver; ties go to the first row.
    """
    z = np.where(np.isnan(rows), np.nanmedian(rows, axis=0), rows)
    sd = z.std(0)
    z = (z - z.mean(0)) / np.where(sd > 0, sd, 1)
    chosen = [int((z**2).sum(1).argmax()) if first is None else first]
    near = ((z - z[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(z)):
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((z - z[chosen[-1]]) ** 2).sum(1))
    return chosen


def spread_out(df: DataFrame, key: str, vector: str, count: int, every: int = 10) -> list:
    """Keys (numbers) of the greedy k-centre order over all rows of a table of any size; ties go to the least key.

    As farthest_points, with mean, deviation and each pick as aggregates: a pick is one max_by, and the
    driver gets one row of it. The least distance so far is written with the rows every few picks.
    """
    given = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    n = given.count()
    number = F.when(F.abs("x") < float("inf"), F.col("x"))  # null for a missing, unbounded or NaN value
    long = given.select(F.posexplode("v").alias("at", "x")).select("at", number.alias("x"))
    stats = {r["at"]: r for r in long.groupBy("at").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()}
    size = max(stats, default=-1) + 1
    gaps = [i for i in range(size) if stats[i]["n"] < n]
    fill = np.zeros(size)
    mean, sd = (np.array([stats[i][c] or 0.0 for i in range(size)]) for c in ("mean", "sd"))
    if gaps:
        for r in long.filter(F.col("at").isin(gaps)).groupBy("at").agg(F.median("x").alias("m")).collect():
            fill[r["at"]] = r["m"] or 0.0
        # values that were missing stand at the median before mean and deviation are taken
        seen = np.array([stats[i]["n"] for i in range(size)]) / n
        whole = seen * mean + (1 - seen) * fill
        sd = np.sqrt(seen * (sd**2 + (mean - whole) ** 2) + (1 - seen) * (fill - whole) ** 2)
        mean = whole
    sd = np.where(sd > 0, sd, 1.0)

    def standard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.tile(fill, (b.num_rows, 1))
            for i, v in enumerate(b.column(1).to_pylist()):
                x = np.array(v or [], float)
                z[i, : len(x)] = np.where(np.isfinite(x), x, fill[: len(x)])
            z = (z - mean) / sd
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * size, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array((z**2).sum(1))], ["key", "z", "near"])

    def nearer(points: np.ndarray, first: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = b.column("z").flatten().to_numpy().reshape(b.num_rows, size)
                near = np.full(b.num_rows, np.inf) if first else b.column("near").to_numpy()
                for p in points:
                    near = np.minimum(near, ((z - p) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("z"), pa.array(near), b.column("row")], ["key", "z", "near", "row"])

        return work

    kind = given.schema["key"].dataType.simpleString()
    rows = keep(given.mapInArrow(standard, f"key {kind}, z array<double>, near double").withColumn("row", F.monotonically_increasing_id()), "spread")
    now, keys, taken, points, first = rows, [], [], [], True
    while len(keys) < min(count, n):
        best = now.filter(~F.col("row").isin(taken)) if taken else now
        r = best.agg(F.max_by(F.struct("key", "row", "z"), F.struct("near", -F.col("key"), -F.col("row"))).alias("r")).first()["r"]
        keys.append(r["key"])
        taken.append(r["row"])
        points.append(np.array(r["z"]))
        now = rows.mapInArrow(nearer(np.array(points), first), rows.schema)
        if len(points) == every:
            new = keep(now, "spread")
            discard(rows)
            rows = now = new
            points, first = [], False
    discard(rows)
    return keys
