"""Comparing the members of index cells without gathering a hot cell in one task.

A cell with at most BLOCK members is one group. A larger one is dealt into packs by a hash of
the node: a pack is one row of some thousands of members, and pairs of packs meet, so that every
pair of members does, in tasks of bounded size and without rows that grow with the square of
the members. What a group returns is a spanning forest of the links found in it (fewer edges
than members), never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
PACK = 4096


def counted(rows: DataFrame, cell: str) -> DataFrame:
    """rows of cells with two members or more, with the cell's size n; sizes are partial aggregates, so no cell passes one task."""
    n = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(n, cell)


def packs(rows: DataFrame, cell: str, size: int = PACK) -> DataFrame:
    """Members of cells (counted; node, vector and further longs) dealt into packs: one row of at most some `size` members.

    A pack holds its columns as arrays in one row, so what meets is rows of packs and not of
    members: a cell of n members makes (n / size) ** 2 pairs of packs.
    """
    k = F.ceil(F.col("n") / F.lit(size)).cast("int")
    dealt = rows.withColumn("k", k).withColumn("b", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k").cast("long")).cast("int"))
    more = [c for c in rows.columns if c not in (cell, "node", "vector", "n")]
    fields = [f"{cell} long", "b int", "k int", "nodes array<long>", "vectors array<double>", *(f"{c} array<long>" for c in more)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, [cell, "b"]):
            for s, e in zip(start, np.append(start[1:], t.num_rows)):
                g = t.slice(s, e - s)
                one = [pa.array([g.column(cell)[0].as_py()]), pa.array([g.column("b")[0].as_py()], pa.int32()), pa.array([g.column("k")[0].as_py()], pa.int32()), pa.array([g.column("node").to_numpy()], pa.list_(pa.int64()))]
                flat = g.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                one += [pa.array([flat], pa.list_(pa.float64())), *(pa.array([g.column(c).to_numpy()], pa.list_(pa.int64())) for c in more)]
                yield pa.RecordBatch.from_arrays(one, [f.split()[0] for f in fields])

    return grouped(dealt.select(cell, "b", "k", "node", "vector", *more), [cell, "b"]).mapInArrow(work, ", ".join(fields))


def meet(packed: DataFrame, cell: str, also: bool = False) -> DataFrame:
    """Pairs of packs of one cell: columns of pack p as they are, those of pack q with o_ in front.

    p < q unless also is set; then each pack meets every pack, itself too. A pair is dealt by its
    q, so the pairs of one cell lie in many tasks.
    """
    last = F.col("k") - 1
    first = F.lit(0) if also else F.col("b") + 1
    todo = packed if also else packed.filter(F.col("b") < last)
    left = todo.withColumn("q", F.explode(F.sequence(first, last)))
    right = packed.select(cell, F.col("b").alias("q"), *(F.col(c).alias(f"o_{c}") for c in packed.columns if c not in (cell, "b", "k")))
    return left.join(right, [cell, "q"])


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches that are sorted by keys, with the groups' first rows.

    A group of many batches is put together once, when its end is seen.
    """

    def starts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        ends = [b.column(k)[0].as_py() for k in keys] != last or len(starts(b)) > 1
        held.append(b)
        rows += b.num_rows
        last = [b.column(k)[-1].as_py() for k in keys]
        if rows < 4000 or not ends:
            continue
        t = pa.Table.from_batches(held)
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, s[-1]), s[:-1]
            held, rows = t.slice(s[-1]).to_batches(), t.num_rows - int(s[-1])
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def forest(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(first member, further members) for each set of 2 or more that links hold together.

    near(a, b) gives the boolean links between members a and b. Breadth first: each member is
    compared with those not yet reached only.
    """
    out, rest = [], np.arange(n)
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        got, front = [], seed
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(front), 256):
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                hit[todo] = near(front[i : i + 256], rest[todo]).any(0)
            front, rest = rest[hit], rest[~hit]
            got.append(front)
        members = np.concatenate(got) if got else np.zeros(0, int)
        if len(members):
            out.append((int(seed[0]), members))
    return out
