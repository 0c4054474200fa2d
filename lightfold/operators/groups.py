"""Work on many small groups of rows, as arrays.

Groups lie one after another in sorted partitions and are cut out of Arrow tables, so a group costs
what is done with it; a pandas frame and an Arrow batch a group would cost milliseconds more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import shuffled

KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
ROWS = 4_000  # put together at least, where there are so many


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that differ where values do; nulls have one too."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches that are sorted by keys, with the groups' first rows."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = _codes(t.column(k))
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        ends = [b.column(k)[0].as_py() for k in keys] != last or len(starts(pa.Table.from_batches([b]))) > 1
        held.append(b)
        rows += b.num_rows
        last = [b.column(k)[-1].as_py() for k in keys]
        if rows < ROWS or not ends:  # a group of many batches is put together once, when its end is seen
            continue
        t = pa.Table.from_batches(held)
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, s[-1]), s[:-1]
            held, rows = t.slice(s[-1]).to_batches(), t.num_rows - int(s[-1])
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def mapped(rows: DataFrame, keys: list[str], order: list[str], kept: list[str], read: list[str], work: Callable[[dict[str, np.ndarray]], tuple], new: str) -> DataFrame:
    """The columns `kept` of the rows that work names, and new columns, for each group of keys.

    work is given the columns `read` of a group's rows, sorted by `order`, and returns the places of
    the rows to take (any number of times) and the values of each new column. Groups are dealt by
    their keys into as many tasks as a shuffle has, which is not lowered where their rows are few.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = [c.split() for c in new.split(", ")]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, keys):
            columns = {c: t.column(c).to_numpy() for c in read}
            at, values = [], []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), t.num_rows]):
                i, *v = work({c: x[s:e] for c, x in columns.items()})
                if len(i):
                    at.append(np.asarray(i, np.int64) + s)
                    values.append(v)
            if not at:
                continue
            took = t.select(kept).take(pa.array(np.concatenate(at))).combine_chunks()
            whole = [took.column(c).combine_chunks() for c in kept]
            whole += [pa.array(np.concatenate([v[j] for v in values]), KINDS[kind]) for j, (_, kind) in enumerate(made)]
            yield pa.RecordBatch.from_arrays(whole, [*kept, *(c for c, _ in made)])

    needed = list(dict.fromkeys([*keys, *order, *kept, *read]))
    sorted_ = rows.select(*needed).repartition(shuffled(rows), *keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInArrow(one, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), new]))
