"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups.

Documents with equal texts form a group that stays in one shard. Only (group, bytes) rows are
shuffled. Groups are dealt into chunks of about CHUNK groups; a task differences one chunk into
a single partial partition of `shards` sums, and the chunks' partial partitions (shards numbers
each) are differenced further on the driver: always the two with the largest spread, one of
them in opposite order. A group larger than a shard's share simply has the shard's other places
filled last, so it sits alone; no group is split, dropped or capped.

Null texts count as empty and form one group with them. Repeated rows are rows of their own.
Null doc_ids get a slot like others. An empty table gives an empty result. A column of docs with
another name is ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, table

SHARDS = 24
CHUNK = 100_000
SLOT_ROWS = 50_000


def differencing(parts: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp for k-way partial partitions, one per row of parts.

    Returns for each row and each place in it the final set's number. Largest spread first;
    ties by row number, so the result depends on the rows alone.
    """
    n, k = parts.shape
    if n == 0:
        return np.zeros((0, k), np.int64)
    sums: list = [None] * (2 * n)
    order: list = [None] * (2 * n)  # places of the input, in falling order of sum
    kids: list = [None] * (2 * n)
    heap = []
    for i in range(n):
        o = np.argsort(-parts[i], kind="stable")
        order[i], sums[i] = o, parts[i][o]
        heap.append((-int(sums[i][0] - sums[i][-1]), i))
    heapq.heapify(heap)
    top = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        o = np.argsort(-both, kind="stable")
        sums[top], order[top], kids[top] = both[o], o.astype(np.int32), (a, b)
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[top][0] - sums[top][-1]), top))
        top += 1
    out = np.zeros((n, k), np.int64)
    root = heap[0][1]
    stack = [(root, np.arange(k))]  # final set of each sorted place of the node
    while stack:
        node, final = stack.pop()
        at = np.empty(k, np.int64)
        at[order[node]] = final  # by place before sorting
        if node < n:
            out[node] = at
        else:
            a, b = kids[node]
            stack += [(a, at), (b, at[::-1])]
    return out


def _one_chunk(shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        t = pa.Table.from_batches(given)
        chunks = t.column("chunk").to_numpy()
        keys, size = np.array(t.column("key").to_pylist(), object), t.column("bytes").to_numpy()
        for c in np.unique(chunks):
            at = np.flatnonzero(chunks == c)
            at = at[np.lexsort((keys[at].astype("S32"), -size[at]))]
            parts = np.zeros((len(at), shards), np.int64)
            parts[:, 0] = size[at]
            place = differencing(parts)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(list(keys[at]), pa.string()), pa.array(size[at], pa.int64()), pa.array(place, pa.int32())], ["chunk", "key", "bytes", "place"])

    return work


def assign_groups(groups: DataFrame, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """(key, shard) for groups (key: string, bytes: long) of distinct keys."""
    spark = prepare(groups.sparkSession)
    groups = cut(groups.select("key", "bytes"), "groups")
    n = groups.count()
    chunks = max(1, -(-n // chunk))
    dealt = groups.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    if chunks == 1:
        dealt = dealt.repartition(1)
    else:
        dealt = dealt.repartition(chunks, "chunk")
    local = cut(dealt.mapInArrow(_one_chunk(shards), "chunk int, key string, bytes long, place int"), "places")
    rows = local.groupBy("chunk", "place").agg(F.sum("bytes").alias("bytes")).collect()  # shards numbers a chunk
    number = {c: i for i, c in enumerate(sorted({r["chunk"] for r in rows}))}
    parts = np.zeros((len(number), shards), np.int64)
    for r in rows:
        parts[number[r["chunk"]], r["place"]] = r["bytes"]
    final = differencing(parts)
    named = [(c, p, int(final[i, p])) for c, i in number.items() for p in range(shards)] or [(0, 0, 0)]
    places = spark.createDataFrame(named, "chunk int, place int, shard int")
    return local.join(places, ["chunk", "place"]).select("key", "shard")


def with_slots(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds slot: a gapless number from 0 within each shard, without sorting a shard in one task."""
    blocks = max(1, -(-n // SLOT_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy(*order)
    return rows.join(base, ["shard", "block"]).withColumn("slot", F.col("base") + F.row_number().over(within) - 1).drop("base", "block")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("key"))
    rows = cut(rows, "sizes")
    shard = assign_groups(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards)
    placed = cut(rows.join(shard, "key"), "placed")
    out = with_slots(placed, placed.count(), ["doc_id", "key", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(prepare(spark), sf_dir, "documents"))
