"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token ids, end with END and are cut only where longer than a sequence: into
whole sequences from the end, so the first piece may be shorter. Whole pieces are sequences
already. The others are dealt by a hash into shards of about SHARD pieces, and every shard is packed
on ISLANDS islands, each a task's group. An island begins with packings in random orders, best
fit without sorting, and evolves them by crossover: whole well-filled bins of one parent are injected
into the other, bins that now hold duplicates are dropped and the displaced pieces are best-fitted,
longest first (Falkenauer 1996). A packing in falling order of size joins as a further parent
only if half of the generations haven't met the least number of bins that the sizes allow. Islands stop there;
of shards that are not there yet each island sends its elite to the next in a ring, EPOCHS times
at most, and the best island's packing counts. Bins that a shard left
unfilled are opened and their pieces packed again with those of other shards, level by level,
until one shard is left or a level fills no more than half of what it was given.

Null text counts as empty: one piece that holds END alone. Repeated rows are packed like others
(rows are numbered once written, not by doc_id). Every piece is packed; an empty table gives
an empty result. Pieces of one size are told apart by their row only. Only doc_id and text are
read, so columns of any other names change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import grouped, runs
from .common import cut, discard, prepare, table
from .tokens import END, VOCABULARY, encoder

LENGTH = 2048
SHARD = 4096
ISLANDS = 2
EPOCHS = 3
POPULATION = 3
GENERATIONS = 8
FULL = 0.995  # bins below this share are opened for the next level
SEED = 11


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def _pieces(length: int, vocabulary: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([END], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(t or "") + end
                for i, (s, n) in enumerate(cuts(len(ids) // 4, length)):
                    out.append((row, d, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
                    row += 1
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return work


class Bins:
    """Bins with room, found by the least room that is enough."""

    def __init__(self, cap: int):
        self.cap, self.items, self.room = cap, [], []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def add(self, items: list[int], load: int) -> None:
        self.items.append(items)
        self.room.append(self.cap - load)
        self._offer(len(self.items) - 1)

    def _offer(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.by_room.setdefault(r, []).append(b)
            self.mask |= 1 << r

    def fit(self, item: int, size: int) -> None:
        m = self.mask >> size
        if not m:
            self.add([item], size)
            return
        r = size + (m & -m).bit_length() - 1
        stack = self.by_room[r]
        b = stack.pop()
        if not stack:
            self.mask &= ~(1 << r)
        self.items[b].append(item)
        self.room[b] = r - size
        self._offer(b)


Packing = list[tuple[int, list[int]]]  # (load, items) of each bin


def _packed(bins: Bins) -> Packing:
    return [(bins.cap - r, i) for r, i in zip(bins.room, bins.items)]


def best_fit(sizes: list[int], order: list[int], cap: int, bins: Bins | None = None) -> Packing:
    bins = bins or Bins(cap)
    for i in order:
        bins.fit(i, sizes[i])
    return _packed(bins)


def worth(p: Packing) -> tuple[int, int]:
    """Fewer bins first, then fuller full ones."""
    return len(p), -sum(load * load for load, _ in p)


def crossover(a: Packing, b: Packing, sizes: list[int], cap: int, rng: np.random.Generator) -> Packing:
    """Injects a random part of b's well-filled bins into a."""
    ranked = sorted(range(len(b)), key=lambda i: -b[i][0])
    good = ranked[: max(1, len(ranked) // 2)]
    chosen = [good[i] for i in np.flatnonzero(rng.random(len(good)) < rng.uniform(0.2, 0.8))] or good[:1]
    taken = bytearray(len(sizes))
    bins, loose = Bins(cap), []
    for i in chosen:
        load, items = b[i]
        for x in items:
            taken[x] = 1
        bins.add(list(items), load)
    opened = (rng.random(len(a)) < 0.1).tolist()
    for (load, items), now in zip(a, opened):
        left = [x for x in items if not taken[x]]
        # now and then a poorly filled bin is opened too
        if len(left) < len(items) or (now and load < cap):
            loose += left
        else:
            bins.add(left, load)
    loose.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, loose, cap, bins)


def least_bins(sizes: list[int], cap: int) -> int:
    """No packing has fewer bins (Martello & Toth 1990): the best bound over all sizes k, where items above cap - k
    share with none of size k or more, those above cap / 2 have a bin each, and those from k on fill what is left."""
    s = np.sort(np.array(sizes, np.int64))
    if not len(s):
        return 0
    total = np.concatenate(([0], np.cumsum(s)))
    k = np.unique(np.append(s[2 * s <= cap], 0))
    low, half, high = (np.searchsorted(s, x, side) for x, side in ((k, "left"), (cap // 2, "right"), (cap - k, "right")))
    high = np.maximum(high, half)
    room = (high - half) * cap - (total[high] - total[half])
    more = np.maximum(0, -(-(total[half] - total[low] - room) // cap))
    return int((len(s) - half + more).max())


def evolve(sizes: list[int], cap: int, start: list[Packing], rng: np.random.Generator, population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing after some generations; it is never worse than the best of start, nor than best fit in falling order."""
    least = least_bins(sizes, cap)
    people = list(start)
    while len(people) < population:
        people.append(best_fit(sizes, rng.permutation(len(sizes)).tolist(), cap))
    people.sort(key=worth)
    for g in range(generations):
        if len(people[0]) <= least:
            break
        if not start and g == generations // 2:
            people[-1] = best_fit(sizes, sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), cap)
        for _ in range(population):
            i, j = rng.choice(population, 2, replace=False)
            people.append(crossover(people[i], people[j], sizes, cap, rng))
            if len(people[-1]) <= least:
                break
        people = sorted(people, key=worth)[:population]
    return people[0]


def _epoch(cap: int, epoch: int):
    """Evolves each (shard, island) from the elites that its rows hold (bin < 0: none yet)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["shard", "island"]):
            for s, e in zip(start, np.append(start[1:], t.num_rows)):
                g = t.slice(s, e - s)
                shard, island = g.column("shard")[0].as_py(), g.column("island")[0].as_py()
                row, size, source, at = (g.column(c).to_numpy() for c in ("row", "length", "source", "bin"))
                rows, first = np.unique(row, return_index=True)
                sizes = size[first].tolist()
                elites: list[Packing] = []
                for src in np.unique(source[at >= 0]):
                    w = np.flatnonzero(source == src)
                    item, where = np.searchsorted(rows, row[w]), at[w]
                    o = np.lexsort((item, where))
                    item, where = item[o], where[o]
                    parts = np.split(item, np.flatnonzero(np.diff(where)) + 1)
                    elites.append([(sum(sizes[i] for i in p), p) for p in (x.tolist() for x in parts)])
                rng = np.random.default_rng([SEED, int(shard) & 0xFFFFFFFF, int(island), epoch])
                best = evolve(sizes, cap, elites, rng)
                n, energy = len(best), -worth(best)[1]
                item = np.concatenate([np.sort(np.array(i)) for _, i in best])
                where = np.repeat(np.arange(n), [len(i) for _, i in best])
                length = np.array(sizes)[item]
                begin = np.cumsum(length) - length
                load = np.repeat([x for x, _ in best], [len(i) for _, i in best])
                offset = begin - np.repeat(begin[np.flatnonzero(np.diff(where, prepend=-1))], [len(i) for _, i in best])
                m = len(item)
                full = lambda v, k: pa.array(np.full(m, v), k)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [full(shard, pa.int64()), full(island, pa.int32()), pa.array(rows[item]), pa.array(length, pa.int64()), full(island, pa.int32()), pa.array(where, pa.int32()), pa.array(offset, pa.int64()), pa.array(load, pa.int64()), full(n, pa.int64()), full(energy, pa.int64()), full(least_bins(sizes, cap), pa.int64())],
                    ["shard", "island", "row", "length", "source", "bin", "offset", "load", "bins", "energy", "least"],
                )

    return work


_FOUND = "shard long, island int, row long, length long, source int, bin int, offset long, load long, bins long, energy long, least long"


def _judge(last: bool):
    """Of each shard (a group of its islands' packings) the best packing where it ends; else every island's
    packing for that island and for its neighbour in the ring. A row for each piece of a packing: nothing is joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["shard"]):
            n = np.diff(np.append(start, t.num_rows))
            island, bins, energy, least = (t.column(c).to_numpy() for c in ("island", "bins", "energy", "least"))
            of = np.repeat(np.arange(len(start)), n)
            first = np.lexsort((island, -energy, bins, of))[start]  # a row of the best island of each shard
            ends = np.full(len(start), last) | (bins[first] <= np.minimum.reduceat(least, start))
            done = np.flatnonzero(ends[of] & (island == island[first][of]))
            going = np.flatnonzero(~ends[of])
            rows = np.concatenate((done, going, going))
            to = np.concatenate((island[done], island[going], (island[going] + 1) % ISLANDS))
            out = t.take(pa.array(rows)).combine_chunks()
            out = out.set_column(1, "island", pa.array(to, pa.int32())).append_column("ends", pa.array(ends[of[rows]]))
            yield from out.to_batches()

    return work


def pack_level(rows: DataFrame, n: int, level: int, length: int = LENGTH) -> DataFrame:
    """One level: n rows (row, length) packed shard by shard; returns shard, row, length, bin, offset, load."""
    shards = max(1, -(-n // SHARD))
    shard = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).alias("shard")
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    now = rows.select(shard, islands, "row", "length").withColumn("source", F.lit(-1)).withColumn("bin", F.lit(-1))
    out = None
    for epoch in range(EPOCHS):
        now = grouped(now.select("shard", "island", "row", "length", "source", "bin"), ["shard", "island"])
        now = cut(now.mapInArrow(_epoch(length, epoch), _FOUND), "elites")
        judged = grouped(now, ["shard"]).mapInArrow(_judge(epoch == EPOCHS - 1), _FOUND + ", ends boolean")
        judged = cut(judged, "judged")
        discard(now)
        done, now = judged.filter("ends"), judged.filter("not ends")
        out = out.union(done) if out else done
        if not now.take(1):
            return out
    return out


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, sequence_id and offset for pieces (row, length)."""
    done = pieces.filter(F.col("length") >= length).select("row", (F.lit(1 << 60) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, before, level = pieces.filter(F.col("length") < length).select("row", "length"), None, 0
    while n := todo.count():
        got = pack_level(todo, n, level, length)
        last = n <= SHARD or (before is not None and 2 * n > before)
        keep = got if last else got.filter(F.col("load") >= FULL * length)
        name = F.lit(level << 56) + F.shiftleft(F.col("shard"), 16) + F.col("bin")
        done = done.unionByName(keep.select("row", name.alias("sequence_id"), "offset"))
        if last:
            break
        todo, before, level = got.filter(F.col("load") < FULL * length).select("row", "length"), n, level + 1
    return done


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    prepare(docs.sparkSession)
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(length, vocabulary), schema), "pieces")
    return pieces.join(pack(pieces, length), "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(prepare(spark), sf_dir, "documents"))
