"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within RADIUS = 4 bits are cut into 3 segments (21, 21 and 22 bits): 4 differing
bits over 3 segments leave one segment with at most one. Every distinct fingerprint is indexed
under 64 variants, one for each bit left out of its segment, so two fingerprints within the
radius share at least one (segment, bit left out, remaining bits). An equality join on these
cells proposes, an exact bit count verifies, and connected components give the classes.

Equal fingerprints are collapsed first, so a group of copies, however large, is one node. What
meets in a task is at most CELL fingerprints of a cell, and it returns a spanning forest of its
links, not its pairs. A hot cell, one of more members, is dealt into blocks first. Fingerprints
lie in many cells and are dealt otherwise in each, so this holds most of a dense group together.
Then only members outside the cell's largest class can add a link: they are compared with all
its members, block by block, if they are at most FEW. If they are more, the cell is a crowd
rather than a group; its members agree in the bits that it fixes, so the same cut is made
again over the bits it leaves free, whose cells are far smaller. No pair is lost either way, and
rows grow with a cell's members, not with their square.

Null text counts as empty; texts without words have fingerprint zero and link like any others.
Null doc_ids take part and never become a component's id unless all are null. Repeated rows
each get their row. An empty table gives an empty result. Only doc_id and text are read; columns
of other names, whatever they are, are ignored by near_duplicates and kept by keep_first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import forest, grouped, runs
from .common import components, cut, discard, prepare, table

RADIUS = 4
WORDS = 4
SEED = 42
CELL = 4096
FEW = 8 * CELL


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the text's word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[words - 1 :].tolist()
    for i in range(0, n, 8192):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a[i : i + 8192], b[i : i + 8192])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep of docs and fp, the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    given = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = given.drop("_text").schema.add("fp", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = signed([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps], [*keep, "fp"])

    return given.mapInArrow(work, schema)


def wildcards(fixed: int, parts: int) -> list[int]:
    """The bits that each variant fixes, given those fixed already: one segment of the others less one bit."""
    free = [i for i in range(64) if not fixed >> i & 1]
    ends = [len(free) * i // parts for i in range(parts + 1)]
    out = []
    for a, z in zip(ends[:-1], ends[1:]):
        segment = sum(1 << i for i in free[a:z])
        out += [fixed | segment ^ (1 << i) for i in free[a:z]]
    return out


def _variants(parts: int):
    """Rows (fixed, fp) under the cells of all variants; a cell is named by a hash of the bits it fixes and their values."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given, prints = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)
            for f in np.unique(given):
                fp = prints[given == f]
                masks = np.array(wildcards(int(f), parts), np.uint64)
                cell = mixed((fp & masks[:, None]) + mixed(masks)[:, None])
                cols = cell.ravel(), np.repeat(masks, len(fp)), np.tile(fp, len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["cell", "fixed", "fp"])

    return work


def _links(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["cell", "p"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            size = np.diff(np.append(start, len(fp)))
            group = np.repeat(np.arange(len(start)), size)
            a, b = [], []
            small = size[group] <= 16
            for lag in range(1, min(16, int(size.max()))):
                ok = np.flatnonzero(small[lag:] & (group[lag:] == group[:-lag]))
                ok = ok[np.bitwise_count(fp[ok] ^ fp[ok + lag]) <= radius]
                a.append(fp[ok])
                b.append(fp[ok + lag])
            for g in np.flatnonzero(size > 16):
                x = fp[start[g] : start[g] + size[g]]
                for seed, others in forest(len(x), lambda i, j: np.bitwise_count(x[i][:, None] ^ x[j][None]) <= radius):  # noqa: B023
                    a.append(np.full(len(others), x[seed]))
                    b.append(x[others])
            if a and sum(map(len, a)):
                e = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(e[0].view(np.int64)), pa.array(e[1].view(np.int64))], ["a", "b"])

    return work


def _outside(radius: int):
    """Links between classes, from groups of members outside (1) or inside a cell's largest class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["cell", "p", "q"]):
            fp, name, minor = t.column("fp").to_numpy().view(np.uint64), t.column("class").to_numpy(), t.column("minor").to_numpy()
            for s, e in zip(start, np.append(start[1:], len(fp))):
                few, all_ = s + np.flatnonzero(minor[s:e] == 1), s + np.flatnonzero(minor[s:e] == 0)
                for i in range(0, len(few), 256):
                    x = few[i : i + 256]
                    a, b = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[all_][None]) <= radius)
                    e_ = np.unique(np.stack([name[x[a]], name[all_[b]]]), axis=1)
                    e_ = e_[:, e_[0] != e_[1]]
                    if e_.size:
                        yield pa.RecordBatch.from_arrays([pa.array(e_[0]), pa.array(e_[1])], ["a", "b"])

    return work


def link_edges(prints: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that hold together all distinct fingerprints (fp) linked within the radius, and tables to discard."""
    parts = radius // 2 + 1  # the fewest segments of which one differs by at most one bit
    rows, edges, scratch = prints.select(F.lit(0).cast("long").alias("fixed"), "fp"), None, []

    def written(df: DataFrame, label: str) -> DataFrame:
        scratch.append(cut(df, label))
        return scratch[-1]

    def deal(of: str, n) -> F.Column:
        return F.pmod(F.xxhash64(of, "cell"), F.ceil(n / F.lit(CELL)).cast("long"))

    while True:
        # few bytes become many rows, so they are spread before
        spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
        cells = spread.mapInArrow(_variants(parts), "cell long, fixed long, fp long")
        hot = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL), "cells")
        # how many cells have two members by chance grows with the square of the fingerprints, so cells of one aren't left out
        some = cells.join(hot, "cell", "left").select("cell", F.coalesce(deal("fp", F.col("n")), F.lit(0)).alias("p"), "fp")
        found = written(grouped(some, ["cell", "p"]).mapInArrow(_links(radius), "a long, b long"), "links")
        edges = edges.union(found) if edges else found
        if not hot.take(1):
            return edges, scratch
        named = written(components(edges, "simhash").withColumnsRenamed({"node": "fp", "component": "class"}), "named")
        members = written(cells.join(hot, "cell").join(named, "fp", "left").select("cell", "n", "fixed", "fp", F.coalesce("class", "fp").alias("class")), "hot")
        held = members.groupBy("cell", "n", "class").agg(F.count(F.lit(1)).alias("c"))
        most = held.groupBy("cell", "n").agg(F.max("c").alias("c"), F.max_by("class", "c").alias("largest"))
        open_ = written(most.select("cell", "largest", (F.col("n") - F.col("c")).alias("rest")).filter("rest > 0"), "open")
        near = members.join(open_.filter(F.col("rest") <= FEW), "cell")
        inside = near.withColumn("q", deal("fp", F.col("n")))
        minor = inside.filter("class <> largest").withColumn("p", deal("fp", F.col("rest")))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / F.lit(CELL)).cast("long") - 1))
        sides = inside.select("cell", every(F.col("rest")).alias("p"), "q", "fp", "class", F.lit(0).alias("minor"))
        sides = sides.union(minor.select("cell", "p", every(F.col("n")).alias("q"), "fp", "class", F.lit(1).alias("minor")))
        edges = edges.union(written(grouped(sides, ["cell", "p", "q"]).mapInArrow(_outside(radius), "a long, b long"), "outside"))
        crowd = open_.filter(F.col("rest") > FEW)
        if not crowd.take(1):
            return edges, scratch
        rows = written(members.join(crowd, "cell", "left_semi").select("fixed", "fp"), "crowd")


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) with the class of each distinct fp of rows, named by its smallest fp."""
    prints = cut(rows.select("fp").distinct(), "prints")
    edges, scratch = link_edges(prints, radius)
    comp = cut(components(edges, "simhash"), "classes")
    for t in scratch:
        discard(t)
    return prints.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    rows = cut(with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"]), "fp")
    per = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = cut(per.join(classes(rows), "fp"), "classes")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "component").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: that with the smallest doc_id (nulls last, then two text hashes)."""
    names = docs.columns
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")).alias("key")
    rows = cut(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, "text"), ["doc_id", "key"]), "fp")
    per = rows.groupBy("fp").agg(F.min("key").alias("first"))
    kept = per.join(classes(rows), "fp").groupBy("component").agg(F.min("first").alias("first"))
    kept = cut(kept.select("first.*"), "kept")
    # the columns of docs ride in one struct, so that none of their names can clash
    all_ = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), key).select("row", "key.*")
    match = [all_.h == kept.h, all_.g == kept.g, all_.id.eqNullSafe(kept.id)]
    out = all_.join(kept, match, "left_semi")
    once = Window.partitionBy("h", "g", "id").orderBy("h")
    return out.withColumn("n", F.row_number().over(once)).filter("n = 1").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(prepare(spark), sf_dir, "documents"))
