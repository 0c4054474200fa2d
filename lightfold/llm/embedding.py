"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected by seeded random orthonormal maps, TABLES of them, onto BLOCKS times
8 dimensions; each 8-dimensional part is decoded to its nearest point of the E8 lattice, and the
points of a table name a cell. Besides its own cell a vector is listed in the PROBES
neighbouring cells (by minimal lattice vectors) that it is nearest to. Cells propose, the cosine
in double precision verifies, and links are counted in full within each connected component:
linked vectors share a component by definition, so the count needs no pair list and also
finds links that no cell proposed.

At cosine 0.95, the hardest case, one table brings a pair together with probability about 0.8
and all of them miss about 1 in 10,000 isolated pairs (tests measure recall against brute force).

Vectors that are null, zero, or hold null or non-finite components link with nothing and stay
their own component. Equal vectors are collapsed before anything is shuffled. Vectors of
different lengths never link. Repeated rows count as other vectors. Empty table, empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, PACK, counted, forest, grouped, meet, packs, runs
from .common import components, cut, discard, prepare, scratch, table

COSINE = 0.95
TABLES = 6
PROBES = 6
BLOCKS = 2
SCALE = 0.22  # side of a lattice cell for 64 dimensions; it shrinks with their square root
SEED = 20240
STRIP = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    e = x - f
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    k = np.abs(e[odd]).argmax(1)
    f[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return f


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer of D8 and D8 shifted by one half (Conway & Sloane 1982)."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def maps(dim: int) -> list[np.ndarray]:
    wide = max(dim, 8 * BLOCKS)
    return [np.linalg.qr(np.random.default_rng([SEED, t]).normal(size=(wide, 8 * BLOCKS)))[0][:dim] for t in range(TABLES)]


def cells(unit: np.ndarray) -> np.ndarray:
    """For each unit vector its cells, own and neighbouring, over all tables, as 64-bit hashes."""
    n, dim = unit.shape
    mv = minimal_vectors()
    odd = np.random.default_rng([SEED, 99]).integers(1, 2**62, size=8 * BLOCKS).astype(np.uint64) | np.uint64(1)
    scale = SCALE * np.sqrt(64 / dim)
    out = []
    for t, q in enumerate(maps(dim)):
        y = unit @ q / scale
        points, steps, gains = [], [], []
        for b in range(BLOCKS):
            z = y[:, 8 * b : 8 * b + 8]
            p = decode_e8(z)
            g = (z - p) @ mv.T  # the larger, the nearer the neighbouring point
            top = np.argpartition(-g, PROBES, axis=1)[:, :PROBES]
            points.append(np.rint(2 * p).astype(np.int64))
            steps.append(top)
            gains.append(np.take_along_axis(g, top, 1))
        base = np.concatenate(points, 1)
        best = np.argsort(-np.concatenate(gains, 1), axis=1, kind="stable")[:, :PROBES]
        salt = np.uint64((t * 1009 + dim) * 0x9E3779B97F4A7C15 % 2**64)
        mixed = (base.astype(np.uint64) * odd).sum(1) + salt
        out.append(mixed)
        for j in range(PROBES):
            b, at = best[:, j] // PROBES, best[:, j] % PROBES
            key = mixed.copy()
            for k in range(BLOCKS):
                r = np.flatnonzero(b == k)
                move = np.rint(2 * mv[steps[k][r, at[r]]]).astype(np.int64)
                key[r] += (move.astype(np.uint64) * odd[8 * k : 8 * k + 8]).sum(1)
            out.append(key)
    keys = np.stack(out, 1)
    keys ^= keys >> np.uint64(29)
    return keys * np.uint64(0xBF58476D1CE4E5B9)


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(a), -1))


def unit_rows(v: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, dims = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            keys = cells(_unit(b.column(1).take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(node[at], keys.shape[1]))], ["cell", "node"])


def _links(least: float):
    """Edges that hold together the linked members of each small cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["cell"]):
            node, v = t.column("node").to_numpy(), t.column("vector").combine_chunks()
            a, b = [], []
            for s, e in zip(start, np.append(start[1:], len(node))):
                part = v.slice(s, e - s)
                if len(np.unique(part.value_lengths().to_numpy())) > 1:
                    continue  # a hash collision: lengths are part of a cell
                u = _unit(part)
                for seed, others in forest(len(u), lambda i, j: u[i] @ u[j].T >= least):  # noqa: B023
                    a.append(np.full(len(others), node[s + seed]))
                    b.append(node[s + others])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return work


def _unpacked(b: pa.RecordBatch, i: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(nodes, unit vectors) of a pack; none where a hash collision has mixed lengths."""
    nodes = b.column(prefix + "nodes")[i].values.to_numpy()
    flat = b.column(prefix + "vectors")[i].values.to_numpy(zero_copy_only=False)
    return (nodes, unit_rows(flat.reshape(len(nodes), -1))) if len(flat) % len(nodes) == 0 else (nodes[:0], np.zeros((0, 1)))


def _inside(least: float):
    """The forest of each pack alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                nodes, u = _unpacked(b, i)
                found = forest(len(u), lambda x, y: u[x] @ u[y].T >= least)  # noqa: B023
                if found:
                    a = np.concatenate([np.full(len(o), nodes[s]) for s, o in found])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate([nodes[o] for _, o in found]))], ["a", "b"])

    return work


def _between(least: float):
    """For each pair of packs an edge for every two sets, connected within their packs, that links join anew."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (m, u), (n, w) = _unpacked(batch, i), _unpacked(batch, i, "o_")
                if not len(m) or not len(n) or u.shape[1] != w.shape[1]:
                    continue
                of = np.arange(len(m) + len(n))  # what of p and q hangs together already
                for x, base in ((u, 0), (w, len(m))):
                    for seed, others in forest(len(x), lambda p, q: x[p] @ x[q].T >= least):  # noqa: B023
                        of[base + others] = base + seed
                edges = []
                for s in range(0, len(m), STRIP):
                    if len(np.unique(of)) == 1:
                        break
                    p, q = np.nonzero(u[s : s + STRIP] @ w.T >= least)
                    pair = np.stack([of[p + s], of[q + len(m)]])
                    for at in np.unique(pair, axis=1, return_index=True)[1]:
                        a, b = of[p[at] + s], of[q[at] + len(m)]
                        if a != b:
                            of[of == b] = a
                            edges.append((m[p[at] + s], n[q[at]]))
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([int(e[0]) for e in edges]), pa.array([int(e[1]) for e in edges])], ["a", "b"])

    return work


def _count(least: float):
    """Links of each member of a small component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["component"]):
            node, copies, v = t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("vector").combine_chunks()
            links = np.zeros(len(node), np.int64)
            for s, e in zip(start, np.append(start[1:], len(node))):
                u = _unit(v.slice(s, e - s))
                near = u @ u.T >= least
                np.fill_diagonal(near, False)
                links[s:e] = near @ copies[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])

    return work


def _count_packs(least: float):
    """Links of each member of pack p to those of pack q, itself left out: one row of counts a pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (m, u), (n, w) = _unpacked(b, i), _unpacked(b, i, "o_")
                copies = b.column("o_copies")[i].values.to_numpy()
                links = np.zeros(len(m), np.int64)
                for s in range(0, len(m), STRIP):
                    near = u[s : s + STRIP] @ w.T >= least
                    if b.column("b")[i].as_py() == b.column("q")[i].as_py():
                        np.fill_diagonal(near[:, s:], False)
                    links[s : s + STRIP] = near @ copies
                yield pa.RecordBatch.from_arrays([b.column("component").slice(i, 1), b.column("b").slice(i, 1), pa.array([m], pa.list_(pa.int64())), pa.array([links], pa.list_(pa.int64()))], ["component", "b", "nodes", "links"])

    return work


def _sum_packs(t: pa.Table) -> pa.Table:
    nodes = t.column("nodes")[0].values
    return pa.table({"node": nodes, "links": pa.array(np.sum([x.values.to_numpy() for x in t.column("links")], axis=0))})


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of a few rows, for rows of packs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def links_in_cells(keys: DataFrame, nodes: DataFrame, least: float, block: int = BLOCK, size: int = PACK) -> DataFrame:
    """Edges (a, b) that hold together whatever links share a cell, for keys (cell, node) and nodes (node, vector)."""
    spark = keys.sparkSession
    members = counted(keys, "cell").join(nodes, "node")
    small = cut(grouped(members.filter(F.col("n") <= block).select("cell", "node", "vector"), ["cell"]).mapInArrow(_links(least), "a long, b long"), "links")
    packed = cut(packs(members.filter(F.col("n") > block), "cell", size), "packs")
    with few_rows(spark):
        inside = cut(packed.mapInArrow(_inside(least), "a long, b long"), "inside")
        between = cut(meet(packed, "cell").mapInArrow(_between(least), "a long, b long"), "between")
    discard(packed)
    return small.union(inside).union(between)


def count_links(members: DataFrame, least: float, block: int = BLOCK, size: int = PACK) -> DataFrame:
    """(node, links) for members (component, node, vector, copies): all links of every node, counted within its component."""
    spark = members.sparkSession
    sized = counted(members, "component")
    small = grouped(sized.filter(F.col("n") <= block).drop("n"), ["component"]).mapInArrow(_count(least), "node long, links long")
    packed = cut(packs(sized.filter(F.col("n") > block), "component", size), "packs")
    with few_rows(spark):
        told = cut(meet(packed, "component", also=True).mapInArrow(_count_packs(least), "component long, b int, nodes array<long>, links array<long>"), "counts")
    discard(packed)
    return small.union(told.groupBy("component", "b").applyInArrow(_sum_packs, "node long, links long"))


def near_duplicates(vectors: DataFrame, least: float = COSINE, block: int = BLOCK, size: int = PACK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding); further columns are ignored, whatever their names."""
    prepare(vectors.sparkSession)
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    # rows that can link, keyed by their class of equal vectors
    usable = F.coalesce(whole, F.lit(False))
    with scratch():
        nodes = given.filter(usable).groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "least", "copies"), "vectors")
        keys = nodes.select("node", "vector").mapInArrow(_cells, "cell long, node long")
        edges = links_in_cells(cut(keys.distinct(), "cells"), nodes.select("node", "vector"), least, block, size)
        comp = cut(components(edges, "embedding"), "components")
        members = cut(comp.join(nodes, "node"), "members")
        links = count_links(members.select("component", "node", "vector", "copies"), least, block, size)
        ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
        known = comp.join(ids, "component").join(links, "node", "left").select("node", "component_id", "links")
        per = nodes.join(known, "node", "left").select("vector", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        able = given.filter(usable).join(cut(per, "linked"), "vector").select("vec_id", "n_links", "component_id")
        alone = given.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return cut(able.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near")


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(prepare(spark), sf_dir, "embeddings"))
