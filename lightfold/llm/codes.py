"""Product-quantised vector codes whose nearest entries are found by partial-distance search.

Components become integers floor(SCALE * x); a vector is cut into `parts` equal consecutive parts,
each with a codebook of `entries` entries. Codebooks start as the parts of the vectors with the
smallest ids and are refined for a fixed number of rounds: every part goes to its nearest entry
(squared distance, ties to the lower index) and an entry becomes the floor of the mean of its parts.
All sums are of integers, so the result depends neither on partitions nor on their order.

A nearest entry is found dimension by dimension, in falling variance of the codebook: after each
one the entry with the least distance so far is completed and bounds the search, and all entries
whose distance so far strictly exceeds the least complete distance are dropped. What is dropped is
farther than a whole candidate, so the answer is exact, ties included.

Tasks return at most parts * entries sums a round, and as many rows are collected: the codebooks, of
fixed size, are all that the driver holds. Sums over equal labels are partial aggregates; labels of
over 1 / HOT_SHARE of all rows, fewer than HOT_SHARE of them, reach their rows by a broadcast,
others by a join, so no label's rows meet in one task.

Rows whose vector is null, empty, or holds null or non-finite components are left out, as are those
of another length than the vector with the smallest id (nulls last, ties by components). A length
that `parts` doesn't divide is filled up with zeros. Components are clamped to 2 ** 27 in size, so
that sums fit. Rows of one vec_id are rows of their own; null labels are one label. With fewer
vectors than entries the codebooks are that much smaller; an empty table gives an empty result.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, scratch, table

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 1 << 27
HOT_SHARE = 256
ROWS = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (int64) the nearest row of book, ties to the lower one, and its squared distance."""
    n, k = len(x), len(book)
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    far = np.zeros(n * k, np.int64)  # distance so far of each entry still held
    least = np.full(n, np.iinfo(np.int64).max)
    for i, d in enumerate(order):
        far += (x[row, d] - book[entry, d]) ** 2
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        if i + 1 < len(order):  # complete the entry that is ahead in each row
            ahead = np.minimum.reduceat(far, start)
            at = np.flatnonzero(far == np.repeat(ahead, np.diff(np.append(start, len(row)))))
            at = at[np.append(True, row[at][1:] != row[at][:-1])]
            rest = order[i + 1 :]
            whole = far[at] + ((x[row[at]][:, rest] - book[entry[at]][:, rest]) ** 2).sum(1)
            least = np.minimum(least, whole)
            held = far <= least[row]
            row, entry, far = row[held], entry[held], far[held]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(far, start)
    at = np.flatnonzero(far == least[row])  # entries rise within a row
    at = at[np.append(True, row[at][1:] != row[at][:-1])]
    return entry[at], least


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances (rows, parts) of rows of integers; books is (parts, entries, width)."""
    parts, _, width = books.shape
    code, error = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for s in range(0, len(x), ROWS):
        for p in range(parts):
            code[s : s + ROWS, p], error[s : s + ROWS, p] = nearest(x[s : s + ROWS, p * width : (p + 1) * width], books[p])
    return code, error


def decode(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors of integers that codes stand for."""
    return np.concatenate([books[p][code[:, p]] for p in range(books.shape[0])], axis=1)


def _sums(books: np.ndarray):
    """Partial sums of the parts that go to each entry, a row an entry used in this task."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("q"))
                code, _ = encode(x, books)
                for p in range(parts):
                    np.add.at(n[p], code[:, p], 1)
                    np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return work


def _codes(books: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, error = encode(_matrix(b.column("q")), books)
                text = ["".join(f"{c:02x}" for c in r) for r in code.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return work


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q: array of integers) for the usable rows of vectors (vec_id, embedding, label), written."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = given.filter(F.coalesce(fine, F.lit(False)))
    first = given.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    n = first["n"] if first else parts
    whole = -(-n // parts) * parts
    q = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long"))
    if whole > n:
        q = F.concat(q, F.array_repeat(F.lit(0).cast("long"), whole - n))
    return cut(given.filter(F.size("v") == n).select("vec_id", "label", q.alias("q")), "integers")


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of rows (vec_id, q)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()  # `entries` rows
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for _ in range(rounds):
        told = rows.select("q").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        sums = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)))
        for r in sums.collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_sum(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """rows (written) with name: the sum of value over the rows of equal label, nulls together."""
    sums = cut(rows.groupBy(F.col(label).alias("_of")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_n")), "labels")
    n = rows.count()
    hot = F.broadcast(sums.filter(F.col("_n") * HOT_SHARE > n))  # fewer than HOT_SHARE labels can be
    few = sums.filter(F.col("_n") * HOT_SHARE <= n)
    one = rows.join(hot, F.col(label).eqNullSafe(F.col("_of")))
    many = rows.join(hot, F.col(label).eqNullSafe(F.col("_of")), "left_anti").join(few, F.col(label).eqNullSafe(F.col("_of")))
    return one.drop("_of", "_n").union(many.drop("_of", "_n"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each usable row of vectors (vec_id, embedding, label)."""
    prepare(vectors.sparkSession)
    with scratch():
        rows = integers(vectors, parts, scale)
        books = fit(rows, parts, entries, rounds)
        coded = cut(rows.mapInArrow(_codes(books), "vec_id long, label string, code string, error long"), "codes")
        out = with_label_sum(coded, "label", "error", "label_error")
        return cut(out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), "compressed")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(prepare(spark), sf_dir, "embeddings"))
