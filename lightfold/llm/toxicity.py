"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-case words and the words' first four and five letters (invented or
inflected forms share them), each hashed to BUCKETS numbers; a text holds a term or not. From a
bounded sample of labelled rows (TRAIN_ROWS a class, in the order of a hash of doc_id, never of
the fold where crc32(doc_id) mod 5 is 0) the TERMS hashes that tell the classes apart best by
a G-test are kept, and a factorization machine (Rendle 2010)

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

is fitted to them by AdaGrad; the pair term is what an additive model lacks, such as an insult
that counts only next to a mention. Every whole text is scored; the model is a few thousand rows
and goes to the executors as it is. doc_id, lang and source are no inputs.

Null and empty texts hold no term and score sigmoid(w0). Without labels of both classes in the
training folds the score is the smoothed share of toxic rows. Repeated rows get a row each; null
doc_id stays null and is not held out; an empty table gives an empty result. Terms seen fewer
than three times and words of digits only are no terms. Ties of the G-test go to the smaller hash.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

BUCKETS = 1 << 20
TRAIN_ROWS = 4000
TERMS = 4096
FACTORS = 4
EPOCHS = 30
RATE = 0.1
SEED = 3
_WORD = re.compile(r"[^\W\d_]+")
CACHE = 300_000


class Terms:
    """Hashes of a word's terms, remembered."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        names = {f"w {w}"} | {f"p{n} {w[:n]}" for n in (4, 5) if len(w) >= n}
        got = tuple(sorted({zlib.crc32(x.encode()) % BUCKETS for x in names}))
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[w] = got
        return got

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        known = self.known
        for w in set(_WORD.findall((text or "").lower())):
            out.update(known.get(w) or self.word(w))
        return out


def choose(rows: list[np.ndarray], y: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """The hashes with the largest G statistic between the classes, seen in 3 texts or more."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    each = np.repeat(y, [len(r) for r in rows])
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    a = np.bincount(flat, weights=each, minlength=BUCKETS)
    b = np.bincount(flat, minlength=BUCKETS) - a
    seen = np.flatnonzero(a + b >= 3)
    a, b = a[seen], b[seen]

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / e), 0.0)

    p = (a + b) / (n1 + n0)
    g = part(a, p * n1) + part(n1 - a, np.maximum((1 - p) * n1, 1e-9)) + part(b, p * n0) + part(n0 - b, np.maximum((1 - p) * n0, 1e-9))
    best = np.lexsort((seen, -g))[:terms]
    best = best[g[best] > 5.0]
    return np.sort(seen[best])


class Machine:
    """w0, w and V over the chosen hashes."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.w0, self.w, self.v = terms, w0, w, v
        self.place = {int(t): i for i, t in enumerate(terms)}

    def rows(self, held: set[int]) -> list[int]:
        return [self.place[t] for t in held if t in self.place]

    def score(self, held: set[int]) -> float:
        at = sorted(self.rows(held))
        s = self.w0
        if at:
            v = self.v[at]
            s += self.w[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, each: tuple[float, float] = (1.0, 1.0)) -> Machine:
    """each: how many labelled documents a sampled one of class 0 or 1 stands for."""
    rng = np.random.default_rng(SEED)
    n1, n0 = float(y.sum()) * each[1], float(len(y) - y.sum()) * each[0]
    share = (n1 + 0.5) / (n1 + n0 + 5.0)
    none = np.zeros(0, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Machine(none, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    terms = choose(rows, y)
    at = [np.flatnonzero(np.isin(terms, r, assume_unique=True)) for r in rows]
    n = len(terms)
    w, v, w0 = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)), float(np.log(share / (1 - share)))
    stands = np.where(y > 0, each[1], each[0]) * len(y) / (n1 + n0)  # 1 on average
    weight = np.where(y > 0, min(3.0, max(1.0, n0 / n1)), 1.0) * stands
    gw, gv, g0 = np.full(n, 1e-3), np.full((n, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            some = order[lo : lo + 64]
            size = np.array([len(at[i]) for i in some])
            col = np.concatenate([at[i] for i in some])
            row = np.repeat(np.arange(len(some)), size)
            sums = np.zeros((len(some), FACTORS))
            squares, linear = np.zeros(len(some)), np.zeros(len(some))
            if len(col):
                np.add.at(sums, row, v[col])
                np.add.at(squares, row, (v[col] ** 2).sum(1))
                np.add.at(linear, row, w[col])
            s = w0 + linear + 0.5 * ((sums**2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[some]) * weight[some] / len(some)
            g0 += err.sum() ** 2
            w0 -= RATE * err.sum() / np.sqrt(g0)
            if not len(col):
                continue
            used, inv = np.unique(col, return_inverse=True)
            dw = np.bincount(inv, weights=err[row]) + 1e-5 * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, inv, err[row, None] * (sums[row] - v[col]))
            dv += 1e-4 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
    return Machine(terms, w0, w, v)


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.filter(fold("doc_id") != 0)


def stand_for(labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[float, float]:
    """How many labelled documents of class 0 and 1 one that training_rows takes stands for."""
    n = {r["toxic"]: r["n"] for r in training_labels(labels).filter("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return max(1.0, n.get(0, 0) / rows), max(1.0, n.get(1, 0) / rows)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of at most `rows` labelled documents a class, none of the held-out fold."""
    known = training_labels(labels)
    some = [known.filter(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    picked = F.broadcast(some[0].union(some[1]))  # 2 * rows ids at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            held = [np.array(sorted(terms(t)), np.int32).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.binary())], ["doc_id", "toxic", "terms"])

    # one row a doc_id, so that repeated documents can't outgrow the bound
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    got = text.mapInArrow(work, "doc_id long, toxic int, terms binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    return [np.frombuffer(r["terms"], np.int32).astype(np.int64) for r in got], np.array([r["toxic"] for r in got], float)


def fold(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, score = Terms(), machine.score
        for b in batches:
            out = [score(terms(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return given.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_documents(docs, fit(*training_rows(docs, labels), stand_for(labels)))
