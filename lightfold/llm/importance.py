"""Resampling documents towards a target distribution, by hashed word features.

A document's features (runs of 1 to `longest` consecutive words) are hashed into `buckets`
buckets. A bucket's gain is the scaled log ratio of its smoothed share in the target texts and in
the documents; a document's weight is the sum of its features' gains, and Gumbel noise from a hash
of its id turns the highest scores into a draw without replacement in proportion to exp(weight).

Scoring never makes a row of a feature: higher-order functions turn a text into its array of
buckets, and an aggregate over that array looks each one up in a literal array of gains. Only
counts of buckets are shuffled, at most `buckets` rows from a task, and collected, at most
`buckets` rows. Ranks come from a sort by ranges with the sizes of the ranges added up, so no task
sees more than its range, whatever ties there are.

Nulls, in docs and in the target, count as empty texts without features: weight 0, never drawn
where a least count of words is asked for. Empty tables have no features; the smoothing keeps all
gains finite. A null doc_id hashes as the word null and ranks after other ids. Ties go to the
smaller doc_id, then to more features. Rows of one doc_id are rows of their own with one
noise. Further columns are ignored, whatever their names, and kept by resample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, prepare, scratch, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def buckets_of(found: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The bucket of each run of 1 to `longest` words of an array of words, repeats included."""

    def bucket(feature: Column) -> Column:
        return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")

    def runs(given: Column, n: int) -> Column:
        starts = F.when(F.size(given) >= n, F.sequence(F.lit(1), F.size(given) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.concat_ws(" ", F.slice(given, i, n))))

    if longest == 1:
        return F.transform(found, bucket)
    # bound once as the variable of an outer transform, so that no run computes the words anew
    return F.flatten(F.transform(F.array(found), lambda given: F.concat(F.transform(given, bucket), *(runs(given, n) for n in range(2, longest + 1)))))


def bucketed(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, buckets) a row, written so that texts are read once."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("found"))
    return cut(found.select("doc_id", F.size("found").alias("n_words"), buckets_of(F.col("found"), buckets, longest).alias("buckets")), "buckets")


def counts(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features each bucket holds, over all rows."""
    out = [0] * buckets
    for b, n in rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `buckets` rows
        out[b] = n
    return out


def gains(have: list[int], want: list[int]) -> list[int]:
    s_all, t_all, k = float(sum(have)), float(sum(want)), float(len(have))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(have, want)]


def weight(found: Column, gain: list[int]) -> Column:
    """The sum of gains over an array of buckets."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folded into one literal
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (written) with place: 0, 1, 2 ... in the given order, each task numbering one range of it."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the range's number, then the place in it
    held = cut(sorted_.withColumn("at", at).withColumn("range", F.shiftright("at", 33)), "ranges")
    sizes = held.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("range", F.coalesce(before, F.lit(0)).alias("base"))
    return held.join(F.broadcast(base), "range").withColumn("place", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("range", "at", "base")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) for each row of docs (doc_id, text); target has text."""
    spark = prepare(docs.sparkSession)
    with scratch():
        rows = bucketed(docs, buckets, longest)
        want = counts(target.select(buckets_of(words(F.col("text")), buckets, longest).alias("buckets")), buckets)
        scored = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gains(counts(rows, buckets), want)).alias("weight"))
        scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
        able = scored.filter(F.col("n_words") >= least_words)
        drawn = able.count() * percent // 100
        placed = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc()])
        rank = F.when(F.col("place") < drawn, F.col("place") + 1)
        out = placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
        rest = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
        return cut(out.union(rest), "importance")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **settings) -> DataFrame:
    """The drawn rows of docs, with all their columns.

    Rows that share doc_id and text share their score; where the last draw falls on such, all of
    them come along.
    """
    found = importance(docs, target, percent, **settings)
    last = found.filter("rank IS NOT NULL").agg(F.max_by(F.struct("score", "doc_id", "n_features"), "rank").alias("last"))
    drawn = found.filter("rank IS NOT NULL").select("doc_id", "n_features", "score").union(last.filter("last IS NOT NULL").select("last.doc_id", "last.n_features", "last.score")).distinct()
    n, longest = fresh(docs, "n_features"), settings.get("longest", LONGEST)
    rows = docs.withColumn(n, F.size(buckets_of(words(F.col("text")), settings.get("buckets", BUCKETS), longest)).cast("long"))
    match = rows["doc_id"].cast("long").eqNullSafe(drawn["doc_id"]) & (rows[n] == drawn["n_features"])
    return rows.join(drawn, match, "left_semi").drop(n)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
