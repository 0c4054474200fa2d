"""The append-only evidence store and the current state folded from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import STATUSES
from ..session import shuffled

KEY = ("tic", "kind", "source")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, int(a), int(b)) for s, a, b in STATUSES], "status string, stage int, precedence int")


def with_rank(df: DataFrame, status: str = "verdict") -> DataFrame:
    """Adds stage and precedence of the status (25 rows at most are sent to every task); unknown ones drop out."""
    return df.join(F.broadcast(registry(df.sparkSession).withColumnRenamed("status", status)), status)


def fold(evidence: DataFrame, key: str = "tic", status: str = "verdict", sequence: str = "evidence_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """The deciding row of each key: highest stage, then precedence, then the latest; carry names further columns of it."""
    row = F.max_by(F.struct(status, sequence, "kind", *carry), F.struct("stage", "precedence", sequence)).alias("_r")
    got = with_rank(evidence.filter(F.col(status).isNotNull()), status).groupBy(key).agg(row)
    return got.select(key, F.col(f"_r.{status}").alias("status"), F.col(f"_r.{sequence}").alias("decided_by"), F.col("_r.kind").alias("kind"), *(F.col(f"_r.{c}").alias(c) for c in carry))


def state(evidence: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fold over the rows that vote."""
    return fold(evidence.filter("affects_state = 1"), carry=carry)


def append(store: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """store and the rows of new whose key it lacks, the first of each key; existing rows stay untouched."""
    # one pass over both: a new row stays if it comes first, behind all of the store; a null equals nothing in the store
    unknown = F.lit(False)
    for k in key:
        unknown = unknown | F.col(k).isNull()
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).repartition(shuffled(store), *key)
    both = both.withColumn("_apart", F.when(unknown, F.col("_new")))
    first = F.row_number().over(Window.partitionBy(*key, "_apart").orderBy("_new", "evidence_id"))
    return both.withColumn("_n", first).filter("_new = 0 OR _n = 1").drop("_new", "_apart", "_n")


def numbered(rows: DataFrame, order: list[str], name: str = "evidence_id") -> DataFrame:
    """Ids that follow an order, from 1, without sorting all rows in one task.

    Rows are range-partitioned by the order; each partition counts on from those before it.
    """
    sized = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    sized = sized.sortWithinPartitions(*order)
    counts = sized.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_p", before.alias("_base"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return sized.withColumn("_n", at).join(base, "_p").withColumn(name, F.col("_base") + F.col("_n")).drop("_p", "_n", "_base")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key; a new value replaces an old one unless it is null."""
    both = old.alias("o").join(new.alias("n"), key, "full")
    return both.select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns if c != key))


def overwrite(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page with the number of rows and pages."""
    total = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("pages", F.ceil(F.col("rows") / size).cast("long"))
    return df.orderBy(*order).offset(number * size).limit(size).crossJoin(F.broadcast(total))


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose fields differ between two projections, with the names of those that do."""
    both = left.withColumn("_l", F.lit(True)).alias("l").join(right.withColumn("_r", F.lit(True)).alias("r"), key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields)))
    side = F.when(F.col("l._l").isNull(), "missing_left").when(F.col("r._r").isNull(), "missing_right").otherwise("both")
    return both.select(key, side.alias("side"), F.concat_ws(",", changed).alias("changed")).filter("changed <> '' or side <> 'both'")


def transitions(left: DataFrame, right: DataFrame, key: str, field: str) -> DataFrame:
    both = left.select(key, F.col(field).alias("before")).join(right.select(key, F.col(field).alias("after")), key)
    return both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def valid_events(events: DataFrame) -> DataFrame:
    """Events that no invalidation names, the invalidations themselves left out."""
    gone = events.filter("kind = 'invalidate'").select(F.col("target").alias("event_id"))
    return events.filter("kind <> 'invalidate'").join(gone, "event_id", "left_anti")


def lease(holder: Column, age: Column, asking: Column, ttl: float) -> Column:
    """What asking for a lease leads to."""
    return F.when(holder.isNull(), "acquired").when(holder == asking, "refreshed").when(age <= ttl, "denied").otherwise("taken_over")


def liveness(age: Column, live: float = 45.0, alarm: float = 120.0) -> Column:
    return F.when(age.isNull(), "absent").when(age < live, "live").when(age <= alarm, "stale").otherwise("alarm")


def supersede(outcomes: DataFrame, key: list[str], order: str, outcome: str) -> DataFrame:
    """The outcomes of each key that differ from the one before, in order: the row each invalidates, its
    revision (how often that outcome came before), and a name with the revision where it came back."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.lag(outcome).over(w)
    changed = outcomes.withColumn("_was", before).filter(F.col("_was").isNull() | (F.col("_was") != F.col(outcome))).drop("_was")
    n = (F.row_number().over(Window.partitionBy(*key, outcome).orderBy(order)) - 1).cast("long")
    out = changed.withColumn("revision", n).withColumn("invalidates", F.lag(order).over(w))
    suffix = F.when(F.col("revision") > 0, F.concat(F.lit("-rev-"), F.col("revision").cast("string"))).otherwise(F.lit(""))
    return out.withColumn("name", F.concat(F.concat_ws(":", *(F.col(k).cast("string") for k in key), outcome), suffix))
