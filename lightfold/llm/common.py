"""Session settings, shared scratch tables and distributed connected components."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_package


def prepare(spark: SparkSession) -> SparkSession:
    """Bounded Arrow batches, UTC, and this repository on the Python workers' path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return workers_find_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    It is set here only where it is unset and everything runs in one process, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lightfold-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that lineage ends here.

    The written table takes the place of the job's shuffle files, which Spark therefore deletes at
    the job's end instead of when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes all tables that cut() writes inside, but for the last, when it ends.

    For work whose last cut() is its result; what that was computed from is not needed any more.
    """
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for t in made[:-1]:
            discard(t)


def discard(df: DataFrame) -> None:
    """Deletes a table that cut() wrote and that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def task_tmp() -> str:
    """A folder of this task alone; the caller deletes it before the task ends."""
    return tempfile.mkdtemp(prefix="lightfold-")


def drop_tmp(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for each node of edges (a, b: long); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes.
    Each round is a written table, nothing is collected but one checksum a round. Minima are
    partial aggregates; the join that hands a hub's minimum to its neighbours streams their rows
    (two longs each) and adaptive execution splits such a partition where it is large.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
            m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            return both.filter("v > u").join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        up = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        m = up.groupBy("u").agg(F.min("v").alias("m"))
        return up.join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(m.select("u", "m"))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").distinct()

    def mark(e: DataFrame):
        h = F.xxhash64(F.greatest("a", "b"), F.least("a", "b"))
        return tuple(e.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.bit_xor(h)).first())

    now = cut(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), label)
    seen = mark(now)
    while seen[0]:
        nxt = cut(tidy(star(tidy(star(now, True)), False)), label)
        got = mark(nxt)
        discard(now)
        now = nxt
        if got == seen:
            break
        seen = got
    found = now.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    return found.union(found.select("component", "component").distinct())
