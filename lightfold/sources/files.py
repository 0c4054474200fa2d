"""Reading target lists, reports, catalogue snapshots and event logs; writing them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import aliased, lenient_double, lenient_id, sectors


def commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, lines that begin with # left out, every value text."""
    return spark.read.option("header", True).option("comment", "#").option("mode", "PERMISSIVE").csv(path)


def targets(spark: SparkSession, path: str) -> DataFrame:
    """A target list: target, tic_id and sectors read and checked, further columns as they are.

    A row that can't be read, or a (tic_id, sectors) that is there twice, fails the job when it runs.
    """
    raw = commented_csv(spark, path)
    missing = {"target", "tic_id", "sectors"} - set(raw.columns)
    if missing:
        raise ValueError(f"the target list lacks {sorted(missing)}")
    ids, where = lenient_id("tic_id"), sectors("sectors")
    bad = F.col("target").isNull() | ids.isNull() | (F.size(where) == 0)
    said = F.concat(F.lit("bad target row: "), F.to_json(F.struct("target", "tic_id", "sectors")))
    out = raw.withColumn("tic_id", F.when(bad, F.raise_error(said).cast("long")).otherwise(ids)).withColumn("sectors", where)
    twice = out.groupBy("tic_id", "sectors").agg(F.count(F.lit(1)).alias("_n"))
    n = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("target is there twice: "), F.col("tic_id").cast("string"))).cast("long")).otherwise(F.col("_n"))
    return out.join(twice.withColumn("_n", n), ["tic_id", "sectors"]).filter("_n >= 1").drop("_n").select(*raw.columns)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a line; what can't be read is left out."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(kind.add("_corrupt", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache().filter("_corrupt is null").drop("_corrupt")


def reports(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of many lines under a folder, with the file each came from and its time."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(kind).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("modified", F.col("_metadata.file_modification_time"))


def campaign_rows(spark: SparkSession, path: str, result: str) -> DataFrame:
    """The results of campaign summaries, one row each, with the campaign's file."""
    docs = reports(spark, path, f"campaign_id string, state string, results array<struct<{result}>>")
    return docs.select("campaign_id", "state", "file", F.posexplode("results").alias("position", "r")).select("campaign_id", "state", "file", "position", "r.*")


def ephemeris_rows(raw: DataFrame, source: str, object_class: str, period: list[str], epoch: list[str], name: list[str]) -> DataFrame:
    """Snapshot rows of any catalogue in one form, by the first column that each list finds."""
    df = aliased(aliased(aliased(raw, period, "_p"), epoch, "_e"), name, "_n")
    return df.select(F.lit(source).alias("source"), F.lit(object_class).alias("object_class"), F.col("_n").alias("identifier"), lenient_double("_p").alias("period_days"), lenient_double("_e").alias("epoch_bjd"))


def content_hash(rows: DataFrame) -> DataFrame:
    """A hash of a table that row order and partitions don't change: the sum of row hashes with their count.

    Rows are hashed where they lie; only sums of halves of SHA-256 are combined.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count(F.lit(1)).cast("string").alias("n"), part(1).alias("a"), part(16).alias("b"), part(31).alias("c"), part(46).alias("d")).select(F.sha2(F.concat_ws("|", "n", "a", "b", "c", "d"), 256).alias("content_hash"), F.col("n").cast("long").alias("row_count"))


def write_snapshot(rows: DataFrame, root: str, source: str, version: str) -> DataFrame:
    """Writes a generation as Parquet with its manifest; returns the manifest's row."""
    path = f"{root}/{source}/{version}"
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    m = content_hash(rows.sparkSession.read.parquet(f"{path}/rows")).withColumn("source", F.lit(source)).withColumn("version", F.lit(version)).withColumn("path", F.lit(f"{path}/rows"))
    m.coalesce(1).write.json(f"{path}/manifest")
    return rows.sparkSession.read.schema("content_hash string, row_count long, source string, version string, path string").json(f"{path}/manifest")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("content_hash string, row_count long, source string, version string, path string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)


def newest(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Rows of the newest generation, after their content hash is found right."""
    m = manifests(spark, root).filter(F.col("source") == source).orderBy(F.desc("version")).first()
    if m is None:
        raise FileNotFoundError(f"no snapshot of {source}")
    rows = spark.read.parquet(m["path"])
    if content_hash(rows).first()["content_hash"] != m["content_hash"]:
        raise ValueError(f"the rows of {source} {m['version']} don't match their manifest")
    return rows


def prune(found: DataFrame, keep: int) -> DataFrame:
    """Manifests with drop: whether a generation is older than the newest `keep` of its source."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("version"))
    return found.withColumn("drop", F.row_number().over(w) > keep)


def coverage(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Every declared source with its newest generation, if any."""
    best = found.groupBy("source").agg(F.max_by(F.struct("version", "row_count"), "version").alias("b")).select("source", "b.*")
    return declared.join(best, "source", "left").withColumn("covered", F.col("version").isNotNull())


def append_events(events: DataFrame, path: str) -> int:
    """Appends the events whose id the log lacks; returns how many.

    Made for one writer at a time, as the log itself is.
    """
    spark = events.sparkSession
    try:
        old = spark.read.schema("event_id string").json(path).select("event_id")
        events = events.join(old, "event_id", "left_anti")
    except Exception as e:  # the log's first event
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = events.dropDuplicates(["event_id"]).withColumn("batch", F.lit(uuid.uuid4().hex)).cache()
    n = fresh.count()
    if n:
        fresh.drop("batch").write.mode("append").json(path)
    fresh.unpersist()
    return n


def write_flat_csv(df: DataFrame, path: str) -> None:
    """CSV with lists, maps and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("newest"))
