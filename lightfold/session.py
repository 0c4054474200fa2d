"""Makes this package importable on Python workers wherever the session was started from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_find_package(spark: SparkSession) -> SparkSession:
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path under spark.checkpoint.dir, or under a temporary folder where all runs in one process."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lightfold-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> int:
    """How many partitions a shuffle has. Given to repartition, it is not lowered where the rows are few but their work is not."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keep(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to a new scratch folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that keep() wrote and that nothing reads any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
