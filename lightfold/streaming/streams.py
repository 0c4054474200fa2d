"""Incremental forms: registry counts, rolling rates, sessions, replay-safe appends, leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet event files in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Counts by event type and clock-anchored window; the same as a batch count of floor(t / window)."""
    w = F.window("at", f"{minutes} minutes")
    return events.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "event_type", "n", "top")


def rolling_rate(events: DataFrame, minutes: int = 15, every: int = 5, late: str = "1 hour") -> DataFrame:
    w = F.window("at", f"{minutes} minutes", f"{every} minutes")
    return events.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", (F.col("n") * 60.0 / minutes).alias("per_hour"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Activity of each user cut where it pauses for the gap or longer (a batch segment cuts beyond it)."""
    s = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, however often its file is replayed within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def leases(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """Outcome of each request (name, holder, ms) in order: acquired, refreshed, denied, taken_over.

    State is one (holder, last heartbeat) a name.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, beat = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ms")
        out = []
        for h, ms in zip(rows["holder"], rows["ms"]):
            if holder is None:
                said = "acquired"
            elif holder == h:
                said = "refreshed"
            elif ms - beat <= ttl_ms:
                said = "denied"
            else:
                said = "taken_over"
            if said != "denied":
                holder, beat = h, int(ms)
            out.append((key[0], h, int(ms), said))
        state.update((holder, beat))
        yield pd.DataFrame(out, columns=["name", "holder", "ms", "outcome"])

    return requests.groupBy("name").applyInPandasWithState(step, "name string, holder string, ms long, outcome string", "holder string, beat long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it gave, from Parquet in the shared folder."""
    spark = stream.sparkSession
    path = scratch(spark, "streamed")
    spark.createDataFrame([], stream.schema).write.parquet(path)  # what is read where no batch runs

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    out = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    # a file sink only appends; a complete answer takes the place of the one before
    q = out.format("parquet").start(path) if mode == "append" else out.foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def append_batches(stream: DataFrame, path: str, key: str, checkpoint: str) -> None:
    """Appends each micro-batch's rows whose key the table lacks, so that a replayed batch adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            batch = batch.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.dropDuplicates([key]).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
