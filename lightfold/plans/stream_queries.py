"""Streams over the event files run to their end, against the same batch answers; sources there and back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch, workers_find_package
from ..sources import files
from ..streaming import streams
from .views import query, r, table


def _events(s, d):
    """The table as a stream of files; it may be one file or a folder of them."""
    read = workers_find_package(s).readStream.schema(streams.EVENTS)
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    if path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        found = read.parquet(f"{d}/events.parquet")
    else:
        found = read.option("pathGlobFilter", "events.parquet").parquet(d)
    return found.withColumn("at", F.col("ts").cast("timestamp"))


def _run(s, stream, mode):
    return streams.run_once(stream, f"q{uuid.uuid4().hex}", mode, scratch(s, "stream"))


@query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    out = _run(s, streams.tumbling_counts(_events(s, d)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "top")


@query("stream_rolling_rate", "WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(k * 5) AS start, event_type FROM events, range(3) g(k)) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, round(count(*) * 60.0 / 15, 6) AS per_hour FROM w GROUP BY ALL")
def stream_rolling_rate(s, d):
    out = _run(s, streams.rolling_rate(_events(s, d)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", r("per_hour").alias("per_hour"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM h GROUP BY user_id, k")
def stream_sessions(s, d):
    out = _run(s, streams.sessions(_events(s, d)), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("stream_distinct", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_distinct(s, d):
    out = _run(s, streams.distinct_events(_events(s, d)).select("event_id", "event_type"), "append")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_leases")
def stream_leases(s, d):
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    asked = _events(s, d).select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("holder"), ms.alias("ms"))
    return _run(s, streams.leases(asked, 30_000_000), "append").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_round_trip", "SELECT p_brand AS brand, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY 1")
def snapshot_round_trip(s, d):
    """Writes a catalogue generation with its manifest, reads the newest back after checking its hash."""
    root = scratch(s, "snapshots")
    files.write_snapshot(table(s, d, "part"), root, "part", "v1")
    return files.newest(s, root, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("top"))


@query("flat_csv_round_trip", "SELECT o_custkey AS host, array_to_json(list_sort(list(o_orderkey)))::VARCHAR AS keys FROM orders GROUP BY 1")
def flat_csv_round_trip(s, d):
    path = scratch(s, "csv")
    files.write_flat_csv(table(s, d, "orders").groupBy(F.col("o_custkey").alias("host")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys")), path)
    return s.read.schema("host long, keys string").option("header", True).option("escape", '"').csv(path)


@query("event_log_append", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def event_log_append(s, d):
    """Appends the events twice to a JSON log; the second time adds nothing."""
    path = scratch(s, "log")
    ev = table(s, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("kind"))
    files.append_events(ev, path)
    files.append_events(ev, path)
    return files.json_lines(s, path, "event_id string, kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("content_hash_order_free", "SELECT count(*) AS rows, true AS same FROM supplier")
def content_hash_order_free(s, d):
    x = table(s, d, "supplier")
    a, b = files.content_hash(x), files.content_hash(x.orderBy(F.desc("s_name")).repartition(3))
    return a.alias("a").join(b.alias("b"), F.col("a.row_count") == F.col("b.row_count")).select(F.col("a.row_count").alias("rows"), (F.col("a.content_hash") == F.col("b.content_hash")).alias("same"))
