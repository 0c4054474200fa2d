"""The campaign log: revisions per outcome, withdrawals, replays, and the stream against the batch."""

import pytest

from lightfold.operators import eventlog

SCHEMA = "campaign long, seq long, action string, outcome string"


def log(df):
    return [(r["campaign"], r["seq"], r["outcome"], r["name"], r["invalidates"]) for r in df.orderBy("campaign", "seq").collect()]


def said(outcomes):
    return [(1, i, "withdraw" if o.startswith("-") else "record", o.strip("-")) for i, o in enumerate(outcomes)]


@pytest.mark.parametrize(
    "given,names",
    [
        (["A", "B", "A"], ["A", "B", "A-rev-1"]),
        (["A", "A", "B", "B"], ["A", "B"]),
        (["A", "B", "A", "B", "A"], ["A", "B", "A-rev-1", "B-rev-1", "A-rev-2"]),
        (["A", "-A", "A"], ["A", None, "A-rev-1"]),
        (["A", "-B", "A"], ["A"]),
        (["-A", "A"], ["A"]),
        (["A", "-A", "-A", "B"], ["A", None, "B"]),
    ],
)
def test_revisions_are_counted_per_outcome(spark, given, names):
    got = log(eventlog.campaign_log(spark.createDataFrame(said(given), SCHEMA)))
    full = [n and f"campaign-1-{n}" for n in names]
    assert [x[3] for x in got] == full
    assert [x[4] for x in got] == [None, *full[:-1]][: len(full)]


def test_a_replay_adds_nothing(spark):
    rows = said(["A", "B", "A"])
    once = log(eventlog.campaign_log(spark.createDataFrame(rows, SCHEMA)))
    assert log(eventlog.campaign_log(spark.createDataFrame(rows * 3, SCHEMA).repartition(3))) == once
    assert log(eventlog.campaign_log(spark.createDataFrame([], SCHEMA))) == []


def test_the_stream_keeps_its_state_across_batches_and_replays(spark, tmp_path):
    """Batches of two requests, with the first ones sent again at the end: the same log as in one pass."""
    rows = said(["A", "B", "A", "-A", "A", "C", "C", "B"]) + [(2, 5, "record", "X"), (2, 9, "record", "Y"), (2, 11, "record", "X")]
    want = log(eventlog.campaign_log(spark.createDataFrame(rows, SCHEMA)))
    there, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for i in range(0, len(rows) + 4, 2):
        part = rows[i : i + 2] if i < len(rows) else rows[:3]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(there)
        stream = eventlog.stream_campaign_log(spark.readStream.schema(SCHEMA).parquet(there))
        stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    assert log(spark.read.parquet(out)) == want


def test_content_ids_and_closed_kinds(spark):
    rows = [("rediscovery", 1, None, 2), ("rediscovery", 1, None, 2), ("rediscovery", 1, "", 2), ("anything", 1, "a", 2)]
    got = eventlog.outcome_events(spark.createDataFrame(rows, "kind string, tic long, label string, source long")).collect()
    assert len(got) == 2 and len({r["event_id"] for r in got}) == 2
    runs = [(1, "b", "exact"), (1, "a", "miss"), (2, "a", "miss"), (2, "b", "exact"), (3, "a", "exact"), (3, "b", "harmonic_alias")]
    v = {r["run"]: r for r in eventlog.validation_events(spark.createDataFrame(runs, "run long, planet string, status string").repartition(3)).collect()}
    assert v[1]["event_id"] == v[2]["event_id"] != v[3]["event_id"] and v[3]["rediscoveries"] == 2


def test_statistics_leave_invalidated_events_out(spark):
    cols = "event_id string, kind string, invalidates string, targets long, survivors long, rejected long, errors long, tics array<long>, tic long, label string, rediscoveries long"
    rows = [("a", "campaign_completed", None, 10, 1, 2, 3, [1, 2], None, None, None), ("b", "campaign_completed", "a", 20, 2, 3, 4, [2, 3, None], None, None, None)]
    rows += [("c", "known_tce_rediscovery", None, None, None, None, None, None, 7, "x", None), ("d", "known_tce_rediscovery", None, None, None, None, None, None, 7, "x", None), ("e", "known_planet_validation", None, None, None, None, None, None, None, None, 4), ("f", "rediscovery", None, None, None, None, None, None, 1, "x", None)]
    r = eventlog.statistics(spark.createDataFrame(rows, cols)).collect()
    assert len(r) == 1 and r[0].asDict() == {"campaign_runs": 1, "target_searches": 20, "survivors": 2, "rejected": 3, "errors": 4, "packets": 0, "vetted": 0, "confirmed": 0, "false_positives": 0, "planet_rediscoveries": 5, "tce_rediscoveries": 1, "unique_targets": 2, "events": 6, "invalidated": 1}
    none = eventlog.statistics(spark.createDataFrame([], cols)).collect()[0]
    assert none["campaign_runs"] == 0 and none["unique_targets"] == 0
