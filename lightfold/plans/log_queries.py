"""Queries over the log of campaign outcomes, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eventlog
from .stream_queries import _events, _run
from .views import EVID, evid, query, table

W = "WITH "
REQ = "req AS (SELECT user_id AS campaign, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'withdraw' ELSE 'record' END AS action, event_type AS outcome FROM events)"
LOG = REQ + """, s AS (SELECT *, last_value(CASE WHEN action = 'record' THEN outcome END IGNORE NULLS) OVER (PARTITION BY campaign ORDER BY seq) AS now FROM req),
v AS (SELECT *, CASE WHEN action = 'record' THEN outcome END AS valid FROM s WHERE action = 'record' OR outcome = now),
w AS (SELECT *, lag(valid) OVER (PARTITION BY campaign ORDER BY seq) AS was, row_number() OVER (PARTITION BY campaign ORDER BY seq) AS i FROM v),
c AS (SELECT * FROM w WHERE (i = 1 AND valid IS NOT NULL) OR (i > 1 AND valid IS DISTINCT FROM was)),
n AS (SELECT *, CASE WHEN valid IS NOT NULL THEN 'campaign-' || campaign || '-' || outcome || CASE WHEN rev > 0 THEN '-rev-' || rev ELSE '' END END AS name FROM (SELECT *, count(valid) OVER (PARTITION BY campaign, outcome ORDER BY seq) - 1 AS rev FROM c)),
log AS (SELECT campaign, seq, CASE WHEN valid IS NULL THEN 'event_invalidated' ELSE 'campaign_completed' END AS kind, valid AS outcome, name, lag(name) OVER (PARTITION BY campaign ORDER BY seq) AS invalidates FROM n)"""


def requests(events):
    return events.select(F.col("user_id").alias("campaign"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "withdraw").otherwise("record").alias("action"), F.col("event_type").alias("outcome"))


@query("campaign_log", W + LOG + " SELECT * FROM log")
def campaign_log(s, d):
    return eventlog.campaign_log(requests(table(s, d, "events")))


@query("stream_campaign_log", W + LOG + " SELECT * FROM log")
def stream_campaign_log(s, d):
    return _run(s, eventlog.stream_campaign_log(requests(_events(s, d))), "append")


_KINDS = "('candidate_packet_created', 'vetted_candidate', 'confirmed_planet', 'false_positive', 'rediscovery', 'known_tce_rediscovery')"
_PICK = "CASE i WHEN 0 THEN 'candidate_packet_created' WHEN 1 THEN 'vetted_candidate' WHEN 2 THEN 'confirmed_planet' WHEN 3 THEN 'false_positive' WHEN 4 THEN 'rediscovery' WHEN 5 THEN 'known_tce_rediscovery' ELSE 'other' END"
ENTERED = f"entered AS (SELECT {_PICK} AS kind, tic, label, source FROM (SELECT evidence_id % 7 AS i, tic, signature AS label, source % 3 AS source FROM evid))"


def entered(s, d):
    i = F.col("evidence_id") % 7
    kind = F.element_at(F.array(*map(F.lit, (*eventlog.OUTCOME_KINDS, "other"))), (i + 1).cast("int"))
    return evid(s, d).select(kind.alias("kind"), "tic", F.col("signature").alias("label"), (F.col("source") % 3).alias("source"))


@query("outcome_events", W + EVID + ", " + ENTERED + f""" SELECT 'outcome-' || left(sha256('{{"f0":"' || kind || '","f1":' || tic || ',"f2":' || coalesce('"' || label || '"', 'null') || ',"f3":' || source || '}}'), 20) AS event_id, kind, tic, label, source FROM (SELECT DISTINCT * FROM entered) WHERE kind IN {_KINDS}""")
def outcome_events(s, d):
    return eventlog.outcome_events(entered(s, d))


@query("validation_events", W + EVID + """, b AS (SELECT tic % 50 AS run, evidence_id AS planet, CASE evidence_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'harmonic_alias' ELSE 'miss' END AS status FROM evid)
SELECT run, 'validation-' || left(sha256('{"f0":[' || string_agg('{"planet":' || planet || ',"status":"' || status || '"}', ',' ORDER BY planet) || ']}'), 20) AS event_id, count(*) AS benchmarks, count(*) FILTER (status <> 'miss') AS rediscoveries FROM b GROUP BY run""")
def validation_events(s, d):
    k = F.col("evidence_id") % 3
    return eventlog.validation_events(evid(s, d).select((F.col("tic") % 50).alias("run"), F.col("evidence_id").alias("planet"), F.when(k == 0, "exact").when(k == 1, "harmonic_alias").otherwise("miss").alias("status")))


@query("log_statistics", W + LOG + f""", full_log AS (SELECT coalesce(name, 'i-' || campaign || '-' || seq) AS event_id, kind, invalidates, 10 + seq % 5 AS targets, seq % 3 AS survivors, seq % 4 AS rejected, seq % 2 AS errors, [campaign, seq % 97] AS tics, NULL::BIGINT AS tic, NULL AS label, NULL::BIGINT AS rediscoveries FROM log
UNION ALL SELECT 'o-' || event_id, {_PICK.replace("ELSE 'other'", "ELSE 'known_planet_validation'")}, NULL, NULL, NULL, NULL, NULL, NULL, user_id, event_type, event_id % 5 FROM (SELECT *, event_id % 7 AS i FROM events)),
live AS (SELECT * FROM full_log WHERE event_id NOT IN (SELECT invalidates FROM full_log WHERE invalidates IS NOT NULL))
SELECT (count(*) FILTER (kind = 'campaign_completed')) AS campaign_runs, coalesce(sum(targets), 0)::BIGINT AS target_searches, coalesce(sum(survivors) FILTER (kind = 'campaign_completed'), 0)::BIGINT AS survivors, coalesce(sum(rejected) FILTER (kind = 'campaign_completed'), 0)::BIGINT AS rejected, coalesce(sum(errors) FILTER (kind = 'campaign_completed'), 0)::BIGINT AS errors,
count(*) FILTER (kind = 'candidate_packet_created') AS packets, count(*) FILTER (kind = 'vetted_candidate') AS vetted, count(*) FILTER (kind = 'confirmed_planet') AS confirmed, count(*) FILTER (kind = 'false_positive') AS false_positives,
(count(*) FILTER (kind = 'rediscovery') + coalesce(sum(rediscoveries) FILTER (kind = 'known_planet_validation'), 0))::BIGINT AS planet_rediscoveries, count(DISTINCT (tic, label)) FILTER (kind = 'known_tce_rediscovery') AS tce_rediscoveries,
(SELECT count(DISTINCT t) FROM (SELECT unnest(tics) AS t FROM live WHERE kind = 'campaign_completed')) AS unique_targets, (SELECT count(*) FROM full_log) AS events, (SELECT count(DISTINCT invalidates) FROM full_log) AS invalidated FROM live""".replace("coalesce(sum(targets), 0)", "coalesce(sum(targets) FILTER (kind = 'campaign_completed'), 0)"))
def log_statistics(s, d):
    """Counts over the valid events of the campaign log and of outcomes entered by hand."""
    ev, seq = table(s, d, "events"), F.col("seq")
    log = eventlog.campaign_log(requests(ev))
    none = F.lit(None).cast("long")
    a = log.select(F.coalesce("name", F.concat_ws("-", F.lit("i"), F.col("campaign").cast("string"), seq.cast("string"))).alias("event_id"), "kind", "invalidates", (10 + seq % 5).alias("targets"), (seq % 3).alias("survivors"), (seq % 4).alias("rejected"), (seq % 2).alias("errors"), F.array("campaign", seq % 97).alias("tics"), none.alias("tic"), F.lit(None).cast("string").alias("label"), none.alias("rediscoveries"))
    kind = F.element_at(F.array(*map(F.lit, (*eventlog.OUTCOME_KINDS, "known_planet_validation"))), (F.col("event_id") % 7 + 1).cast("int"))
    b = ev.select(F.concat(F.lit("o-"), F.col("event_id").cast("string")).alias("event_id"), kind.alias("kind"), F.lit(None).cast("string").alias("invalidates"), *(none.alias(c) for c in ("targets", "survivors", "rejected", "errors")), F.lit(None).cast("array<long>").alias("tics"), F.col("user_id").alias("tic"), F.col("event_type").alias("label"), (F.col("event_id") % 5).alias("rediscoveries"))
    return eventlog.statistics(a.union(b))
