"""An append-only log of campaign outcomes: revisions, withdrawals, content ids and the counts that follow from it.

A request is (campaign, seq, action, outcome). Recording an outcome that is the campaign's valid
one adds nothing. Another outcome invalidates the valid event and becomes valid under its own
name; an outcome that comes back after it was invalidated gets that name with a revision, counted
per outcome. Withdrawing an outcome invalidates the valid event if it is of that outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Kinds of outcomes that may be entered by hand.
OUTCOME_KINDS = ("candidate_packet_created", "vetted_candidate", "confirmed_planet", "false_positive", "rediscovery", "known_tce_rediscovery")
LOG = "campaign long, seq long, kind string, outcome string, name string, invalidates string"


def event_name(campaign, outcome, revision) -> Column:
    """Name of an outcome's event; from its first return on with -rev-n."""
    suffix = F.when(revision > 0, F.concat(F.lit("-rev-"), revision.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("campaign-"), campaign.cast("string"), F.lit("-"), outcome, suffix)


def campaign_log(requests: DataFrame) -> DataFrame:
    """The log (campaign, seq, kind, outcome, name, invalidates) that all requests leave, in one pass over each campaign.

    Rows of one (campaign, seq) are replays of one request. A window a campaign streams its
    requests in order; nothing is gathered.
    """
    r = requests.select("campaign", "seq", "action", "outcome").dropDuplicates(["campaign", "seq"])
    order = Window.partitionBy("campaign").orderBy("seq")
    said = F.last(F.when(F.col("action") == "record", F.col("outcome")), ignorenulls=True).over(order)
    # a withdrawal counts as no outcome at all, if it names what was recorded last
    r = r.withColumn("_now", said).filter("action = 'record' OR outcome = _now").withColumn("_valid", F.when(F.col("action") == "record", F.col("outcome")))
    first = F.row_number().over(order) == 1
    changed = r.withColumn("_was", F.lag("_valid").over(order)).withColumn("_first", first).filter((F.col("_first") & F.col("_valid").isNotNull()) | (~F.col("_first") & ~F.col("_valid").eqNullSafe(F.col("_was"))))
    again = F.row_number().over(Window.partitionBy("campaign", "outcome").orderBy("seq"))
    recorded = changed.filter("_valid IS NOT NULL").select("campaign", "seq", "outcome", (again - 1).alias("_rev"))
    named = recorded.withColumn("name", event_name(F.col("campaign"), F.col("outcome"), F.col("_rev"))).drop("_rev")
    full = changed.select("campaign", "seq", "_valid").join(named, ["campaign", "seq"], "left").withColumn("_prior", F.lag("name").over(order))
    kind = F.when(F.col("_valid").isNull(), "event_invalidated").otherwise("campaign_completed")
    return full.select("campaign", "seq", kind.alias("kind"), "outcome", "name", F.col("_prior").alias("invalidates"))


def stream_campaign_log(requests: DataFrame) -> DataFrame:
    """The same log from a stream of requests, whatever micro-batches they come in.

    State is a campaign's last request, its valid event, and how often each outcome was recorded.
    Requests at or before the last one seen add nothing, so a replayed batch adds nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, valid, name, known, counts = state.get if state.exists else (-(1 << 63), None, None, [], [])
        times = dict(zip(known, counts))
        out = []
        for seq, action, outcome in sorted({(int(r.seq), r.action, r.outcome) for b in batches for r in b.itertuples()}):
            if seq <= last:
                continue
            last = seq
            if action == "record" and outcome != valid:
                n = times.get(outcome, 0)
                new = f"campaign-{key[0]}-{outcome}" + (f"-rev-{n}" if n else "")
                out.append((key[0], seq, "campaign_completed", outcome, new, name))
                valid, name, times[outcome] = outcome, new, n + 1
            elif action == "withdraw" and outcome == valid and valid is not None:
                out.append((key[0], seq, "event_invalidated", None, None, name))
                valid = name = None
        state.update((last, valid, name, list(times), list(times.values())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    held = "last long, valid string, name string, known array<string>, counts array<long>"
    return requests.groupBy("campaign").applyInPandasWithState(step, LOG, held, "append", GroupStateTimeout.NoTimeout)


def content_id(prefix: str, *fields: Column) -> Column:
    """An id that follows from content: SHA-256 of the fields as JSON, first 20 hex digits. Nulls are kept apart from empty strings."""
    names = [f.alias(f"f{i}") for i, f in enumerate(fields)]
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256), 1, 20))


def outcome_events(entered: DataFrame) -> DataFrame:
    """Events of outcomes entered by hand (kind, tic, label, source): other kinds are refused, repeats are one event."""
    ok = entered.filter(F.col("kind").isin(*OUTCOME_KINDS)).select("kind", "tic", "label", "source").distinct()
    return ok.select(content_id("outcome", F.col("kind"), F.col("tic"), F.col("label"), F.col("source")).alias("event_id"), "kind", "tic", "label", "source")


def validation_events(benchmarks: DataFrame) -> DataFrame:
    """One event a validation run (run, planet, status): its id follows from all (planet, status) in order of planet."""
    per = benchmarks.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("planet", "status"))).alias("rows"), F.count(F.lit(1)).alias("benchmarks"), F.count_if(F.col("status").isin("exact", "harmonic_alias")).alias("rediscoveries"))
    return per.select("run", content_id("validation", F.col("rows")).alias("event_id"), "benchmarks", "rediscoveries")


def statistics(log: DataFrame) -> DataFrame:
    """One row of counts over the valid events of a log.

    log: event_id, kind, invalidates, targets, survivors, rejected, errors, tics (array), tic,
    label, rediscoveries. Events that an invalidation names don't count, whenever it came.
    """
    gone = log.filter("invalidates IS NOT NULL").select(F.col("invalidates").alias("event_id")).distinct()
    live = log.join(gone, "event_id", "left_anti")
    run = F.col("kind") == "campaign_completed"
    of = lambda kind: F.count_if(F.col("kind") == kind)
    total = lambda c: F.coalesce(F.sum(F.when(run, F.col(c))), F.lit(0))
    got = live.agg(
        F.count_if(run).alias("campaign_runs"), total("targets").alias("target_searches"), total("survivors").alias("survivors"), total("rejected").alias("rejected"), total("errors").alias("errors"),
        of("candidate_packet_created").alias("packets"), of("vetted_candidate").alias("vetted"), of("confirmed_planet").alias("confirmed"), of("false_positive").alias("false_positives"),
        (of("rediscovery") + F.coalesce(F.sum(F.when(F.col("kind") == "known_planet_validation", F.col("rediscoveries"))), F.lit(0))).alias("planet_rediscoveries"),
        F.countDistinct(F.when(F.col("kind") == "known_tce_rediscovery", F.struct("tic", "label"))).alias("tce_rediscoveries"),
    )
    seen = live.filter(run).select(F.explode("tics").alias("t")).agg(F.countDistinct("t").alias("unique_targets"))
    counts = log.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("invalidates").alias("invalidated"))
    return got.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(counts))  # one row each
