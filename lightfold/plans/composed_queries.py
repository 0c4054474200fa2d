"""Queries that put several operators together: cohorts, newest verdicts, provenance rates, revisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ephemeris as ep
from ..operators import evidence, joins
from .views import CAT, EPH, EVID, LC, STAR, cat, eph, evid, lc, query, r, star, table

W = "WITH "


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


@query("required_sources", W + EPH + " SELECT count(*) AS n, (events <> 0 AND camera <> 1 AND status <> 'P') AS complete FROM eph GROUP BY 2")
def required_sources(s, d):
    """Whether every source that must be asked is there and ended well."""
    e = eph(s, d)
    state = lambda missing, name: F.when(missing, F.lit(None)).otherwise(F.struct(F.lit(name).alias("key"), F.lit("ok").alias("value")))
    got = F.array(state(F.col("events") == 0, "gaia"), state(F.col("camera") == 1, "toi"), F.struct(F.lit("tce").alias("key"), F.when(F.col("status") == "P", "error").otherwise("empty").alias("value")))
    states = F.map_from_entries(F.array_compact(got))
    there = F.forall(F.array(*map(F.lit, ("gaia", "toi", "tce"))), lambda k: F.array_contains(F.map_keys(states), k))
    well = F.forall(F.map_values(states), lambda v: v.isin("ok", "empty"))
    return e.groupBy((there & well).alias("complete")).agg(n())


@query("same_signal", W + EPH + ", " + CAT + ", p AS (SELECT round(period, 1) AS a, round(cat_period, 1) AS b FROM eph e JOIN cat c ON e.host % 500 = c.slot) SELECT abs(a - b) <= greatest(1e-10::DOUBLE * greatest(abs(a), abs(b)), 1e-10::DOUBLE) AS same, count(*) AS n FROM p GROUP BY 1")
def same_signal(s, d):
    """Pairs of different periods with how often each side has them."""
    e = eph(s, d).groupBy((F.col("host") % 500).alias("slot"), r("period", 1).alias("a")).agg(n("_e"))
    c = cat(s, d).groupBy("slot", r("cat_period", 1).alias("b")).agg(n("_c"))
    return e.join(c, "slot").groupBy(ep.same_signal("a", "b").alias("same")).agg(F.sum(F.col("_e") * F.col("_c")).alias("n"))


@query("blank_targets", W + STAR + ", " + EPH + ", " + EVID + " SELECT tic, lane FROM star WHERE tic NOT IN (SELECT host FROM eph WHERE snr > 30) AND tic NOT IN (SELECT tic FROM evid WHERE kind = 'R')")
def blank_targets(s, d):
    hosts = eph(s, d).filter("snr > 30").select(F.col("host").alias("tic"))
    listed = evid(s, d).filter("kind = 'R'").select("tic")
    return star(s, d).join(hosts, "tic", "left_anti").join(listed, "tic", "left_anti").select("tic", "lane")


@query("known_hosts", W + STAR + ", " + EPH + ", " + EVID + " SELECT tic FROM star WHERE tic IN (SELECT host FROM eph WHERE events = 4 UNION SELECT tic FROM evid WHERE verdict = 'known_eb_rediscovery')")
def known_hosts(s, d):
    ids = eph(s, d).filter("events = 4").select(F.col("host").alias("tic")).union(evid(s, d).filter("verdict = 'known_eb_rediscovery'").select("tic"))
    return star(s, d).select("tic").join(ids.distinct(), "tic", "left_semi")


@query("recovery_by_provenance", W + EVID + " SELECT coalesce(signature, 'unknown') AS provenance, count(*) AS n, round(count(*) FILTER (verdict IS NOT NULL)::DOUBLE / count(*), 6) AS found, round(count(*) FILTER (verdict = 'automated_survivor')::DOUBLE / count(*), 6) AS survived FROM evid GROUP BY 1")
def recovery_by_provenance(s, d):
    rate = lambda c: r(F.count_if(F.coalesce(c, F.lit(False))) / F.count(F.lit(1)))
    v = F.col("verdict")
    return evid(s, d).groupBy(F.coalesce("signature", F.lit("unknown")).alias("provenance")).agg(n(), rate(v.isNotNull()).alias("found"), rate(v == "automated_survivor").alias("survived"))


@query("packet_summary", W + EPH + """, p AS (SELECT list_filter([CASE WHEN snr < 7.1 THEN 'snr' END, CASE WHEN events < 2 THEN 'events' END, CASE WHEN status = 'P' THEN 'sources' END], lambda x: x IS NOT NULL) AS b FROM eph)
SELECT 'ready' AS reason, count(*) AS n FROM p WHERE len(b) = 0 UNION ALL SELECT 'blocked', count(*) FROM p WHERE len(b) > 0 UNION ALL SELECT 'blocked:' || reason, count(*) FROM (SELECT unnest(b) AS reason FROM p) GROUP BY reason""")
def packet_summary(s, d):
    """Packets that are ready, those blocked, and each reason's count, in one pass."""
    b = F.array_compact(F.array(F.when(F.col("snr") < 7.1, F.lit("snr")), F.when(F.col("events") < 2, F.lit("events")), F.when(F.col("status") == "P", F.lit("sources"))))
    said = F.when(F.size("b") == 0, F.array(F.lit("ready"))).otherwise(F.concat(F.array(F.lit("blocked")), F.transform("b", lambda x: F.concat(F.lit("blocked:"), x))))
    return eph(s, d).select(b.alias("b")).select(F.explode(said).alias("reason")).groupBy("reason").agg(n())


@query("newest_report", W + EPH + ", k AS (SELECT host, tic, campaign, row_number() OVER (PARTITION BY host ORDER BY campaign DESC, tic DESC) AS rn, count(*) OVER (PARTITION BY host) AS reports FROM eph) SELECT host, campaign, tic, reports FROM k WHERE rn = 1")
def newest_report(s, d):
    """The newest report of each star; of equal times the later path."""
    at = F.struct("campaign", "tic")
    return eph(s, d).groupBy("host").agg(F.max(at).alias("m"), F.count(F.lit(1)).alias("reports")).select("host", "m.campaign", "m.tic", "reports")


@query("newest_verdicts", W + EVID + """, k AS (SELECT *, row_number() OVER (PARTITION BY tic, kind ORDER BY evidence_id DESC) AS rn FROM evid), a AS (SELECT tic, verdict AS pixel, evidence_id AS pixel_id FROM k WHERE rn = 1 AND kind = 'A'), b AS (SELECT tic, verdict AS sector, evidence_id AS sector_id FROM k WHERE rn = 1 AND kind = 'R')
SELECT tic, pixel, sector, CASE WHEN pixel_id IS NULL THEN 'sector' WHEN sector_id IS NULL THEN 'pixel' ELSE 'both' END AS held FROM a FULL JOIN b USING (tic)""")
def newest_verdicts(s, d):
    """Two kinds' newest verdicts side by side; one conditional aggregate instead of two and an outer join."""
    at = lambda k: F.max_by(F.struct("verdict"), F.when(F.col("kind") == k, F.col("evidence_id")))
    got = evid(s, d).filter(F.col("kind").isin("A", "R")).groupBy("tic").agg(at("A").alias("a"), at("R").alias("b"), F.bool_or(F.col("kind") == "A").alias("x"), F.bool_or(F.col("kind") == "R").alias("y"))
    held = F.when(~F.col("x"), "sector").when(~F.col("y"), "pixel").otherwise("both")
    return got.select("tic", F.when(F.col("x"), F.col("a.verdict")).alias("pixel"), F.when(F.col("y"), F.col("b.verdict")).alias("sector"), held.alias("held"))


@query("screening_winner", W + EVID + ", k AS (SELECT tic, evidence_id, verdict, affects_state, row_number() OVER (PARTITION BY tic ORDER BY affects_state DESC, evidence_id DESC) AS rn FROM evid) SELECT tic, evidence_id, verdict, affects_state = 1 AS active FROM k WHERE rn = 1")
def screening_winner(s, d):
    """The last event in order, unless an active checkpoint stands above it."""
    got = evid(s, d).groupBy("tic").agg(F.max_by(F.struct("evidence_id", "verdict", "affects_state"), F.struct("affects_state", "evidence_id")).alias("w"))
    return got.select("tic", "w.evidence_id", "w.verdict", (F.col("w.affects_state") == 1).alias("active"))


@query("neighbour_hosts", W + EPH + ", e AS (SELECT host, tic, CASE WHEN events <> 0 THEN depth_ppm END AS depth FROM eph) SELECT host, tic, row_number() OVER (PARTITION BY host ORDER BY depth DESC NULLS LAST, tic) AS rank FROM e")
def neighbour_hosts(s, d):
    e = eph(s, d).select("host", "tic", F.when(F.col("events") != 0, F.col("depth_ppm")).alias("depth"))
    return e.select("host", "tic", F.row_number().over(Window.partitionBy("host").orderBy(F.desc_nulls_last("depth"), "tic")).cast("long").alias("rank"))


@query("cohort_equality", W + EVID + ", a AS (SELECT DISTINCT tic FROM evid WHERE kind = 'A'), b AS (SELECT DISTINCT tic FROM evid WHERE kind = 'R') , x AS (SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b) SELECT *, only_a = 0 AND only_b = 0 AS equal FROM x")
def cohort_equality(s, d):
    """How many ids only one of two cohorts holds, by one aggregate an id instead of two anti joins."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    ids = evid(s, d).filter(F.col("kind").isin("A", "R")).groupBy("tic").agg(has("A").alias("a"), has("R").alias("b"))
    got = ids.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    return got.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


@query("mask_any", W + LC + """, e AS (SELECT * FROM (VALUES (2.3::DOUBLE, 0.4::DOUBLE, 0.2::DOUBLE), (5.7::DOUBLE, 1.1::DOUBLE, 0.5::DOUBLE), (0.9::DOUBLE, 0.0::DOUBLE, 0.05::DOUBLE)) v(period, epoch, duration)),
m AS (SELECT star, t, (SELECT bool_or(abs((t - epoch + period / 2) - period * floor((t - epoch + period / 2) / period) - period / 2) <= 0.75::DOUBLE * duration) FROM e) AS hit FROM lc) SELECT star, count(*) AS n, count(*) FILTER (hit) AS masked FROM m GROUP BY star""")
def mask_any(s, d):
    """Points within 1.5 durations' width of an event of any of several ephemerides."""
    given = ((2.3, 0.4, 0.2), (5.7, 1.1, 0.5), (0.9, 0.0, 0.05))
    hit = F.lit(False)
    for period, epoch, duration in given:
        hit = hit | (ep.folded_offset("t", F.lit(period), F.lit(epoch)) <= 0.75 * duration)
    return lc(s, d).groupBy("star").agg(n(), F.count_if(hit).alias("masked"))


@query("fn_conversions", W + CAT + " SELECT entry, round(CASE WHEN cat_epoch > 2000000 THEN cat_epoch - 2457000 ELSE cat_epoch END, 6) AS btjd, round(3 * pi() / 6.67430e-11::DOUBLE / 1408 * pow(cat_duration_h * 3, 3) / (cat_period * 86400 * (cat_period * 86400)), 6) AS density, round(greatest(abs(cat_period_error), abs(-cat_epoch_error)), 9) AS worst FROM cat")
def fn_conversions(s, d):
    density = ep.density_from_orbit(F.col("cat_duration_h") * 3, "cat_period")
    return cat(s, d).select("entry", r(ep.to_relative_julian("cat_epoch")).alias("btjd"), r(density).alias("density"), r(ep.worst_uncertainty("cat_period_error", -F.col("cat_epoch_error")), 9).alias("worst"))


@query("missing_coordinates", W + EPH + ", c AS (SELECT host, CASE WHEN host % 7 <> 0 THEN ra END AS ra, CASE WHEN host % 11 <> 0 THEN dec END AS dec FROM eph) SELECT DISTINCT host FROM c WHERE ra IS NULL OR dec IS NULL")
def missing_coordinates(s, d):
    c = eph(s, d).select("host", F.when(F.col("host") % 7 != 0, F.col("ra")).alias("ra"), F.when(F.col("host") % 11 != 0, F.col("dec")).alias("dec"))
    return c.filter("ra is null or dec is null").select("host").distinct()


@query("supersession", W + EVID + """, p AS (SELECT tic, kind, evidence_id, coalesce(verdict, '-') AS outcome, lag(evidence_id) OVER w AS before, lag(coalesce(verdict, '-')) OVER w AS was FROM evid WINDOW w AS (PARTITION BY tic, kind ORDER BY evidence_id)),
c AS (SELECT * FROM p WHERE was IS NULL OR was <> outcome), x AS (SELECT *, row_number() OVER (PARTITION BY tic, kind, outcome ORDER BY evidence_id) - 1 AS revision, lag(evidence_id) OVER (PARTITION BY tic, kind ORDER BY evidence_id) AS invalidates FROM c)
SELECT tic, kind, evidence_id, outcome, revision, invalidates, tic || ':' || kind || ':' || outcome || CASE WHEN revision > 0 THEN '-rev-' || revision ELSE '' END AS name FROM x""")
def supersession(s, d):
    """Outcomes of one campaign and star in order: an equal one is a replay, another one invalidates the last; one that comes back is a revision of itself."""
    return evidence.supersede(evid(s, d).select("tic", "kind", "evidence_id", F.coalesce("verdict", F.lit("-")).alias("outcome")), ["tic", "kind"], "evidence_id", "outcome")


@query("vote_toggle", W + EVID + " SELECT tic, kind, source, CASE WHEN evidence_id % 10 = 0 THEN 1 - affects_state ELSE affects_state END AS affects_state FROM evid")
def vote_toggle(s, d):
    """Rows named in a change set take its flag, all others keep theirs. Sources over 24,999 give rows of two stars one id, so the set names the whole key."""
    key = ["evidence_id", "tic", "kind", "source"]
    e = evid(s, d).select(*key, "affects_state")
    change = e.filter("evidence_id % 10 = 0").select(*(F.col(c).alias(f"_{c}") for c in key), (1 - F.col("affects_state")).alias("new"))
    named = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]  # a kind may be null
    return e.join(change, named, "left").select("tic", "kind", "source", F.coalesce("new", "affects_state").alias("affects_state"))


@query("vetting_progress", W + EVID + ", p AS (SELECT tic, count(*) AS total, count(verdict) AS done, (max(evidence_id) - min(evidence_id))::DOUBLE AS elapsed FROM evid GROUP BY tic) SELECT tic, done, total - done AS remaining, round(CASE WHEN elapsed > 0 THEN done / elapsed END, 9) AS rate, round(CASE WHEN elapsed > 0 AND done > 0 THEN (total - done) / (done / elapsed) END, 3) AS eta FROM p")
def vetting_progress(s, d):
    p = evid(s, d).groupBy("tic").agg(F.count(F.lit(1)).alias("total"), F.count("verdict").alias("done"), (F.max("evidence_id") - F.min("evidence_id")).cast("double").alias("elapsed"))
    rate = F.when(F.col("elapsed") > 0, F.col("done") / F.col("elapsed"))
    left = F.col("total") - F.col("done")
    return p.select("tic", "done", left.alias("remaining"), r(rate, 9).alias("rate"), r(F.when(rate > 0, left / rate), 3).alias("eta"))
