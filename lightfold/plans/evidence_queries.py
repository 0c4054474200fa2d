"""Queries over the evidence store, selections and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, joins, ranking
from .views import EPH, EVID, EVS, STAR, eph, evid, query, r, star, table

W = "WITH "


@query("status_fold", W + EVS + " SELECT * FROM state")
def status_fold(s, d):
    return evidence.state(evid(s, d))


@query("state_rebuild", W + EVS + ", " + STAR + " SELECT tic, status, decided_by, kind, lane, magnitude FROM state LEFT JOIN star USING (tic)")
def state_rebuild(s, d):
    return evidence.state(evid(s, d)).join(star(s, d), "tic", "left")


@query("latest_by_kind", W + EVID + ", k AS (SELECT *, row_number() OVER (PARTITION BY tic, kind ORDER BY evidence_id DESC) AS rn FROM evid) SELECT tic, kind, evidence_id, verdict, source FROM k WHERE rn = 1")
def latest_by_kind(s, d):
    return joins.latest(evid(s, d).select("tic", "kind", "evidence_id", "verdict", "source"), ["tic", "kind"], F.col("evidence_id"))


@query("newest_generation", W + EVID + ", k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY evidence_id DESC) AS rn FROM evid) SELECT source, evidence_id, kind FROM k WHERE rn = 1")
def newest_generation(s, d):
    return joins.latest(evid(s, d).select("source", "evidence_id", "kind"), ["source"], F.col("evidence_id"))


@query("status_counts", W + EVS + " SELECT status, count(*) AS n FROM state GROUP BY status")
def status_counts(s, d):
    return evidence.state(evid(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("verdict_counts", W + EVID + " SELECT verdict, count(*) AS n FROM evid WHERE verdict IS NOT NULL GROUP BY verdict")
def verdict_counts(s, d):
    return evid(s, d).filter("verdict is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("status_by_signature", W + EVS + " SELECT coalesce(signature, 'unversioned') AS signature, status, count(*) AS n FROM state LEFT JOIN (SELECT evidence_id AS decided_by, signature FROM evid) USING (decided_by) GROUP BY 1, 2")
def status_by_signature(s, d):
    return evidence.state(evid(s, d), ("signature",)).groupBy(F.coalesce("signature", F.lit("unversioned")).alias("signature"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("status_by_lane", W + EVS + ", " + STAR + " SELECT coalesce(lane, 'unassigned') AS lane, status, count(*) AS n FROM state LEFT JOIN star USING (tic) GROUP BY 1, 2")
def status_by_lane(s, d):
    return evidence.state(evid(s, d)).join(star(s, d), "tic", "left").groupBy(F.coalesce("lane", F.lit("unassigned")).alias("lane"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("summary_payload", W + EVID + " SELECT count(DISTINCT tic) AS stars, count(*) AS rows, count(*) FILTER (verdict IS NULL) AS silent, count(DISTINCT tic) FILTER (kind = 'A') AS stars_a, count(*) FILTER (affects_state = 1) AS voting, round(count(*) FILTER (kind = 'R')::DOUBLE / count(*), 4) AS share_r, max(evidence_id) AS newest, max(score) AS top FROM evid")
def summary_payload(s, d):
    # stars are counted as groups, so rows are not spread out for each distinct count
    n = F.count(F.lit(1))
    per = evid(s, d).groupBy("tic").agg(
        n.alias("rows"), F.count_if(F.col("verdict").isNull()).alias("silent"), F.count_if(F.col("kind") == "A").alias("a"), F.count_if(F.col("affects_state") == 1).alias("voting"),
        F.count_if(F.col("kind") == "R").alias("r"), F.max("evidence_id").alias("newest"), F.max("score").alias("top"),
    )
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        F.count("tic").alias("stars"), sums("rows").alias("rows"), sums("silent").alias("silent"), F.count_if((F.col("a") > 0) & F.col("tic").isNotNull()).alias("stars_a"), sums("voting").alias("voting"),
        r(F.try_divide(F.sum("r"), F.sum("rows")), 4).alias("share_r"), F.max("newest").alias("newest"), F.max("top").alias("top"),
    )


@query("summary_revision", W + EVID + " SELECT max(evidence_id) || ':' || count(*) AS revision FROM evid")
def summary_revision(s, d):
    return evid(s, d).agg(F.concat_ws(":", F.max("evidence_id").cast("string"), F.count(F.lit(1)).cast("string")).alias("revision"))


@query("science_summary", W + EVID + " SELECT kind, count(*) AS n, count(*) FILTER (verdict = 'science_vetted_lead') AS vetted, count(*) FILTER (verdict = 'common_mode_systematic') AS shared, round(count(*) FILTER (verdict = 'science_vetted_lead')::DOUBLE / nullif(count(*), 0), 6) AS rate FROM evid GROUP BY kind")
def science_summary(s, d):
    v = lambda x: F.count_if(F.coalesce(F.col("verdict") == x, F.lit(False)))
    return evid(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), v("science_vetted_lead").alias("vetted"), v("common_mode_systematic").alias("shared"), r(v("science_vetted_lead") / F.count(F.lit(1))).alias("rate"))


@query("survivor_rate", W + EVID + " SELECT coalesce(signature, 'legacy:unknown') AS signature, count(*) AS screened, count(*) FILTER (verdict = 'automated_survivor') AS survivors, round(count(*) FILTER (verdict = 'automated_survivor')::DOUBLE / count(*), 6) AS rate FROM evid GROUP BY 1")
def survivor_rate(s, d):
    n = F.count_if(F.coalesce(F.col("verdict") == "automated_survivor", F.lit(False)))
    return evid(s, d).groupBy(text.row_signature("signature", F.lit(None).cast("string")).alias("signature")).agg(F.count(F.lit(1)).alias("screened"), n.alias("survivors"), r(n / F.count(F.lit(1))).alias("rate"))


@query("systematics_histogram", W + EPH + " SELECT round(floor(epoch / 30) * 30, 3) AS epoch, count(*) AS n, count(*) FILTER (snr > 30) AS flagged, round(max(snr), 6) AS top FROM eph GROUP BY 1")
def systematics_histogram(s, d):
    return eph(s, d).groupBy(r((F.floor(F.col("epoch") / 30) * 30).cast("double"), 3).alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("snr") > 30).alias("flagged"), r(F.max("snr")).alias("top"))


@query("star_page", W + EVS + ", t AS (SELECT count(*) AS rows, ceil(count(*) / 50.0)::BIGINT AS pages FROM state) SELECT tic, status, rows, pages FROM (SELECT * FROM state ORDER BY tic LIMIT 50 OFFSET 100), t")
def star_page(s, d):
    return evidence.page(evidence.state(evid(s, d)).select("tic", "status"), ["tic"], 2, 50)


@query("star_detail", W + EVID + " SELECT tic, count(*) AS n, string_agg(kind || ':' || coalesce(verdict, '-'), ',' ORDER BY evidence_id) AS history FROM evid GROUP BY tic")
def star_detail(s, d):
    row = F.struct("evidence_id", F.concat("kind", F.lit(":"), F.coalesce("verdict", F.lit("-"))).alias("h"))
    return evid(s, d).groupBy("tic").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["h"]), ",").alias("history"))


@query("review_queue", W + EVID + ", s AS (SELECT tic, sum(CASE WHEN verdict = 'common_mode_systematic' THEN 40 WHEN verdict = 'known_eb_rediscovery' THEN 30 WHEN verdict = 'automated_survivor' THEN 20 WHEN verdict = 'single_event_lead' THEN 10 ELSE 0 END)::BIGINT AS score FROM evid GROUP BY tic) SELECT * FROM s ORDER BY score DESC, tic LIMIT 100")
def review_queue(s, d):
    v = F.col("verdict")
    w = F.when(v == "common_mode_systematic", 40).when(v == "known_eb_rediscovery", 30).when(v == "automated_survivor", 20).when(v == "single_event_lead", 10).otherwise(0)
    return evid(s, d).groupBy("tic").agg(F.sum(w).alias("score")).orderBy(F.desc("score"), "tic").limit(100)


@query("history_queue", W + EPH + ", k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY snr DESC, tic) AS rn, count(*) OVER (PARTITION BY host) AS fits FROM eph) SELECT host, tic, fits FROM k WHERE rn = 1")
def history_queue(s, d):
    e = eph(s, d)
    best = F.max_by(F.col("tic"), F.struct("snr", -F.col("tic"))).alias("tic")
    return e.groupBy("host").agg(best, F.count(F.lit(1)).alias("fits"))


@query("blocker_counts", W + EPH + ", b AS (SELECT unnest(list_filter([CASE WHEN snr < 7.1 THEN 'snr' END, CASE WHEN events < 2 THEN 'events' END, CASE WHEN depth_ppm > 50000 THEN 'deep' END], lambda x: x IS NOT NULL)) AS blocker FROM eph) SELECT blocker, count(*) AS n FROM b GROUP BY blocker")
def blocker_counts(s, d):
    b = F.array_compact(F.array(F.when(F.col("snr") < 7.1, F.lit("snr")), F.when(F.col("events") < 2, F.lit("events")), F.when(F.col("depth_ppm") > 50000, F.lit("deep"))))
    return eph(s, d).select(F.explode(b).alias("blocker")).groupBy("blocker").agg(F.count(F.lit(1)).alias("n"))


@query("idempotent_append", W + EVID + ", old AS (SELECT * FROM evid WHERE source % 2 = 0) SELECT count(*) AS rows, sum(evidence_id)::HUGEINT::VARCHAR AS ids FROM (SELECT * FROM old UNION ALL SELECT * FROM evid e WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.tic = e.tic AND o.kind = e.kind AND o.source = e.source))")
def idempotent_append(s, d):
    e = evid(s, d)
    out = evidence.append(e.filter("source % 2 = 0"), e.unionByName(e))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("evidence_id").cast("decimal(38,0)")).cast("string").alias("ids"))


@query("event_fold_with_invalidation", "WITH ev AS (SELECT event_id, event_type, value, user_id FROM events), gone AS (SELECT event_id - 1 AS event_id FROM ev WHERE event_type = 'error'), ok AS (SELECT * FROM ev WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id FROM gone)) SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users, round(max(value), 6) AS top FROM ok GROUP BY event_type")
def event_fold_with_invalidation(s, d):
    ev = table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", "invalidate").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("event_type") == "error", F.col("event_id") - 1).alias("target"), "value", "user_id")
    return evidence.valid_events(ev).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), r(F.max("value")).alias("top"))


@query("transition_matrix", W + EVS + ", second AS (SELECT tic, min(verdict) AS v FROM evid WHERE verdict IS NOT NULL GROUP BY tic) SELECT status AS before, v AS after, count(*) AS n FROM state JOIN second USING (tic) GROUP BY 1, 2")
def transition_matrix(s, d):
    e = evid(s, d)
    second = e.filter("verdict is not null").groupBy("tic").agg(F.min("verdict").alias("status"))
    return evidence.transitions(evidence.state(e), second, "tic", "status")


@query("paired_ab", W + EPH + ", a AS (SELECT host, max(snr) AS x FROM eph WHERE camera <= 2 GROUP BY host), b AS (SELECT host, max(snr) AS x FROM eph WHERE ccd <= 2 GROUP BY host) SELECT count(*) FILTER (a.host IS NOT NULL AND b.host IS NOT NULL) AS both_arms, count(*) FILTER (b.host IS NULL) AS only_left, count(*) FILTER (a.host IS NULL) AS only_right, count(*) FILTER (a.x = b.x) AS same FROM a FULL JOIN b ON a.host = b.host")
def paired_ab(s, d):
    e = eph(s, d)
    a = e.filter("camera <= 2").groupBy("host").agg(F.max("snr").alias("x"))
    b = e.filter("ccd <= 2").groupBy("host").agg(F.max("snr").alias("y"))
    j = a.join(b, "host", "full")
    return j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both_arms"), F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"), F.count_if(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("same"))


@query("parity_diff", W + EVID + ", a AS (SELECT tic, count(*) AS n, max(score) AS top FROM evid GROUP BY tic), b AS (SELECT tic, count(*) AS n, max(score) AS top FROM evid WHERE source % 5 <> 0 GROUP BY tic) SELECT coalesce(a.tic, b.tic) AS tic, CASE WHEN a.tic IS NULL THEN 'missing_left' WHEN b.tic IS NULL THEN 'missing_right' ELSE 'both' END AS side, concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.top IS DISTINCT FROM b.top THEN 'top' END) AS changed FROM a FULL JOIN b ON a.tic = b.tic WHERE a.n IS DISTINCT FROM b.n OR a.top IS DISTINCT FROM b.top OR a.tic IS NULL OR b.tic IS NULL")
def parity_diff(s, d):
    g = lambda x: x.groupBy("tic").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    e = evid(s, d)
    return evidence.differences(g(e), g(e.filter("source % 5 <> 0")), "tic", ["n", "top"])


@query("upsert_star", W + STAR + ", new AS (SELECT c_custkey AS tic, CASE WHEN c_custkey % 3 = 0 THEN 'lane-x' END AS lane, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS magnitude FROM customer WHERE c_custkey % 4 <> 1) SELECT coalesce(s.tic, n.tic) AS tic, coalesce(n.lane, s.lane) AS lane, coalesce(n.magnitude, s.magnitude) AS magnitude FROM star s FULL JOIN new n ON s.tic = n.tic")
def upsert_star(s, d):
    c = table(s, d, "customer").filter("c_custkey % 4 <> 1")
    new = c.select(F.col("c_custkey").alias("tic"), F.when(F.col("c_custkey") % 3 == 0, "lane-x").alias("lane"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("magnitude"))
    return evidence.upsert(star(s, d), new, "tic")


@query("overwrite_by_key", W + STAR + ", new AS (SELECT tic, 'moved' AS lane, magnitude FROM star WHERE tic % 10 = 0) SELECT * FROM star WHERE tic NOT IN (SELECT tic FROM new) UNION ALL SELECT * FROM new")
def overwrite_by_key(s, d):
    x = star(s, d)
    return evidence.overwrite(x, x.filter("tic % 10 = 0").withColumn("lane", F.lit("moved")).select(*x.columns), ["tic"])


@query("numbered_rows", W + STAR + " SELECT tic, row_number() OVER (ORDER BY magnitude, tic) AS evidence_id FROM star")
def numbered_rows(s, d):
    return evidence.numbered(star(s, d).select("tic", "magnitude"), ["magnitude", "tic"]).select("tic", "evidence_id")


@query("lease_state", "WITH e AS (SELECT user_id, event_type, ts, lag(event_type) OVER w AS holder, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS age FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT CASE WHEN holder IS NULL THEN 'acquired' WHEN holder = event_type THEN 'refreshed' WHEN age <= 30000000000 THEN 'denied' ELSE 'taken_over' END AS outcome FROM e) SELECT outcome, count(*) AS n FROM x GROUP BY outcome")
def lease_state(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(s, d, "events").withColumn("us", us).withColumn("holder", F.lag("event_type").over(w)).withColumn("age", F.col("us") - F.lag("us").over(w))
    return e.groupBy(evidence.lease(F.col("holder"), F.col("age"), F.col("event_type"), 30000000000).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("liveness", "WITH m AS (SELECT max(epoch_us(ts)) AS top FROM events), u AS (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY user_id) SELECT user_id, CASE WHEN (top - last) / 60000000.0 < 45 THEN 'live' WHEN (top - last) / 60000000.0 <= 120 THEN 'stale' ELSE 'alarm' END AS state FROM u, m")
def liveness(s, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(s, d, "events").select("user_id", us.alias("us"))
    top = e.agg(F.max("us").alias("top"))
    return e.groupBy("user_id").agg(F.max("us").alias("last")).crossJoin(F.broadcast(top)).select("user_id", evidence.liveness((F.col("top") - F.col("last")) / 60000000.0).alias("state"))


@query("throughput_rolling", "WITH m AS (SELECT max(epoch_us(ts)) AS top FROM events), e AS (SELECT event_type, epoch_us(ts) AS us FROM events, m WHERE epoch_us(ts) >= top - 86400000000) SELECT event_type, count(*) AS n, round(CASE WHEN count(*) > 1 THEN (count(*) - 1) / ((max(us) - min(us)) / 3600000000.0::DOUBLE) END, 6) AS per_hour FROM e GROUP BY event_type")
def throughput_rolling(s, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(s, d, "events").select("event_type", us.alias("us"))
    top = e.agg(F.max("us").alias("top"))
    e = e.crossJoin(F.broadcast(top)).filter("us >= top - 86400000000")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.when(F.count(F.lit(1)) > 1, (F.count(F.lit(1)) - 1) / ((F.max("us") - F.min("us")) / 3600000000.0))).alias("per_hour"))


@query("status_tally", "SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low, round(count(*) FILTER (o_orderpriority = '5-LOW')::DOUBLE / count(*), 6) AS share FROM orders GROUP BY 1")
def status_tally(s, d):
    p = F.col("o_orderpriority")
    return table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(p == "1-URGENT").alias("urgent"), F.count_if(p == "5-LOW").alias("low"), r(F.count_if(p == "5-LOW") / F.count(F.lit(1))).alias("share"))


@query("json_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_fields(s, d):
    return table(s, d, "events").select("event_id", text.json_field("props", "$.k", "bigint").alias("k"))


@query("reason_counts", "WITH t AS (SELECT trim(w) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)) SELECT word, count(*) AS n FROM t WHERE word <> '' GROUP BY word")
def reason_counts(s, d):
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.trim("w").alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("already_searched_anti", "SELECT c_custkey AS tic FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def already_searched_anti(s, d):
    done = table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("tic"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("tic")).join(done, "tic", "left_anti")


@query("retry_semi", "SELECT c_custkey AS tic FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)")
def retry_semi(s, d):
    bad = table(s, d, "orders").filter("o_orderstatus = 'P' and o_totalprice > 300000").select(F.col("o_custkey").alias("tic"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("tic")).join(bad, "tic", "left_semi")


@query("id_sets", "WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def id_sets(s, d):
    o = table(s, d, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FO")
    count = lambda n, x: x.agg(F.lit(n).alias("op"), F.count(F.lit(1)).alias("n"))
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", a.subtract(b)))


@query("row_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)")
def row_dedup(s, d):
    return table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates().agg(F.count(F.lit(1)).alias("n"))


@query("union_of_keys", "SELECT 'customer' AS origin, c_nationkey AS nation, count(*) AS n, NULL::DOUBLE AS top FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*), round(max(s_acctbal), 2) FROM supplier GROUP BY 2")
def union_of_keys(s, d):
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("customer"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), r(F.max("s_acctbal"), 2).alias("top")).withColumn("origin", F.lit("supplier"))
    return a.unionByName(b, allowMissingColumns=True)


@query("metadata_enrichment", "WITH u AS (SELECT c_custkey AS tic, 1 AS p, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS v FROM customer UNION ALL SELECT s_suppkey, 2, s_acctbal FROM supplier WHERE s_suppkey % 3 = 0) SELECT tic, arg_max(v, p) FILTER (v IS NOT NULL) AS v FROM u GROUP BY tic")
def metadata_enrichment(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("tic"), F.lit(1).alias("p"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("v"))
    b = table(s, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("tic"), F.lit(2).alias("p"), F.col("s_acctbal").alias("v"))
    return a.union(b).groupBy("tic").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("p"))).alias("v"))


@query("coverage_state", W + EPH + ", c AS (SELECT campaign, count(DISTINCT host) AS targeted, count(DISTINCT host) FILTER (status <> 'P') AS analysed FROM eph GROUP BY campaign) SELECT campaign, targeted, analysed, CASE WHEN analysed >= targeted THEN 'completed' WHEN analysed > 0 THEN 'partial' ELSE 'unsearched' END AS state FROM c")
def coverage_state(s, d):
    c = eph(s, d).groupBy("campaign").agg(F.countDistinct("host").alias("targeted"), F.countDistinct(F.when(F.col("status") != "P", F.col("host"))).alias("analysed"))
    return c.withColumn("state", F.when(F.col("analysed") >= F.col("targeted"), "completed").when(F.col("analysed") > 0, "partial").otherwise("unsearched"))


@query("hash_sample", "SELECT c_custkey AS tic FROM customer ORDER BY sha256('seed|' || c_custkey), c_custkey LIMIT (SELECT ceil(0.05 * count(*))::BIGINT FROM customer)")
def hash_sample(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("tic"))
    return ranking.hash_sample(c, "tic", "seed", 0.05, c.count()).select("tic")


@query("round_robin", W + EPH + ", k AS (SELECT tic, camera, ccd, row_number() OVER (PARTITION BY camera, ccd ORDER BY snr DESC, tic) AS rank FROM eph) SELECT tic, camera, ccd, rank FROM k ORDER BY rank, camera, ccd LIMIT 200")
def round_robin(s, d):
    return ranking.round_robin(eph(s, d).select("tic", "camera", "ccd", "snr"), ["camera", "ccd"], [F.desc("snr"), "tic"], 200).select("tic", "camera", "ccd", "rank")


@query("quota_fill", W + EPH + ", k AS (SELECT tic, camera, ccd, snr, row_number() OVER (PARTITION BY camera, ccd ORDER BY snr DESC, tic) AS rank FROM eph), g AS (SELECT count(*) AS g FROM (SELECT DISTINCT camera, ccd FROM eph)), p AS (SELECT k.*, CASE WHEN rank <= greatest(1, 200 // (4 * g)) THEN 'quota' ELSE 'fill' END AS picked FROM k, g) SELECT tic, picked FROM p ORDER BY picked DESC, snr DESC, tic LIMIT 200")
def quota_fill(s, d):
    return ranking.quota_fill(eph(s, d).select("tic", "camera", "ccd", "snr"), ["camera", "ccd"], [F.desc("snr"), "tic"], 200, "tic").select("tic", "picked")


@query("running_budget_cut", W + EPH + ", k AS (SELECT tic, host, coalesce(sum(tic % 100 + 1) OVER (PARTITION BY host ORDER BY epoch, tic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(tic % 100 + 1) OVER (PARTITION BY host) - 300 AS excess FROM eph) SELECT tic, before < excess AS remove FROM k")
def running_budget_cut(s, d):
    e = eph(s, d).select("tic", "host", "epoch", (F.col("tic") % 100 + 1).alias("size"))
    return ranking.within_budget(e, ["host"], ["epoch", "tic"], "size", 300).select("tic", "remove")


@query("strided_pick", W + EPH + ", k AS (SELECT tic, campaign, row_number() OVER (PARTITION BY campaign ORDER BY period, tic) - 1 AS pos, count(*) OVER (PARTITION BY campaign) AS n FROM eph), x AS (SELECT *, ceil(pos * 10 / n::DOUBLE)::BIGINT AS slot FROM k) SELECT tic, campaign, pos FROM x WHERE n <= 10 OR (floor(slot * n / 10::DOUBLE)::BIGINT = pos AND slot < 10)")
def strided_pick(s, d):
    return ranking.strided(eph(s, d).select("tic", "campaign", "period"), ["campaign"], ["period", "tic"], 10).select("tic", "campaign", F.col("at").alias("pos"))


@query("farthest_points")
def farthest_points(s, d):
    """Spread-out vectors of the whole table, as archetypes are chosen for a calibration sample."""
    found = ranking.spread_out(table(s, d, "embeddings"), "vec_id", "embedding", 50)
    return s.createDataFrame(list(enumerate(found, 1)), "rank long, vec_id long")


@query("top_targets", W + STAR + " SELECT tic, magnitude FROM star ORDER BY magnitude, tic LIMIT 50")
def top_targets(s, d):
    return star(s, d).select("tic", "magnitude").orderBy("magnitude", "tic").limit(50)


@query("content_hashes", "SELECT r_regionkey, sha256(r_name) AS h FROM region")
def content_hashes(s, d):
    return table(s, d, "region").select("r_regionkey", F.sha2("r_name", 256).alias("h"))
