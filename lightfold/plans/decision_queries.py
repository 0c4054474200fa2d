"""Queries over choices that follow from ordered rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from .views import EPH, eph, query, table

W = "WITH "


@query("followup_queue", W + EPH + """, p AS (SELECT tic, CASE WHEN snr < 7.1::DOUBLE THEN 15 WHEN events >= 2 THEN least(99, 75 + floor((snr - 7.1::DOUBLE) / 2)::INT) WHEN events = 1 THEN least(94, 65 + floor((snr - 7.1::DOUBLE) / 3)::INT) ELSE 15 END AS priority FROM eph)
SELECT tic, priority, row_number() OVER (ORDER BY priority DESC, tic) AS rank FROM p WHERE priority >= 50""")
def followup_queue(s, d):
    """Fits worth a closer look, ranked by the priority of a clean survivor or single event."""
    over = F.col("snr") - 7.1
    priority = F.when(F.col("snr") < 7.1, 15).when(F.col("events") >= 2, F.least(F.lit(99), 75 + F.floor(over / 2))).when(F.col("events") == 1, F.least(F.lit(94), 65 + F.floor(over / 3))).otherwise(15)
    return decisions.followup_queue(eph(s, d).select("tic", priority.cast("int").alias("priority")), "tic").select("tic", "priority", "rank")


@query("sector_choice", W + EPH + """, l AS (SELECT host, list(camera * 10 + ccd ORDER BY tic)[1:2] AS discovery, list_distinct(list(camera * 10 + ccd)) AS own FROM eph GROUP BY host), a AS (SELECT host, discovery, list_concat(own, [host % 60, host % 45]) AS available FROM l),
f AS (SELECT host, discovery, list_distinct(list_filter(available, lambda x: NOT list_contains(discovery, x))) AS free, list_max(discovery) AS top FROM a)
SELECT host, array_to_string(list_concat([discovery[1]], list_concat(list_reverse_sort(list_filter(free, lambda x: x > top)), list_reverse_sort(list_filter(free, lambda x: x <= top)))[1:2]), ',') AS sectors FROM f""")
def sector_choice(s, d):
    """The discovery sector and two independent ones, later ones first."""
    sector = (F.col("camera") * 10 + F.col("ccd")).cast("long")
    l = eph(s, d).groupBy("host").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("tic", sector.alias("x")))), lambda v: v["x"]), 1, 2).alias("discovery"), F.collect_set(sector).alias("own"))
    available = F.concat("own", F.array(F.col("host") % 60, F.col("host") % 45))
    return l.select("host", F.array_join(decisions.choose_sectors(F.col("discovery"), available), ",").alias("sectors"))


@query("tightest_cover", W + """f AS (SELECT lo, hi, min(entry) AS entry FROM (SELECT p_partkey AS entry, p_partkey % 60 AS lo, p_partkey % 60 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS hi FROM part) GROUP BY ALL),
q AS (SELECT s_suppkey AS request, [s_suppkey % 50, s_suppkey % 50 + s_suppkey % 7, s_suppkey % 50 + 3] AS sectors FROM supplier), one AS (SELECT request, sector, entry FROM (SELECT DISTINCT request, unnest(sectors) AS sector FROM q) JOIN f ON lo = sector AND hi = sector),
k AS (SELECT request, entry, lo, hi, row_number() OVER (PARTITION BY request ORDER BY hi - lo, entry) AS rn FROM q JOIN f ON lo < hi AND lo <= list_min(sectors) AND hi >= list_max(sectors))
SELECT request, sector AS place, entry, sector AS lo, sector AS hi FROM one UNION ALL SELECT request, 1099511627776, entry, lo, hi FROM k WHERE rn = 1""")
def tightest_cover(s, d):
    """The files to read for the sectors asked: one a sector, and the narrowest that covers all."""
    p, k = F.col("p_partkey"), F.col("s_suppkey")
    files = table(s, d, "part").select(p.alias("entry"), (p % 60).alias("lo"), (p % 60 + F.when(p % 3 == 0, 0).otherwise(F.col("p_size"))).cast("long").alias("hi"))
    asked = table(s, d, "supplier").select(k.alias("request"), F.array(k % 50, k % 50 + k % 7, k % 50 + 3).alias("sectors"))
    return decisions.select_files(asked, files)


@query("kernel_comparison", W + EPH + """, old AS (SELECT tic, status, period, depth_ppm, CASE WHEN events > 0 THEN snr END AS snr FROM eph WHERE tic % 10 <> 3), new AS (SELECT tic, CASE WHEN tic % 5 = 0 THEN 'R' ELSE status END AS status, CASE WHEN tic % 7 = 0 THEN period * 2 ELSE period END AS period, depth_ppm, CASE WHEN events > 0 THEN snr END AS snr FROM eph WHERE tic % 10 <> 4)
SELECT o.status AS before, n.status AS after, CASE WHEN o.status IS NOT DISTINCT FROM n.status THEN 'unchanged' WHEN o.period IS NOT DISTINCT FROM n.period AND o.depth_ppm IS NOT DISTINCT FROM n.depth_ppm AND o.snr IS NOT DISTINCT FROM n.snr THEN 'verdict_only' ELSE 'detection_moved' END AS cause, count(*) AS n FROM old o JOIN new n USING (tic) GROUP BY ALL""")
def kernel_comparison(s, d):
    """Two campaigns over the same stars: transitions, and whether the detection moved or only the verdict."""
    e = eph(s, d).select("tic", "status", "period", "depth_ppm", F.when(F.col("events") > 0, F.col("snr")).alias("snr"))
    k = F.col("tic")
    new = e.withColumn("status", F.when(k % 5 == 0, "R").otherwise(F.col("status"))).withColumn("period", F.when(k % 7 == 0, F.col("period") * 2).otherwise(F.col("period"))).filter(k % 10 != 4)
    return decisions.compare_campaigns(e.filter(k % 10 != 3), new, ["period", "depth_ppm", "snr"])
