"""Queries over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, events, islands, kernels, population, screening, search, series
from .views import LC, LCC, STAR_EPH, lc, lcc, query, r, star_eph

W = "WITH "


@query("lc_normalize", W + LC + ", m AS (SELECT star, median(y) AS m, count(*) AS n FROM lc GROUP BY star) SELECT star, count(*) AS n, round(max(y / m), 6) AS top, round(median(y / m), 6) AS mid FROM lc JOIN m USING (star) WHERE n >= 20 AND m <> 0 GROUP BY star")
def lc_normalize(s, d):
    return series.clean(lc(s, d), least=20).groupBy("star").agg(F.count(F.lit(1)).alias("n"), r(F.max("y")).alias("top"), r(F.median("y")).alias("mid"))


@query("lc_mad", W + LC + " SELECT star, count(*) AS n, round(median(y), 6) AS median, round(1.4826 * mad(y), 6) AS scatter FROM lc GROUP BY star")
def lc_mad(s, d):
    return series.mad(lc(s, d), ["star"], "y").select("star", "n", r("median").alias("median"), r("scatter").alias("scatter"))


NOISE = "d AS (SELECT star, y - lag(y) OVER (PARTITION BY star ORDER BY t) AS dy, t - lag(t) OVER (PARTITION BY star ORDER BY t) AS dt FROM lc), noise AS (SELECT star, 1.4826 * mad(dy) / sqrt(2.0::DOUBLE) AS noise FROM d WHERE dy IS NOT NULL GROUP BY star)"


@query("lc_point_noise", W + LC + ", " + NOISE + " SELECT star, (SELECT count(*) FROM lc l WHERE l.star = n.star) AS n, round(noise, 6) AS noise FROM noise n")
def lc_point_noise(s, d):
    return series.point_noise(lc(s, d)).select("star", "n", r("noise").alias("noise"))


@query("lc_noise_3h", W + LC + ", " + NOISE + ", c AS (SELECT star, median(dt) AS cadence FROM d WHERE dy IS NOT NULL GROUP BY star) SELECT star, round(cadence, 9) AS cadence, round(noise / sqrt(greatest(1.0::DOUBLE, (3.0::DOUBLE / 24.0::DOUBLE) / cadence)) * 1e6, 2) AS noise_ppm FROM noise JOIN c USING (star)")
def lc_noise_3h(s, d):
    return series.noise_over_hours(lc(s, d)).select("star", r("cadence", 9).alias("cadence"), r("noise_ppm", 2).alias("noise_ppm"))


SEG = "g AS (SELECT star, t, y, CASE WHEN t - lag(t) OVER w > 0.5::DOUBLE THEN 1 ELSE 0 END AS cut FROM lc WINDOW w AS (PARTITION BY star ORDER BY t)), seg AS (SELECT star, t, y, sum(cut) OVER (PARTITION BY star ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g)"


@query("lc_segments", W + LC + ", " + SEG + " SELECT star, segment, count(*) AS n, round(min(t), 6) AS first, round(max(t), 6) AS last FROM seg GROUP BY star, segment")
def lc_segments(s, d):
    return islands.segments(lc(s, d), ["star"], "t", 0.5).groupBy("star", "segment").agg(F.count(F.lit(1)).alias("n"), r(F.min("t")).alias("first"), r(F.max("t")).alias("last"))


@query("lc_longest_segment", W + LC + ", " + SEG + ", c AS (SELECT star, segment, count(*) AS n FROM seg GROUP BY star, segment) SELECT star, max(n) AS n, arg_min(segment, (-n, segment)) AS segment FROM c GROUP BY star")
def lc_longest_segment(s, d):
    c = islands.segments(lc(s, d), ["star"], "t", 0.5).groupBy("star", "segment").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("star").agg(F.max("n").alias("n"), F.min_by("segment", F.struct(-F.col("n"), F.col("segment"))).alias("segment"))


@query("lc_edge_guard", W + LC + ", " + SEG + ", k AS (SELECT star, (t - min(t) OVER w >= 0.1::DOUBLE AND max(t) OVER w - t >= 0.1::DOUBLE) AS keep FROM seg WINDOW w AS (PARTITION BY star, segment)) SELECT star, count(*) AS n, count_if(keep)::BIGINT AS kept FROM k GROUP BY star")
def lc_edge_guard(s, d):
    k = series.edge_safe(islands.segments(lc(s, d), ["star"], "t", 0.5), 0.1)
    return k.groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"))


@query("lc_support", W + LC + ", " + SEG + ", k AS (SELECT star, count(*) OVER (PARTITION BY star, segment ORDER BY t RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS around FROM seg) SELECT star, min(around) AS least, max(around) AS most, sum(around)::BIGINT AS total FROM k GROUP BY star")
def lc_support(s, d):
    k = series.support(islands.segments(lc(s, d), ["star"], "t", 0.5), 0.5)
    return k.groupBy("star").agg(F.min("around").alias("least"), F.max("around").alias("most"), F.sum("around").alias("total"))


@query("lc_block_means", W + LC + ", b AS (SELECT star, y, (row_number() OVER (PARTITION BY star ORDER BY t) - 1) // 5 AS block FROM lc), m AS (SELECT star, block, avg(y) AS mean FROM b GROUP BY star, block HAVING count(*) = 5) SELECT star, count(*) AS blocks, round(max(mean), 6) AS top FROM m GROUP BY star")
def lc_block_means(s, d):
    return series.block_means(lc(s, d), ["star"], "t", "y", 5).groupBy("star").agg(F.count(F.lit(1)).alias("blocks"), r(F.max("mean")).alias("top"))


PLACED = "p AS (SELECT l.star, t, y, period, epoch, duration, round_even((t - epoch) / period, 0)::BIGINT AS cycle, abs(((t - epoch + period / 2) - period * floor((t - epoch + period / 2) / period)) - period / 2) AS off FROM lc l JOIN eph USING (star))"
DEPTHS = PLACED + ", base AS (SELECT star, median(y) AS baseline FROM p WHERE NOT off <= duration / 2 GROUP BY star), dep AS (SELECT star, cycle, count(*) AS points, baseline - median(y) AS depth FROM p JOIN base USING (star) WHERE off <= duration / 2 GROUP BY star, cycle, baseline HAVING count(*) >= 2)"
LE = W + LC + ", " + STAR_EPH + ", "


@query("lc_event_depths", LE + DEPTHS + " SELECT star, cycle, points, round(depth, 6) AS depth FROM dep")
def lc_event_depths(s, d):
    return events.event_depths(lc(s, d), star_eph(s, d)).select("star", "cycle", "points", r("depth").alias("depth"))


@query("lc_depth_consistency", LE + DEPTHS + " SELECT star, count(*) AS events, round(median(depth), 6) AS depth, CASE WHEN count(*) >= 2 AND mad(depth) > 0 THEN round(median(depth) / (1.4826 * mad(depth) / sqrt(count(*))), 6) END AS consistency FROM dep GROUP BY star")
def lc_depth_consistency(s, d):
    return events.depth_consistency(events.event_depths(lc(s, d), star_eph(s, d))).select("star", "events", r("depth").alias("depth"), r("consistency").alias("consistency"))


@query("lc_odd_even", LE + DEPTHS + " SELECT star, round(median(depth) FILTER (cycle % 2 <> 0), 6) AS odd_depth, round(median(depth) FILTER (cycle % 2 = 0), 6) AS even_depth, count(*) FILTER (cycle % 2 <> 0) AS n_odd, count(*) FILTER (cycle % 2 = 0) AS n_even FROM dep GROUP BY star")
def lc_odd_even(s, d):
    o = events.odd_even(events.event_depths(lc(s, d), star_eph(s, d)))
    return o.select("star", r("odd_depth").alias("odd_depth"), r("even_depth").alias("even_depth"), "n_odd", "n_even")


SUPPORT = NOISE + ", " + PLACED + ", sup AS (SELECT star, count(*) FILTER (off <= duration / 2) AS n_in, count(*) FILTER (off >= duration) AS n_out, median(y) FILTER (off <= duration / 2) AS i, median(y) FILTER (off >= duration) AS o, count(DISTINCT cycle) FILTER (off <= duration / 2) AS ev FROM p GROUP BY star), sup2 AS (SELECT star, n_in, n_out, n_in >= 3 AND n_out >= 20 AS sampled, CASE WHEN n_in >= 3 AND n_out >= 20 THEN o - i ELSE 0 END AS depth, CASE WHEN n_in >= 3 AND n_out >= 20 AND noise > 0 THEN (o - i) / (noise / sqrt(n_in)) ELSE 0 END AS snr, CASE WHEN n_in >= 3 AND n_out >= 20 THEN ev ELSE 0 END AS events FROM sup JOIN noise USING (star))"


def _support(s, d):
    x = lc(s, d)
    return events.ephemeris_support(x, star_eph(s, d), series.point_noise(x))


@query("lc_ephemeris_support", LE + SUPPORT + " SELECT star, n_in, n_out, sampled, round(depth, 6) AS depth, round(snr, 6) AS snr, events FROM sup2")
def lc_ephemeris_support(s, d):
    return _support(s, d).select("star", "n_in", "n_out", "sampled", r("depth").alias("depth"), r("snr").alias("snr"), "events")


SECOND = "h AS (SELECT star, y, duration, off, abs(((t - (epoch + period / 2) + period / 2) - period * floor((t - (epoch + period / 2) + period / 2) / period)) - period / 2) AS off2 FROM p), sec AS (SELECT star, count(*) FILTER (off2 <= duration / 2) AS n_secondary, median(y) FILTER (off2 >= duration AND off >= duration) - median(y) FILTER (off2 <= duration / 2) AS secondary_depth FROM h GROUP BY star)"


@query("lc_secondary", LE + PLACED + ", " + SECOND + " SELECT star, n_secondary, round(secondary_depth, 6) AS secondary_depth FROM sec")
def lc_secondary(s, d):
    return events.secondary(lc(s, d), star_eph(s, d)).select("star", "n_secondary", r("secondary_depth").alias("secondary_depth"))


@query("lc_event_support", LE + PLACED + ", x AS (SELECT star, cycle, duration, ((t - epoch + period / 2) - period * floor((t - epoch + period / 2) / period)) - period / 2 AS x FROM p), e AS (SELECT star, cycle, count(*) FILTER (abs(x) <= duration / 2) AS i, count(*) FILTER (x <= -duration) AS b, count(*) FILTER (x >= duration) AS a FROM x WHERE abs(x) <= 3 * duration GROUP BY star, cycle) SELECT star, count(*) AS events, count(*) FILTER (i >= 3 AND b >= 3 AND a >= 3) AS supported FROM e GROUP BY star")
def lc_event_support(s, d):
    return events.event_support(lc(s, d), star_eph(s, d))


@query("lc_phase_curve", LE + "b AS (SELECT star, least(floor(((t - epoch + period / 2) - period * floor((t - epoch + period / 2) / period)) / period * 20)::BIGINT, 19) AS bin, y FROM lc JOIN eph USING (star)) SELECT star, bin, count(*) AS points, round(median(y), 6) AS level FROM b GROUP BY star, bin")
def lc_phase_curve(s, d):
    return events.phase_curve(lc(s, d), star_eph(s, d), 20).select("star", "bin", "points", r("level").alias("level"))


@query("lc_secondary_scan", LE + PLACED + """, sc AS (SELECT star, 1.4826 * mad(y) AS scatter FROM lc GROUP BY star), x AS (SELECT star, y, period, duration, ((t - epoch + period / 2) - period * floor((t - epoch + period / 2) / period)) - period / 2 AS x FROM p),
k AS (SELECT *, floor((x + period / 2) / (duration / 2))::BIGINT AS pos FROM x WHERE abs(x) >= 1.5::DOUBLE * duration), b AS (SELECT star, median(y) AS base FROM k GROUP BY star),
w AS (SELECT star, win AS slot, median(y) AS level, count(*) AS n FROM (SELECT star, y, unnest([pos - 1, pos]) AS win FROM k) GROUP BY star, win HAVING count(*) >= 3),
v AS (SELECT star, slot, (base - level) / (1.2533141373155003::DOUBLE * scatter / sqrt(n)) AS snr FROM w JOIN b USING (star) JOIN sc USING (star) WHERE scatter > 0)
SELECT star, count(*) AS windows, round(max(snr), 6) AS snr, arg_max(slot, (snr, -slot)) AS slot FROM v GROUP BY star""")
def lc_secondary_scan(s, d):
    x = lc(s, d)
    return events.secondary_scan(x, star_eph(s, d), series.mad(x, ["star"], "y")).select("star", "windows", r("snr").alias("snr"), "slot")


@query("lc_mask_events", LE + PLACED + " SELECT star, count(*) AS n, count(*) FILTER (off <= duration / 2) AS masked FROM (SELECT star, t, any_value(off) AS off, any_value(duration) AS duration FROM p GROUP BY star, t) GROUP BY star")
def lc_mask_events(s, d):
    return events.masked(lc(s, d), star_eph(s, d).withColumn("seq", F.lit(1))).groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("masked"))


@query("lc_inject_box", LE + PLACED + " SELECT star, count(*) FILTER (off <= duration / 2) AS touched, round(sum(CASE WHEN off <= duration / 2 THEN y - 0.5::DOUBLE ELSE y END), 4) AS total FROM p GROUP BY star")
def lc_inject_box(s, d):
    e = star_eph(s, d).withColumn("depth", F.lit(0.5))
    touched = events.placed(lc(s, d), e).groupBy("star").agg(F.count_if(F.col("offset") <= F.col("duration") / 2).alias("touched"))
    return events.injected(lc(s, d), e).groupBy("star").agg(r(F.sum("y"), 4).alias("total")).join(touched, "star").select("star", "touched", "total")


@query("lc_invert", W + LC + ", m AS (SELECT star, median(y) AS m FROM lc GROUP BY star) SELECT star, round(max(2 * m - y), 6) AS top, round(median(2 * m - y), 6) AS mid FROM lc JOIN m USING (star) GROUP BY star")
def lc_invert(s, d):
    return calibration.inverted(lc(s, d)).groupBy("star").agg(r(F.max("y")).alias("top"), r(F.median("y")).alias("mid"))


GRID = "grid AS (SELECT i AS grid, 1.0::DOUBLE / (1.0::DOUBLE / 1.0::DOUBLE - i::DOUBLE * ((1.0::DOUBLE / 1.0::DOUBLE - 1.0::DOUBLE / 6.0::DOUBLE) / 59)) AS trial FROM range(60) g(i))"
BOX = GRID + """, tot AS (SELECT star, count(*) AS n, sum(y) AS s FROM lcc GROUP BY star), box AS (SELECT star, grid, trial, least(floor((t - trial * floor(t / trial)) / trial * 30)::BIGINT, 29) AS bin, count(*) AS k, sum(y) AS b FROM lcc, grid GROUP BY ALL),
pw AS (SELECT star, grid, trial, bin, k, (s - b) / (n - k) - b / k AS depth, 0.5::DOUBLE * pow((s - b) / (n - k) - b / k, 2) / (1.0::DOUBLE / k + 1.0::DOUBLE / (n - k)) AS power FROM box JOIN tot USING (star) WHERE n > k)"""


@query("lc_bls_relational", W + LCC + ", " + BOX + ", q AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY round(power, 9) DESC, grid, bin) AS rn FROM pw WHERE depth > 0) SELECT star, grid, bin, k, round(depth, 6) AS depth, round(power, 4) AS power FROM q WHERE rn = 1")
def lc_bls_relational(s, d):
    p = search.box_powers(lcc(s, d), search.period_table(s, 1.0, 6.0, 60), 30)
    return search.best_box(p).select("star", "grid", "bin", "k", r("depth").alias("depth"), r("power", 4).alias("power"))


@query("lc_detection_efficiency", W + LCC + ", " + BOX + ", g AS (SELECT star, grid, max(power) AS power FROM pw WHERE depth > 0 GROUP BY star, grid) SELECT star, round((max(power) - avg(power)) / stddev_pop(power), 5) AS sde FROM g GROUP BY star")
def lc_detection_efficiency(s, d):
    p = search.box_powers(lcc(s, d), search.period_table(s, 1.0, 6.0, 60), 30).groupBy("star", "grid").agg(F.max("power").alias("power"))
    return search.detection_efficiency(p).select("star", r("sde", 5).alias("sde"))


@query("lc_detrend_biweight")
def lc_detrend_biweight(s, d):
    return kernels.detrended(lc(s, d), 3.0, 2.0).groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.median("y").alias("mid"))


@query("lc_detrend_savgol")
def lc_detrend_savgol(s, d):
    return kernels.detrended(lc(s, d), 3.0, 2.0, "savgol").groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.median("y").alias("mid"))


@query("lc_scramble")
def lc_scramble(s, d):
    return kernels.scrambled(lc(s, d), 0.5, 7).groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.median("y").alias("mid"))


@query("lc_bootstrap")
def lc_bootstrap(s, d):
    return kernels.bootstrap_medians(lc(s, d), "y", 64, 7)


@query("lc_edge_bias")
def lc_edge_bias(s, d):
    return kernels.edge_bias(lc(s, d), 3.0, 1, 7).groupBy("from_edge").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("bias") * F.col("bias"))).alias("rms"), F.percentile(F.abs("bias"), F.lit(0.95)).alias("p95"))


@query("lc_posterior")
def lc_posterior(s, d):
    x = series.clean(lcc(s, d))
    e = x.select("star").distinct().select("star", F.lit(2.5).alias("period"), F.lit(0.4).alias("epoch"), F.lit(8.0).alias("a_over_r"))
    return kernels.posterior(x, e, 60, 7)


@query("lc_screening", LE + SUPPORT + ", " + SECOND + """, m AS (SELECT star, median(y) AS m FROM lc GROUP BY star), f AS (SELECT star, period, duration * 24 AS duration_h, snr, events, CASE WHEN depth > 0 THEN depth / m * 1e6 ELSE 0 END AS depth_ppm, secondary_depth / noise * sqrt(n_secondary) AS ssnr FROM sup2 JOIN eph USING (star) JOIN m USING (star) JOIN sec USING (star) JOIN noise USING (star)),
g AS (SELECT *, snr < 7.1::DOUBLE AS a, events < 2 AS b, coalesce(ssnr > 3, false) AS c, duration_h / (period * 24) > 0.15::DOUBLE AS du, depth_ppm > 50000 AS e, greatest(0, snr - 7.1::DOUBLE) AS over FROM f),
hh AS (SELECT *, a::INT + b::INT + c::INT + du::INT + e::INT AS n FROM g)
SELECT star, round(snr, 6) AS snr, CASE WHEN n = 0 THEN 'automated_survivor' WHEN b AND snr >= 7.1::DOUBLE AND NOT (c OR du OR e) THEN 'single_event_lead' WHEN a AND n = 1 THEN 'no_transit_detected' ELSE 'screened_rejected' END AS class,
CASE WHEN n = 0 THEN least(99, 75 + floor(over / 2)::INT) WHEN b AND snr >= 7.1::DOUBLE AND NOT (c OR du OR e) THEN least(94, 65 + floor(over / 3)::INT) WHEN a AND n = 1 THEN 5 ELSE 15 END AS priority,
concat_ws('; ', CASE WHEN a THEN 'white-noise BLS depth S/N is below 7.1' END, CASE WHEN b THEN 'fewer than two transit events are represented' END, CASE WHEN c THEN 'a secondary eclipse is detected above 3 sigma' END, CASE WHEN du THEN 'the fitted transit duty cycle exceeds 15 percent' END, CASE WHEN e THEN 'the fitted transit depth exceeds 5 percent' END) AS reasons FROM hh""")
def lc_screening(s, d):
    """Flagship: support at a fixed ephemeris, flags, reasons, class and priority of every star."""
    x, e = lc(s, d), star_eph(s, d)
    noise = series.point_noise(x)
    mid = x.groupBy("star").agg(F.median("y").alias("m"))
    f = events.ephemeris_support(x, e, noise).join(e, "star").join(mid, "star").join(events.secondary(x, e), "star").join(noise.select("star", "noise"), "star")
    f = f.select("star", "period", (F.col("duration") * 24).alias("duration_h"), "snr", "events", F.when(F.col("depth") > 0, F.col("depth") / F.col("m") * 1e6).otherwise(0.0).alias("depth_ppm"), F.lit(None).cast("double").alias("odd_even_sigma"), (F.col("secondary_depth") / F.col("noise") * F.sqrt("n_secondary")).alias("secondary_snr"), F.lit(False).alias("review"), F.lit(False).alias("eb_lane"))
    out = screening.classify(screening.flags(f))
    return out.select("star", r("snr").alias("snr"), "class", "priority", F.concat_ws("; ", screening.reasons()).alias("reasons"))


@query("lc_red_noise", W + LC + ", " + NOISE + ", b AS (SELECT star, y, (row_number() OVER (PARTITION BY star ORDER BY t) - 1) // 4 AS block FROM lc), m AS (SELECT star, block, avg(y) AS mean FROM b GROUP BY star, block HAVING count(*) = 4), s AS (SELECT star, 1.4826 * mad(mean) AS sc, count(*) AS n FROM m GROUP BY star HAVING count(*) >= 4) SELECT star, CASE WHEN noise / 2 > 0 THEN round(least(25.0::DOUBLE, greatest(1.0::DOUBLE, sc / (noise / 2))), 5) END AS factor FROM s JOIN noise USING (star)")
def lc_red_noise(s, d):
    x = lc(s, d)
    n = series.point_noise(x).select("star", "noise").withColumn("k", F.lit(4))
    return screening.red_noise(series.block_means(x, ["star"], "t", "y", 4), n, "k").select("star", r("factor", 5).alias("factor"))


FLAGS = "per AS (SELECT star, median(y) AS med, 1.4826 * mad(y) AS sc, count(*) AS n FROM lc GROUP BY star), bins AS (SELECT star, cohort, floor(t / (30.0::DOUBLE / 1440.0::DOUBLE * 8))::BIGINT AS bin, median(y) AS level, count(*) AS points FROM lc GROUP BY ALL HAVING count(*) >= 2), flags AS (SELECT star, cohort, bin, points, (med - level) / (1.2533141373155003::DOUBLE * sc / sqrt(points)) AS sig FROM bins JOIN per USING (star) WHERE n >= 10 AND sc > 0)"
WIDE = population.BIN_DAYS * 8


def _flags(s, d):
    return population.dip_flags(lc(s, d), width=WIDE, keep=("cohort",))


@query("dip_flags", W + LC + ", " + FLAGS + " SELECT star, cohort, bin, points, round(sig, 6) AS significance, sig > 3 AS dipped FROM flags")
def dip_flags(s, d):
    return _flags(s, d).select("star", "cohort", "bin", "points", r("significance").alias("significance"), "dipped")


COUNTS = FLAGS + ", counts AS (SELECT cohort, bin, count(*) AS observed, count(*) FILTER (sig > 0.5::DOUBLE) AS dips FROM flags GROUP BY cohort, bin)"


def _counts(s, d):
    f = _flags(s, d).withColumn("dipped", F.col("significance") > 0.5)
    return population.bin_counts(f, ["cohort"])


@query("dip_registry", W + LC + ", " + COUNTS + " SELECT * FROM counts")
def dip_registry(s, d):
    return _counts(s, d)


@query("dip_windows", W + LC + ", " + COUNTS + ", bad AS (SELECT *, bin - row_number() OVER (PARTITION BY cohort ORDER BY bin) AS g FROM counts WHERE observed >= 3 AND dips::DOUBLE / observed >= 0.3::DOUBLE) SELECT cohort, round(min(bin) * (30.0::DOUBLE / 1440.0::DOUBLE * 8), 6) AS start, round((max(bin) + 1) * (30.0::DOUBLE / 1440.0::DOUBLE * 8), 6) AS stop, count(*) AS bins, round(max(dips::DOUBLE / observed), 6) AS peak FROM bad GROUP BY cohort, g")
def dip_windows(s, d):
    w = population.dip_windows(_counts(s, d), ["cohort"], 3, 0.3, WIDE)
    return w.select("cohort", r("start").alias("start"), r("stop").alias("stop"), "bins", r("peak").alias("peak"))


@query("interval_veto", W + LC + ", " + COUNTS + ", bad AS (SELECT *, bin - row_number() OVER (PARTITION BY cohort ORDER BY bin) AS g FROM counts WHERE observed >= 3 AND dips::DOUBLE / observed >= 0.3::DOUBLE), win AS (SELECT cohort, min(bin) * (30.0::DOUBLE / 1440.0::DOUBLE * 8) AS start, (max(bin) + 1) * (30.0::DOUBLE / 1440.0::DOUBLE * 8) AS stop FROM bad GROUP BY cohort, g) SELECT l.cohort, star, count(*) AS hits FROM lc l JOIN win w ON l.cohort = w.cohort AND t BETWEEN start AND stop GROUP BY l.cohort, star")
def interval_veto(s, d):
    from ..operators.joins import interval_join

    w = population.dip_windows(_counts(s, d), ["cohort"], 3, 0.3, WIDE)
    return interval_join(lc(s, d), w, ["cohort"], "t", "start", "stop", WIDE).groupBy("cohort", "star").agg(F.count(F.lit(1)).alias("hits"))


#: Binomial tails as sums of their terms.
ARTIFACTS = COUNTS + """, bg AS (SELECT cohort, sum(dips)::DOUBLE / sum(observed) AS p FROM counts GROUP BY cohort),
te AS (SELECT cohort, bin, dips::DOUBLE / observed AS share, CASE WHEN dips = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(dips, observed + 1), lambda i: exp(lgamma(observed + 1) - lgamma(i + 1) - lgamma(observed - i + 1) + i * ln(p) + (observed - i) * ln(1 - p))))) END AS tail FROM counts JOIN bg USING (cohort) WHERE observed >= 3),
ba AS (SELECT *, bin - row_number() OVER (PARTITION BY cohort ORDER BY bin) AS g FROM te WHERE tail <= 0.05::DOUBLE), ru AS (SELECT cohort, g, min(bin) AS first, max(bin) AS last, arg_max({'bin': bin, 'share': share, 'tail': tail}, (share, -bin)) AS p FROM ba GROUP BY cohort, g),
rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p.share DESC, p.bin) AS rank FROM ru)"""


@query("artifact_epochs", W + LC + ", " + ARTIFACTS + " SELECT cohort, rank, p.bin AS bin, round(p.share, 6) AS share, round(p.tail, 9) AS tail, first, last FROM rk WHERE rank <= 5")
def artifact_epochs(s, d):
    a = population.artifact_bins(_counts(s, d), ["cohort"], 0.05, 3, 5)
    return a.select("cohort", F.col("rank").cast("long").alias("rank"), "bin", r("share").alias("share"), r("tail", 9).alias("tail"), "first", "last")


@query("rle_encode", W + LC + ", b AS (SELECT DISTINCT star, floor(t)::BIGINT AS bin FROM lc), g AS (SELECT star, bin, bin - row_number() OVER (PARTITION BY star ORDER BY bin) AS g FROM b), s AS (SELECT star, min(bin) AS first, max(bin) AS last FROM g GROUP BY star, g) SELECT star, string_agg(first || '-' || last, ',' ORDER BY first) AS spans FROM s GROUP BY star")
def rle_encode(s, d):
    e = islands.encode_runs(lc(s, d).withColumn("bin", F.floor("t")), ["star"], "bin")
    return e.select("star", F.array_join(F.transform("spans", lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string"))), ",").alias("spans"))


@query("rle_round_trip", W + LC + " SELECT DISTINCT star, floor(t)::BIGINT AS bin FROM lc")
def rle_round_trip(s, d):
    e = islands.encode_runs(lc(s, d).withColumn("bin", F.floor("t")), ["star"], "bin")
    return islands.decode_runs(e, ["star"], "bin")


@query("granularity_replay", W + LC + ", " + FLAGS + " SELECT cohort, bin, count(*) AS observed, count(*) FILTER (sig > 0.5::DOUBLE) AS dips FROM flags GROUP BY GROUPING SETS ((cohort, bin), (bin), (cohort))")
def granularity_replay(s, d):
    f = _flags(s, d).withColumn("dipped", F.col("significance") > 0.5)
    return f.groupingSets([[F.col("cohort"), F.col("bin")], [F.col("bin")], [F.col("cohort")]], "cohort", "bin").agg(F.count(F.lit(1)).alias("observed"), F.count_if("dipped").alias("dips"))


@query("longest_day_run", W + LC + ", b AS (SELECT DISTINCT star, floor(t)::BIGINT AS bin FROM lc), g AS (SELECT star, bin, bin - row_number() OVER (PARTITION BY star ORDER BY bin) AS g FROM b), s AS (SELECT star, least(count(*), 3) AS n, max(bin) AS last FROM g GROUP BY star, g), k AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY n DESC, last DESC) AS rn FROM s) SELECT star, last - n + 1 AS first, last, n FROM k WHERE rn = 1")
def longest_day_run(s, d):
    return islands.longest_run(lc(s, d).withColumn("bin", F.floor("t")), ["star"], "bin", 3)


@query("compact_days", W + LC + ", b AS (SELECT DISTINCT star, floor(t)::BIGINT AS bin FROM lc), f AS (SELECT star, bin, lead(bin, 3) OVER (PARTITION BY star ORDER BY bin) AS far FROM b), k AS (SELECT star, bin AS first, far AS last, far - bin AS span, row_number() OVER (PARTITION BY star ORDER BY far - bin, bin) AS rn FROM f WHERE far IS NOT NULL) SELECT star, first, last, span FROM k WHERE rn = 1")
def compact_days(s, d):
    return islands.compact_window(lc(s, d).withColumn("bin", F.floor("t")), ["star"], "bin", 4)
