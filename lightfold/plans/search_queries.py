"""Queries over whole periodic searches, alias ladders and single events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ALIAS_RATIOS
from ..operators import boxsearch, calibration, events, injection, rolling, search, series
from .series_queries import NOISE
from .views import LC, LCC, STAR_EPH, lc, lcc, query, r, star_eph

W = "WITH "
#: Some 60 trial periods over the month that the table covers.
GRID = boxsearch.Periodic(low=1.0, high=6.0, hours=(2.4, 4.8, 9.6), factor=127.0)
#: As in production: some 20,000 trial periods over that month.
FULL = boxsearch.Periodic()


def known_sql(s: boxsearch.Periodic) -> str:
    reach = f"({1.0 / s.low!r}::DOUBLE - 1.0::DOUBLE / least({s.high}::DOUBLE, span))"
    return f"""{NOISE.replace("FROM lc)", "FROM lcc)")}, f0 AS (SELECT star, count(*) AS n, min(t) AS first, max(t) - min(t) AS span, median(y) AS level FROM lcc GROUP BY star),
f1 AS (SELECT *, greatest({s.factor}::DOUBLE, {reach} * span * span / {s.most * s.days[0]!r}::DOUBLE) * {s.days[0]!r}::DOUBLE / (span * span) AS step, {reach} AS reach FROM f0 JOIN noise USING (star) WHERE noise > 0 AND span > {s.low}),
f AS (SELECT *, 1 + round_even(reach / step, 0)::BIGINT AS trials FROM f1)"""


def powers_sql(s: boxsearch.Periodic, shape: str = "box") -> str:
    """pw: the strongest dip at each trial period, from dense phase bins that run on over the end of the phase."""
    head = f"""{known_sql(s)}, tr AS (SELECT f.*, i AS grid, 1.0::DOUBLE / ({1.0 / s.low!r}::DOUBLE - step * i) AS period FROM f, unnest(range(trials)) g(i)),
hist AS (SELECT star, grid, least(floor(((t - first) % period) / {s.side!r}::DOUBLE)::BIGINT, ceil(period / {s.side!r}::DOUBLE)::BIGINT - 1) AS bin, count(*) AS k, sum(y - level) AS s FROM lcc JOIN tr USING (star) GROUP BY ALL),
dense AS (SELECT tr.star, tr.grid, j, bins, coalesce(k, 0) AS k, coalesce(s, 0) AS s FROM (SELECT *, ceil(period / {s.side!r}::DOUBLE)::BIGINT AS bins FROM tr) tr, unnest(range(bins + {max(s.widths) - 1})) u(j) LEFT JOIN hist h ON h.star = tr.star AND h.grid = tr.grid AND h.bin = j % bins),
tot AS (SELECT star, sum(y - level) AS total FROM lcc JOIN f USING (star) GROUP BY star)"""
    if shape == "box":
        cols = ", ".join(f"sum(k) OVER w{w} AS k{w}, sum(s) OVER w{w} AS s{w}" for w in s.widths)
        frames = ", ".join(f"w{w} AS (PARTITION BY star, grid ORDER BY j ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)" for w in s.widths)
        each = " UNION ALL ".join(f"SELECT star, grid, {w} AS w, j, k{w} AS k, s{w} AS s FROM win WHERE j < bins AND bins >= {w}" for w in s.widths)
        fit = f"""win AS (SELECT star, grid, j, bins, {cols} FROM dense WINDOW {frames}), each AS ({each}),
fit AS (SELECT star, grid, w, j, (total - s) / (n - k) - s / k AS depth, k AS weight, noise * sqrt(1.0::DOUBLE / k + 1.0::DOUBLE / (n - k)) AS error FROM each JOIN tot USING (star) JOIN f USING (star) WHERE k > 0 AND k < n)"""
    else:
        bank = ", ".join(f"({w}, {i}, {float(x)!r}::DOUBLE)" for w in s.widths for i, x in enumerate(boxsearch.profile(w)))
        fit = f"""bank AS (SELECT * FROM (VALUES {bank}) b(w, i, shape)), each AS (SELECT star, grid, w, j - i AS j, sum(k * shape * shape) AS weight, sum(s * shape) AS s FROM dense, bank WHERE j >= i AND j - i < bins AND bins >= w AND k > 0 GROUP BY ALL),
fit AS (SELECT star, grid, w, j, -s / weight AS depth, weight, noise / sqrt(weight) AS error FROM each JOIN f USING (star) WHERE weight > 0)"""
    return head + ", " + fit + f""", ranked AS (SELECT *, 0.5::DOUBLE * weight * pow(depth / noise, 2) AS power FROM fit JOIN f USING (star) WHERE depth >= 0),
pw AS (SELECT star, grid, period, coalesce(power, 0) AS power FROM tr LEFT JOIN (SELECT star, grid, max(power) AS power FROM ranked GROUP BY star, grid) USING (star, grid))"""


POWERS = LCC + ", " + powers_sql(GRID)
BEST = "best AS (SELECT star, grid, period, power FROM (SELECT *, row_number() OVER (PARTITION BY star ORDER BY round(power, 9) DESC, grid) AS rn FROM pw) WHERE rn = 1)"


def _powers(s, d, shape="box"):
    x = lcc(s, d)
    return boxsearch.powers(x, GRID, boxsearch.facts(x, GRID, fallback=False), shape)


@query("lc_box_powers", W + POWERS + " SELECT star, grid, round(period, 6) AS period, round(power, 4) AS power FROM pw")
def lc_box_powers(s, d):
    return _powers(s, d).select("star", "grid", r("period").alias("period"), r("power", 4).alias("power"))


@query("lc_bls_kernel", W + POWERS + ", " + BEST + " SELECT star, grid, round(period, 6) AS period, round(power, 4) AS power FROM best")
def lc_bls_kernel(s, d):
    """The strongest trial period of each long series."""
    best = _powers(s, d).groupBy("star").agg(F.max_by(F.struct("grid", "period", "power"), F.struct(F.round("power", boxsearch.DIGITS), -F.col("grid"))).alias("b"))
    return best.select("star", "b.grid", r("b.period").alias("period"), r("b.power", 4).alias("power"))


#: Greedy choice along falling power: a peak is kept if it lies apart from all kept before.
PEAKS = """o AS (SELECT star, grid, period, power, row_number() OVER (PARTITION BY star ORDER BY round(power, 9) DESC, grid) AS i FROM pw),
walk AS (SELECT star, i, [period] AS kept, true AS taken FROM o WHERE i = 1 UNION ALL SELECT o.star, o.i, CASE WHEN x THEN list_append(kept, period) ELSE kept END, x FROM (SELECT o.star, o.i, o.period, kept, len(list_filter(kept, lambda k: abs(o.period - k) / least(o.period, k) < 0.02)) = 0 AND len(kept) < 64 AS x FROM walk JOIN o ON o.star = walk.star AND o.i = walk.i + 1) o),
peaks AS (SELECT star, grid, period, power, row_number() OVER (PARTITION BY star ORDER BY i) AS rank, power / max(power) OVER (PARTITION BY star) AS share FROM walk JOIN o USING (star, i) WHERE taken)"""


@query("lc_peaks", W + "RECURSIVE " + POWERS + ", " + PEAKS + " SELECT star, rank, grid, round(power, 4) AS power, round(share, 6) AS share FROM peaks")
def lc_peaks(s, d):
    return boxsearch.distinct_peaks(_powers(s, d)).select("star", F.col("rank").cast("long").alias("rank"), "grid", r("power", 4).alias("power"), r("share").alias("share"))


@query("lc_near_ties", W + "RECURSIVE " + POWERS + ", " + PEAKS.replace(" AND len(kept) < 64", "") + " SELECT star, rank, grid, round(share, 6) AS share FROM peaks WHERE rank = 1 OR share >= 0.8::DOUBLE")
def lc_near_ties(s, d):
    """All peaks within a fifth of the best (a thousandth in production; these series have no signal)."""
    p = boxsearch.distinct_peaks(_powers(s, d), most=None)
    return p.filter((F.col("rank") == 1) | (F.col("share") >= 0.8)).select("star", F.col("rank").cast("long").alias("rank"), "grid", r("share").alias("share"))


@query("lc_harmonic_powers", W + POWERS + ", " + BEST + """, h AS (SELECT * FROM (VALUES ('third', 1.0::DOUBLE / 3), ('half', 0.5::DOUBLE), ('double', 2.0::DOUBLE), ('triple', 3.0::DOUBLE)) v(harmonic, factor))
SELECT b.star, harmonic, round(max(p.power) / any_value(b.power), 6) AS share FROM best b, h JOIN pw p ON p.star = b.star AND abs(p.period - b.period * factor) <= 0.05::DOUBLE * b.period * factor GROUP BY ALL""")
def lc_harmonic_powers(s, d):
    p = _powers(s, d)
    best = p.groupBy("star").agg(F.max_by(F.struct("period", "power"), F.struct(F.round("power", boxsearch.DIGITS), -F.col("grid"))).alias("b")).select("star", "b.*")
    return search.harmonic_powers(p, best, 0.05).select("star", "harmonic", r("share").alias("share"))


@query("lc_template_search", W + LCC + ", " + powers_sql(GRID, "transit") + """, chi AS (SELECT star, sum(pow((y - level) / noise, 2)) AS chi2 FROM lcc JOIN f USING (star) GROUP BY star),
rest AS (SELECT star, grid, period, power, chi2 - 2 * power AS rest FROM pw JOIN chi USING (star)), sr AS (SELECT *, min(rest) OVER (PARTITION BY star) / rest AS sr FROM rest),
b AS (SELECT star, grid, period, row_number() OVER (PARTITION BY star ORDER BY round(power, 9) DESC, grid) AS rn FROM pw)
SELECT star, round((1 - avg(sr)) / stddev_pop(sr), 4) AS sde, round(any_value(b.period), 6) AS period FROM sr JOIN (SELECT star, period FROM b WHERE rn = 1) b USING (star) GROUP BY star""")
def lc_template_search(s, d):
    """Significance of the best transit-shaped signal of each long series."""
    x = lcc(s, d)
    known = boxsearch.facts(x, GRID, fallback=False)
    chi2 = x.join(known.select("star", "level", "noise"), "star").groupBy("star").agg(F.sum(F.pow((F.col("y") - F.col("level")) / F.col("noise"), F.lit(2.0))).alias("chi2"))
    return boxsearch.significance(boxsearch.powers(x, GRID, known, "transit"), known, chi2).select("star", r("sde", 4).alias("sde"), r("period").alias("period"))


@query("lc_search")
def lc_search(s, d):
    """The whole box search of every star: near ties, observed events, parity, secondary."""
    wide = boxsearch.Periodic(low=1.0, high=6.0, hours=(6.0, 12.0), factor=60.0)
    return boxsearch.search_transits(lc(s, d), wide)


@query("lc_template_decision")
def lc_template_decision(s, d):
    """The second decider against the best box period of each long series, over all periods, durations and steps of a search by default."""
    x = lcc(s, d)
    best = boxsearch.powers(x, FULL).groupBy("star").agg(F.max_by("period", F.struct(F.round("power", boxsearch.DIGITS), -F.col("grid"))).alias("period"))
    return boxsearch.template_decision(x, best, FULL, 7.0)


_RATIOS = ", ".join(f"({i}, {float(x)!r}::DOUBLE)" for i, x in enumerate(ALIAS_RATIOS))
_PHASES = ", ".join(f"({j}, {float(x)!r}::DOUBLE)" for j, x in enumerate((0.0, *boxsearch.SUB_PHASES)))
LADDER = f"""{NOISE}, {STAR_EPH}, span AS (SELECT star, min(t) AS low, max(t) AS high FROM lc GROUP BY star),
tried AS (SELECT star, i, ratio, period * ratio AS period, epoch, duration, low, high FROM eph JOIN span USING (star), (VALUES {_RATIOS}) r(i, ratio) WHERE period * ratio >= 2 * duration AND period * ratio <= (high - low) / 2),
probe AS (SELECT star, i, j, ratio, period, epoch + period * part AS epoch, duration, low, high FROM tried, (VALUES {_PHASES}) q(j, part)),
pts AS (SELECT p.*, t, y, abs((t - epoch + period / 2) - period * floor((t - epoch + period / 2) / period) - period / 2) AS off, round_even((t - epoch) / period, 0)::BIGINT AS cycle FROM probe p JOIN lc USING (star)),
sup AS (SELECT star, i, j, any_value(ratio) AS ratio, any_value(period) AS period, count(*) FILTER (off <= duration / 2) AS n_in, count(*) FILTER (off >= duration) AS n_out, median(y) FILTER (off >= duration) - median(y) FILTER (off <= duration / 2) AS depth FROM pts GROUP BY star, i, j),
m AS (SELECT star, i, ratio, period, depth, CASE WHEN noise > 0 THEN depth / (noise / sqrt(n_in)) ELSE 0 END AS snr FROM sup JOIN noise USING (star) WHERE j = 0 AND n_in >= 3 AND n_out >= 20),
worst AS (SELECT star, i, max(CASE WHEN n_in >= 3 AND n_out >= 20 THEN depth ELSE 0 END) AS deepest FROM sup WHERE j > 0 GROUP BY star, i),
base AS (SELECT star, i, median(y) AS base, 1.4826 * mad(y) AS scatter FROM pts WHERE j = 0 AND off >= duration GROUP BY star, i HAVING count(*) >= 20),
ev AS (SELECT star, i, cycle, median(y) AS level, count(*) AS k FROM pts WHERE j = 0 AND off <= duration / 2 AND epoch + cycle * period BETWEEN low AND high GROUP BY ALL HAVING count(*) >= 2),
share AS (SELECT star, i, (count(*) FILTER (base - level > 3 * scatter / sqrt(k)))::DOUBLE / count(*) AS share FROM ev JOIN base USING (star, i) WHERE scatter > 0 GROUP BY star, i),
sc AS (SELECT star, i, ratio, period, snr, coalesce(share, 0) AS share, CASE WHEN depth > 0 THEN greatest(0, least(1, deepest / depth)) ELSE 1 END AS skipped FROM m JOIN worst USING (star, i) LEFT JOIN share USING (star, i)),
s AS (SELECT *, greatest(0, snr) * share * (1 - skipped) AS score FROM sc), top AS (SELECT star, max(score) AS top, max(score) FILTER (ratio = 1) AS own, arg_max(i, (score, -i)) AS best FROM s GROUP BY star)"""


@query("alias_ladder", W + LC + ", " + LADDER + " SELECT star, round(ratio, 6) AS ratio, round(period, 6) AS period, round(snr, 5) AS snr, round(share, 6) AS event_share, round(skipped, 5) AS skipped, round(score, 5) AS score, CASE WHEN own IS NULL OR top > 1.1::DOUBLE * own THEN i = best ELSE ratio = 1 END AS chosen FROM s JOIN top USING (star)")
def alias_ladder(s, d):
    x = lc(s, d)
    got = boxsearch.alias_ladder(x, star_eph(s, d), series.point_noise(x))
    return got.select("star", r("ratio").alias("ratio"), r("period").alias("period"), r("snr", 5).alias("snr"), r("event_share").alias("event_share"), r("skipped", 5).alias("skipped"), r("score", 5).alias("score"), "chosen")


#: Series about 1, as deep as their scatter allows.
LEVEL = "x AS (SELECT star, t, 1 + (y - m) / 1e5 AS y, row_number() OVER (PARTITION BY star ORDER BY t, y) - 1 AS i, count(*) OVER (PARTITION BY star) AS n FROM lc JOIN (SELECT star, median(y) AS m FROM lc GROUP BY star) USING (star))"


def _level(s, d):
    x = lc(s, d)
    mid = x.groupBy("star").agg(F.median("y").alias("m"))
    return x.join(mid, "star").select("star", "t", (1 + (F.col("y") - F.col("m")) / 1e5).alias("y"))


@query("lc_rolling_scatter", W + LC + ", " + LEVEL + """, w AS (SELECT star, i, t, n, mad(y) OVER v AS mad, stddev_pop(y) OVER v AS dev FROM x WINDOW v AS (PARTITION BY star ORDER BY i ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING))
SELECT star, i, round(t, 6) AS t, round(CASE WHEN mad > 0 THEN 1.4826 * mad WHEN dev > 0 THEN dev END * 1e5, 4) AS scatter FROM w""")
def lc_rolling_scatter(s, d):
    return rolling.rolling_scatter(_level(s, d), 9).select("star", "i", r("t").alias("t"), r(F.col("scatter") * 1e5, 4).alias("scatter"))


DURATIONS, THRESHOLD, GAP = [2.0, 4.0], 1.5, 1.0
CANDIDATES = LEVEL + f""", cad AS (SELECT star, median(dt) AS cadence FROM (SELECT star, t - lag(t) OVER (PARTITION BY star ORDER BY t) AS dt FROM lc) WHERE dt IS NOT NULL GROUP BY star HAVING median(dt) > 0),
sp AS (SELECT star, n, d, span, greatest(span // 2, 1) AS half, greatest(span // 3, 1) AS step FROM (SELECT DISTINCT star, n, d, round_even(d / cadence, 0)::BIGINT AS span FROM x JOIN cad USING (star), (VALUES {", ".join(f"({v}::DOUBLE)" for v in DURATIONS)}) v(d) WHERE n >= 50) WHERE span >= 3),
c AS (SELECT sp.*, c FROM sp, unnest(range(half, n - half, step)) u(c)),
sc AS (SELECT star, d, c, 1.4826 * mad(y) AS mad, stddev_pop(y) AS dev FROM c JOIN x USING (star) WHERE i BETWEEN c - 6 * span AND c + 6 * span GROUP BY ALL),
pts AS (SELECT c.star, d, c, x.t, x.y, (x.t - o.t) / d AS off, o.t AS tc FROM c JOIN x ON x.star = c.star AND x.i BETWEEN c - half AND c + half JOIN x o ON o.star = c.star AND o.i = c),
shp AS (SELECT *, CASE WHEN abs(off) <= 0.5 THEN 1 - 0.35::DOUBLE * (1 - sqrt(1 - least(1, 4 * off * off))) - 0.23::DOUBLE * pow(1 - sqrt(1 - least(1, 4 * off * off)), 2) ELSE 0 END AS s FROM pts),
fit AS (SELECT star, d, c, any_value(tc) AS tc, sum(s * (1 - y)) / sum(s * s) AS depth, sum(s * s) AS s2, count(*) FILTER (s > 0.5) AS points, min(t) AS a, max(t) AS z FROM shp GROUP BY star, d, c),
edges AS (SELECT DISTINCT star, unnest([i, i + 1]) AS e FROM (SELECT star, i, lead(t) OVER (PARTITION BY star ORDER BY i) - t AS dt FROM x) WHERE dt > {GAP} UNION SELECT star, 0 FROM x UNION SELECT star, n - 1 FROM x),
cand AS (SELECT f.star, f.d AS duration, f.c AS i, tc AS t, depth, depth * sqrt(s2) / CASE WHEN mad > 0 THEN mad ELSE dev END AS significance, points, (SELECT count(*) FROM x WHERE x.star = f.star AND x.t < f.a AND x.t > f.a - f.d) AS before, (SELECT count(*) FROM x WHERE x.star = f.star AND x.t > f.z AND x.t < f.z + f.d) AS after,
EXISTS (SELECT 1 FROM edges e WHERE e.star = f.star AND abs(f.c - e.e) <= sp.span) AS edge FROM fit f JOIN sc USING (star, d, c) JOIN sp ON sp.star = f.star AND sp.d = f.d WHERE s2 > 0 AND depth > 0),
e AS (SELECT * FROM cand WHERE significance >= {THRESHOLD})"""


@query("lc_event_candidates", W + LC + ", " + CANDIDATES + " SELECT star, duration, i, round(t, 6) AS t, round(depth * 1e5, 4) AS depth, round(significance, 5) AS significance, points, before, after, edge FROM e")
def lc_event_candidates(s, d):
    e = rolling.event_candidates(_level(s, d), DURATIONS, THRESHOLD, GAP)
    return e.select("star", "duration", "i", r("t").alias("t"), r(F.col("depth") * 1e5, 4).alias("depth"), r("significance", 5).alias("significance"), "points", "before", "after", "edge")


@query("lc_single_events", W + "RECURSIVE " + LC + ", " + CANDIDATES + """, o AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY round(significance, 9) DESC, duration, i) AS k FROM e),
walk AS (SELECT star, k, [{'t': t, 'd': duration}] AS kept, true AS taken FROM o WHERE k = 1 UNION ALL SELECT star, k, CASE WHEN x THEN list_append(kept, {'t': t, 'd': duration}) ELSE kept END, x FROM (SELECT o.star, o.k, o.t, o.duration, kept, len(list_filter(kept, lambda q: abs(o.t - q.t) < greatest(o.duration, q.d))) = 0 AND len(kept) < 20 AS x FROM walk JOIN o ON o.star = walk.star AND o.k = walk.k + 1))
SELECT star, row_number() OVER (PARTITION BY star ORDER BY k) AS rank, duration, i, round(significance, 5) AS significance, concat_ws('; ', CASE WHEN points < 3 THEN 'fewer_than_minimum_cadences_in_event' END, CASE WHEN before = 0 OR after = 0 THEN 'no_two_sided_local_baseline' END, CASE WHEN edge THEN 'adjacent_to_segment_edge_or_gap' END, CASE WHEN depth > 0.05 THEN 'depth_over_5_percent' END) AS vetoes FROM walk JOIN o USING (star, k) WHERE taken""")
def lc_single_events(s, d):
    e = rolling.single_events(rolling.vetoes(rolling.event_candidates(_level(s, d), DURATIONS, THRESHOLD, GAP)))
    return e.select("star", F.col("rank").cast("long").alias("rank"), "duration", "i", r("significance", 5).alias("significance"), F.concat_ws("; ", "vetoes").alias("vetoes"))


#: A box planted at each star's ephemeris, and preparation by medians of bins of half a day.
TRANSFER = f"""{STAR_EPH}, off AS (SELECT star, t, y, abs((t - epoch + period / 2) - period * floor((t - epoch + period / 2) / period) - period / 2) AS off, duration FROM lc JOIN eph USING (star)),
pl AS (SELECT star, t, y - CASE WHEN off <= duration / 2 THEN 8.0::DOUBLE ELSE 0 END AS y FROM off), raw AS (SELECT 'raw' AS tag, star, t, y FROM lc UNION ALL SELECT 'raw_planted', star, t, y FROM pl),
med AS (SELECT tag, star, floor(t / 0.5::DOUBLE) AS bin, median(y) AS m FROM raw GROUP BY ALL), four AS (SELECT * FROM raw UNION ALL SELECT replace(r.tag, 'raw', 'prepared'), r.star, r.t, CASE WHEN m <> 0 THEN r.y / m END FROM raw r JOIN med ON med.tag = r.tag AND med.star = r.star AND med.bin = floor(r.t / 0.5::DOUBLE)),
d AS (SELECT tag, f.star, count(*) FILTER (off <= duration / 2) AS n_in, count(*) FILTER (off >= duration) AS n_out, median(f.y) FILTER (off >= duration) - median(f.y) FILTER (off <= duration / 2) AS depth FROM four f JOIN off o ON o.star = f.star AND o.t = f.t GROUP BY ALL),
p AS (SELECT star, max(depth) FILTER (tag = 'raw_planted') - max(depth) FILTER (tag = 'raw') AS a, max(depth) FILTER (tag = 'prepared_planted') - max(depth) FILTER (tag = 'prepared') AS b FROM (SELECT tag, star, CASE WHEN n_in >= 3 AND n_out >= 20 THEN depth END AS depth FROM d) GROUP BY star)"""


@query("depth_transfer", W + LC + ", " + TRANSFER + " SELECT star, CASE WHEN b IS NOT NULL THEN round(a, 5) END AS input_depth, CASE WHEN a IS NOT NULL THEN round(b, 5) END AS prepared_depth, CASE WHEN a > 0 AND b IS NOT NULL THEN round(abs(b - a) / a, 5) END AS bias, CASE WHEN a IS NULL OR b IS NULL THEN 'insufficient_fixed_ephemeris_samples' WHEN a <= 0 THEN 'nonpositive_input_depth' ELSE 'measured' END AS status FROM p")
def depth_transfer(s, d):
    x, e = lc(s, d), star_eph(s, d)
    planted = events.injected(x, e.withColumn("depth", F.lit(8.0)))
    got = injection.depth_transfer(x, planted, lambda one: series.step_detrend(one, 0.5), e)
    return got.select("star", r("input_depth", 5).alias("input_depth"), r("prepared_depth", 5).alias("prepared_depth"), r("bias", 5).alias("bias"), "status")


#: Each long series as it is, mirrored, and with a box planted, under names of their own.
VARIANTS = LC + """, base AS (SELECT cohort AS star, t, y FROM lc), mid AS (SELECT star, median(y) AS m FROM base GROUP BY star), lcc AS (SELECT star || '|baseline' AS star, t, y FROM base UNION ALL SELECT star || '|inverted', t, 2 * m - y FROM base JOIN mid USING (star)
UNION ALL SELECT star || '|planted', t, y - CASE WHEN abs((t - 0.4::DOUBLE + 1.25::DOUBLE) - 2.5::DOUBLE * floor((t - 0.4::DOUBLE + 1.25::DOUBLE) / 2.5::DOUBLE) - 1.25::DOUBLE) <= 0.1::DOUBLE THEN 30.0::DOUBLE ELSE 0 END FROM base)"""


@query("variant_search", W + VARIANTS + ", " + powers_sql(GRID) + ", " + BEST + " SELECT split_part(star, '|', 1) AS star, split_part(star, '|', 2) AS tag, grid, round(period, 6) AS period, round(power, 4) AS power FROM best")
def variant_search(s, d):
    """Baseline, mirrored and planted series through one search."""
    x = lcc(s, d)
    e = x.select("star").distinct().select("star", F.lit(2.5).alias("period"), F.lit(0.4).alias("epoch"), F.lit(0.2).alias("duration"), F.lit(30.0).alias("depth"))
    got = injection.variant_search({"baseline": x, "inverted": calibration.inverted(x), "planted": events.injected(x, e)}, GRID, fallback=False)
    return got.select("star", "tag", "grid", r("period").alias("period"), r("power", 4).alias("power"))


@query("recovery_grid")
def recovery_grid(s, d):
    """Boxes of a grid of periods and depths planted in each long series and searched for."""
    return injection.recovery_grid(lcc(s, d), [1.7, 2.9, 4.3], [5.0, 40.0], 0.4, 0.2, GRID)


@query("planted_transits")
def planted_transits(s, d):
    """Limb-darkened transits of a wanted depth in every star's series: the ratio found, and what the series lost."""
    e = star_eph(s, d)
    k = F.col("star")
    plan = e.select("star", (F.col("period") + 1).alias("period"), "epoch", (0.0005 * (1 + k % 9)).alias("depth"), ((k % 10) / 10.0).alias("impact"), (0.5 + (k % 7) / 5.0).alias("radius"), F.when(k % 3 != 0, 0.9).alias("mass"), (3500.0 + k % 5 * 800).alias("teff"))
    p = injection.planned(plan)
    lost = injection.plant(lc(s, d), p).groupBy("star").agg(F.count_if(F.col("loss") > 0).alias("touched"), F.max("loss").alias("deepest"))
    return p.join(lost, "star", "left").select("star", "ratio", "a_over_r", "duration", "state", "touched", "deepest")
