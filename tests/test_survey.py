import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lightfold.operators import catalogue, evidence, islands, joins, population, screening, series
from lightfold.sources import files
from lightfold.streaming import streams


def store(spark, rows):
    return spark.createDataFrame(rows, "tic long, evidence_id long, kind string, source string, verdict string, affects_state int")


def test_fold_prefers_stage_then_precedence_then_latest(spark):
    rows = [
        (1, 1, "a", "x", "automated_survivor", 1), (1, 2, "b", "x", "science_vetted_lead", 1), (1, 3, "c", "x", "common_mode_systematic", 1),
        (2, 4, "a", "x", "automated_survivor", 1), (2, 5, "b", "x", "common_mode_systematic", 1), (2, 6, "c", "x", "false_positive", 1),
        (3, 7, "a", "x", "false_positive", 1), (3, 8, "b", "x", "rediscovery", 1),
        (4, 9, "a", "x", "no_transit_detected", 1), (4, 10, "b", "x", "automated_survivor", 0), (5, 11, "a", "x", "unlisted", 1),
    ]
    want = {1: "common_mode_systematic", 2: "false_positive", 3: "rediscovery", 4: "no_transit_detected"}
    for order in (rows, rows[::-1]):
        assert {r["tic"]: r["status"] for r in evidence.state(store(spark, order)).collect()} == want


def test_append_twice_adds_nothing(spark):
    a = store(spark, [(1, 1, "a", "x", None, 1), (1, 2, "a", "y", None, 1)])
    b = store(spark, [(1, 3, "a", "x", "searched", 1), (2, 4, "a", "x", None, 1), (2, 5, "a", "x", None, 1)])
    once = evidence.append(a, b)
    assert sorted(r["evidence_id"] for r in once.collect()) == [1, 2, 4]
    assert sorted(r["evidence_id"] for r in evidence.append(once, b).collect()) == [1, 2, 4]


def test_shared_ephemerides(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "c", 6.85, 4080.2, 3.0, i % 4 + 1, float(rng.uniform(0, 360)), float(rng.uniform(-60, 60))) for i in range(200)] + [(999, "c", 6.85, 4077.0, 3.0, 1, 5.0, 5.0)]
    e = spark.createDataFrame(rows, "tic long, campaign string, period double, epoch double, duration_h double, camera int, ra double, dec double")
    got = {r["tic"]: r for r in population.shared_ephemerides(e, ["campaign"]).collect()}
    assert got[0]["sharers"] == 199 and got[0]["verdict"] == "common_mode_systematic" and got[999]["verdict"] == "independent_timing"


def test_shared_instants(spark):
    rows = [(i, "c", 3.0 + 0.37 * i, 1000.0) for i in range(40)] + [(99, "c", 1.0, 1008.0)]
    e = spark.createDataFrame(rows, "tic long, campaign string, period double, epoch double")
    ev, bins = population.instant_bins(e, ["campaign"])
    got = {r["tic"]: r["verdict"] for r in population.instant_verdicts(ev, population.instants(bins).filter("flagged"), ["campaign"]).collect()}
    assert sum(got[i] == "shared_instant" for i in range(40)) >= 30 and got[99] == "independent_instants"


def curves(spark, stars, sharing):
    rng = np.random.default_rng(1)
    t = np.arange(0, 5, 10 / 1440)
    parts = []
    for s in range(stars):
        y = 1 + rng.normal(0, 5e-4, len(t))
        if s < sharing * stars:
            y[(t >= 2.0) & (t <= 2.02)] -= 0.003
        parts.append(pd.DataFrame({"star": s, "t": t, "y": y}))
    return spark.createDataFrame(pd.concat(parts))


def test_dip_registry_and_merge_law(spark):
    flags = population.dip_flags(curves(spark, 60, 0.3)).withColumn("c", F.lit("x")).cache()
    whole = population.bin_counts(flags, ["c"])
    w = population.dip_windows(whole, ["c"]).collect()
    assert len(w) == 1 and w[0]["start"] <= 2.0 <= w[0]["stop"] and w[0]["peak"] >= 0.25
    half = [population.bin_counts(flags.filter(F.col("star") % 2 == i), ["c"]) for i in (0, 1)]
    both = half[0].union(half[1]).groupBy("c", "bin").agg(F.sum("observed").alias("observed"), F.sum("dips").alias("dips"))
    assert both.exceptAll(whole).count() == 0
    assert population.dip_windows(population.bin_counts(population.dip_flags(curves(spark, 30, 0.0)).withColumn("c", F.lit("x")), ["c"]), ["c"]).count() == 0


def test_islands(spark):
    d = spark.createDataFrame([("a", x) for x in (1, 2, 3, 7, 8, 9, 10, 20)], "k string, v long")
    assert [tuple(s) for s in islands.encode_runs(d, ["k"], "v").first()["spans"]] == [(1, 3), (7, 10), (20, 20)]
    assert islands.decode_runs(islands.encode_runs(d, ["k"], "v"), ["k"], "v").exceptAll(d).count() == 0
    assert tuple(islands.longest_run(d, ["k"], "v", 3).first())[1:] == (8, 10, 3)
    assert tuple(islands.compact_window(d, ["k"], "v", 3).first())[1:] == (1, 3, 2)


def test_band_and_sky_joins_match_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0.3, 20, 300)
    a = spark.createDataFrame([(i, "c", float(x)) for i, x in enumerate(p)], "i long, g string, a double")
    b = spark.createDataFrame([(i, "c", float(x)) for i, x in enumerate(p)], "j long, g string, b double")
    got = {(r["i"], r["j"]) for r in joins.band_join(a, b, ["g"], "a", "b", 0.02).collect()}
    assert got == {(i, j) for i, x in enumerate(p) for j, y in enumerate(p) if x * (1 - 0.02) <= y <= x * (1 + 0.02)}
    ra, dec = rng.uniform(0, 20, 200), rng.uniform(-10, 10, 200)
    l = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ra, dec))], "i long, ra double, dec double")
    r = l.select(F.col("i").alias("j"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    n = joins.sky_join(l, r, 1.0, ("ra", "ra2"), ("dec", "dec2")).count()
    x = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], 1)
    assert n == int((np.degrees(np.arccos(np.clip(x @ x.T, -1, 1))) <= 1.0).sum())


def test_adjudication_families(spark):
    cols = "tic long, period double, epoch double, duration_h double, object_class string, cat_period double, cat_epoch double, cat_duration_h double, cat_period_error double, cat_epoch_error double, host_only boolean"
    rows = [
        (1, 3.0, 1500.0, 2.0, "eclipsing_binary", 3.0, 2458500.0, 2.0, 1e-6, None, False),
        (2, 3.0, 1501.5, 2.0, "eclipsing_binary", 3.0, 2458500.0, 2.0, 1e-6, None, False),
        (3, 3.15, 1500.0, 2.0, "eclipsing_binary", 3.0, 2458500.0, 2.0, 1e-6, None, False),
        (4, 1.5, 1500.0, 2.0, "toi", 3.0, 2458500.0, 2.0, 1e-6, None, False),
        (5, 3.0, 1500.0, 2.0, "variable_star", 3.0, None, None, None, None, False),
    ]
    rel = catalogue.relate(spark.createDataFrame(rows, cols))
    got = {r["tic"]: (r["relation"], r["epoch_verdict"], r["match"]) for r in rel.collect()}
    assert got[1] == ("exact", "agrees", "signal_match") and got[2][1:] == ("disagrees", "host_match") and got[3][0] == "none"
    assert got[4] == ("half_period_alias", "agrees", "signal_match") and got[5][2] == "period_only_match"
    st = {r["tic"]: (r["status"], r["blocked"]) for r in catalogue.adjudicate(rel).collect()}
    assert st[1][0] == "known_eb_rediscovery" and st[2][0] == "known_eb_host_residual_review" and st[4] == (None, True) and st[5][0] == "known_variable_star_review"


def test_priority(spark):
    cols = "snr double, events int, odd_even_sigma double, secondary_snr double, duration_h double, period double, depth_ppm double, review boolean, eb_lane boolean"
    rows = [(12.0, 6, None, None, 2.0, 3.0, 900.0, False, False), (113.6, 0, None, None, 2.0, 3.0, 900.0, False, False), (12.0, 6, None, None, 2.0, 3.0, 215028.0, False, False), (5.0, 6, None, None, 2.0, 3.0, 900.0, False, False)]
    got = [(r["class"], r["priority"]) for r in screening.classify(screening.flags(spark.createDataFrame(rows, cols))).collect()]
    assert got == [("automated_survivor", 77), ("single_event_lead", 94), ("screened_rejected", 15), ("no_transit_detected", 5)]


def test_clean_drops_what_is_not_finite(spark):
    d = spark.createDataFrame([("a", 0.0, 2.0), ("a", 0.0, 4.0), ("a", 1.0, float("nan")), ("a", 2.0, None), ("a", 3.0, 3.0)], "star string, t double, y double")
    assert sorted((r["t"], r["y"]) for r in series.clean(d, least=2).collect()) == [(0.0, 1.0), (3.0, 1.0)]


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    m = files.write_snapshot(rows, str(tmp_path), "cat", "v1").first()
    assert m["row_count"] == 3
    assert files.content_hash(rows.orderBy(F.desc("k")).repartition(3)).first()["content_hash"] == m["content_hash"]
    assert files.newest(spark, str(tmp_path), "cat").count() == 3


def test_target_list(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("# note\ntarget,tic_id,sectors,more\nA,1,14;15,x\nB,2,3,y\n")
    assert sorted((r["tic_id"], r["sectors"]) for r in files.targets(spark, str(good)).collect()) == [(1, [14, 15]), (2, [3])]
    bad = tmp_path / "bad.csv"
    bad.write_text("target,tic_id,sectors\nA,one,14\n")
    try:
        files.targets(spark, str(bad)).collect()
    except Exception as e:
        assert "bad target row" in str(e)
    else:
        raise AssertionError("a bad row must fail")


def test_event_log_is_idempotent(spark, tmp_path):
    e = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "event_id string, kind string")
    assert files.append_events(e, str(tmp_path / "log")) == 2
    assert files.append_events(e, str(tmp_path / "log")) == 0


def test_streams_match_batch(spark, tmp_path):
    src = tmp_path / "in"
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(3):
        ev.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(src / f"part{i}"))
    read = lambda: spark.readStream.schema(streams.EVENTS).option("recursiveFileLookup", True).parquet(str(src)).withColumn("at", F.col("ts").cast("timestamp"))
    got = streams.run_once(streams.tumbling_counts(read()), "tumbling", "complete", str(tmp_path / "c1"))
    want = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "30 minutes")["start"].alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert got.select("start", "event_type", "n").exceptAll(want).count() == 0 and got.count() == want.count()
    assert streams.run_once(streams.distinct_events(read()), "once", "append", str(tmp_path / "c2")).count() == ev.count()
    streams.append_batches(read(), str(tmp_path / "out"), "event_id", str(tmp_path / "c3"))
    streams.append_batches(read(), str(tmp_path / "out"), "event_id", str(tmp_path / "c4"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == ev.count()
    assert streams.run_once(streams.rolling_rate(read()), "rates", "complete", str(tmp_path / "c5")).count() > 0
    assert streams.run_once(streams.sessions(read()), "sess", "complete", str(tmp_path / "c6")).agg(F.sum("n")).first()[0] == ev.count()


def test_leases(spark, tmp_path):
    d = spark.createDataFrame([("l", "alpha", 0), ("l", "beta", 1), ("l", "alpha", 2), ("l", "beta", 600_002)], "name string, holder string, ms long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = streams.run_once(streams.leases(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 300_000), "leases", "append", str(tmp_path / "c"))
    assert [r["outcome"] for r in got.orderBy("ms").collect()] == ["acquired", "denied", "refreshed", "taken_over"]
