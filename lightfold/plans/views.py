"""Survey inputs made from the given tables, each as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STATUSES
from ..session import shuffled, workers_find_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its twin."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return workers_find_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def r(column, digits: int = 6):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def lc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("double") / 86400000000.0
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("star"), F.col("event_type").alias("cohort"), t.alias("t"), F.col("value").alias("y"))


LC = "lc AS (SELECT user_id AS star, event_type AS cohort, (epoch_us(ts) - 1704067200000000)::DOUBLE / 86400000000.0::DOUBLE AS t, value AS y FROM events)"


def lcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long series: one a cohort."""
    return lc(spark, sf_dir).select(F.col("cohort").alias("star"), "t", "y")


LCC = LC + ", lcc AS (SELECT cohort AS star, t, y FROM lc)"
#: One ephemeris a star, in days.
STAR_EPH = "eph AS (SELECT user_id AS star, 1.5::DOUBLE + (user_id % 7)::DOUBLE * 0.37::DOUBLE AS period, 0.25::DOUBLE + (user_id % 5)::DOUBLE * 0.11::DOUBLE AS epoch, 0.3::DOUBLE AS duration FROM events GROUP BY user_id)"


def star_eph(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("star")).distinct()
    return u.select("star", (1.5 + (F.col("star") % 7).cast("double") * 0.37).alias("period"), (0.25 + (F.col("star") % 5).cast("double") * 0.11).alias("epoch"), F.lit(0.3).alias("duration"))


SLUGS = ("no_transit_detected", "screened_rejected", "automated_survivor", "single_event_lead", "search_error", "known_eb_rediscovery", "science_vetted_lead", "common_mode_systematic", None, "false_positive", "unlisted_slug")


def evid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (tic, kind, source). Rows are dealt by tic once, into as many tasks as a shuffle has, so that no
    task holds more than its share and groupings by tic, or by more, move nothing again."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", "l_discount", "l_tax", "l_partkey", "l_extendedprice")
    li = li.repartition(shuffled(li), "l_orderkey")
    code = F.when(F.col("kind") == "A", 0).when(F.col("kind") == "N", 1).otherwise(2)
    g = li.groupBy(F.col("l_orderkey").alias("tic"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("source")).agg(F.min(F.rint(F.col("l_discount") * 100).cast("int")).alias("i"), F.min("l_tax").alias("tax"), F.min("l_partkey").alias("part"), F.max("l_extendedprice").alias("score"))
    verdict = F.element_at(F.array(*(F.lit(s) for s in SLUGS)), F.col("i") + 1)
    return g.select(
        "tic", (F.col("tic") * 100000 + F.col("source") * 4 + code).alias("evidence_id"), "kind", "source", verdict.alias("verdict"),
        F.when(F.col("tax") >= 0.07, 0).otherwise(1).alias("affects_state"),
        F.when(F.col("part") % 7 != 0, F.concat(F.lit("sig"), (F.col("part") % 3).cast("string"))).alias("signature"), "score",
    )


_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SLUGS) if s)
EVID = f"""ev0 AS (SELECT l_orderkey AS tic, l_returnflag AS kind, l_suppkey AS source, min(round_even(l_discount * 100, 0)::INT) AS i, min(l_tax) AS tax, min(l_partkey) AS part, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
evid AS (SELECT tic, tic * 100000 + source * 4 + CASE kind WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS evidence_id, kind, source, CASE i {_CASE} END AS verdict, CASE WHEN tax >= 0.07::DOUBLE THEN 0 ELSE 1 END AS affects_state, CASE WHEN part % 7 <> 0 THEN 'sig' || (part % 3)::VARCHAR END AS signature, score FROM ev0)"""

REGISTRY = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {a}, {b})" for s, a, b in STATUSES) + ") v(verdict, stage, precedence))"
FOLD = "ranked AS (SELECT e.*, stage, precedence, row_number() OVER (PARTITION BY tic ORDER BY stage DESC, precedence DESC, evidence_id DESC) AS rn FROM evid e JOIN reg USING (verdict) WHERE affects_state = 1), state AS (SELECT tic, verdict AS status, evidence_id AS decided_by, kind FROM ranked WHERE rn = 1)"
EVS = EVID + ", " + REGISTRY + ", " + FOLD


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("tic"), F.col("n_name").alias("lane"), F.col("c_acctbal").alias("magnitude"))


STAR = "star AS (SELECT c_custkey AS tic, n_name AS lane, c_acctbal AS magnitude FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def eph(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01 00:00:00', o_orderdate)")
    return o.select(
        k.alias("tic"), c.alias("host"), F.date_format("o_orderdate", "yyyy-MM").alias("campaign"), F.col("o_orderstatus").alias("status"),
        (0.5 + p % 13.0).alias("period"), (day + (k % 97) / 97.0).alias("epoch"), (0.5 + (c % 11) / 2.0).alias("duration_h"),
        (c % 4 + 1).cast("int").alias("camera"), (k % 3 + 1).cast("int").alias("ccd"), (c * 37.7 % 360.0).alias("ra"), (c * 13.3 % 170.0 - 85.0).alias("dec"),
        (p % 40.0).alias("snr"), (p / 3.0).alias("depth_ppm"), (k % 5).cast("int").alias("events"),
    )


EPH = """eph AS (SELECT o_orderkey AS tic, o_custkey AS host, strftime(o_orderdate, '%Y-%m') AS campaign, o_orderstatus AS status, 0.5::DOUBLE + o_totalprice % 13.0::DOUBLE AS period,
date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) + (o_orderkey % 97)::DOUBLE / 97.0::DOUBLE AS epoch, 0.5::DOUBLE + (o_custkey % 11)::DOUBLE / 2.0::DOUBLE AS duration_h,
(o_custkey % 4 + 1)::INT AS camera, (o_orderkey % 3 + 1)::INT AS ccd, o_custkey::DOUBLE * 37.7::DOUBLE % 360.0::DOUBLE AS ra, o_custkey::DOUBLE * 13.3::DOUBLE % 170.0::DOUBLE - 85.0::DOUBLE AS dec,
o_totalprice % 40.0::DOUBLE AS snr, o_totalprice / 3.0::DOUBLE AS depth_ppm, (o_orderkey % 5)::INT AS events FROM orders)"""

CLASSES = ("confirmed_planet", "toi", "eclipsing_binary", "variable_star", "astrometric_binary")


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    return p.select(
        (k % 500).alias("slot"), k.alias("entry"), F.element_at(F.array(*map(F.lit, CLASSES)), F.col("p_size") % 5 + 1).alias("object_class"),
        (0.5 + v % 13.0).alias("cat_period"), F.when(k % 6 != 0, 2457000.0 + v % 2000.0).alias("cat_epoch"), F.when(k % 4 != 0, 1.0 + (k % 7) / 2.0).alias("cat_duration_h"),
        F.when(k % 3 != 0, 0.00001 * (k % 50)).alias("cat_period_error"), F.when(k % 5 != 0, 0.001 * (k % 9)).alias("cat_epoch_error"), (k % 11 == 0).alias("host_only"),
    )


_CLS = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))
CAT = f"""cat AS (SELECT p_partkey % 500 AS slot, p_partkey AS entry, CASE p_size % 5 {_CLS} END AS object_class, 0.5::DOUBLE + p_retailprice % 13.0::DOUBLE AS cat_period,
CASE WHEN p_partkey % 6 <> 0 THEN 2457000.0::DOUBLE + p_retailprice % 2000.0::DOUBLE END AS cat_epoch, CASE WHEN p_partkey % 4 <> 0 THEN 1.0::DOUBLE + (p_partkey % 7)::DOUBLE / 2.0::DOUBLE END AS cat_duration_h,
CASE WHEN p_partkey % 3 <> 0 THEN 0.00001::DOUBLE * (p_partkey % 50)::DOUBLE END AS cat_period_error, CASE WHEN p_partkey % 5 <> 0 THEN 0.001::DOUBLE * (p_partkey % 9)::DOUBLE END AS cat_epoch_error, p_partkey % 11 = 0 AS host_only FROM part)"""


def sky(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    targets = c.select(F.col("c_custkey").alias("tic"), (F.col("c_custkey") * 37.7 % 360.0).alias("ra"), (F.col("c_custkey") * 13.3 % 170.0 - 85.0).alias("dec"), F.col("c_acctbal").alias("target_magnitude"))
    sources = s.select(F.col("s_suppkey").alias("identifier"), (F.col("s_suppkey") * 91.3 % 360.0).alias("ra2"), (F.col("s_suppkey") * 29.9 % 170.0 - 85.0).alias("dec2"), F.col("s_acctbal").alias("magnitude"))
    return targets, sources


SKY = """targets AS (SELECT c_custkey AS tic, c_custkey::DOUBLE * 37.7::DOUBLE % 360.0::DOUBLE AS ra, c_custkey::DOUBLE * 13.3::DOUBLE % 170.0::DOUBLE - 85.0::DOUBLE AS dec, c_acctbal AS target_magnitude FROM customer),
sources AS (SELECT s_suppkey AS identifier, s_suppkey::DOUBLE * 91.3::DOUBLE % 360.0::DOUBLE AS ra2, s_suppkey::DOUBLE * 29.9::DOUBLE % 170.0::DOUBLE - 85.0::DOUBLE AS dec2, s_acctbal AS magnitude FROM supplier)"""


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return f"degrees(2 * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))))"
