"""Evidence is dealt into all tasks, and appended in one pass."""

from pyspark.sql import functions as F

from lightfold.operators import evidence
from lightfold.plans import views

SF = "/root/testdata/sf0.001"


def test_evidence_is_spread_over_all_tasks_and_groups_by_star_move_nothing(spark):
    e = views.evid(spark, SF)
    assert {r["p"] for r in e.select(F.spark_partition_id().alias("p")).distinct().collect()} == {0, 1, 2, 3}
    per = e.groupBy("tic").agg(F.max("evidence_id"))
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_append_keeps_the_store_and_the_first_of_each_new_key(spark):
    schema = "tic long, kind string, source long, evidence_id long"
    store = spark.createDataFrame([(1, "A", 1, 50), (1, "A", 1, 51), (None, "A", 1, 52)], schema)
    new = spark.createDataFrame([(1, "A", 1, 5), (2, "A", 1, 9), (2, "A", 1, 8), (2, "A", 1, 8), (None, "A", 1, 7), (None, "A", 1, 6), (3, None, 1, 4)], schema)
    out = evidence.append(store, new)
    assert out.columns == store.columns
    assert sorted(r["evidence_id"] for r in out.collect()) == [4, 6, 8, 50, 51, 52]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
