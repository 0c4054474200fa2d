"""Pairs of a slot are made in all tasks, however few the fits are."""

from pyspark.sql import functions as F

from lightfold.plans import catalog

SF = "/root/testdata/sf0.001"


def test_period_relations_are_made_in_all_tasks(spark):
    rows = catalog.QUERIES["period_relation"](spark, SF)
    made = {r["p"] for r in rows.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert made == set(range(int(spark.conf.get("spark.sql.shuffle.partitions"))))
