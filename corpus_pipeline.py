"""A corpus made ready for training: five stages, each written as Parquet and read by the next.

run(spark, sf_dir) applies STAGES to documents. No SQL can express the stages (an iterated
label model, connected components, a suffix collection and a genetic algorithm), so ORACLE_SQL
is None and tests hold each stage against a brute-force version.

All stages count null texts as empty, treat repeated rows as rows of their own, give an empty
table back for an empty one, and carry further columns along whatever their names, but for the
last, whose columns are those of the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lightfold.llm import common, packing, pii, quality, simhash, suffix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted label model keeps."""
    common.prepare(spark)
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    common.prepare(spark)
    return simhash.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    common.prepare(spark)
    return suffix.remove_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the names of their kinds."""
    common.prepare(spark)
    return pii.mask_pii(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    common.prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("PII", mask_personal_data),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's scratch tables and its input go once its own table is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with common.scratch():
            docs = common.cut(stage(spark, before, sf_dir), name.replace(" ", "-"))
        common.discard(before)
    return docs
