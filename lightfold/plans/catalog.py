"""Every registered query of the survey engine and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_queries, composed_queries, decision_queries, evidence_queries, log_queries, review_queries, search_queries, series_queries, stream_queries  # noqa: F401
from .views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["lc_screening"](spark, sf_dir)
