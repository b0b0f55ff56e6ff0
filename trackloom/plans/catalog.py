"""Every query of the library with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import analysis_queries, codec_queries, general_queries, io_queries, view_queries  # noqa: F401  (they register their queries)
from trackloom.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_queries.plane_entropy(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
