"""All queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, catalogue_queries, consistency_queries, graph_queries, incremental_queries, lookup_queries, mapping_queries, mining_queries, resolution_queries, sentence_queries  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest consistent set of nations for each customer."""
    return base.QUERIES["conjoint_customer_region"](spark, sf_dir)
