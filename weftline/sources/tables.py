"""Readers of the plain Parquet tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``; any path that Spark can read will do."""
    return spark.read.parquet(f"{base}/{name}.parquet")
