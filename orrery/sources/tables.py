"""Named parquet tables under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``; filters and column selection reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
