"""Table scans over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; columns are pruned and filters pushed down by the caller's plan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
