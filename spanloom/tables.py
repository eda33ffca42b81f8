"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet tables; Spark prunes its columns and pushes filters down."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
