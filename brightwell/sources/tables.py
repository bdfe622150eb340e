"""Parquet tables in one folder, `<folder>/<name>.parquet`."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's Parquet file or folder, by Spark's own reader (any store that Spark reaches)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
