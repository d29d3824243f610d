"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (one file or a directory of files)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
