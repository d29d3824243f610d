"""Settings: ``n_workers`` is the number of shuffle partitions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEYS = {"n_workers": "spark.sql.shuffle.partitions"}


def get(spark: SparkSession, key: str) -> str:
    return spark.conf.get(_KEYS.get(key, key))


def put(spark: SparkSession, key: str, value) -> None:
    spark.conf.set(_KEYS.get(key, key), str(value))
