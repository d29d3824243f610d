"""All queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import arrays, records, records_sql, rounds, streams

arrays.register_sources()
MORE = (streams.__name__, rounds.__name__)  # importing them registers their queries

RECORDS = [
    "p1_found", "p1_values", "p2_found", "p2_flags", "p3_found", "p3_grid", "p4_found", "p4_classes", "p4_from_order", "p4_instants", "p4_utc", "p5_found", "p5_classes", "p5_manifest", "p5_plan", "p5_records",
    "p5_reconcile", "p6_found", "p6_table", "p7_found",
]


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Common-mode removal on hourly event sums, then threshold picks."""
    return arrays.find_picks(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return arrays.QUERIES | {name: getattr(records, name) for name in RECORDS}


def oracle_sql() -> dict[str, str]:
    return arrays.SQL | {name: getattr(records_sql, name.upper()) for name in RECORDS if hasattr(records_sql, name.upper())}
