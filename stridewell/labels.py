"""Questions about labels that live in a column: the distributed counterparts of
what a coordinate's descriptor answers on the driver.

``by`` names columns whose values are axes of their own.  Labels are numbers or
nanoseconds; rows without a label are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coords as C
from .frame import LabeledFrame
from .operators.intervals import merge_intervals


def _axis(f: LabeledFrame, name: str) -> tuple[DataFrame, str]:
    c = f.coords[name]
    if not isinstance(c, C.Column):
        raise TypeError(f"{name} isn't a column; ask the coordinate itself")
    return f.df.filter(F.col(c.column).isNotNull()), c.column


def monotonic(f: LabeledFrame, name: str, order: str, by: list[str]) -> DataFrame:
    """``by`` and ``value``: whether labels rise strictly along ``order``."""
    df, column = _axis(f, name)
    rises = F.col(column) > F.lag(column).over(Window.partitionBy(*by).orderBy(order))
    return df.select(*by, rises.alias("up")).groupBy(*by).agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("value"))


def sampling_interval(f: LabeledFrame, name: str, by: list[str]) -> DataFrame:
    """``by`` and ``value``: the mean step between labels (seconds on time axes; null for one label)."""
    df, column = _axis(f, name)
    unit = C.NS if f.coords[name].is_time else 1
    span, steps = F.max(column) - F.min(column), F.count("*") - 1
    return df.groupBy(*by).agg((span / F.lit(float(unit)) / F.when(steps > 0, steps)).alias("value"))


def _stretches(f: LabeledFrame, name: str, by: str, tolerance) -> DataFrame:
    df, column = _axis(f, name)
    slack = C.parse_tolerance(tolerance, f.coords[name].is_time)
    points = df.select(by, F.col(column).cast("long").alias("a"), F.col(column).cast("long").alias("b"), F.lit(slack).cast("long").alias("slack"))
    return merge_intervals(points, by, "a", "b", "slack")


def timeline(f: LabeledFrame, name: str, by: str, tolerance=None) -> DataFrame:
    """``by``, start_value, end_value, delta and type: stretches of labels no further apart than the tolerance
    ('data'), and what lies between them ('gap')."""
    kind = F.when(F.col("kind") == "gap", "gap").otherwise("data")
    return _stretches(f, name, by, tolerance).select(
        by, F.col("start_ns").alias("start_value"), F.col("end_ns").alias("end_value"), (F.col("end_ns") - F.col("start_ns")).alias("delta"), kind.alias("type")
    )


def availabilities(f: LabeledFrame, name: str, by: str, tolerance=None) -> DataFrame:
    return timeline(f, name, by, tolerance).filter("type = 'data'")


def discontinuities(f: LabeledFrame, name: str, by: str, tolerance=None) -> DataFrame:
    return timeline(f, name, by, tolerance).filter("type = 'gap'")
