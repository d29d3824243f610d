"""Trace tables: one row a channel with its start, step and samples.

This is the packed layout with a station's codes, the exchange form of
seismological data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import coords as C
from ..frame import LabeledFrame, idx, with_label, with_segment
from ..operators.blocks import BROADCAST_ROWS
from ..pack import unpack

# Band code letters of the SEED convention, by sampling rate in Hz:
# T from 1e-6 to 1e-5, P to 1e-4, R to 0.001, U to 0.01, V to 0.1, L to 1, M to 10, B to 80, H to 250, C to 1000, F to 5000
BAND_EDGES = [0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 80.0, 250.0, 1000.0, 5000.0]
BAND_LETTERS = ["T", "P", "R", "U", "V", "L", "M", "B", "H", "C", "F"]


def band_code(rate: Column) -> Column:
    """SEED band letter of a sampling rate; X outside the table and of none."""
    out = F.when(rate.isNull() | F.isnan(rate) | (rate < BAND_EDGES[0]), "X")
    for edge, letter in zip(BAND_EDGES[1:], BAND_LETTERS):
        out = out.when(rate < edge, letter)
    return out.otherwise("X")


def to_traces(f: LabeledFrame, dim: str = "time", channel: str | None = None, network: str = "XX", station: str = "", location: str = "00") -> DataFrame:
    """network, station, location, channel, start_ns, delta (s), samples: a row a lane and continuous segment."""
    dim = f.axis(dim)
    c = f.coords[dim]
    cuts = [0, *c.split_indices("discontinuities", 0).tolist(), c.size]
    rows = with_segment(f.df, idx(dim), cuts, "__no", "__first")
    pair = F.struct(F.col(idx(dim)).alias("i"), F.col(f.value).cast("double").alias("v"))
    rows = rows.groupBy(*f.lanes(dim), "__first").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    rows = with_label(rows.withColumnRenamed("__first", idx(dim)), c, "start_ns")
    if channel:
        rows = with_label(rows, f.coords[channel], "__channel").withColumn("channel", F.col("__channel").cast("string"))
    else:
        rows = rows.withColumn("channel", F.concat_ws("_", *[F.col(x).cast("string") for x in f.lanes(dim)]))
    return rows.select(
        F.lit(network).alias("network"), F.lit(station).alias("station"), F.lit(location).alias("location"), "channel",
        F.col("start_ns").cast("long").alias("start_ns"), F.lit(float(c.sampling_interval())).alias("delta"), F.transform("p", lambda p: p["v"]).alias("samples"),
    )


def time_coordinate(start_ns: int, n: int, delta: float, ignore_last_sample: bool = False, kind: str = "sampled", dim: str = "time") -> C.Coordinate:
    """The time axis of a trace, its step to the microsecond."""
    step, n = round(delta * 1e6) * 1000, n - bool(ignore_last_sample)
    if kind == "interpolated":
        return C.Interp([0, n - 1] if n > 1 else [0][:n], [start_ns, start_ns + (n - 1) * step] if n > 1 else [start_ns][:n], dim, True)
    return C.Sampled(np.array([start_ns][: int(n > 0)], np.int64), [n] if n > 0 else [], step, dim, True)


def from_traces(traces: DataFrame, dim: str = "time") -> LabeledFrame:
    """A frame channel x time of traces with one start, step and length."""
    first = traces.agg(F.min("start_ns"), F.max("start_ns"), F.min("delta"), F.max("delta"), F.min(F.size("samples")), F.max(F.size("samples")), F.array_sort(F.collect_set("channel"))).first()
    lo, hi, d0, d1, n0, n1, names = first
    if lo != hi or d0 != d1 or n0 != n1:
        raise ValueError("traces aren't synchronized; group them by start, step and length first")
    axis = traces.sparkSession.createDataFrame(list(enumerate(names)), "channel__i long, channel string")
    packed = traces.join(F.broadcast(axis) if len(names) <= BROADCAST_ROWS else axis, "channel").select("channel__i", "samples")  # one row a channel
    coords = {"channel": C.Dense(np.array(names, object), "channel"), dim: C.Sampled(np.array([lo]), [n0], int(round(d0 * C.NS)), dim, True)}
    shell = LabeledFrame(packed.withColumn(idx(dim), F.lit(0)), ("channel", dim), coords, extents={"channel": len(names), dim: n0})
    return unpack(packed, shell, dim, coords, n0)


def write_sds(traces: DataFrame, folder: str, flat: bool = False) -> None:
    """Partitioned by year, network, station, channel and day of year (or not at all)."""
    start = F.timestamp_micros((F.col("start_ns") / 1000).cast("long"))
    rows = traces.withColumn("year", F.year(start)).withColumn("julday", F.dayofyear(start))
    writer = rows.write.mode("append")
    (writer if flat else writer.partitionBy("year", "network", "station", "channel", "julday")).parquet(folder)
