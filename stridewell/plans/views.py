"""The driver tables seen as labeled frames, in Spark and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import coords as C
from ..frame import LabeledFrame
from ..tables import table

HOUR_NS = 3_600_000_000_000


def event_cells(spark: SparkSession, folder: str) -> DataFrame:
    """h (hours since 1970), lane, q (value in 1/10000, so that sums are exact)."""
    hour = F.expr("unix_micros(cast(ts AS timestamp)) div 3600000000")
    q = F.round(F.col("value") * 10000).cast("long")
    return table(spark, folder, "events").select(hour.alias("h"), F.col("event_type").alias("lane"), q.alias("q"))


def ev_grid(spark: SparkSession, folder: str, holes: bool = False) -> LabeledFrame:
    """Hourly sums per event type: dims time and lane. Empty cells are 0, or NaN with ``holes``."""
    ev = event_cells(spark, folder)
    lo, hi, lanes = ev.agg(F.min("h"), F.max("h"), F.array_sort(F.collect_set("lane"))).first()  # types label an axis
    if lo is None:
        lo, hi, lanes = 0, -1, []
    n = hi - lo + 1
    axis = spark.createDataFrame(list(enumerate(lanes)), "lane__i long, lane string")
    sums = ev.groupBy("h", "lane").agg(F.sum("q").alias("q"))
    cells = axis.select("lane__i", "lane", F.explode(F.expr(f"sequence({lo}L, {hi}L)")).alias("h")) if n > 0 else axis.withColumn("h", F.lit(0).cast("long")).limit(0)
    empty = F.lit(float("nan")) if holes else F.lit(0.0)
    df = cells.join(sums, ["h", "lane"], "left").select(
        (F.col("h") - lo).alias("time__i"), "lane__i", F.coalesce(F.col("q") / F.lit(10000.0), empty).alias("value")
    )
    coords = {"time": C.Sampled(np.array([lo * HOUR_NS], np.int64), [n], HOUR_NS, "time", True) if n > 0 else C.Default(0, "time"),
              "lane": C.Dense(np.array(lanes, dtype=object), "lane")}
    return LabeledFrame(df, ("time", "lane"), coords)


EV = """
WITH ev AS (SELECT epoch_us(ts) // 3600000000 AS h, event_type AS lane, CAST(round(value * 10000) AS BIGINT) AS q FROM events),
b AS (SELECT min(h) AS lo, max(h) AS hi FROM ev),
lanes AS (SELECT lane, row_number() OVER (ORDER BY lane) - 1 AS lane__i FROM (SELECT DISTINCT lane FROM ev)),
cells AS (SELECT lane, lane__i, h, h - lo AS time__i FROM lanes, b, LATERAL (SELECT unnest(range(lo, hi + 1)) AS h)),
g AS (SELECT c.lane, c.lane__i, c.h, c.time__i, CAST(coalesce(sum(q), 0) AS DOUBLE) / 10000e0 AS value, count(q) AS n
      FROM cells c LEFT JOIN ev e ON e.h = c.h AND e.lane = c.lane GROUP BY ALL),
gn AS (SELECT time__i, lane__i, h, lane, CASE WHEN n > 0 THEN value END AS x FROM g)
"""


def ev_counts(spark: SparkSession, folder: str) -> LabeledFrame:
    """The same grid with the number of events in each cell."""
    f = ev_grid(spark, folder)
    lo = f.coords["time"].start // HOUR_NS
    lanes = f.coords["lane"].data.tolist()
    axis = spark.createDataFrame(list(enumerate(lanes)), "lane__i long, lane string")
    counts = event_cells(spark, folder).groupBy("h", "lane").agg(F.count("*").alias("n")).join(F.broadcast(axis), "lane")  # types label an axis
    counts = counts.select((F.col("h") - lo).alias("time__i"), "lane__i", "n")
    df = f.df.drop("value").join(counts, ["time__i", "lane__i"], "left").select("time__i", "lane__i", F.coalesce("n", F.lit(0)).cast("long").alias("value"))
    return f._with(df)


def ev_raw(spark: SparkSession, folder: str) -> LabeledFrame:
    """Events in time order of their type; the label stays a column."""
    df = table(spark, folder, "events").select(
        F.col("event_type").alias("lane"), F.expr("unix_micros(cast(ts AS timestamp)) * 1000").alias("time_ns"), "value", "event_id"
    )
    return LabeledFrame(df, (), {"time": C.Column("time_ns", None, True)})


def li_cube(spark: SparkSession, folder: str) -> LabeledFrame:
    """Quantity by month, return flag and line status: a 3-D frame."""
    li = table(spark, folder, "lineitem").select(
        F.expr("year(l_shipdate) * 12 + month(l_shipdate) - 1").alias("m"), "l_returnflag", "l_linestatus", F.col("l_quantity").alias("q")
    )
    lo, hi, flags, states = li.agg(F.min("m"), F.max("m"), F.array_sort(F.collect_set("l_returnflag")), F.array_sort(F.collect_set("l_linestatus"))).first()
    sums = li.groupBy("m", "l_returnflag", "l_linestatus").agg(F.sum("q").alias("value"))
    df = sums.select(
        (F.col("m") - lo).cast("long").alias("month__i"), (F.array_position(F.array(*map(F.lit, flags)), F.col("l_returnflag")) - 1).cast("long").alias("flag__i"),
        (F.array_position(F.array(*map(F.lit, states)), F.col("l_linestatus")) - 1).cast("long").alias("status__i"), "value",
    )
    coords = {"month": C.Interp([0, hi - lo], [lo, hi], "month"), "flag": C.Dense(np.array(flags, object), "flag"), "status": C.Dense(np.array(states, object), "status")}
    return LabeledFrame(df, ("month", "flag", "status"), coords)


LI = """
WITH li AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, l_returnflag AS fl, l_linestatus AS st, l_quantity AS q FROM lineitem),
fls AS (SELECT fl, row_number() OVER (ORDER BY fl) - 1 AS flag__i FROM (SELECT DISTINCT fl FROM li)),
sts AS (SELECT st, row_number() OVER (ORDER BY st) - 1 AS status__i FROM (SELECT DISTINCT st FROM li)),
cube AS (SELECT m - (SELECT min(m) FROM li) AS month__i, flag__i, status__i, sum(q) AS value FROM li JOIN fls USING (fl) JOIN sts USING (st) GROUP BY ALL)
"""


def emb_mat(spark: SparkSession, folder: str) -> LabeledFrame:
    """Embeddings as a matrix: dims vec and k."""
    df = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "value"))
    df = df.select(F.col("vec_id").alias("vec__i"), F.col("k").cast("long").alias("k__i"), F.col("value").cast("double").alias("value"))
    return LabeledFrame(df, ("vec", "k"), {"k": C.Default(64, "k")}, extents={"k": 64})


EMB = """
WITH emb AS (SELECT vec_id AS vec__i, k - 1 AS k__i, CAST(embedding[k] AS DOUBLE) AS value
             FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS k))
"""
