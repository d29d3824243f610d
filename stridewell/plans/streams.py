"""Queries that run as streams: packed lanes arrive in blocks, out of order and
some twice, in several micro-batches; results are those of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsp.design import firwin
from ..pack import pack
from ..pipeline import Atom, DownSample, LFilter, Sequential
from ..session import ensure_checkpoint_dir
from ..streaming.stateful import blocks_of, filter_stream, pick_stream, process
from .arrays import _PICKS, GRID, R, query, tidy
from .filters_sql import FILTERS
from .views import EV, ev_grid

BLOCK = 96


def _arriving(spark: SparkSession, folder: str, common_mode: bool = False) -> tuple[DataFrame, str]:
    """A stream of the grid's lanes in blocks, from files in the shared folder."""
    place = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    f = ev_grid(spark, folder)
    f = f - f.reduce("mean", "lane") if common_mode else f
    blocks = blocks_of(pack(f, "time").withColumnRenamed("lane__i", "lane"), BLOCK)
    again = blocks.filter(f"pmod(i0 div {BLOCK}, 3) = 0")  # delivered twice
    blocks.unionByName(again).repartition(4, F.xxhash64("lane", "i0")).write.parquet(f"{place}/in")
    return spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/in"), place


def _run(stream: DataFrame, place: str) -> DataFrame:
    process(stream, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")


def _filtered(spark: SparkSession, folder: str, atom: Atom, digits: int = 6) -> DataFrame:
    stream, place = _arriving(spark, folder)
    out = _run(filter_stream(stream, atom), place)
    rows = out.select("lane", "i0", F.posexplode("samples").alias("p", "v"))
    return rows.select((F.col("i0") + F.col("p")).alias("time__i"), F.col("lane").alias("lane__i"), (F.round("v", digits) + F.lit(0.0)).alias("value"))


_W = "OVER (PARTITION BY lane__i ORDER BY time__i)"


@query("stream_find_picks", _PICKS.replace("SELECT n.time__i, q.lane__i, n.h * 3600000000000 AS time, q.lane, round", "SELECT n.time__i, q.lane__i, round"))
def _(spark, folder):
    stream, place = _arriving(spark, folder, common_mode=True)
    picks = _run(pick_stream(stream, 100.0), place)
    return picks.select(F.col("i").alias("time__i"), F.col("lane").alias("lane__i"), tidy(F.col("value")).alias("value"))


query("stream_downsample", EV + f"SELECT time__i // 5 AS time__i, lane__i, {R.format('value')} AS value FROM g WHERE time__i % 5 = 0")(
    lambda s, d: _filtered(s, d, DownSample(5)))
query("stream_fir", EV + f"SELECT {GRID.format(f'0.5 * value + 0.3 * coalesce(lag(value) {_W}, 0) + 0.2 * coalesce(lag(value, 2) {_W}, 0)')} FROM g")(
    lambda s, d: _filtered(s, d, LFilter([0.5, 0.3, 0.2], [1.0])))
query("stream_filter_decimate", FILTERS["stream_filter_decimate"])(
    lambda s, d: _filtered(s, d, Sequential([LFilter(firwin(31, 0.2), [1.0]), DownSample(4)]), 4))


@query("stream_window_sums", "SELECT event_type, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n, sum(CAST(round(value * 10000) AS BIGINT))::BIGINT AS q FROM events GROUP BY ALL")
def _(spark, folder):
    """Daily sums per type by event time; the watermark bounds the state."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    place = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    whole = _is_folder(path)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if whole else "events.parquet").parquet(path if whole else folder)
    rows = events.select(F.col("ts").cast("timestamp").alias("at"), "event_type", F.round(F.col("value") * 10000).cast("long").alias("q"))
    sums = rows.withWatermark("at", "30 days").groupBy("event_type", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("q").alias("q"))
    flat = sums.select("event_type", F.expr("unix_micros(w.start) div 86400000000").alias("day"), "n", "q")
    flat_schema = flat.schema

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out")  # all sums as they are now

    stream = flat.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(flat_schema).parquet(f"{place}/out")


def _is_folder(path: str) -> bool:
    import os

    return os.path.isdir(path.removeprefix("file://"))
