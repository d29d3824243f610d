"""Queries over the record tables, through the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import broadcast_checked
from ..operators import compaction, drift, grid, intervals, pairs, spikes, timestamps, units
from ..session import ensure_checkpoint_dir
from ..tables import table

MINUTE_NS = 60_000_000_000


def _instruments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row an instrument, broadcast if they are counted to be few."""
    return broadcast_checked(table(spark, folder, "instruments").dropDuplicates(["instrument"]).select("instrument", *columns))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    covered = intervals.coverage(table(spark, folder, "segments")).filter("step IS NOT NULL")
    covered = covered.withColumn("end", F.expr("try_add(tie_values, try_multiply(tie_lengths, step))"))
    return intervals.merge_intervals(covered, "series_id", "tie_values", "end", "step")


def p3_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The sample number of each series on whole minutes; gaps up to ten minutes filled."""
    ensure_checkpoint_dir(spark)
    runs = intervals.coverage(table(spark, folder, "segments")).select(
        "series_id", F.col("tie_values").alias("start"), F.col("tie_lengths").alias("n"), "step", F.coalesce("i0", F.lit(0)).alias("value0")
    ).checkpoint()  # read once for the sizes of series and once or twice for their slots
    seen = grid.observed_slots(runs, "series_id", MINUTE_NS)
    slots = grid.regular_grid(seen, "series_id", MINUTE_NS, gap_limit_ns=10 * MINUTE_NS)
    return slots.select("series_id", (F.col("slot") * 60).alias("slot"), "status", "value")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_grid(spark, folder).filter("status <> 'observed'").select("series_id", "slot")


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every step and rate with its unit and its value in metres, seconds or hertz."""
    found = units.header_quantities(table(spark, folder, "acq_headers"), table(spark, folder, "instruments"))
    return found.distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = units.header_quantities(table(spark, folder, "acq_headers"), table(spark, folder, "instruments"))
    return found.filter("NOT is_common").select("acq_id", "field").distinct()


def p4_instants(spark: SparkSession, folder: str) -> DataFrame:
    """The start of every acquisition as one UTC instant, with the notation it was read in."""
    clocks = _instruments(spark, folder, "tz", "date_order")
    headers = table(spark, folder, "acq_headers").select(
        "acq_id", "instrument", F.coalesce(F.when(F.trim("metadata_timestamp") != "", F.col("metadata_timestamp")), "header_time").alias("start"),
        F.unix_micros(F.col("received_ts").cast("timestamp")).alias("arrival"),
    ).filter("acq_id IS NOT NULL")
    return timestamps.normalise(headers.join(clocks, "instrument", "left"), "acq_id", "instrument", "start", "arrival")


def p4_utc(spark: SparkSession, folder: str) -> DataFrame:
    """The usable starts alone."""
    return p4_instants(spark, folder).filter("instant_us IS NOT NULL").select("acq_id", "instant_us")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.class_pairs(p4_instants(spark, folder).filter("instant_us IS NOT NULL"), "instant_us", "acq_id")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Acquisitions that share their start: the first one and the number of the others."""
    return pairs.class_members(p4_instants(spark, folder).filter("instant_us IS NOT NULL"), ["instant_us"], "acq_id")


def p4_from_order(spark: SparkSession, folder: str) -> DataFrame:
    """Dates with slashes when nobody says whether day or month comes first: the path over
    each instrument's record order decides."""
    headers = table(spark, folder, "acq_headers").select(
        "acq_id", "instrument", F.coalesce(F.when(F.trim("metadata_timestamp") != "", F.col("metadata_timestamp")), "header_time").alias("start"),
        F.unix_micros(F.col("received_ts").cast("timestamp")).alias("arrival"), F.lit(None).cast("string").alias("tz"), F.lit(None).cast("string").alias("date_order"),
    ).filter("acq_id IS NOT NULL")
    found = timestamps.normalise(headers, "acq_id", "instrument", "start", "arrival")
    return found.filter("notation LIKE 'slash%'")


def p6_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every header's attributes in one table, with schema version and fingerprint."""
    return drift.drift(table(spark, folder, "zone_headers")).drop("changes")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = drift.drift(table(spark, folder, "zone_headers"), changes_only=True)
    return found.select("device_id", "header_id", F.explode("changes").alias("c")).select("device_id", "header_id", "c.attr", "c.change")


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings of both layouts with their cause."""
    bounds = _instruments(spark, folder, "range_lo", "range_hi")
    long = table(spark, folder, "readings").select("reading_id", "lane_id", "instrument", "time__ns", "value").join(bounds, "instrument", "left")
    packed = table(spark, folder, "packed_blocks").select("block_id", "lane_id", "instrument", "start_ns", "step_ns", "samples").join(bounds, "instrument", "left")
    a = spikes.implausible(long, lane="lane_id", at="time__ns", row_id="reading_id", value="value", low="range_lo", high="range_hi")
    b = spikes.implausible(packed, lane="lane_id", at="start_ns", row_id="block_id", value="samples", low="range_lo", high="range_hi", step="step_ns")
    return a.withColumn("tbl", F.lit("readings")).unionByName(b.withColumn("tbl", F.lit("packed_blocks")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_flags(spark, folder).select("tbl", "row_id", "pos")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.manifest(table(spark, folder, "file_list"), table(spark, folder, "file_rows"))


def p5_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder).drop("sum_a", "xor_b")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files with the same records: the manifest's classes, spelled out."""
    return pairs.class_pairs(_manifest(spark, folder), "kept_as", "file_id")


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are kept more than once: the one that stays and the number of the others."""
    return pairs.class_members(_manifest(spark, folder), ["kept_as"], "file_id")


def p5_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The output file of every file that stays."""
    return compaction.plan(_manifest(spark, folder)).select("file_id", "out_file", "records")


def _consolidated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The plan, and the output files as written and read back."""
    rows = table(spark, folder, "file_rows")
    planned = compaction.plan(_manifest(spark, folder)).checkpoint()
    place = f"{ensure_checkpoint_dir(spark)}/consolidated-{uuid.uuid4().hex}"
    compaction.write(rows, planned, place)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("time__ns", "distance__i", "value")}
    schema = f"file_id long, {', '.join(f'{c} {k}' for c, k in kinds.items())}, out_file long"
    return planned, spark.read.schema(schema).parquet(place)


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return _consolidated(spark, folder)[1].select("out_file", "file_id", "time__ns", "distance__i", "value")


def p5_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.reconcile(*_consolidated(spark, folder))
