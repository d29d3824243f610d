"""Far too many small files: plan, rewrite and reconcile their consolidation.

The manifest is frozen first: one row a file with its path in one spelling, its
true number of records and a fingerprint of its set of records, stored in the
shared folder so that every later step sees the same.  Of files with
the same records one is kept.  The kept files are put in order, their bytes are
summed along it, and target-sized intervals of the sum are the output files.
Planning is SQL only; the running sum is taken within blocks of the order and
carried over one row for each block.  After the rewrite the written files are
read back and compared with the manifest: numbers of files and records, and
the sums of the records' hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import time_blocks

RECORD_BYTES = 24  # time, channel and value as they are, before compression
TARGET_BYTES = 128 << 20
SALTS = 32
_RECORD = ["time__ns", "distance__i", "value"]


def tidy_path(path):
    """One spelling of a path: no scheme, no empty or '.' steps."""
    bare = F.regexp_replace(path, r"^[a-z][a-z0-9+]*://+", "/")
    return F.regexp_replace(F.regexp_replace(bare, r"(/\.)+(?=/)", ""), r"/{2,}", "/")


def distinct_records(file_rows: DataFrame) -> DataFrame:
    """Each record once a file. NaN equals NaN, -0.0 equals 0.0, null equals null."""
    value = (F.col("value") + F.lit(0.0)).alias("value")
    return file_rows.filter("file_id IS NOT NULL").select("file_id", "time__ns", "distance__i", value).distinct()


def fingerprints(file_rows: DataFrame) -> DataFrame:
    """file_id, records and two hashes of each file's set of records, whatever its order."""
    return _marks(distinct_records(file_rows), "file_id")


def _marks(records: DataFrame, *by: str) -> DataFrame:
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in _RECORD]
    hashed = records.select(*by, F.xxhash64(*_RECORD, *spelled).alias("a"), F.xxhash64(F.lit(7), *spelled).alias("b"))
    return hashed.groupBy(*by).agg(F.count("*").alias("records"), F.sum(F.col("a").cast("decimal(38,0)")).alias("sum_a"), F.bit_xor("b").alias("xor_b"))


def manifest(file_list: DataFrame, file_rows: DataFrame) -> DataFrame:
    """The frozen manifest: one row for each file of the list or with records.

    file_id, path, mtime (first arrival), listed_records (what the list says,
    which may be missing or wrong), records, bytes, kept_as (the file that is kept
    for it: the smallest id with the same set of records; null without records),
    sum_a and xor_b (hashes of its records).
    """
    ensure_checkpoint_dir(file_list.sparkSession)
    listed = file_list.filter("file_id IS NOT NULL").groupBy("file_id").agg(
        F.min(F.struct("mtime", tidy_path(F.col("path")).alias("path"), F.col("n_records").alias("n"))).alias("f")
    )
    listed = listed.select("file_id", "f.mtime", "f.path", F.col("f.n").alias("listed_records"))
    marks = fingerprints(file_rows).checkpoint()  # one row a file, used twice
    # a class of copies may hold any share of the files: its join key is salted
    salt = F.expr(f"cast(pmod(xxhash64(file_id), {SALTS}) as int)")
    first = marks.groupBy("records", "sum_a", "xor_b").agg(F.min("file_id").alias("kept_as"), F.collect_set(salt).alias("salts"))
    first = first.withColumn("salt", F.explode("salts")).drop("salts")
    classed = marks.withColumn("salt", salt).join(first, ["records", "sum_a", "xor_b", "salt"]).select("file_id", "records", "sum_a", "xor_b", "kept_as")
    found = listed.join(classed, "file_id", "full").withColumn("records", F.coalesce("records", F.lit(0)))
    return found.withColumn("bytes", F.col("records") * RECORD_BYTES).checkpoint()


def plan(frozen: DataFrame, target_bytes: int = TARGET_BYTES, *, block_rows: int = 50_000) -> DataFrame:
    """file_id, out_file, records and hashes of all kept files; output files follow (mtime, file_id).

    An output file holds the files that begin in its interval of the running sum,
    so it is larger than the target by less than its last file.
    """
    kept = frozen.filter("kept_as = file_id").select("file_id", "records", "sum_a", "xor_b", "bytes", F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")), F.lit(0)).alias("at"))
    placed = time_blocks(kept.withColumn("all", F.lit(0)), "all", "at", target=block_rows, ties="file_id", fine=16)
    blocks = placed.groupBy("block").agg(F.sum("bytes").alias("b"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("block", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("block").orderBy("at", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("before", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(blocks, "block")
    return summed.select("file_id", F.expr(f"(ahead + before) div {target_bytes}").alias("out_file"), "records", "sum_a", "xor_b")


def rewrite(file_rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The records of the output files: out_file, file_id, time__ns, distance__i, value."""
    return distinct_records(file_rows).join(planned.select("file_id", "out_file"), "file_id").select("out_file", "file_id", *_RECORD)


def write(file_rows: DataFrame, planned: DataFrame, folder: str) -> None:
    """Write one Parquet file for each output file, whose rows meet in one task."""
    rows = rewrite(file_rows, planned)
    rows.repartition("out_file").sortWithinPartitions("out_file", "time__ns", "distance__i").write.mode("overwrite").partitionBy("out_file").parquet(folder)


def reconcile(planned: DataFrame, written: DataFrame) -> DataFrame:
    """Per output file: files and records planned and written, bytes, and whether they agree.

    ``written``: the output files as read back.  They agree if no file or record
    is missing or there twice, and every record is the one that was planned.
    """
    planned_, of_file = planned.groupBy("out_file"), _marks(written, "out_file", "file_id")
    wanted = planned_.agg(F.count("*").alias("files"), F.sum("records").alias("planned_records"), F.sum("sum_a").alias("want_a"), F.bit_xor("xor_b").alias("want_b"))
    got = of_file.groupBy("out_file").agg(
        F.count("*").alias("written_files"), F.sum("records").alias("written_records"), F.sum("sum_a").alias("got_a"), F.bit_xor("xor_b").alias("got_b")
    )
    joined = wanted.join(got, "out_file", "full")
    same = " AND ".join(f"{a} = {b}" for a, b in (("files", "written_files"), ("planned_records", "written_records"), ("want_a", "got_a"), ("want_b", "got_b")))
    return joined.select(
        "out_file", "files", "planned_records", "written_records",
        (F.col("written_records") * RECORD_BYTES).alias("bytes"), F.coalesce(F.expr(same), F.lit(False)).alias("agrees"),
    )
