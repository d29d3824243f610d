"""Long and packed layouts, and kernels over packed lanes.

Packed: one row a lane with its samples in order.  A chain of kernels along one
dimension packs once and runs in one Arrow stage (see :func:`run_lanes`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import coords as C
from .frame import LabeledFrame, idx

Kernel = Callable[[np.ndarray], np.ndarray]


def pack(f: LabeledFrame, dim: str = "last") -> DataFrame:
    """lane index columns and ``samples``, in order along the dimension."""
    dim = f.axis(dim)
    pair = F.struct(F.col(idx(dim)).alias("i"), F.col(f.value).cast("double").alias("v"))
    rows = f.df.groupBy(*f.lanes(dim)).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return rows.select(*f.lanes(dim), F.transform("p", lambda p: p["v"]).alias("samples"))


def unpack(packed: DataFrame, f: LabeledFrame, dim: str, coords: dict, size: int | None = None, new_dim: str | None = None) -> LabeledFrame:
    new = new_dim or dim
    rows = packed.select(*f.lanes(dim), F.posexplode("samples").alias("p", f.value)).withColumn(idx(new), F.col("p").cast("long")).drop("p")
    extents = {d: n for d, n in f.extents.items() if d != dim} | ({new: size} if size else {})
    return f._with(rows, dims=tuple(new if d == dim else d for d in f.dims), coords=coords, extents=extents)


def run_lanes(packed: DataFrame, kernels: list[Kernel], complex_out: bool = False) -> DataFrame:
    """Apply kernels, one after the other, to (lanes x samples) arrays of equal length."""
    lanes = [c for c in packed.columns if c != "samples"]
    kind = "array<struct<re:double,im:double>>" if complex_out else "array<double>"
    schema = ", ".join([*(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in lanes), f"samples {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            out: list = [None] * batch.num_rows
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[starts[rows][:, None] + np.arange(size)]
                for kernel in kernels if size else ():
                    x = kernel(x)
                for r, y in zip(rows, x):
                    out[r] = y
            lens = np.array([len(y) for y in out], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            values = np.concatenate(out) if out else np.zeros(0)
            if complex_out:
                values = values.astype(complex)
                item = pa.StructArray.from_arrays([pa.array(values.real.copy()), pa.array(values.imag.copy())], names=["re", "im"])
            else:
                item = pa.array(values.astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, item)], names=[*lanes, "samples"])

    return packed.mapInArrow(run, schema)


def along(f: LabeledFrame, dim: str, kernel: Kernel | list[Kernel], coord=None, size: int | None = None, complex_out: bool = False, new_dim: str | None = None) -> LabeledFrame:
    """Kernels along a dimension; ``coord`` is the new coordinate of it (default: as it was)."""
    dim = f.axis(dim)
    new = new_dim or dim
    coords = {k: c for k, c in f.coords.items() if c.dim != dim or (coord is None and new == dim)}
    if coord is not None:
        coords[new] = coord
    out = run_lanes(pack(f, dim), kernel if isinstance(kernel, list) else [kernel], complex_out)
    return unpack(out, f, dim, coords, size, new_dim)


#: Samples of a lane up to which it is one row; longer lanes are worked on block by block where a kernel can.
LANE_SAMPLES = 4_000_000
BLOCK_SAMPLES = 1_000_000

Stage = Callable[[np.ndarray, object, bool, bool], tuple[np.ndarray, object]]


def pack_blocks(f: LabeledFrame, dim: str, block: int = BLOCK_SAMPLES) -> DataFrame:
    """lane index columns, ``block`` and its ``samples`` in order; what is left at the end belongs to the last block."""
    last = max(0, f.size(dim) // block - 1)
    pair = F.struct(F.col(idx(dim)).alias("i"), F.col(f.value).cast("double").alias("v"))
    keyed = f.df.withColumn("block", F.expr(f"least(`{idx(dim)}` div {block}, {last}L)"))
    rows = keyed.groupBy(*f.lanes(dim), "block").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return rows.select(*f.lanes(dim), "block", F.transform("p", lambda p: p["v"]).alias("samples"))


def run_blocks(blocks: DataFrame, stage: Stage, backward: bool = False) -> DataFrame:
    """A stage over the blocks of each lane, one after the other (or from the last to the first).

    ``stage(samples, state, first, last)`` gives the block's new samples and the
    state for the next; a task holds one lane's block at a time, never the lane.
    """
    lanes = [c for c in blocks.columns if c not in ("block", "samples")]
    order = [F.col("block").desc() if backward else F.col("block").asc()]
    counted = blocks.groupBy(*lanes).agg(F.min("block").alias("__lo"), F.max("block").alias("__hi")) if lanes else blocks.agg(F.min("block").alias("__lo"), F.max("block").alias("__hi"))
    rows = blocks.join(counted, lanes) if lanes else blocks.withColumn("__k", F.lit(0)).join(counted.withColumn("__k", F.lit(0)), "__k").drop("__k")
    rows = rows.repartition(*lanes).sortWithinPartitions(*lanes, *order) if lanes else rows.coalesce(1).sortWithinPartitions(*order)
    schema = ", ".join([*(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in lanes), "block long", "samples array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, state = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                here = tuple(row.column(c)[0].as_py() for c in lanes)
                at, lo, hi = (row.column(c)[0].as_py() for c in ("block", "__lo", "__hi"))
                begins, ends = (at == hi, at == lo) if backward else (at == lo, at == hi)
                if begins or here != lane:
                    lane, state = here, None
                x = row.column("samples").flatten().to_numpy(zero_copy_only=False)
                y, state = stage(x, state, begins, ends)
                item = pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), pa.array(np.asarray(y, float)))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in lanes), pa.array([at], pa.int64()), item], names=[*lanes, "block", "samples"])

    return rows.select(*lanes, "block", "samples", "__lo", "__hi").mapInArrow(run, schema)


def unpack_blocks(blocks: DataFrame, f: LabeledFrame, dim: str, block: int = BLOCK_SAMPLES) -> LabeledFrame:
    rows = blocks.select(*f.lanes(dim), "block", F.posexplode("samples").alias("p", f.value))
    rows = rows.withColumn(idx(dim), F.col("block") * block + F.col("p")).drop("block", "p")
    return f._with(rows)


def rate(f: LabeledFrame, dim: str) -> float:
    c = f.coords.get(f.axis(dim))
    step = c.sampling_interval() if c is not None and not isinstance(c, C.Column) else 1.0
    return 1.0 / step
