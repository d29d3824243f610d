"""Threshold picks and tapered selections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coords as C
from .axis import window_expr
from .dsp import kernels
from .frame import LabeledFrame, idx, with_label
from .operators.blocks import BROADCAST_ROWS, cut_blocks
from .pack import pack


def find_picks(f: LabeledFrame, thresh: float, dim: str = "last") -> DataFrame:
    """One row a pick: label (or index) columns of all dims and ``value``.

    A trigger is on from the first sample above ``thresh`` to the next below half
    of it; its pick is the first largest sample in between.  Unfinished triggers
    give none; NaN neither starts nor ends one.  For positive thresholds this is
    windows only: the state is the last sample that was clearly on or off.
    """
    dim = f.axis(dim)
    lanes = f.lanes(dim)
    if thresh > 0:
        x, i = F.col(f.value), F.col(idx(dim))
        w = Window.partitionBy(*lanes).orderBy(idx(dim))
        mark = F.when(F.isnan(x), None).when(x > thresh, 1).when(x < thresh / 2, 0)
        on = F.coalesce(F.last(F.col("__m"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        rows = f.df.withColumn("__m", mark).withColumn("__on", on)
        before = F.coalesce(F.lag("__on").over(w), F.lit(0))
        rows = rows.withColumn("__no", F.sum(((F.col("__on") == 1) & (before == 0)).cast("long")).over(w))
        ends = (F.col("__on") == 0) & (before == 1)
        rows = rows.withColumn("__end", ends).filter((F.col("__on") == 1) | F.col("__end"))
        best = F.max(F.when((F.col("__on") == 1) & ~F.isnan(x), F.struct(x.alias("v"), (-i).alias("i"))))
        picks = rows.groupBy(*lanes, "__no").agg(best.alias("b"), F.bool_or("__end").alias("done")).filter("done")
        return _labelled(f, picks.select(*lanes, (-F.col("b.i")).alias(idx(dim)), F.col("b.v").alias("value")))
    return _labelled(f, trigger_lanes(pack(f, dim), dim, thresh))


def trigger_lanes(packed: DataFrame, dim: str, thresh: float) -> DataFrame:
    """The same by the state machine, lane by lane, for any threshold."""
    lanes = [c for c in packed.columns if c != "samples"]
    types = [packed.schema[c].dataType.simpleString() for c in lanes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, value = [], [], []
            for r, samples in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for i, v in kernels.trigger(np.asarray(samples, float), thresh)[0]:
                    at.append(r)
                    place.append(i)
                    value.append(v)
            taken = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(place, pa.int64()), pa.array(value, pa.float64())], names=[*lanes, idx(dim), "value"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(lanes, types)), f"`{idx(dim)}` long", "value double"])
    return packed.mapInArrow(run, schema)


def _labelled(f: LabeledFrame, picks: DataFrame) -> DataFrame:
    for d in f.dims:
        c = f.coords.get(d)
        picks = with_label(picks, c, d) if c is not None and c.size >= 0 else picks.withColumn(d, F.col(idx(d)))
    return picks.select(*[idx(d) for d in f.dims], *f.dims, "value")


def next_fast_len(n: int) -> int:
    """The least size from n on with no prime factor over 11."""
    while True:
        rest = n
        for p in (2, 3, 5, 7, 11):
            while rest % p == 0 and rest > 1:
                rest //= p
        if rest <= 1:
            return n
        n += 1


def tapered_selection(f: LabeledFrame, spans: DataFrame, dim: str = "last", window=None, size: int | None = None) -> LabeledFrame:
    """Samples of each lane between its ``start`` and ``end`` labels (both included), tapered
    at both ends and padded with zeros to ``size`` (default: the next fast length for transforms).

    ``spans``: the other dims' index columns, start and end; lanes without both
    are left out, and the others of a frame of two dims are numbered anew.  The
    selected axis starts at 0.  ``window``: weights, whose first half goes to a
    span's beginning and second half to its end (of an odd number, the one in the
    middle is left out), or a name, applied over the whole span.  No span may be
    shorter than the weights.
    """
    dim = f.axis(dim)
    lanes = f.lanes(dim)
    c = f.coords[dim]
    spans = spans.filter("start IS NOT NULL AND end IS NOT NULL")
    rows = with_label(f.df, replace(c, dim=dim) if c.dim is None else c, "__t").join(spans, lanes)
    rows = rows.filter((F.col("__t") >= F.col("start")) & (F.col("__t") <= F.col("end")))
    lane = Window.partitionBy(*lanes)
    rows = rows.withColumn("__k", F.row_number().over(lane.orderBy(idx(dim))) - 1).withColumn("__n", F.count("*").over(lane))
    x = F.col(f.value)
    if isinstance(window, str):
        x = x * window_expr(window, F.col("__k"), F.col("__n").cast("double"))
    picked = rows.select(*lanes, F.col("__k").cast("long").alias(idx(dim)), "__n", x.alias(f.value))
    least, most = picked.agg(F.min("__n"), F.max("__n")).first()
    if most is None:
        raise ValueError("no lane has both a start and an end")
    size = size or next_fast_len(most)
    if window is not None and not isinstance(window, str):
        if least < len(window):
            raise ValueError("a span is shorter than the window")
        half = len(window) // 2
        head, tail = (F.array(*[F.lit(float(v)) for v in part]) if half else None for part in (window[:half], window[len(window) - half :]))
        if half:
            k, n = F.col(idx(dim)), F.col("__n")
            weight = F.when(k < half, F.get(head, k.cast("int"))).when(k >= n - half, F.get(tail, (k - n + half).cast("int"))).otherwise(F.lit(1.0))
            picked = picked.withColumn(f.value, F.col(f.value) * weight)
    picked = picked.drop("__n")
    coords = {k: v for k, v in f.coords.items() if v.dim != dim}
    extents = f.extents | {dim: size}
    cells = picked.select(*lanes).distinct().withColumn(idx(dim), F.explode(F.expr(f"sequence(0L, {size - 1}L)")))
    filled = cells.join(picked, [*lanes, idx(dim)], "left").withColumn(f.value, F.coalesce(f.value, F.lit(0.0)))
    if len(lanes) == 1:
        kept = [r[0] for r in picked.select(*lanes).distinct().orderBy(*lanes).collect()]  # at most the axis' size
        other = next(d for d in f.dims if d != dim)
        numbers = f.df.sparkSession.createDataFrame(list(enumerate(kept)), "__new long, __old long")
        numbers = F.broadcast(numbers) if len(kept) <= BROADCAST_ROWS else numbers
        filled = filled.join(numbers, F.col(lanes[0]) == F.col("__old")).withColumn(lanes[0], F.col("__new")).drop("__new", "__old")
        coords = {k: v.take(kept) if v.dim == other and not isinstance(v, C.Column) else v for k, v in coords.items()}
        extents |= {other: len(kept)}
    step = c.sampling_interval()
    coords[dim] = C.Interp([0, size - 1], [0.0, (size - 1) * step], dim) if size > 1 else C.Interp([0], [0.0], dim)
    return f._with(filled.select(*[idx(d) for d in f.dims], f.value), coords=coords, extents=extents)


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, direction: str = "ffill", value: str = "value", *, target: int = 50_000) -> DataFrame:
    """Each left row with the right row at or before (ffill), at or after (bfill) or nearest to it.

    Both sides are merged in order within ``by``, in blocks of about ``target``
    rows along ``on``; what lies beyond a block's ends is handed on, one row a
    block.  ``match`` and ``match_value`` are null where there is none, or ``on``
    is null.  Of right rows at one time, ffill takes the one with the largest value and bfill
    the smallest; nearest takes the earlier of two as near.
    """
    if direction not in ("ffill", "bfill", "nearest"):
        raise ValueError(f"direction must be ffill, bfill or nearest, not {direction}")
    by = by or []
    kind = right.schema[on].dataType.typeName()
    line = {"timestamp": "unix_micros(`{0}`)", "timestamp_ntz": "unix_micros(cast(`{0}` AS timestamp))"}.get(kind, "cast(`{0}` AS bigint)").format(on)
    pair = F.struct(F.col(on).alias("t"), F.col(value).alias("v"))
    one = right.filter(F.col(on).isNotNull()).groupBy(*by, on).agg((F.min if direction == "bfill" else F.max)(pair).alias("__p"))
    # of one time, the right row comes before the left ones, or after them where it is sought ahead
    rank = F.expr(f"cast('{2**63 - 1 if direction == 'bfill' else -(2**63)}' AS bigint)")
    r = one.withColumn("__side", F.lit(0)).withColumn("__rank", rank)
    l = left.withColumn("__p", F.lit(None).cast(one.schema["__p"].dataType)).withColumn("__side", F.lit(1)).withColumn("__rank", F.xxhash64(*left.columns))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__key", F.struct(*by) if by else F.lit(0)).withColumn("__at", F.expr(line))
    both, cut = cut_blocks(both, "__key", "__at", target=target, fine=16, ties=None if kind in ("double", "float") else "__rank")
    # both look back along an order: a window that looks ahead to the end is computed anew for every row
    w = Window.partitionBy("__key", "block").rowsBetween(Window.unboundedPreceding, 0)
    back = F.last("__p", ignorenulls=True).over(w.orderBy(on, "__rank"))
    ahead = F.last("__p", ignorenulls=True).over(w.orderBy(F.desc(on), F.desc("__rank")))
    both = both.withColumn("__b", back).withColumn("__a", ahead)
    if cut is not None:
        ends = both.groupBy("__key", "block").agg(F.max("__p").alias("__last"), F.min("__p").alias("__first"))
        blocks = Window.partitionBy("__key").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
        before = F.max("__last").over(blocks.orderBy("block"))
        after = F.min("__first").over(blocks.orderBy(F.desc("block")))
        ends = ends.select(F.col("__key").alias("__k"), F.col("block").alias("__n"), before.alias("__before"), after.alias("__after"))
        both = both.join(ends, both["__key"].eqNullSafe(F.col("__k")) & (both["block"] == F.col("__n")))
        both = both.withColumn("__b", F.coalesce("__b", "__before")).withColumn("__a", F.coalesce("__a", "__after"))
    b, a, t = F.col("__b"), F.col("__a"), F.col(on)
    found = {"ffill": b, "bfill": a, "nearest": F.when(b.isNull() | (a["t"] - t < t - b["t"]), F.coalesce(a, b)).otherwise(b)}[direction]
    out = both.withColumn("__f", F.when(t.isNotNull(), found)).filter("__side = 1")
    return out.select(*left.columns, F.col("__f.t").alias("match"), F.col("__f.v").alias("match_value"))
