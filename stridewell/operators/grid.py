"""Irregular readings onto a regular grid.

Readings and grid of a source are both in time order and merged as of: every
grid slot gets the last reading at or before it and the first after it, and a
value between them weighted by time, unless they lie further apart than the gap
limit.  The merge steps over readings, not over slots: slots between two
neighbouring readings share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import time_blocks


#: Slots of a gap that are written from one row.
PIECE_SLOTS = 8192


def _floor_div(x: str, by: str) -> str:
    return f"(({x}) - pmod({x}, {by})) div ({by})"


def observed_slots(runs: DataFrame, key: str, slot_ns: int) -> DataFrame:
    """First and last sample in each slot that has one.

    ``runs``: key, start (ns), n, step (ns, null or not positive: only the first
    sample is known), value0 (value of the first sample, rising by 1).  A run is
    expanded to slots, not to samples.
    """
    runs = runs.select(F.col(f"`{key}`").alias("__key"), "start", "n", "step", "value0")
    name, key = key, "__key"
    last = "start + (n - 1) * step"
    runs = runs.withColumn("n", F.expr("CASE WHEN step > 0 THEN n ELSE 1 END")).withColumn("step", F.expr("CASE WHEN step > 0 THEN step ELSE 1 END"))
    # long steps: one row a sample; short ones: one row a slot
    by_sample = runs.filter(f"step >= {slot_ns}").select(key, F.expr("explode(sequence(0L, n - 1L))").alias("__j"), "start", "step", "value0")
    by_sample = by_sample.select(key, F.expr("start + __j * step").alias("t"), F.expr("value0 + __j").alias("v"))
    by_sample = by_sample.select(
        key, F.expr(_floor_div("t", f"{slot_ns}L")).alias("slot"), F.struct("t", "v").alias("first"), F.struct("t", "v").alias("last")
    )
    by_slot = runs.filter(f"step < {slot_ns}").select(
        key, "start", "n", "step", "value0",
        F.expr(f"explode(sequence({_floor_div('start', f'{slot_ns}L')}, {_floor_div(last, f'{slot_ns}L')}))").alias("slot"),
    )
    k0 = f"greatest(0L, (slot * {slot_ns}L - start + step - 1) div step)"
    k1 = f"least(n - 1L, ((slot + 1) * {slot_ns}L - 1 - start) div step)"
    by_slot = by_slot.select(
        key, "slot",
        F.expr(f"named_struct('t', start + ({k0}) * step, 'v', value0 + ({k0}))").alias("first"),
        F.expr(f"named_struct('t', start + ({k1}) * step, 'v', value0 + ({k1}))").alias("last"),
    )
    both = by_sample.unionByName(by_slot).groupBy(key, "slot").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return both.withColumnRenamed(key, name)


def regular_grid(observed: DataFrame, key: str, slot_ns: int, *, gap_limit_ns: int | None = None, target: int = 50_000) -> DataFrame:
    """Every slot from a source's first to its last observed one.

    ``observed``: key, slot, first, last (structs of t, v) as of
    :func:`observed_slots`.  Columns: key, slot, status and value.  status is
    'observed' (the slot has a reading; value is that of its first reading),
    'filled' (value interpolated by time at the slot's beginning) or 'missing'
    (its neighbours are further apart than the limit; value null).  Sources
    without readings have no rows; an empty table gives none.
    """
    rows = observed.select(F.col(f"`{key}`").alias("__key"), "slot", "first", "last")
    name, key = key, "__key"
    rows = time_blocks(rows, key, "slot", target=target, fine=16).drop("core")
    in_block = Window.partitionBy(key, "block").orderBy("slot")
    rows = rows.withColumn("next", F.lead(F.struct("slot", "first")).over(in_block))
    # the reading after a block's last one is the first of the next block
    heads = rows.groupBy(key, "block").agg(F.min(F.struct("slot", "first")).alias("head"))
    after = heads.select(key, "block", F.lead("head").over(Window.partitionBy(key).orderBy("block")).alias("after"))
    rows = rows.join(after, [key, "block"]).withColumn("next", F.coalesce("next", "after"))
    limit = f"AND next.first.t - last.t <= {gap_limit_ns}" if gap_limit_ns is not None else ""
    # a long gap is cut in pieces first, so that no row holds all its slots
    piece = f"explode(CASE WHEN next IS NULL THEN array(slot) ELSE sequence(slot, next.slot - 1, {PIECE_SLOTS}L) END)"
    pieces = rows.select(key, "slot", "first", "last", "next", F.expr(piece).alias("g0"))
    slots = pieces.select(key, "slot", "first", "last", "next", F.expr(f"explode(sequence(g0, least(g0 + {PIECE_SLOTS - 1}L, coalesce(next.slot - 1, slot))))").alias("g"))
    share = f"(g * {slot_ns} - last.t) / (next.first.t - last.t)"
    return slots.select(
        F.col(key).alias(name), F.col("g").alias("slot"),
        F.expr(f"CASE WHEN g = slot THEN 'observed' WHEN true {limit} THEN 'filled' ELSE 'missing' END").alias("status"),
        F.expr(f"CASE WHEN g = slot THEN cast(first.v AS double) WHEN true {limit} THEN last.v + {share} * (next.first.v - last.v) END").alias("value"),
    )
