"""Implausible readings: spikes, stuck values and impossible ones.

Each lane (a channel of an instrument) has a hidden Markov model with the states
normal, spike, stuck and out of range.  Its emissions are relative to the lane:
a reading's distance from the local level in local spreads, whether it repeats
the one before (against how often the lane does so), and the instrument's hard
bounds.  The stated rules are where a state can emit at all: out of range what
lies beyond the bounds, stuck in runs of twelve and more of one value, spike
beyond ten spreads in at most three readings after which the level is taken up
again; normal anywhere but beyond the bounds and in stuck runs, and less and
less likely away from the level.  How often a lane changes its state is taken
from the lane (one step of expectation and maximisation); a reading's flag is
its most probable state by forward and backward probabilities.

The chain is evaluated in short segments side by side: the segments' transfer
matrices are multiplied out for all segments at once, messages step from segment
to segment, and posteriors follow within all segments at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import broadcast_checked, time_blocks

NORMAL, SPIKE, STUCK, OUT = range(4)
#: State changes before a lane is known; the lane's own are these with this many steps of weight, and its counts.
TRANSITIONS = np.array([[0.985, 0.005, 0.005, 0.005], [0.5, 0.4, 0.05, 0.05], [0.05, 0.005, 0.94, 0.005], [0.5, 0.05, 0.05, 0.4]])
PRIOR_STEPS = 200.0
SPIKE_DENSITY = 5e-3  # of a distance in spreads, anywhere beyond the ten


@dataclass(frozen=True)
class Rules:
    spreads: float = 10.0
    longest_spike: int = 3
    shortest_stuck: int = 12
    level_reach: int = 12  # readings on either side for the level
    spread_reach: int = 40  # and for the spread

    @property
    def context(self) -> int:
        """Plausible readings on either side that decide a reading, with what may be a stuck run's rest at the outer end."""
        return self.level_reach + self.spread_reach + self.longest_spike + self.shortest_stuck


def _rolling_median(x: np.ndarray, reach: int) -> np.ndarray:
    reach = min(reach, max(0, (len(x) - 1)))
    padded = np.pad(x, reach, mode="reflect") if len(x) > reach else np.pad(x, reach, mode="edge")
    windows = sliding_window_view(padded, 2 * reach + 1)
    out = np.empty(len(windows))
    for at in range(0, len(windows), 16384):  # bounded copies
        out[at : at + 16384] = np.partition(windows[at : at + 16384], reach, axis=1)[:, reach]
    return out


def local_normal(x: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Level and spread around each of a lane's plausible readings."""
    level = _rolling_median(x, rules.level_reach)
    spread = 1.4826 * _rolling_median(np.abs(x - level), rules.spread_reach)
    if len(spread) and not spread.all():  # flat stretches: the lane's own resolution
        gaps = np.diff(np.unique(x))
        spread = np.where(spread > 0, spread, gaps.min() if len(gaps) else np.inf)
    return level, spread


def _runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number of each element and run lengths, from flags of run starts."""
    number = np.cumsum(start) - 1
    return number, np.bincount(number, minlength=int(start.sum()))


def posteriors(emission: np.ndarray, chain: np.ndarray, segment: int = 64, changes: np.ndarray | None = None) -> np.ndarray:
    """State probabilities (n x 4) of chains that follow each other in ``emission``.

    ``chain``: number of the chain of each element (0, 1, ... in order);
    ``changes``: each chain's state changes (chains x 4 x 4).
    """
    n = len(emission)
    length = np.bincount(chain)
    pieces = -(-length // segment)
    first = np.cumsum(pieces) - pieces
    within = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    row, column = first[chain] + within // segment, within % segment
    total = int(pieces.sum())
    e = np.ones((segment, total, 4))
    e[column, row] = emission
    used = np.zeros((segment, total), bool)
    used[column, row] = True
    step = np.repeat(TRANSITIONS[None] if changes is None else changes, pieces if changes is not None else total, axis=0)
    identity = np.eye(4)
    transfer = np.broadcast_to(identity, (total, 4, 4)).copy()
    for k in range(segment):
        m = np.where(used[k][:, None, None], step * e[k][:, None, :], identity)
        transfer = transfer @ m
        transfer /= transfer.max(axis=(1, 2), keepdims=True)
    # messages into each segment, all chains at once
    into = np.full((total, 4), 0.25)
    outof = np.full((total, 4), 0.25)
    for k in range(1, int(pieces.max(initial=0))):
        at = first[pieces > k] + k
        message = (into[at - 1][:, None, :] @ transfer[at - 1])[:, 0]
        into[at] = message / message.sum(1, keepdims=True)
        last = first[pieces > k] + pieces[pieces > k] - 1 - k
        message = (transfer[last + 1] @ outof[last + 1][:, :, None])[:, :, 0]
        outof[last] = message / message.sum(1, keepdims=True)
    forward = np.empty((segment, total, 4))
    now = into
    for k in range(segment):
        moved = (now[:, None, :] @ step)[:, 0] * e[k]
        now = np.where(used[k][:, None], moved / moved.sum(1, keepdims=True), now)
        forward[k] = now
    now = outof
    result = np.empty((segment, total, 4))
    for k in range(segment - 1, -1, -1):
        both = forward[k] * now
        result[k] = both / both.sum(1, keepdims=True)
        back = (step @ (e[k] * now)[:, :, None])[:, :, 0]
        now = np.where(used[k][:, None], back / back.sum(1, keepdims=True), now)
    return result[column, row]


def own_changes(p: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """State changes of each chain, from its state probabilities and the common ones."""
    chains = int(chain[-1]) + 1
    on = np.flatnonzero(chain[1:] == chain[:-1])
    counts = np.empty((chains, 4, 4))
    for a in range(4):
        for b in range(4):
            counts[:, a, b] = np.bincount(chain[on], p[on, a] * p[on + 1, b], chains)
    counts += PRIOR_STEPS * TRANSITIONS
    return counts / counts.sum(2, keepdims=True)


def _repeats(values: np.ndarray, chain: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per reading: first of its lane, same as the one before, its run, and whether that run is long enough to be stuck."""
    start = np.ones(len(values), bool)
    start[1:] = chain[1:] != chain[:-1]
    same = np.zeros(len(values), bool)
    same[1:] = (values[1:] == values[:-1]) & ~start[1:]
    run, run_length = _runs(~same)
    return start, same, run, run_length[run] >= rules.shortest_stuck


def lacking(values: np.ndarray, out_of_range: np.ndarray, chain: np.ndarray, core: np.ndarray, ends: np.ndarray, rules: Rules) -> np.ndarray:
    """Per chain (a block of a lane): are there too few plausible readings around its own, though the lane goes on?

    ``ends`` (per chain): 1 if it holds the lane's first rows, 2 the last, 3 both.
    """
    short = np.zeros(len(ends), bool)
    if not len(values):
        return short
    clean = np.flatnonzero(~out_of_range & ~_repeats(values, chain, rules)[3])
    size = np.bincount(chain[clean], minlength=len(ends))
    place = np.arange(len(clean)) - np.repeat(np.cumsum(size) - size, size)
    own, place = chain[clean][core[clean]], place[core[clean]]
    before, after = np.full(len(ends), len(values)), np.full(len(ends), len(values))
    np.minimum.at(before, own, place)
    np.minimum.at(after, own, size[own] - 1 - place)
    return ((before < rules.context) & (ends & 1 == 0)) | ((after < rules.context) & (ends & 2 == 0))


def flag(values: np.ndarray, out_of_range: np.ndarray, chain: np.ndarray, rules: Rules = Rules()) -> np.ndarray:
    """Cause of each reading (0 none, 1 spike, 2 stuck, 3 out of range): its most probable state.

    ``chain``: lane number of each reading, readings of a lane in time order
    without missing ones.  No lane's own state changes can outweigh the emissions
    by so much that the same reading is flagged in one block and not in another:
    beyond ten spreads normal is e**-50 of what it is at the level, and changes
    are bounded by their common part.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int8)
    start, same, run, long_run = _repeats(values, chain, rules)
    clean = np.flatnonzero(~out_of_range & ~long_run)
    z, far = np.zeros(n), np.zeros(n, bool)
    edges = np.append(np.flatnonzero(np.diff(chain[clean], prepend=-1)), len(clean)) if len(clean) else np.zeros(1, np.int64)
    for lo, hi in zip(edges, edges[1:]):
        at = clean[lo:hi]
        x = values[at]
        level, spread = local_normal(x, rules)
        with np.errstate(over="ignore", invalid="ignore"):
            away = np.abs(x - level)
            z[at] = np.where(away > 0, away / spread, 0.0)
            far[at] = away > rules.spreads * spread
    lanes = int(chain[-1]) + 1
    repeats = np.bincount(chain, same & ~long_run, lanes) / np.maximum(1, np.bincount(chain, ~long_run, lanes))
    p_same = np.clip(repeats, 1e-3, 0.5)[chain]
    brief = np.zeros(n, bool)  # far for a short time, then back at the level
    if len(clean):
        apart = np.zeros(len(clean), bool)
        apart[edges[:-1]] = True
        f = far[clean]
        begin = apart.copy()
        begin[1:] |= f[1:] != f[:-1]
        number, size = _runs(begin)
        starts = np.flatnonzero(begin)
        after = starts + size
        resumed = (after < len(clean)) & ~np.append(apart, True)[after]
        brief[clean] = f & (size[number] <= rules.longest_spike) & resumed[number]
    # a far reading that stays, or isn't followed, is a change of level: as normal as any
    near = np.where(far & ~brief, 1.0, np.exp(-0.5 * np.minimum(z, 25.0) ** 2))
    e = np.zeros((n, 4))
    e[:, NORMAL] = near * np.where(same, p_same, (1 - p_same) * 0.3989)
    e[long_run, NORMAL] = 0.0
    e[brief, SPIKE] = SPIKE_DENSITY
    e[long_run, STUCK] = 0.98
    e[out_of_range] = (0.0, 0.0, 0.0, 1.0)
    p = posteriors(e, chain)
    p = posteriors(e, chain, changes=own_changes(p, chain))
    return p.argmax(1).astype(np.int8)


def implausible(df: DataFrame, *, lane: str, at: str, row_id: str, value: str, low: str, high: str, step: str | None = None,
                rules: Rules = Rules(), target: int = 50_000, halo: int = 256) -> DataFrame:
    """Flagged readings: row_id, pos, cause ('spike', 'stuck' or 'out of range').

    ``value`` is a number (pos is 0) or, with ``step`` (ns between samples), an
    array of numbers (pos is the place in it, ``at`` the time of its first).
    Null and NaN are missing and never flagged; a null bound doesn't bind.  Rows
    with a null lane, time or id are left out; rows delivered twice (same id) are
    taken once.  Long lanes are cut into blocks that overlap by ``halo`` rows (a
    sixteenth of it where a row has many readings).
    A block that finds fewer plausible readings there than the rules look around
    (long stuck runs, many deliveries) is taken again with a wider overlap.
    """
    packed = step is not None
    rows = df.select(
        F.col(lane).alias("lane"), F.col(at).cast("long").alias("at"), F.col(row_id).cast("long").alias("row_id"),
        *([F.col(step).cast("long").alias("step"), F.col(value).cast("array<double>").alias("value"), F.col(low).alias("low"), F.col(high).alias("high")] if packed else
          [F.col(value).cast("double").alias("value"), F.expr(f"coalesce({value} < {low} OR {value} > {high}, false)").alias("out")]),
    ).filter("lane IS NOT NULL AND at IS NOT NULL AND row_id IS NOT NULL AND value IS NOT NULL")
    if not packed:
        rows = rows.filter("NOT isnan(value)")

    def batch_flags(t: pa.Table) -> pa.RecordBatch:
        take = {c: t.column(c).to_numpy() for c in ("lane", "block", "at", "row_id", "core", "ends")}
        new = np.ones(t.num_rows, bool)
        new[1:] = (take["lane"][1:] != take["lane"][:-1]) | (take["block"][1:] != take["block"][:-1])
        again = np.zeros(t.num_rows, bool)
        again[1:] = (take["row_id"][1:] == take["row_id"][:-1]) & ~new[1:]
        chain = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        ends = np.bitwise_or.reduceat(take["ends"], first)
        pos = np.zeros(t.num_rows, np.int32)
        if packed:
            t, chain = t.filter(pa.array(~again)), chain[~again]
            lists = t.column("value").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lists)), size)
            pos = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            number = lambda c: t.column(c).to_numpy()
            time = number("at")[row] + pos * np.nan_to_num(number("step").astype(float)).astype(np.int64)[row]
            low_, high_ = (t.column(c).to_numpy().astype(float)[row] for c in ("low", "high"))
            ids, core, chain = number("row_id")[row], number("core")[row], chain[row]
            with np.errstate(invalid="ignore"):
                out = (values < low_) | (values > high_)
            keep = np.flatnonzero(~np.isnan(values))
            keep = keep[np.lexsort((pos[keep], time[keep], chain[keep]))]
        else:
            values, out, ids, core = t.column("value").to_numpy(), t.column("out").to_numpy(), take["row_id"], take["core"]
            keep = np.flatnonzero(~again)
        values, out, ids, core, chain, pos = (x[keep] for x in (values, out, ids, core, chain, pos))
        short = lacking(values, out, chain, core, ends, rules)
        held, chain = chain, np.unique(chain, return_inverse=True)[1]
        cause = flag(values, out, chain, rules)
        on = (cause > 0) & core & ~short[held]
        names = np.array(["", "spike", "stuck", "out of range"], object)
        at, none = first[short], int(on.sum())
        rest = len(at)  # one row for each block that has to be taken again, without an id
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(none, lanes), pa.array(take["lane"][at], lanes)]), pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(take["block"][at], pa.int32())]),
             *(pa.concat_arrays([x, pa.nulls(rest, x.type)]) for x in (pa.array(ids[on]), pa.array(pos[on]), pa.array(names[cause[on]], pa.string())))],
            names=["lane", "block", "row_id", "pos", "cause"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < (2000 if packed else 100_000):
                continue
            t = pa.Table.from_batches(held)
            lane_of, blocks = t.column("lane").to_numpy(), t.column("block").to_numpy()
            open_group = np.flatnonzero((lane_of != lane_of[-1]) | (blocks != blocks[-1]))
            done = int(open_group[-1]) + 1 if len(open_group) else 0  # the last group may go on
            if done:
                yield batch_flags(t.slice(0, done))
            held, count = t.slice(done).to_batches(), t.num_rows - done
        if count:
            yield batch_flags(pa.Table.from_batches(held))

    lane_type = rows.schema["lane"].dataType
    lanes = to_arrow_type(lane_type)

    def flagged(rows: DataFrame, halo: int, only: DataFrame | None = None) -> DataFrame:
        placed = time_blocks(rows, "lane", "at", target=max(1, target // 64) if packed else target, halo=halo, ties="row_id", ends=True)  # a packed row has some 64 readings
        if only is not None:
            placed = placed.join(broadcast_checked(only), ["lane", "block"], "left_semi")
        placed = placed.repartition("lane", "block").sortWithinPartitions("lane", "block", "at", "row_id")
        return placed.mapInArrow(run, f"lane {lane_type.simpleString()}, block int, row_id long, pos int, cause string").checkpoint()

    halo = max(1, halo // 16) if packed else halo
    found = flagged(rows, halo)
    parts, short = [found], found.filter("row_id IS NULL").select("lane", "block")
    while not short.isEmpty():
        halo *= 8
        again = flagged(rows.join(broadcast_checked(short.select("lane").distinct()), "lane", "left_semi"), halo, short)
        parts.append(again)
        short = again.filter("row_id IS NULL").select("lane", "block")
    return reduce(DataFrame.unionByName, parts).filter("row_id IS NOT NULL").select("row_id", "pos", "cause")
