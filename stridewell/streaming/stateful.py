"""Lane operators on streams of blocks.

Rows are blocks (lane, i0, samples) and may come late, out of order or twice.
Each lane's state holds the next sample awaited, blocks that came too early, and
the chain's own state; blocks are worked on as soon as they join on.  Results
equal those of the whole lane.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..pipeline import Atom, Trigger

_STATE = "data binary"


class OrderedBlocks:
    """Joins blocks of one lane into a gapless sequence."""

    def __init__(self, first: int = 0, most_pending: int = 10_000):
        self.next, self.pending, self.most = first, {}, most_pending

    def push(self, i0: int, samples: np.ndarray) -> Iterator[np.ndarray]:
        if i0 + len(samples) > self.next and len(samples):
            if i0 not in self.pending or len(samples) > len(self.pending[i0]):
                self.pending[i0] = samples
        yield from self.ready()
        if len(self.pending) > self.most:
            raise RuntimeError(f"{len(self.pending)} blocks wait for sample {self.next}")

    def ready(self) -> Iterator[np.ndarray]:
        while self.pending:
            at = min(self.pending)
            if at > self.next:
                break
            samples = self.pending.pop(at)
            fresh = samples[self.next - at :]
            self.next += len(fresh)
            if len(fresh):
                yield fresh

    def skip(self) -> int:
        """Give up what lies before the first waiting block; how many samples that is."""
        if not self.pending:
            return 0
        lost = min(self.pending) - self.next
        self.next += lost
        return lost


def _load(state: GroupState, fresh: Callable):
    return pickle.loads(state.get[0]) if state.exists else fresh()


def _run(blocks: DataFrame, lane: str, columns: str, work: Callable, gap: Callable, when: str | None, patience: str | None) -> DataFrame:
    """The lanes' blocks in order through ``work(inner, key, samples) -> (rows, inner)``.

    With ``when`` (a timestamp column) and ``patience``, a lane whose next block
    hasn't come when the watermark has passed the waiting ones goes on after the
    gap: ``gap(inner, next) -> inner``.
    """
    kind = blocks.schema[lane].dataType.simpleString()
    names = [lane, *[c.split()[0] for c in columns.split(", ")]]
    if when:
        blocks = blocks.withWatermark(when, patience or "0 seconds")

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        order, inner, latest = _load(state, lambda: (OrderedBlocks(), None, 0))
        rows: list[tuple] = []

        def take(samples: np.ndarray) -> None:
            nonlocal inner
            found, inner = work(inner, key[0], samples)
            rows.extend(found)

        if state.hasTimedOut:
            while order.skip():
                inner = gap(inner, order.next)
                for x in order.ready():
                    take(x)
                break  # one gap at a time: later blocks may still come
        else:
            for frame in frames:
                if when and len(frame):
                    latest = max(latest, int(pd.Timestamp(frame[when].max()).value // 1_000_000))
                for i0, samples in zip(frame["i0"], frame["samples"]):
                    for x in order.push(int(i0), np.asarray(samples, float)):
                        take(x)
        state.update((pickle.dumps((order, inner, latest)),))
        if when and order.pending:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if when else GroupStateTimeout.NoTimeout
    return blocks.groupBy(lane).applyInPandasWithState(step, f"`{lane}` {kind}, {columns}", _STATE, "append", timeout)


def filter_stream(blocks: DataFrame, atom: Atom, fs: float = 1.0, lane: str = "lane", when: str | None = None, patience: str | None = None) -> DataFrame:
    """A chain of stages on a stream (or a batch) of lane, i0, samples blocks.

    A lost block holds its lane up, unless ``when`` names a time column and
    ``patience`` how far the watermark lies behind it: then the chain begins anew after the gap.
    """

    def work(inner, key, samples):
        state, at = inner or (None, 0)
        y, state = atom.call(samples[None], state, fs)
        rows = [(key, at, y[0])] if y.shape[1] else []
        return rows, (state, at + y.shape[1])

    def gap(inner, place):
        return None, math.ceil(place * atom.factor(fs) - 1e-9)

    return _run(blocks, lane, "i0 long, samples array<double>", work, gap, when, patience)


def pick_stream(blocks: DataFrame, thresh: float, lane: str = "lane", when: str | None = None, patience: str | None = None) -> DataFrame:
    """Threshold picks of each lane: lane, i (place in the lane), value.  A gap (see :func:`filter_stream`) drops an open trigger."""
    trigger = Trigger(thresh)

    def work(inner, key, samples):
        picks, inner = trigger.call(samples, inner)
        return [(key, i, v) for i, v in picks], inner

    return _run(blocks, lane, "i long, value double", work, lambda inner, place: {"offset": place, "open": None}, when, patience)


def process(stream: DataFrame, folder: str, checkpoint: str, kind: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Run a stream over all that is there into files, exactly once."""
    writer = stream.writeStream.outputMode("append").format(kind).option("path", folder).option("checkpointLocation", checkpoint)
    if kind == "csv":
        writer = writer.option("header", True)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def blocks_of(packed: DataFrame, size: int) -> DataFrame:
    """Packed lanes cut into blocks of ``size`` samples: the other columns, i0, samples."""
    cut = F.expr(f"sequence(0L, greatest(0L, cast(size(samples) - 1 as long)), {size}L)")
    rows = packed.withColumn("i0", F.explode(cut))
    return rows.withColumn("samples", F.expr(f"slice(samples, cast(i0 + 1 as int), {size})"))


class Monitor(StreamingQueryListener):
    """Running shares (0.3 for the newest batch) of the time that streams spend reading, working and writing."""

    PARTS = {"read": ("latestOffset", "getBatch", "queryPlanning"), "work": ("addBatch",), "write": ("walCommit", "commitOffsets", "commitBatch")}

    def __init__(self, weight: float = 0.3):
        self.weight, self.shares, self.batches = weight, {}, 0

    def note(self, durations: dict) -> None:
        spent = {part: sum(durations.get(k, 0) for k in keys) for part, keys in self.PARTS.items()}
        total = sum(spent.values())
        if not total:
            return
        now = {part: ms / total for part, ms in spent.items()}
        self.shares = {k: self.weight * v + (1 - self.weight) * self.shares.get(k, v) for k, v in now.items()}
        self.batches += 1

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.note(dict(event.progress.durationMs))

    def onQueryTerminated(self, event) -> None:
        pass


def progress(query: StreamingQuery) -> dict:
    """Rows, rate and times of the last micro-batch."""
    p = query.lastProgress
    return {} if p is None else {"rows": p["numInputRows"], "rows_per_s": p.get("processedRowsPerSecond"), "ms": dict(p["durationMs"])}
