"""Long exact spans shared between records, by level-wise doubling.

A window of ``length`` (200) characters is *shared* if it stands verbatim in
the text of another document too.  What isn't repeated at a short length isn't
at a longer one, so windows are followed from level to level (50, 100, 200):
those found in one document only are dropped, the others are extended to twice
their length, until the last level decides and no candidate is left.

Not every short window has to be followed.  Of the 50-character windows inside a
200-character one, that with the smallest hash stands for it: the choice depends
on the characters alone, so equal long windows follow equal short ones at equal
places.  Neighbouring long windows with the same short one form a run.

1. First level.  Runs are keyed by their short window.  A run whose window is
   found in one document only is dropped.
2. Middle levels.  The texts of the documents with runs left are read again.  In
   each run the window is doubled to the right, for the long windows that go on
   so far, and to the left for the others; again only repeated ones are kept.
3. Last level.  The run's context is all text its long windows cover (200 to 300
   characters).  If it is repeated in another document, so are all its
   windows.  Of the runs left, the context itself is brought together by key,
   one copy per distinct context, and its 200-character windows are compared.

Shared windows that overlap or touch are then joined per document.

Skew.  Within a block of documents equal windows (at the last level, contexts)
of several documents are known to be repeated: they are combined before the
shuffle, so that a key's rows are bounded by the number of blocks (and of its
distinct contexts).  A key of the last level in more than ``hot_share`` of all
runs (by default a quarter of what an average shuffle partition holds; the list
sent to the workers has at most 2 / hot_share keys) isn't used as a key:
its contexts are compared by themselves, and their windows one by one, keyed by
themselves.  Keys with more than ``group_rows`` distinct contexts
are compared window by window in the JVM, too, instead of in one worker's memory.
All ways give the same result; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BASE = 0x9E3779B97F4A7C15
_SEEDS = "h long, run long, doc long, multi boolean, stand_in boolean"
_RUNS = "h long, ctx long, doc long, a int, n int, multi boolean, stand_in boolean, hot boolean"
_LEFT = np.uint64(0xA5A5A5A5A5A5A5A5)  # keeps windows doubled to the left apart


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters close values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WindowHashes:
    """Hashes of windows of a text: sums of mixed characters times powers."""

    def __init__(self, capacity: int = 1 << 16):
        self._grow(capacity)

    def _grow(self, n: int) -> None:
        steps = np.full(n + 1, BASE, np.uint64)
        steps[0] = 1
        self.up = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        self.down = np.cumprod(steps, dtype=np.uint64)

    def load(self, text: str) -> None:
        raw = text.encode("utf-32-le", "surrogatepass")
        code = np.frombuffer(raw, np.uint32).astype(np.uint64)
        if len(code) >= len(self.up):
            self._grow(2 * len(code))
        code = _mix(code + np.uint64(0x632BE59BD9B4E019)) * self.up[: len(code)]
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code, out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Hash of the window of this size at each place."""
        h = (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]
        return _mix(h)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours (block-wise prefix and suffix minima)."""
    n = len(x) - width + 1
    rows = -(-len(x) // width) + 1
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


class Runs:
    """Runs of long windows of some texts: number of the text, first window, number of windows, place of the followed window."""

    def __init__(self, number: np.ndarray, a: np.ndarray, n: np.ndarray, at: np.ndarray):
        self.number, self.a, self.n, self.at = number, a, n, at

    def pack(self) -> np.ndarray:
        return (self.a << 32) | (self.n << 16) | (self.at - self.a)

    @classmethod
    def unpack(cls, number: np.ndarray, packed: np.ndarray) -> Runs:
        a = packed >> 32
        return cls(number, a, (packed >> 16) & 0xFFFF, a + (packed & 0xFFFF))


class Chunk:
    """A few texts, loaded one after the other."""

    def __init__(self, hashes: WindowHashes, texts: list[str], length: int):
        hashes.load("".join(texts))
        self.hashes, self.length = hashes, length
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.size) - self.size

    def seeds(self, seed: int) -> tuple[Runs, np.ndarray]:
        """All runs and the hash of each one's short window."""
        length, size, first = self.length, self.size, self.first
        short = self.hashes.every(seed)
        place_bits = np.uint64(max(1, int(len(short)).bit_length()))
        key = ((short >> place_bits) << place_bits) | np.arange(len(short), dtype=np.uint64)
        low = _sliding_min(key, length - seed + 1)
        windows = size - length + 1
        text_no = np.repeat(np.arange(len(size)), windows)
        start = np.arange(len(text_no)) + np.repeat(first - (np.cumsum(windows) - windows), windows)
        low = low[start]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (text_no[1:] != text_no[:-1])
        begin = np.flatnonzero(new)
        anchor = (low[begin] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
        number = text_no[begin]
        runs = Runs(number, start[begin] - first[number], np.diff(np.append(begin, len(low))), anchor - first[number])
        return runs, short[anchor]

    def double(self, runs: Runs, size: int) -> tuple[Runs, np.ndarray]:
        """Runs whose windows of ``size`` became twice as long, and their hashes.

        Long windows that end before a window doubled to the right does have it
        doubled to the left, so a run may become two.
        """
        border = np.clip(runs.at + 2 * size - self.length, runs.a, runs.a + runs.n)  # the first long window that reaches so far
        number = np.concatenate([runs.number, runs.number])
        a, end = np.concatenate([border, runs.a]), np.concatenate([runs.a + runs.n, border])
        at = np.concatenate([runs.at, runs.at - size])
        left = np.arange(len(a)) >= len(border)
        keep = end > a
        number, a, end, at, left = (x[keep] for x in (number, a, end, at, left))
        base = self.first[number] + at
        h = self.hashes.at(base, base + 2 * size)
        return Runs(number, a, end - a, at), np.where(left, _mix(h ^ _LEFT), h)

    def contexts(self, runs: Runs) -> np.ndarray:
        base = self.first[runs.number] + runs.a
        return self.hashes.at(base, base + runs.n + (self.length - 1))


def _levels(length: int, seed: int | None) -> list[int]:
    """Lengths at which windows are followed before the last one."""
    levels = [seed or length // 4]
    while 2 * levels[-1] < length:
        levels.append(2 * levels[-1])
    if len(levels) < 2 or 2 * levels[-1] != length or length > 0xFFFF:
        raise ValueError("the length must be the first level's, doubled at least twice")
    return levels


def _as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _scattered(doc: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Keys that bring nothing together, for rows that are decided."""
    return _mix(doc.view(np.uint64) * np.uint64(BASE) + a.astype(np.uint64))


def _combine(doc: np.ndarray, h: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows of one block by key and context, whether each one's context is in two of
    its documents, and which rows are the first of such: they stand in for all."""
    order = np.lexsort((doc, ctx, h))
    doc, h, ctx = doc[order], h[order], ctx[order]
    new = np.ones(len(doc), bool)
    new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
    begin = np.flatnonzero(new)
    ends = np.append(begin[1:], len(doc)) - 1
    repeated = (doc[begin] != doc[ends])[np.cumsum(new) - 1] if len(doc) else new
    return order, repeated, new & repeated


def _seed_batch(doc: np.ndarray, run: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    order, repeated, lead = _combine(doc, h, np.zeros(len(h), np.uint64))
    doc, run, h = doc[order], run[order], h[order]
    key = np.concatenate([np.where(repeated, _scattered(doc, run), h), h[lead]])
    flags = np.concatenate([repeated, np.ones(int(lead.sum()), bool)])
    stands = np.arange(len(key)) >= len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(_as_long(key)), pa.array(np.concatenate([run, run[lead]])), pa.array(np.concatenate([doc, doc[lead]])), pa.array(flags), pa.array(stands)],
        names=["h", "run", "doc", "multi", "stand_in"],
    )


def _run_batch(doc: np.ndarray, a: np.ndarray, n: np.ndarray, h: np.ndarray, ctx: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    order, repeated, lead = _combine(doc, h, ctx)
    doc, a, n, h, ctx, hot = (x[order] for x in (doc, a, n, h, ctx, hot))
    both = lambda x, y: np.concatenate([x, y[lead]])
    flags = np.concatenate([repeated, np.ones(int(lead.sum()), bool)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(_as_long(both(np.where(repeated, _scattered(doc, a), h), h))), pa.array(_as_long(both(ctx, ctx))),
            pa.array(both(doc, doc)), pa.array(both(a, a).astype(np.int32)), pa.array(both(n, n).astype(np.int32)),
            pa.array(flags), pa.array(np.arange(len(flags)) >= len(doc)), pa.array(both(hot & ~repeated, hot)),
        ],
        names=["h", "ctx", "doc", "a", "n", "multi", "stand_in", "hot"],
    )


def _over_texts(length: int, block_chars: int, chunk_chars: int, scan, batch):
    """A stage over documents: ``scan`` gives the rows of a chunk of texts (with what comes along in
    a third column), ``batch`` makes one batch of the rows of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, chars = WindowHashes(), [], 0
        waiting, size = [], 0

        def work() -> None:
            docs, texts, *more = zip(*waiting)
            held.append(scan(Chunk(hashes, list(texts), length), np.array(docs, np.int64), *more))

        for rows in batches:
            for row in zip(*(rows.column(k).to_pylist() if k < 2 else rows.column(k) for k in range(rows.num_columns))):
                waiting.append(row)
                size += len(row[1])
                if size >= chunk_chars:
                    work()
                    chars += size
                    waiting, size = [], 0
                    if chars >= block_chars:
                        yield batch(*map(np.concatenate, zip(*held)))
                        held, chars = [], 0
        if waiting:
            work()
        if held:
            yield batch(*map(np.concatenate, zip(*held)))

    return run


def _given(packed) -> Runs:
    """The runs that came along with texts."""
    sizes = [len(p) for p in packed]
    flat = np.concatenate([np.asarray(p.values) for p in packed]) if packed else np.zeros(0, np.int64)
    return Runs.unpack(np.repeat(np.arange(len(sizes)), sizes), flat)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 .. s-1 for each s of sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _compare_windows(length: int, chunk_rows: int = 3000):
    """Spans from rows sorted by key; all rows of a key are compared at once."""
    hashes = WindowHashes()
    nothing = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["doc", "s", "e"])

    def spans(t: pa.Table) -> pa.RecordBatch:
        key, doc, a, n, multi = (t.column(c).to_numpy() for c in ("h", "doc", "a", "n", "multi"))
        slices = t.column("slice").to_pylist()
        n = n.astype(np.int64)
        hashes.load("".join(x or "" for x in slices))
        size = np.fromiter((len(x or "") for x in slices), np.int64, len(slices))
        at = np.repeat(np.cumsum(size) - size, n) + _counting(n)
        keyed = np.repeat(size == 0, n)  # a window that is its own key
        window = np.repeat(key.view(np.uint64), n)
        window[~keyed] = hashes.at(at[~keyed], at[~keyed] + length)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(window, kind="stable")
        w, d, m = window[order], doc[row[order]], multi[row[order]]
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        begin = np.flatnonzero(new)
        group_shared = (np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)) | np.logical_or.reduceat(m, begin)
        shared = np.empty(len(w), bool)
        shared[order] = group_shared[np.cumsum(new) - 1]
        shared &= ~multi[row]
        on = np.flatnonzero(shared)
        if not len(on):
            return nothing
        cut = np.flatnonzero((np.diff(on) != 1) | (np.diff(row[on]) != 0))
        lo, hi = on[np.append(0, cut + 1)], on[np.append(cut, len(on) - 1)]
        place = _counting(n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[row[lo]]),
                pa.array((a[row[lo]] + place[lo]).astype(np.int32)),
                pa.array((a[row[hi]] + place[hi] + length).astype(np.int32)),
            ],
            names=["doc", "s", "e"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk_rows:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("h").to_numpy()
            complete = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if complete:
                yield spans(t.slice(0, complete))
            held = t.slice(complete).to_batches()
            rows = t.num_rows - complete
        yield spans(pa.Table.from_batches(held)) if rows else nothing

    return run


def merge_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Longest stretches of overlapping or touching [start, end) per key."""
    order = Window.partitionBy(key).orderBy(start, end)
    far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("__new", (F.col(start) > far) | far.isNull())
    island = cut.withColumn("__no", F.sum(F.col("__new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "__no").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__no")


def shared_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, length: int = 200, seed: int | None = None,
                 hot_share: float | None = None, group_rows: int = 20_000, block_chars: int = 8_000_000,
                 chunk_chars: int = 60_000) -> DataFrame:
    """Longest stretches of each text made of shared ``length``-character windows.

    Columns ``id_col`` (long), ``span_start``, ``span_end`` (code points, end
    exclusive).  Rows without id or text, and texts under ``length`` characters,
    have no spans.  Repeated rows of one id count as one document, so text
    repeated only within a document isn't shared.  Other columns are ignored.
    An empty table gives no rows.  ``seed`` is the first level's length (a
    quarter of ``length``, or an eighth and so on).
    """
    levels = _levels(length, seed)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    share = hot_share or 1 / (4 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = _hot_keys(docs, length, levels, share, block_chars, chunk_chars)
    by_key, by_ctx = Window.partitionBy("h"), Window.partitionBy("h", "ctx")

    def repeated(w):
        return F.max("multi").over(w) | (F.min("doc").over(w) != F.max("doc").over(w))

    def stage(scan, batch):
        return _over_texts(length, block_chars, chunk_chars, scan, batch)

    def first(chunk: Chunk, doc: np.ndarray):
        runs, h = chunk.seeds(levels[0])
        return doc[runs.number], runs.pack(), h

    def middle(size: int):
        def scan(chunk: Chunk, doc: np.ndarray, packed):
            runs, h = chunk.double(_given(packed), size)
            return doc[runs.number], runs.pack(), h

        return scan

    def last(chunk: Chunk, doc: np.ndarray, packed):
        runs, h = chunk.double(_given(packed), levels[-2])
        ctx = chunk.contexts(runs)
        burning = np.isin(h, hot)
        return doc[runs.number], runs.a, runs.n, np.where(burning, _mix(h ^ ctx), h), ctx, burning

    def candidates(seeds: DataFrame) -> DataFrame:
        """Documents with the runs that a level leaves."""
        kept = seeds.withColumn("kept", repeated(by_key)).filter("kept AND NOT stand_in")
        kept = kept.groupBy("doc").agg(F.collect_list("run").alias("runs"))
        return docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "runs")

    left = candidates(docs.mapInArrow(stage(first, _seed_batch), _SEEDS))
    for size in levels[:-2]:
        left = candidates(left.mapInArrow(stage(middle(size), _seed_batch), _SEEDS))
    runs = left.mapInArrow(stage(last, _run_batch), _RUNS)

    level = (
        runs.select("*", repeated(by_key).alias("by_key"), repeated(by_ctx).alias("by_ctx"), F.count("*").over(by_key).alias("rows"),
                    F.row_number().over(by_ctx.orderBy("doc", "a")).alias("rn"))
        .filter("by_key OR hot")
        .withColumn("undecided", F.col("hot") | F.max(~F.col("by_ctx")).over(by_key))
        .select("h", "doc", "a", "n", F.col("by_ctx").alias("multi"), (F.col("by_ctx") & ~F.col("stand_in")).alias("done"),
                (F.col("undecided") & (~F.col("by_ctx") | (F.col("rn") == 1))).alias("open"), ((F.col("rows") > group_rows) | F.col("hot")).alias("large"))
    )
    done = level.filter("done").select("doc", F.col("a").alias("s"), F.expr(f"a + n + {length - 1}").alias("e"))
    joined = docs.join(level.filter("open").hint("shuffle_hash"), F.col("doc_id") == F.col("doc"))
    sliced = joined.select("h", "doc", "a", "n", "multi", "large", F.substring("text", F.col("a") + 1, F.col("n") + (length - 1)).alias("slice"))
    # rows of large groups: one row for each window, which is its own key
    rows = sliced.select(
        F.explode(
            F.expr(f"""
            CASE WHEN large
            THEN transform(sequence(0, n - 1), i -> named_struct('h', xxhash64(substring(slice, i + 1, {length})), 'doc', doc, 'a', a + i,
                'n', 1, 'multi', multi, 'slice', cast(null AS string)))
            ELSE array(named_struct('h', h, 'doc', doc, 'a', a, 'n', n, 'multi', multi, 'slice', slice)) END
            """)
        ).alias("r")
    ).select("r.*")
    compared = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_compare_windows(length), "doc long, s int, e int")
    merged = merge_spans(compared.unionByName(done), "doc", "s", "e")
    return merged.select(F.col("doc").alias(id_col), F.col("s").alias("span_start"), F.col("e").alias("span_end"))


def _hot_keys(docs: DataFrame, length: int, levels: list[int], share: float, block_chars: int, chunk_chars: int) -> np.ndarray:
    """All keys of the last level in ``share`` of all runs or more, and no more than 2 / share keys.

    Each block of documents reports keys with at least half that share of its
    own runs. What a block doesn't report adds up to less than half the share,
    so a key over the share has at least half of it in the reports.
    """

    def scan(chunk: Chunk, doc: np.ndarray):
        runs, h = chunk.seeds(levels[0])
        for size in levels[:-1]:
            runs, h = chunk.double(runs, size)
        return (h,)

    def report(h: np.ndarray) -> pa.RecordBatch:
        keys, n = np.unique(h, return_counts=True)
        often = n >= max(2, share / 2 * len(h))
        return pa.RecordBatch.from_arrays(
            [pa.array([None, *_as_long(keys[often]).tolist()], pa.int64()), pa.array([len(h), *n[often].tolist()], pa.int64())], names=["h", "n"]
        )

    ensure_checkpoint_dir(docs.sparkSession)
    counted = docs.mapInArrow(_over_texts(length, block_chars, chunk_chars, scan, report), "h long, n long")
    reports = counted.groupBy("h").agg(F.sum("n").alias("n")).checkpoint()
    total = reports.filter("h IS NULL").collect()
    if not total:
        return np.zeros(0, np.uint64)
    top = reports.filter(f"h IS NOT NULL AND n >= {share / 2 * total[0]['n']}").collect()
    return np.array([r["h"] for r in top], np.int64).view(np.uint64)


def shared_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document with shared text: number of spans and shared characters."""
    spans = shared_spans(df, id_col, text, **options)
    length = F.sum(F.col("span_end") - F.col("span_start"))
    return spans.groupBy(id_col).agg(F.count("*").alias("n_spans"), length.alias("shared_chars"))
