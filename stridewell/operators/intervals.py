"""Continuous periods and gaps from overlapping, nested and gapped intervals.

A mergeable aggregate: its state is a list of disjoint intervals in order, each
with the slack of the interval that begins it.  Every map partition builds one
list for each entity (or block of an entity's time line) it has rows of, and
lists of one entity are merged two by two, in a tree, until one is left; a merge
steps through both lists once.  The last step emits a list as periods and its
complement as gaps.

An entity of many rows has one such tree for each block of its time line, so
that no list outgrows a task.  Between blocks only the furthest end so far is
handed on, one row a block, and merged with the block's list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import cut_blocks

_LIST = "array<struct<s:bigint,e:bigint,slack:bigint>>"
#: Rows from which a map partition builds its lists, and list rows from which a task merges them.
LEAF_ROWS, MERGE_ROWS = 200_000, 20_000


@dataclass
class Lists:
    """One list of disjoint intervals in order for each of several nodes; list k is [offset[k], offset[k + 1])."""

    offset: np.ndarray
    s: np.ndarray
    e: np.ndarray
    slack: np.ndarray

    @property
    def nodes(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def leaf(node: np.ndarray, s: np.ndarray, e: np.ndarray, slack: np.ndarray, nodes: int) -> Lists:
    """Lists of plain intervals in any order; ``node`` (0 .. nodes - 1) says whose each is."""
    order = np.lexsort((-slack, s, node))
    node, s, e, slack = node[order], s[order], e[order], slack[order]
    n = len(s)
    by_end = np.argsort(e, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_end] = np.arange(n)
    # furthest end so far of the node: later nodes rank above all of earlier ones
    far = e[by_end][np.maximum.accumulate(node * n + rank) % n] if n else e
    new = np.ones(n, bool)
    new[1:] = (node[1:] != node[:-1]) | (s[1:] > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1 if n else first
    return Lists(np.searchsorted(node[first], np.arange(nodes + 1)), s[first], far[last], slack[first])


def _places(starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """After how many of starts[lo:hi] (in order) each x comes, counted from the beginning."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        left = np.flatnonzero(lo < hi)
        if not len(left):
            return lo
        mid = (lo[left] + hi[left]) // 2
        after = starts[mid] <= x[left]
        lo[left[after]] = mid[after] + 1
        hi[left[~after]] = mid[~after]


def merge(a: Lists, b: Lists) -> Lists:
    """Node by node, the list of what either list covers."""
    nodes = len(a.offset) - 1
    node_b = b.nodes
    place = _places(a.s, a.offset[node_b], a.offset[node_b + 1], b.s)  # interval of b comes before a's at this place
    n = len(a.s) + len(b.s)
    from_b = np.zeros(n, bool)
    from_b[place + np.arange(len(b.s))] = True
    node = np.empty(n, np.int64)
    s, e, slack = (np.empty(n, np.int64) for _ in range(3))
    for held, mine, theirs in ((node, a.nodes, node_b), (s, a.s, b.s), (e, a.e, b.e), (slack, a.slack, b.slack)):
        held[~from_b], held[from_b] = mine, theirs
    # ends rise within each list: the furthest so far is one of the two last ones
    seen_a, seen_b = np.cumsum(~from_b) - 1, np.cumsum(from_b) - 1
    far = np.where(from_b, e, np.iinfo(np.int64).min)
    for seen, held in ((seen_a, a), (seen_b, b)):
        within = seen >= held.offset[node]
        far = np.where(within, np.maximum(far, held.e[np.maximum(seen, 0)] if len(held.e) else far), far)
    new = np.ones(n, bool)
    new[1:] = (node[1:] != node[:-1]) | (s[1:] > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1 if n else first
    slack = slack[first]
    double = first[first + 1 < n] + 1  # both lists may have an interval that begins here
    double = double[~new[double] & (s[double] == s[double - 1])]
    at = np.searchsorted(first, double) - 1
    slack[at] = np.maximum(slack[at], np.where(from_b[double], b.slack[seen_b[double]] if len(b.s) else 0, a.slack[seen_a[double]] if len(a.s) else 0))
    return Lists(np.searchsorted(node[first], np.arange(nodes + 1)), s[first], far[last], slack)


def tree(lists: Lists, group: np.ndarray, groups: int) -> Lists:
    """All lists of each group (``group`` rises from list to list) merged two by two until one is left."""
    part = np.arange(len(group)) - np.searchsorted(group, group)
    while len(group) > groups:
        pair = np.ones(len(group), bool)
        pair[1:] = (group[1:] != group[:-1]) | (part[1:] // 2 != part[:-1] // 2)
        node = np.cumsum(pair) - 1
        halves = []
        for odd in (0, 1):
            mine = part % 2 == odd
            size = np.zeros(int(pair.sum()), np.int64)
            size[node[mine]] = np.diff(lists.offset)[mine]
            keep = np.repeat(mine, np.diff(lists.offset))
            halves.append(Lists(np.concatenate([[0], np.cumsum(size)]), lists.s[keep], lists.e[keep], lists.slack[keep]))
        lists = merge(*halves)
        group, part = group[pair], part[pair] // 2
    return lists


def _codes(table: pa.Table, *names: str) -> np.ndarray:
    """A number for each distinct combination of columns, in order of appearance."""
    code = np.zeros(table.num_rows, np.int64)
    for name in names:
        own = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        code = code * (int(own.max(initial=0)) + 1) + own
    return np.unique(code, return_inverse=True)[1]


def _list_column(lists: Lists) -> pa.Array:
    items = pa.StructArray.from_arrays([pa.array(lists.s), pa.array(lists.e), pa.array(lists.slack)], names=["s", "e", "slack"])
    return pa.ListArray.from_arrays(pa.array(lists.offset.astype(np.int32)), items)


def _from_column(column: pa.Array) -> Lists:
    size = np.diff(column.offsets.to_numpy())
    items = column.flatten()
    return Lists(np.concatenate([[0], np.cumsum(size)]), *(np.asarray(items.field(k)) for k in range(3)))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list for each key and block among the rows held at a time."""

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node = _codes(t, "k", "block")
        made = leaf(node, *(t.column(c).to_numpy() for c in ("s", "e", "slack")), int(node.max()) + 1)
        one = pa.array(np.unique(node, return_index=True)[1])
        return pa.RecordBatch.from_arrays([*(t.column(c).take(one).combine_chunks() for c in ("k", "block")), _list_column(made)], names=["k", "block", "list"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= LEAF_ROWS:
            yield build(held)
            held, rows = [], 0
    if held:
        yield build(held)


def _grouped(finish: Callable[[pa.Table, Lists], pa.RecordBatch]):
    """Merge the lists of each key and block (rows sorted by both) and hand them to ``finish`` with their keys."""

    def reduce(t: pa.Table) -> pa.RecordBatch:
        change = np.ones(t.num_rows, bool)
        change[1:] = np.diff(_codes_in_order(t)) != 0
        group = np.cumsum(change) - 1
        merged = tree(_from_column(t.column("list").combine_chunks()), group, int(change.sum()))
        return finish(t.filter(pa.array(change)), merged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < MERGE_ROWS:
                continue
            t = pa.Table.from_batches(held)
            code = _codes_in_order(t)
            done = int(np.searchsorted(code, code[-1]))  # the last one may go on
            if done:
                yield reduce(t.slice(0, done))
            held, rows = t.slice(done).combine_chunks().to_batches(), t.num_rows - done
        if held:
            yield reduce(pa.Table.from_batches(held))

    return run


def _codes_in_order(t: pa.Table) -> np.ndarray:
    """Rising numbers of the (k, block) of sorted rows."""
    change = np.zeros(t.num_rows, np.int64)
    for name in ("k", "block"):
        own = t.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        change[1:] |= own[1:] != own[:-1]
    return np.cumsum(change)


def _begins(lists: Lists, carry: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each interval: whether it begins a period, the furthest end before it, and whether there is one.

    ``carry`` is the furthest end of the node's earlier blocks where ``known``.
    """
    node, n = lists.nodes, len(lists.s)
    far, has = carry[node].copy(), known[node].copy()
    follows = np.zeros(n, bool)
    follows[1:] = node[1:] == node[:-1]
    at = np.flatnonzero(follows)
    far[at] = np.where(has[at], np.maximum(far[at], lists.e[at - 1]), lists.e[at - 1])
    has |= follows
    ahead = lists.s > far  # then their distance, read without a sign, can't overflow
    beyond = (lists.s.view(np.uint64) - far.view(np.uint64)) > lists.slack.view(np.uint64)
    return ~has | (ahead & beyond), far, has


def _periods(keys: pa.Table, lists: Lists) -> pa.RecordBatch:
    """kind, start and end of the periods of whole lists, and of the gaps between them."""
    none = np.zeros(keys.num_rows, np.int64)
    new, far, has = _begins(lists, none, none.astype(bool))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1 if len(new) else first
    gap = first[has[first]]
    kind = np.concatenate([np.zeros(len(first), np.int64), np.ones(len(gap), np.int64)])
    node = np.concatenate([lists.nodes[first], lists.nodes[gap]])
    return pa.RecordBatch.from_arrays(
        [keys.column("k").combine_chunks().take(pa.array(node)), pa.array(["period", "gap"]).take(pa.array(kind)),
         pa.array(np.concatenate([lists.s[first], far[gap]])), pa.array(np.concatenate([lists.e[last], lists.s[gap]]))],
        names=["k", "kind", "start_ns", "end_ns"],
    )


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The periods of each block, numbered within it from 0, which may go on from earlier blocks."""
    for batch in batches:
        lists = _from_column(batch.column("list"))
        carry = batch.column("carry")
        new, far, has = _begins(lists, carry.fill_null(0).to_numpy(), carry.is_valid().to_numpy(zero_copy_only=False))
        node = lists.nodes
        cut = new.copy()
        cut[1:] |= node[1:] != node[:-1]
        cut[:1] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(cut)) - 1 if len(cut) else first
        begun = np.cumsum(new)
        no = begun - np.concatenate([[0], begun])[lists.offset[node]]
        gap = pa.array(far[first], mask=~(new & has)[first])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(node[first])) for c in ("k", "block")), pa.array(no[first]), pa.array(lists.s[first]), pa.array(lists.e[last]), gap],
            names=["k", "block", "no", "s", "e", "far"],
        )


def merge_intervals(df: DataFrame, key: str, start: str, end: str, slack: str | None = None, *, target: int = 50_000) -> DataFrame:
    """Periods and gaps per key.

    ``start``, ``end`` and ``slack`` are long columns; [start, end).  An interval
    belongs to the running period if it starts no later than its ``slack`` (default
    0, as is a negative one) after the furthest end of those that start before it;
    of intervals that start together the largest slack counts.  Columns: key, kind
    ('period' or 'gap'), start_ns, end_ns.  Rows with a null key, start, end or slack, and intervals
    with end < start, are left out.  Repeated rows change nothing.  An empty
    table gives no rows.  Further columns of ``df``, whatever their names, are
    ignored.
    """
    given = F.col(f"`{slack}`") if slack else F.lit(0)
    rows = df.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"), given.cast("long").alias("slack"),
    ).filter("k IS NOT NULL AND s IS NOT NULL AND e >= s AND slack IS NOT NULL")
    rows, cut = cut_blocks(rows.withColumn("slack", F.expr("greatest(slack, 0L)")), "k", "s", target=target, ties="e", fine=16)
    kind = rows.schema["k"].dataType
    spelled, arrow = kind.simpleString(), to_arrow_type(kind)

    leaves = rows.select("k", "block", "s", "e", "slack").mapInArrow(_leaves, f"k {spelled}, block int, list {_LIST}")
    leaves = leaves.repartition("k", "block").sortWithinPartitions("k", "block")
    if cut is None:
        periods = leaves.mapInArrow(_grouped(_periods), f"k {spelled}, kind string, start_ns long, end_ns long")
        return periods.withColumnRenamed("k", key)

    whole = lambda keys, lists: pa.RecordBatch.from_arrays(
        [keys.column("k").combine_chunks().cast(arrow), keys.column("block").combine_chunks(), _list_column(lists)], names=["k", "block", "list"])
    lists = leaves.mapInArrow(_grouped(whole), f"k {spelled}, block int, list {_LIST}").checkpoint()
    by_block = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carry = lists.select("k", "block", F.element_at("list", -1)["e"].alias("e")).select("k", "block", F.max("e").over(by_block).alias("carry"))
    parts = lists.join(carry, ["k", "block"]).select("k", "block", "list", "carry")
    parts = parts.mapInArrow(_fragments, f"k {spelled}, block int, no long, s long, e long, far long")
    offset = parts.groupBy("k", "block").agg(F.max("no").alias("n")).select("k", "block", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("offset"))
    merged = parts.join(offset, ["k", "block"]).groupBy("k", (F.col("offset") + F.col("no")).alias("period"))
    periods = merged.agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("far").alias("far"))
    kinds = F.explode(F.expr("""
        concat(array(named_struct('kind', 'period', 'start_ns', s, 'end_ns', e)),
               CASE WHEN far IS NULL THEN array() ELSE array(named_struct('kind', 'gap', 'start_ns', far, 'end_ns', s)) END)
    """))  # fmt: skip
    return periods.select(F.col("k").alias(key), kinds.alias("i")).select(key, "i.kind", "i.start_ns", "i.end_ns")


def coverage(segments: DataFrame) -> DataFrame:
    """[start, end) of usable segments, with the step of their series filled in.

    A null sampling_interval is that of the series; rows with a null start, or a
    length that is null or below 1, are left out.  Of a series without any step,
    ``step`` is null.
    """
    usable = segments.filter("series_id IS NOT NULL AND tie_values IS NOT NULL AND tie_lengths >= 1").select(
        "series_id", "i0", "tie_values", "tie_lengths", "sampling_interval"
    )
    steps = segments.groupBy("series_id").agg(F.max("sampling_interval").alias("series_step"))
    known = usable.filter("sampling_interval IS NOT NULL").withColumnRenamed("sampling_interval", "step")
    filled = usable.filter("sampling_interval IS NULL").drop("sampling_interval").join(steps, "series_id", "left")
    return known.unionByName(filled.withColumnRenamed("series_step", "step"))
