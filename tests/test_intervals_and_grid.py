import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stridewell.operators import intervals
from stridewell.operators.blocks import time_blocks
from stridewell.operators.grid import observed_slots, regular_grid
from stridewell.operators.intervals import coverage, merge_intervals


def brute(rows):
    out = set()
    for key in {r[0] for r in rows}:
        far = start = None
        for _, s, e, slack in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], -r[3])):
            if far is None or s > far + slack:
                if far is not None:
                    out.add((key, "period", start, far))
                    out.add((key, "gap", far, s))
                start, far = s, e
            far = max(far, e)
        out.add((key, "period", start, far))
    return out


def test_merging_equals_brute_force_at_any_block_size(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key in range(6):
        n = 400 if key == 3 else 20
        starts = rng.integers(0, 20_000, n)
        lengths = np.where(rng.random(n) < 0.02, 3000, rng.integers(0, 40, n))
        rows += [(key, int(s), int(s + k), int(w)) for s, k, w in zip(starts, lengths, rng.integers(0, 9, n) if key % 2 else np.full(n, 5))]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "series long, a long, b long, slack long").selectExpr("*", "'x' AS block", "'y' AS kind")
    for target in (50_000, 50, 7):
        got = merge_intervals(df, "series", "a", "b", "slack", target=target).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 9), st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=60))
def test_lists_merged_in_any_tree_are_those_of_all_rows(rows):
    node, s, n, slack, part = (np.array(c, np.int64) for c in zip(*rows))
    whole = intervals.leaf(node, s, s + n, slack, 3)
    pieces = [intervals.leaf(node[part == p], s[part == p], (s + n)[part == p], slack[part == p], 3) for p in range(5)]
    group = np.repeat(np.arange(3), 5)  # the five lists of a node follow each other
    cuts = [(p, k) for k in range(3) for p in range(5)]
    flat = {c: np.concatenate([getattr(pieces[p], c)[pieces[p].offset[k] : pieces[p].offset[k + 1]] for p, k in cuts]) for c in ("s", "e", "slack")}
    sizes = [pieces[p].offset[k + 1] - pieces[p].offset[k] for p, k in cuts]
    got = intervals.tree(intervals.Lists(np.concatenate([[0], np.cumsum(sizes)]), **flat), group, 3)
    for c in ("offset", "s", "e", "slack"):
        assert getattr(got, c).tolist() == getattr(whole, c).tolist()


def test_periods_come_from_merged_lists(spark, monkeypatch):
    rows = [(1, 0, 10, 0), (1, 5, 20, 0), (1, 20, 30, 0), (1, 40, 50, 0), (1, 2, 3, 0), (1, 35, 36, 0)] * 3
    df = spark.createDataFrame(rows, "k long, a long, b long, s long").repartition(7)
    assert {tuple(r) for r in merge_intervals(df, "k", "a", "b", "s").collect()} == brute(rows)
    a, b = (intervals.leaf(np.zeros(1, np.int64), np.array([x]), np.array([y]), np.zeros(1, np.int64), 1) for x, y in ((0, 10), (5, 20)))
    both = intervals.merge(a, b)
    assert (both.s.tolist(), both.e.tolist()) == ([0], [20])


def test_slack_is_that_of_the_interval_that_starts(spark):
    rows = [(1, 0, 100, 0)] * 2 + [(1, 105, 110, 0), (1, 106, 120, 50), (2, 0, 10, -7), (2, 10, 12, -7)]
    df = spark.createDataFrame(rows, "k long, a long, b long, s long")
    got = {tuple(r) for r in merge_intervals(df, "k", "a", "b", "s").collect()}
    assert got == {(1, "period", 0, 100), (1, "gap", 100, 105), (1, "period", 105, 120), (2, "period", 0, 12)}


def test_far_times_and_text_keys(spark):
    least, most = -(2**63), 2**63 - 1
    df = spark.createDataFrame([("x", least, least + 1, 5), ("x", most - 1, most, most), ("y", 1, 2, 0)], "k string, a long, b long, s long")
    got = {tuple(r) for r in merge_intervals(df, "k", "a", "b", "s").collect()}
    assert got == {("x", "period", least, least + 1), ("x", "gap", least + 1, most - 1), ("x", "period", most - 1, most), ("y", "period", 1, 2)}


@pytest.mark.parametrize("halo", [0, 25])
@pytest.mark.parametrize("shape", ["even", "outlier", "both ends", "bursts", "ties", "nulls"])
def test_blocks_are_bounded_however_rows_lie(spark, shape, halo):
    n, target = 6000, 500
    t = np.arange(n) * 1000
    if shape == "outlier":
        t[0] = -(10**17)
    if shape == "both ends":
        t[:2] = -(2**63), 2**63 - 1
    if shape == "bursts":
        t = np.concatenate([np.arange(n // 2), 10**15 + np.arange(n // 2) * 10**9])
    if shape == "ties":
        t[: n // 2] = 77
    rows = [(1, None if shape == "nulls" and k % 3 == 0 else int(v), k) for k, v in enumerate(t)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    got = time_blocks(df, "k", "t", target=target, halo=halo, ties="id").collect()
    assert sorted(r.id for r in got if r.core) == list(range(n))
    sizes = {}
    for r in got:
        sizes[r.block] = sizes.get(r.block, 0) + 1
    assert max(sizes.values()) <= 2 * target and len(got) <= n + len(sizes) * (2 * halo + target // 2)


def test_unusable_intervals(spark):
    rows = [(None, 1, 2, 0), (1, None, 2, 0), (1, 1, None, 0), (1, 5, 1, 0), (1, 1, 2, None), (2, 3, 3, 0)]
    df = spark.createDataFrame(rows, "k long, a long, b long, s long")
    assert [tuple(r) for r in merge_intervals(df, "k", "a", "b", "s").collect()] == [(2, "period", 3, 3)]
    assert merge_intervals(df.limit(0), "k", "a", "b").count() == 0


def test_blocks_hold_every_row_once_and_halos_reach(spark, monkeypatch):
    monkeypatch.setattr("stridewell.operators.blocks.CELL_GROUP", 8)
    rows = [(1, t) for t in range(1000)] + [(2, 5)] * 3 + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "k long, t long")
    for halo in (0, 20):
        got = time_blocks(df, "k", "t", target=100, halo=halo).collect()
        assert len([r for r in got if r.core]) == len(rows)
        blocks = {}
        for r in got:
            if r.k == 1:
                blocks.setdefault(r.block, []).append((r.t, r.core))
        assert len(blocks) > 5
        for b, members in blocks.items():
            core = [t for t, c in members if c]
            seen = {t for t, _ in members}
            assert (core or halo) and (not halo or not core or all(t in seen for t in range(max(0, min(core) - halo), min(999, max(core) + halo) + 1)))


def test_coverage_fills_the_step_of_the_series(spark):
    rows = [(1, 0, 100, 2, None), (1, 2, 200, 2, 10), (1, 0, None, 2, 10), (1, 0, 5, 0, 10), (1, 0, 5, None, 10), (2, 0, 7, 1, None), (None, 0, 7, 1, 1)]
    df = spark.createDataFrame(rows, "series_id long, i0 long, tie_values long, tie_lengths long, sampling_interval long")
    got = sorted((r.series_id, r.tie_values, r.step) for r in coverage(df).collect())
    assert got == [(1, 100, 10), (1, 200, 10), (2, 7, None)]


def grid(spark, rows, **options):
    df = spark.createDataFrame(rows, "k long, start long, n long, step long, value0 long")
    return regular_grid(observed_slots(df, "k", 100), "k", 100, **options)


def test_slots_against_samples(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(0, 9000)), int(rng.integers(1, 60)), int(rng.choice([7, 30, 100, 250, 1000])), 0) for k in (1, 2) for _ in range(15)]
    samples = {k: {s + j * d for kk, s, n, d, _ in rows if kk == k for j in range(n)} for k in (1, 2)}
    for target in (50_000, 11):
        got = grid(spark, rows, target=target).collect()
        assert len({(r.k, r.slot) for r in got}) == len(got)
        for k in (1, 2):
            seen = {t // 100 for t in samples[k]}
            assert {r.slot for r in got if r.k == k} == set(range(min(seen), max(seen) + 1))
            assert {r.slot for r in got if r.k == k and r.status == "observed"} == seen


def test_values_between_neighbours_and_the_gap_limit(spark):
    rows = [(1, 50, 1, None, 10), (1, 450, 1, 0, 20), (1, 5000, 1, 1, 30)]
    got = {r.slot: (r.status, r.value) for r in grid(spark, rows, gap_limit_ns=1000).collect()}
    assert got[0] == ("observed", 10.0) and got[2] == ("filled", 10 + 150 / 400 * 10) and got[10] == ("missing", None) and got[50] == ("observed", 30.0)
    assert grid(spark, [(1, -250, 2, 100, 0)]).count() == 2
    assert grid(spark, []).count() == 0
