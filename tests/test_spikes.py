import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stridewell.operators.spikes import TRANSITIONS, Rules, flag, implausible, local_normal, posteriors

SCHEMA = "lane long, t long, id long, v double, lo double, hi double, block long, core string"


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(100, 1, n)


def causes(x, lo=-1e9, hi=1e9, chain=None):
    x = np.asarray(x, float)
    return flag(x, (x < lo) | (x > hi), np.zeros(len(x), int) if chain is None else chain)


def test_spikes_of_up_to_three_and_no_level_change():
    x = noise(300)
    x[50], x[100:103], x[150:154], x[200:] = 160, 160, 160, x[200:] + 80
    c = causes(x)
    assert set(np.flatnonzero(c)) == {50, 100, 101, 102}


def test_a_spike_at_the_end_is_never_taken_back():
    x = noise(100)
    x[-1] = 200
    assert not causes(x).any()
    x[0], x[-1] = 200, x[-2]
    assert list(np.flatnonzero(causes(x))) == [0]


def test_stuck_from_twelve_on():
    x = noise(200)
    x[20:31], x[60:72] = 100.0, 101.0
    assert set(np.flatnonzero(causes(x))) == set(range(60, 72))


def test_bounds_hold_exactly():
    x = noise(100)
    x[10], x[20], x[30] = 200, 200.0000001, np.inf
    assert causes(x, 0, 200)[20] == 3 and causes(x, 0, 200)[30] == 3 and causes(x, 0, 200)[10] == 1


def test_spread_is_taken_at_every_reading():
    x = noise(400, 11) * np.linspace(1, 5, 400)
    level, spread = local_normal(x, Rules())
    away = np.abs(x - level)
    for k in range(40, 360):
        assert level[k] == np.median(x[k - 12 : k + 13]) and np.isclose(spread[k], 1.4826 * np.median(away[k - 40 : k + 41]))


def test_equal_spikes_on_coarse_lanes():
    for step in (0.01, 0.5, 1, 1.5):
        x = np.round(noise(600, 9) / step) * step
        x[100:102], x[200:203], x[300], x[400:404] = 160, 160, 160, 160
        assert set(np.flatnonzero(causes(x) == 1)) == {100, 101, 200, 201, 202, 300}


def test_coarse_and_short_lanes():
    assert not causes(np.round(noise(500))).any()
    for n in range(0, 6):
        causes(noise(n))
    assert (causes([5.0] * 30) == 2).all()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=5), st.integers(0, 1000))
def test_posteriors_equal_the_plain_recursion(lengths, seed):
    rng = np.random.default_rng(seed)
    e = rng.uniform(0.01, 1, (sum(lengths), 4))
    chain = np.repeat(np.arange(len(lengths)), lengths)
    got = posteriors(e, chain, segment=8)
    for k in range(len(lengths)):
        x = e[chain == k]
        a, b = np.zeros_like(x), np.zeros_like(x)
        for t in range(len(x)):
            a[t] = (a[t - 1] if t else np.full(4, 0.25)) @ TRANSITIONS * x[t]
            a[t] /= a[t].sum()
        b[-1] = 0.25
        for t in range(len(x) - 2, -1, -1):
            b[t] = TRANSITIONS @ (x[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b
        assert np.allclose(got[chain == k], want / want.sum(1, keepdims=True))


def test_flags_are_the_most_probable_states(monkeypatch):
    x = noise(400, 12)
    x[[50, 51, 200]], x[300:315] = 180, 99.5
    assert set(np.flatnonzero(causes(x))) == {50, 51, 200, *range(300, 315)}
    monkeypatch.setattr("stridewell.operators.spikes.posteriors", lambda e, chain, **_: np.full((len(e), 4), 0.25))
    assert not causes(x).any()


def test_a_lanes_own_changes_follow_its_spikes():
    from stridewell.operators import spikes

    x = np.concatenate([noise(2000, 1), noise(2000, 2)])
    x[20:2000:20] = 200
    chain = np.repeat([0, 1], 2000)
    p = np.zeros((4000, 4))
    p[np.arange(4000), causes(x, chain=chain)] = 1
    own = spikes.own_changes(p, chain)
    assert np.allclose(own.sum(2), 1) and own[0, 0, 1] > 0.04 and own[1, 0, 1] < 0.005


def lane_rows(lane, x, start=0):
    return [(lane, int(t), start + t, None if v is None else float(v), 0.0, 500.0, 1, "c") for t, v in enumerate(x)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return implausible(df, lane="lane", at="t", row_id="id", value="v", low="lo", high="hi", **options)


def test_flags_do_not_depend_on_blocks_or_order(spark):
    x = noise(3000, 3)
    x[[100, 999, 1000, 1001, 2500]] = 250
    x[495:510] = 99.5
    x[1700] = 900
    rows = lane_rows(1, x) + lane_rows(2, noise(50, 4), 10_000)
    rows += rows[90:110] + [(None, 1, 5, 1.0, 0.0, 1.0, 1, "c"), (1, None, 6, 1.0, 0.0, 1.0, 1, "c"), (1, 5, None, 999.0, 0.0, 1.0, 1, "c")]
    rows += [(1, 100_000, 77_777, None, 0.0, 1.0, 1, "c"), (1, 100_001, 77_778, float("nan"), 0.0, 1.0, 1, "c")]
    np.random.default_rng(0).shuffle(rows)
    rows = [tuple(r) for r in rows]
    want = {100, 999, 1000, 1001, 2500, 1700, *range(495, 510)}
    for options in ({}, {"target": 300, "halo": 150}):
        got = run(spark, rows, **options).collect()
        assert sorted(r.row_id for r in got) == sorted(want)
    assert run(spark, rows[:1]).count() == 0 and run(spark, []).count() == 0


def test_packed_rows(spark):
    x = noise(640, 5)
    x[65], x[130] = 300, np.nan
    rows = [(1, int(k * 64), k, [float(v) for v in x[k * 64 : (k + 1) * 64]], 1, 0.0, 500.0) for k in range(10)]
    rows += [rows[1], (1, 10_000, 99, [], 1, 0.0, 500.0), (1, 10_000, 98, None, 1, 0.0, 500.0)]
    df = spark.createDataFrame(rows, "lane long, t long, id long, v array<double>, step long, lo double, hi double")
    got = implausible(df, lane="lane", at="t", row_id="id", value="v", low="lo", high="hi", step="step").collect()
    assert [(r.row_id, r.pos, r.cause) for r in got] == [(1, 1, "spike")]


def test_null_bounds_do_not_bind(spark):
    rows = [(1, t, t, float(v), None, None, 1, "c") for t, v in enumerate(noise(50))]
    assert run(spark, rows).count() == 0


def test_flags_do_not_depend_on_blocks_of_bursty_lanes(spark):
    n = 4000
    x = noise(n, 7)
    x[[*range(25, n, 50), 2999, n - 2]] = 300  # near any cut, and last before the jumps in time
    x[np.arange(40, n, 200)[:, None] + np.arange(12)] = 99.5
    burst = np.where(np.arange(n) < 3000, np.arange(n), 10_000_000 + np.arange(n) * 1000)
    outlying = np.append(np.arange(n - 1), 10**15)
    one_time = np.full(n, 5)
    want = np.flatnonzero(causes(x, 0, 500))
    assert len(want) > 300
    for times in (burst, outlying, one_time):
        rows = [(1, int(t), k, float(v), 0.0, 500.0, 1, "c") for k, (t, v) in enumerate(zip(times, x))]
        got = run(spark, rows, target=300, halo=80).collect()
        assert sorted(r.row_id for r in got) == list(want)


def test_blocks_look_past_what_is_not_plausible(spark):
    x = noise(3000, 8)
    x[600:1500] = 99.5
    x[[595, 599, 1500, 1503, 2000]] = 250
    x[2100:2400] = 900  # out of range
    x[[2098, 2401]] = 250
    rows = lane_rows(1, x) + 200 * lane_rows(1, x)[299:302]
    got = run(spark, rows, target=300, halo=20).collect()
    assert sorted(r.row_id for r in got) == list(np.flatnonzero(causes(x, 0, 500)))


def test_halos_are_whole_on_bursty_lanes(spark):
    from stridewell.operators.blocks import time_blocks

    times = [*range(3000), *range(10**9, 10**9 + 10**6, 1000), 10**15]
    df = spark.createDataFrame([(1, t, k) for k, t in enumerate(times)], "lane long, t long, id long")
    rows = time_blocks(df, "lane", "t", target=640, halo=50, ties="id").collect()
    assert sorted(r.id for r in rows if r.core) == list(range(len(times)))
    for block in {r.block for r in rows if r.core}:
        held = sorted(r.id for r in rows if r.block == block)
        own = [r.id for r in rows if r.block == block and r.core]
        assert held == list(range(held[0], held[-1] + 1)) and len(own) < 800
        assert held[0] <= max(0, min(own) - 50) and held[-1] >= min(len(times) - 1, max(own) + 50)
