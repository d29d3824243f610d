import bisect
import operator

import numpy as np
import pytest

from stridewell import axis, picking, signal
from stridewell import coords as C
from stridewell.dsp import design, kernels
from stridewell.frame import LabeledFrame, with_label
from stridewell.functions import elementwise as E
from stridewell.pipeline import IIRFilter, LazyModule, Sequential, WindowModel, pick_phases
from stridewell.pipeline import DownSample
from stridewell.sources.traces import time_coordinate, to_traces
from stridewell.streaming.stateful import Monitor
from stridewell.tree import Tree, as_frame, unique

ODD = [np.nan, np.inf, -np.inf, 0.0, -0.0, 1.5, -1.5, 7.0, -7.0, 2.0**53 + 2, -1e300, 0.1, 3.0]


def vector(spark, x):
    return LabeledFrame.from_numpy(spark, np.asarray(x), {"x": {"size": len(x)}}, ("x",))


@pytest.mark.parametrize("name", ["floor", "ceil", "trunc", "rint", "sign"])
def test_rounding_keeps_what_is_no_number(spark, name):
    with np.errstate(all="ignore"):
        assert np.array_equal(vector(spark, ODD).apply(E.UNARY[name]).to_numpy(), getattr(np, name)(ODD), equal_nan=True)
    assert np.array_equal(vector(spark, ODD).apply(E.fix).to_numpy(), np.fix(ODD), equal_nan=True)


@pytest.mark.parametrize("op", [operator.floordiv, operator.mod, operator.truediv])
@pytest.mark.parametrize("by", [2.0, -3.0, 0.0, np.inf, -np.inf, np.nan, 0.1])
def test_division_as_arrays_have_it(spark, op, by):
    x = np.array(ODD)
    with np.errstate(all="ignore"):
        assert np.allclose(op(vector(spark, x), by).to_numpy(), op(x, by), equal_nan=True, rtol=1e-15)
        assert np.allclose(op(by, vector(spark, x)).to_numpy(), op(by, x), equal_nan=True, rtol=1e-15)


def test_operators_of_frames(spark):
    a, b = np.array([1, 2, 12, -5]), np.array([3, 2, 10, 7])
    f, g = vector(spark, a), vector(spark, b)
    for op in (operator.and_, operator.or_, operator.xor, operator.add, operator.sub, operator.mul, operator.eq, operator.ne, operator.lt):
        assert op(f, g).to_numpy().tolist() == op(a, b).tolist(), op
    assert (~f).to_numpy().tolist() == (~a).tolist() and (f << 2).to_numpy().tolist() == (a << 2).tolist() and (f >> 1).to_numpy().tolist() == (a >> 1).tolist()
    x = np.array([0.5, np.nan, 2.0, 3.0])
    h = vector(spark, x)
    assert (h == h).to_numpy().tolist() == [1, 0, 1, 1] and (h != h).to_numpy().tolist() == [0, 1, 0, 0]
    assert ((h > 1) & (h < 3)).to_numpy().tolist() == [0, 0, 1, 0] and ((h > 1) ^ (h < 3)).to_numpy().tolist() == [1, 0, 0, 1]
    assert (~(h > 1)).to_numpy().tolist() == [1, 1, 0, 0]
    assert np.allclose((2.0**h).to_numpy(), 2.0**x, equal_nan=True) and np.allclose(np.asarray(h), x, equal_nan=True)
    assert h.nbytes == 32 and len({h: 1, g: 2}) == 2
    q, r = divmod(h, 2.0)
    assert np.allclose(q.to_numpy(), x // 2.0, equal_nan=True) and np.allclose(r.to_numpy(), x % 2.0, equal_nan=True)


def test_differences_of_the_flattened_array(spark):
    data = np.arange(12.0).reshape(3, 4) ** 2
    f = LabeledFrame.from_numpy(spark, data)
    assert axis.ediff1d(f).to_numpy().tolist() == np.ediff1d(data).tolist()
    assert axis.ediff1d(f, -1.0, 99.0).to_numpy().tolist() == np.ediff1d(data, 99.0, -1.0).tolist()


def test_labels_are_found_without_listing_them():
    n = 10**11
    long = C.Sampled(np.array([0, 2 * n * 1000], np.int64), [n, n], 1000, "t")
    assert long.indexer(1000 * (n - 1)) == n - 1 and long.indexer(2 * n * 1000 + 5000) == n + 5
    assert long.indexer(1000 * (n - 1) + 5, "bfill") == n and long.indexer(1000 * n + 1, "ffill") == n - 1
    assert long.indexer(10**18, "nearest") == 2 * n - 1 and long.equals(C.Sampled(long.tie_values, long.tie_lengths, 1000, "t"))
    with pytest.raises(KeyError):
        long.indexer(1)
    line = C.Interp([0, n], [0.0, 2.0 * n], "t")
    assert line.indexer(9.0, "nearest") == 4 and line.indexer(10.0) == 5
    assert line.equals(C.Interp([0, n // 2, n], [0.0, float(n), 2.0 * n], "t")) and not line.equals(C.Interp([0, n // 2, n], [0.0, n + 1.0, 2.0 * n], "t"))
    assert line.take([0, n]).values().tolist() == [0.0, 2.0 * n]


def test_labels_equal_those_of_the_listed_axis():
    rng = np.random.default_rng(0)
    for _ in range(30):
        starts = np.cumsum(rng.integers(20, 60, 5))
        c = C.Sampled(starts, rng.integers(1, 6, 5), 3, "x")
        listed = c.values().tolist()
        for x in rng.integers(0, 300, 20).tolist():
            assert c._below(x) == bisect.bisect_left(listed, x) and c._below(x, True) == bisect.bisect_right(listed, x)
            nearest = min(range(len(listed)), key=lambda k: (abs(listed[k] - x), k))
            assert c.indexer(x, "nearest") == nearest
    with pytest.raises(KeyError):
        C.Default(5, "x").indexer(5)


@pytest.mark.parametrize("kind", ["sampled", "times", "interp", "dense", "words"])
def test_long_descriptors_are_joined(spark, kind):
    n = 1200
    c = {
        "sampled": C.Sampled(np.arange(n) * 10.0, np.full(n, 3), 1.5, "x"), "times": C.Interp(np.arange(0, 3 * n, 3), np.arange(n) ** 2, "x", True),
        "interp": C.Interp(np.arange(0, 3 * n, 3), np.arange(n) ** 1.5, "x"), "dense": C.Dense(np.arange(n) * 7, "x"), "words": C.Dense(np.array([f"w{k}" for k in range(n)], object), "x"),
    }[kind]
    df = with_label(spark.range(c.size).withColumnRenamed("id", "x__i"), c, "x")
    got = [r[0] for r in df.orderBy("x__i").select("x").collect()]
    assert got == c.values().tolist() if kind in ("dense", "words", "times") else np.allclose(got, c.values())
    assert "CASE WHEN" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("target", [50_000, 20])
@pytest.mark.parametrize("direction", ["ffill", "bfill", "nearest"])
@pytest.mark.parametrize("by", [None, ["k"]])
def test_asof_in_blocks(spark, target, direction, by):
    rng = np.random.default_rng(2)
    left = [(int(rng.integers(0, 2)), int(t), n) for n, t in enumerate([*rng.integers(0, 300, 120), *[77] * 60])]
    right = [(int(rng.integers(0, 2)), int(t), float(v)) for t, v in zip(rng.integers(40, 260, 60), rng.normal(size=60))]
    right += [(0, 77, 5.0), (1, 77, 6.0), (1, 77, 7.0)]
    l = spark.createDataFrame([*left, (0, None, -1)], "k int, t long, id long")
    r = spark.createDataFrame([*right, (0, None, 1.0)], "k int, t long, value double")
    got = {x.id: (x.match, x.match_value) for x in picking.asof(l, r, "t", by, direction, target=target).collect()}
    assert got.pop(-1) == (None, None) and len(got) == len(left)
    for k, t, n in left:
        mine = [(u, v) for kk, u, v in right if by is None or kk == k]
        back, ahead = max((p for p in mine if p[0] <= t), default=None), min((p for p in mine if p[0] >= t), default=None)
        if direction == "nearest":
            found = back if ahead is None or (back is not None and t - back[0] <= ahead[0] - t) else ahead
            assert (got[n][0] if found else None) == (found[0] if found else None)
        else:
            assert got[n] == ((back if direction == "ffill" else ahead) or (None, None))


def test_filters_go_on_from_their_states(spark):
    x = np.random.default_rng(3).normal(size=(3, 40))
    f = LabeledFrame.from_numpy(spark, x, {"time": C.Sampled.from_block("2023-01-01", 40, 0.01, "time")}, ("lane", "time"))
    b, a, sos = [0.2, 0.1], [1.0, -0.5, 0.1], design.iir_sos(4, 0.2)
    for run in (lambda g, zi: signal.lfilter(b, a, g, "time", zi), lambda g, zi: signal.sosfilt(sos, g, "time", zi)):
        whole = run(f, None).to_numpy()
        first, state = run(f.isel(time=slice(0, 25)), ...)
        rest, last = run(f.isel(time=slice(25, None)), state)
        assert np.allclose(np.concatenate([first.to_numpy(), rest.to_numpy()], axis=1), whole)
        assert last.count() == 3 and last.columns == ["lane__i", "state"]


def test_resampling_of_spectra(spark):
    x = np.random.default_rng(4).normal(size=(2, 12))
    for num in (6, 7, 12, 20, 21):
        z = np.fft.fft(x, axis=1)
        want = signal.resample(LabeledFrame.from_numpy(spark, x, {"k": {"size": 12}}, ("lane", "k")), num, "k").to_numpy()
        from stridewell.dsp.kernels import resample_spectrum

        assert np.allclose(resample_spectrum(z, num), want, atol=1e-12)
    f = LabeledFrame.from_numpy(spark, x, {"k": {"size": 12}}, ("lane", "k"))
    spectrum = signal.fft(f, dim={"k": "k"})
    rows = {(r["lane__i"], r["k__i"]): r["value"].re for r in signal.resample(spectrum.isel(k=slice(0, 12)), 12, "k", domain="freq").df.collect()}
    shifted = np.fft.ifft(np.fft.fftshift(np.fft.fft(x, axis=1), axes=1), axis=1).real
    assert np.allclose([[rows[i, k] for k in range(12)] for i in range(2)], shifted)


def test_stages_keep_their_states_in_files(tmp_path):
    x = np.random.default_rng(5).normal(size=(2, 90))
    make = lambda: Sequential([IIRFilter(4, 10.0, "lowpass"), DownSample(4)])
    whole = make()(x, None, 100.0)[0]
    one = make()
    assert not one.initialized
    first = one.feed(x[:, :37], 100.0)
    one.save_state(str(tmp_path / "state.json"))
    two = make()
    two.load_state(str(tmp_path / "state.json"))
    assert two.initialized and np.allclose(np.concatenate([first, two.feed(x[:, 37:], 100.0)], axis=1), whole)
    two.reset()
    two.set_state(one.state)
    assert np.allclose(two.feed(x[:, 37:], 100.0), whole[:, first.shape[1] :])


def test_models_with_phases(spark):
    model = WindowModel(lambda w: np.stack([w, -w, w * 0 + 1], axis=1), 10, phases=["P", "S", "N"])
    x = np.random.default_rng(6).normal(size=(2, 47))
    whole = model.call(x, None, 1.0)[0]
    parts, state = [], None
    for chunk in np.split(x, [3, 20, 21], axis=1):
        y, state = model.call(chunk, state, 1.0)
        parts.append(y)
    assert np.allclose(np.concatenate(parts, axis=1), whole) and np.allclose(whole[:3, 0:5], [x[0, :5], -x[0, :5], np.ones(5)])
    f = LabeledFrame.from_numpy(spark, x, {"time": C.Sampled.from_block("2023-01-01", 47, 1.0, "time")}, ("lane", "time"))
    picked = pick_phases(f, model, "time")
    assert picked.dims == ("lane", "phase", "time") and picked.shape == (2, 3, 40)
    assert np.allclose(picked.to_numpy().reshape(6, -1), whole)
    with pytest.raises(ImportError):
        LazyModule("no_such_module_here").anything


def test_trees(spark, tmp_path):
    def part(start, n, k):
        return LabeledFrame.from_numpy(spark, np.full((n, 2), float(k)), {"time": C.Sampled.from_block(start, n, 1.0, "time"), "x": C.Dense(np.arange(2) * 5.0, "x")}, ("time", "x"))

    a, b, c = part("2023-01-01T00:00:00", 5, 1), part("2023-01-01T00:00:05", 5, 2), part("2023-01-02", 4, 3)
    tree = Tree({"das1": Tree([a, b], "part"), "das2": Tree([c], "part")}, "instrument")
    assert tree.fields == ("instrument", "part") and tree.ismapping and tree["das1"].issequence
    early = tree.sel(time=slice("2023-01-01", "2023-01-01T00:00:03"))
    assert [len(v) for v in early.values()] == [1, 0] and early["das1"][0].shape == (4, 2)
    assert [p for p, _ in tree.query(instrument="*2").frames()] == [("das2", 0)] and [p for p, _ in tree.query(part=1).query(instrument="das1").frames()][0] == ("das1", 0)
    assert tree.isel(x=0)["das2"][0].shape == (4,)
    assert tree.map(lambda f: f * 2.0)["das2"][0].to_numpy().max() == 6
    tree.save(str(tmp_path / "tree"))
    assert Tree.open(spark, str(tmp_path / "tree")).equals(tree) and not tree.equals(early) and tree.copy().equals(tree)
    assert as_frame(tree["das1"], "time").shape == (10, 2) and as_frame(a) is a
    with pytest.raises(ValueError):
        as_frame([a, part("2023-01-01T00:00:05", 5, 2).isel(x=0)], "time")
    assert unique(["a", "b", "a"]) == ["a", "b"] and unique([1, 1]) == 1


@pytest.mark.parametrize("n", [100, 97, 60])
def test_long_lanes_are_filtered_in_blocks(spark, monkeypatch, n):
    from stridewell import pack

    x = np.random.default_rng(7).normal(size=(3, n))
    b, a, sos = [0.2, 0.1], [1.0, -0.5, 0.1], design.iir_sos(4, 0.2)
    runs = {
        "lfilter": lambda f: signal.lfilter(b, a, f, "time"), "sosfilt": lambda f: signal.sosfilt(sos, f, "time"), "filtfilt": lambda f: signal.filtfilt(b, a, f, "time"),
        "sosfiltfilt": lambda f: signal.sosfiltfilt(sos, f, "time"), "filter": lambda f: signal.filter(f, [5.0, 20.0], "bandpass", 2, True, "time"),
        "unpadded": lambda f: signal.sosfiltfilt(sos, f, "time", padtype=None),
    }
    f = LabeledFrame.from_numpy(spark, x, {"time": C.Sampled.from_block("2023-01-01", n, 0.01, "time")}, ("lane", "time"))
    want = {k: run(f).to_numpy() for k, run in runs.items()}
    monkeypatch.setattr(pack, "LANE_SAMPLES", 50)
    monkeypatch.setattr(pack, "BLOCK_SAMPLES", 30)
    for k, run in runs.items():
        got = run(f)
        assert "samples" not in got.df.columns and np.allclose(got.to_numpy(), want[k], atol=1e-10), k
    one = LabeledFrame.from_numpy(spark, x[0], {"time": C.Sampled.from_block("2023-01-01", n, 0.01, "time")}, ("time",))
    assert np.allclose(runs["sosfilt"](one).to_numpy(), want["sosfilt"][0])


def test_stretches_by_themselves(spark, monkeypatch):
    time = C.Sampled(np.array([0, 100 * 10**9, 300 * 10**9]), [40, 25, 35], 10**9, "time", True)
    x = np.random.default_rng(8).normal(size=(2, 100))
    f = LabeledFrame.from_numpy(spark, x, {"time": time, "lane": C.Dense(np.arange(2.0), "lane")}, ("lane", "time"))
    sos = design.iir_sos(4, 0.2)
    parts = [x[:, :40], x[:, 40:65], x[:, 65:]]
    for pieces in (32, 2):
        monkeypatch.setattr("stridewell.frame.WRITTEN_PIECES", pieces)
        got = signal.per_segment(f, lambda g: signal.sosfilt(sos, g, "time"), "time")
        want = np.concatenate([kernels.sosfilt(sos, p)[0] for p in parts], axis=1)
        assert got.dims == f.dims and got.coords.keys() == f.coords.keys() and np.allclose(got.to_numpy(), want)
        flat = signal.per_segment(f, lambda g: axis.detrend(g, "constant", "time"), "time").to_numpy()
        assert np.allclose(flat, np.concatenate([p - p.mean(1, keepdims=True) for p in parts], axis=1))
        traces = to_traces(f, "time", "lane")
        assert "Union" not in traces._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.channel, r.start_ns, len(r.samples)) for r in traces.collect()) == [(k, int(t), n) for k in ("0.0", "1.0") for t, n in zip(time.tie_values, (40, 25, 35))]
    whole = signal.per_segment(f.isel(time=slice(0, 40)), lambda g: signal.sosfilt(sos, g, "time"), "time")
    assert np.allclose(whole.to_numpy(), kernels.sosfilt(sos, parts[0])[0])


def test_axes_of_traces_and_shares_of_time():
    assert time_coordinate(5, 3, 0.01).values().tolist() == [5, 10_000_005, 20_000_005] == time_coordinate(5, 4, 0.01, True, "interpolated").values().tolist()
    assert time_coordinate(5, 1, 0.01, True).size == 0 == time_coordinate(5, 1, 0.01, True, "interpolated").size
    m = Monitor()
    m.note({"addBatch": 60, "getBatch": 20, "walCommit": 20})
    m.note({"addBatch": 100})
    m.note({})
    assert m.batches == 2 and m.shares == pytest.approx({"read": 0.14, "work": 0.72, "write": 0.14})
