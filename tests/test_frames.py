import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell import axis, setops
from stridewell import coords as C
from stridewell.frame import Collection, LabeledFrame, binary, divide, open_frame, save_frame
from stridewell.functions import elementwise as E
from stridewell.reductions import REDUCTIONS

FLOATS = np.arange(12.0).reshape(3, 4)


@pytest.fixture
def grid(spark):
    return LabeledFrame.from_numpy(spark, FLOATS, {"x": np.arange(3.0), "y": np.arange(4.0)})


@pytest.fixture
def holes(spark):
    data = FLOATS.copy()
    data[0, 1] = data[2, 3] = data[1, 0] = np.nan
    data[:, 2] = np.nan
    return LabeledFrame.from_numpy(spark, data, {"x": np.arange(3.0), "y": np.arange(4.0)}), data


def test_coordinates_find_labels():
    line = C.Interp([0, 8], [100.0, 900.0], "dim")
    assert (line.indexer(225, "nearest"), line.indexer(225, "ffill"), line.indexer(225, "bfill")) == (1, 1, 2)
    with pytest.raises(KeyError):
        line.indexer(225)
    assert [line.slice_indexer(a, b) for a, b in ((150, 250), (125, 175), (0, 500), (1000, 1100))] == [slice(1, 2), slice(1, 1), slice(0, 5), slice(9, 9)]
    assert line.slice_indexer(100, 300) == slice(0, 3) and line.slice_indexer(100, 300, endpoint=False) == slice(0, 2)
    assert line.slice(slice(None, None, 3)).values().tolist() == [100, 400, 700] and line.slice(slice(2, 7, 3)).values().tolist() == [300, 600]
    with pytest.raises(ValueError):
        line.slice(slice(None, None, -1))


def test_sampled_segments():
    c = C.Sampled(np.array([0.0, 10.0]), [3, 2], 1.0, "x")
    assert c.values().tolist() == [0, 1, 2, 10, 11]
    assert [c.indexer(v, "nearest") for v in (0, 0.4, 0.6, 1, 10.4, 10.6, -10, 20, 5.9, 6.0, 6.1)] == [0, 0, 1, 1, 3, 4, 0, 4, 2, 2, 3]
    assert [c.indexer(v, "ffill") for v in (0, 0.4, 0.6, 1, 10.4, 10.6, 20, 5.9, 6.1)] == [0, 0, 0, 1, 3, 3, 4, 2, 2]
    assert [c.indexer(v, "bfill") for v in (0, 0.4, 1, 10.4, -10, 5.9)] == [0, 1, 1, 4, 0, 3]
    with pytest.raises(KeyError):
        c.indexer(-10, "ffill")
    assert c.slice(slice(1, 5, 2)).values().tolist() == [1, 10]
    for step in (1, 2, 3):
        for lo in range(5):
            assert c.slice(slice(lo, None, step)).values().tolist() == c.values()[lo::step].tolist()


@pytest.mark.parametrize("kind, tolerance, want", [
    ("discontinuities", False, [10, 20, 30, 40, 50]), ("discontinuities", None, [20, 30, 40, 50]), ("discontinuities", 1, [20, 30, 40, 50]), ("discontinuities", 2, [40, 50]),
    ("discontinuities", 8, []), ("gaps", False, [10, 30, 40]), ("gaps", None, [30, 40]), ("gaps", 2, [40]), ("gaps", 8, []),
    ("overlaps", False, [20, 50]), ("overlaps", None, [20, 50]), ("overlaps", 2, [50]), ("overlaps", 8, []),
])
def test_splits_of_six_blocks(kind, tolerance, want):
    c = C.Sampled(np.array([0, 10, 18, 30, 48, 50]), [10] * 6, 1, "x")
    assert c.split_indices(kind, tolerance).tolist() == want


def test_coordinates_round_trip_and_simplify():
    c = C.Sampled.from_block("2023-01-01T00:00:00", 5, 0.5, "time")
    assert C.from_dict(c.to_dict()).equals(c) and c.sampling_interval() == 0.5
    joined = c.concat(c.shift(5 * c.step))
    assert joined.simplify(0).tie_lengths.tolist() == [10] and joined.availabilities(0).shape[0] == 1
    late = c.concat(c.shift(7 * c.step))
    assert late.discontinuities(0)["type"].tolist() == ["gap"] and late.availabilities(0)["end_index"].tolist() == [4, 9]
    assert C.Interp([0, 1, 2, 3], [0.0, 1.0, 2.0, 9.0], "x").simplify(0.1).tie_indices.tolist() == [0, 2, 3]
    assert C.Interp.from_array(np.linspace(0, 1, 50), "x", 1e-9).tie_indices.tolist() == [0, 49]
    with pytest.raises(ValueError):
        C.Interp([1, 2], [0.0, 1.0])


def test_selection(spark, grid):
    assert np.array_equal(grid.isel(x=1).to_numpy(), FLOATS[1]) and isinstance(grid.isel(x=1).coords["x"], C.Scalar)
    assert np.array_equal(grid[:, ::2].to_numpy(), FLOATS[:, ::2]) and np.array_equal(grid.isel(y=[3, 0, 0]).to_numpy(), FLOATS[:, [3, 0, 0]])
    assert np.array_equal(grid.sel(y=slice(1, 2)).to_numpy(), FLOATS[:, 1:3]) and np.array_equal(grid.sel(x=1.4, method="nearest").to_numpy(), FLOATS[1])
    assert np.array_equal(grid.sel(y=[2.0, 1.0]).to_numpy(), FLOATS[:, [2, 1]]) and np.array_equal(grid.loc[1.0:2.0, 0.0].to_numpy(), FLOATS[1:, 0])
    with pytest.raises(IndexError):
        grid.isel(x=3)
    overlap = C.Sampled(np.array([0.0, 0.5]), [10, 10], 0.1, "t")
    f = LabeledFrame.from_numpy(spark, np.arange(20.0), {"t": overlap}, ("t",))
    assert f.sel(t=slice(0.15, 1.25)).to_numpy().tolist() == list(range(2, 18))


def test_axes(grid):
    assert grid.T.shape == (4, 3) and grid.transpose("y", ...).dims == ("y", "x")
    assert grid.expand_dims("k").shape == (1, 3, 4) and grid.rename(x="z").dims == ("z", "y")
    assert grid.assign_coords(w=("x", [5.0, 6.0, 7.0])).swap_dims(x="w").sel(w=6.0).shape == (4,)
    with pytest.raises(ValueError):
        grid.assign_coords(w=("x", [5.0]))
    with pytest.raises(KeyError):
        grid.swap_dims(q="w")
    assert grid.equals(grid.transpose("x", "y")) and not grid.equals(grid + 1.0)


def test_native_format_and_dicts(spark, grid, tmp_path):
    save_frame(grid, str(tmp_path / "f"))
    assert open_frame(spark, str(tmp_path / "f")).equals(grid)
    assert LabeledFrame.from_dict(spark, grid.to_dict()).equals(grid)


@pytest.mark.parametrize("how", [r for r in REDUCTIONS if r not in ("average", "ptp", "argmax", "argmin")])
def test_reductions_equal_numpy(holes, how):
    f, data = holes
    opts = {"percentile": {"q": 30}, "quantile": {"q": 0.3}}.get(how, {})
    args = list(opts.values())
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for dim, ax in (("x", 0), ("y", 1), (None, None)):
            plain = getattr(np, how)
            skip = getattr(np, f"nan{how}", plain) if how not in ("all", "any", "count_nonzero") else plain
            assert np.allclose(np.asarray(f.reduce(how, dim, **opts).to_numpy(), float), np.asarray(skip(data, *args, axis=ax), float), equal_nan=True)
            if how not in ("all", "any", "count_nonzero"):
                assert np.allclose(f.reduce(how, dim, skipna=False, **opts).to_numpy(), plain(data, *args, axis=ax), equal_nan=True)


def test_places_of_extremes(spark, grid, holes):
    f, data = holes
    assert f.reduce("argmax").to_numpy() == np.nanargmax(data) and f.reduce("argmin", "y").to_numpy().tolist() == np.nanargmin(data, axis=1).tolist()
    assert f.reduce("argmax", "y", skipna=False).to_numpy().tolist() == np.argmax(data, axis=1).tolist()
    ties = LabeledFrame.from_numpy(spark, np.array([1.0, 5.0, 5.0]), dims=("x",))
    assert ties.reduce("argmax").to_numpy() == 1
    assert np.array_equal(grid.reduce("ptp", "x").to_numpy(), np.ptp(FLOATS, axis=0)) and np.isnan(f.reduce("ptp").to_numpy())
    w = (F.col("x__i") + 1).cast("double")
    assert np.allclose(grid.reduce("average", "x", weights=w).to_numpy(), np.average(FLOATS, axis=0, weights=[1, 2, 3]))
    assert grid.mean("x").shape == (4,) and grid.count_nonzero().to_numpy() == 11


def test_arithmetic(spark, grid):
    assert np.allclose((grid - grid.reduce("mean", "y")).to_numpy(), FLOATS - FLOATS.mean(1, keepdims=True))
    assert np.allclose((grid.isel(x=1) + grid).transpose("x", "y").to_numpy(), FLOATS + FLOATS[1])
    assert np.allclose((2.0 - grid * 3.0).to_numpy(), 2 - FLOATS * 3) and np.allclose((grid % 5.0).to_numpy(), FLOATS % 5)
    assert np.allclose((grid.reduce("sum", "y") * grid.reduce("sum", "x")).to_numpy(), np.outer(FLOATS.sum(1), FLOATS.sum(0)))
    with np.errstate(all="ignore"):
        assert np.allclose((grid / (grid - 3.0)).to_numpy(), FLOATS / (FLOATS - 3), equal_nan=True)
    with pytest.raises(ValueError):
        binary(lambda a, b: a + b, grid, grid.assign_coords(x=[5.0, 6.0, 7.0]))
    assert np.allclose(grid.apply(lambda x: divide(x, x)).to_numpy(), np.where(FLOATS == 0, np.nan, 1), equal_nan=True)


def test_elementwise_equal_numpy(spark):
    data = np.array([-2.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.5, np.nan, np.inf, -np.inf])
    f = LabeledFrame.from_numpy(spark, data, dims=("x",))
    with np.errstate(all="ignore"):
        for name in ("absolute", "square", "sqrt", "cbrt", "exp", "exp2", "expm1", "log", "log2", "log10", "log1p", "sin", "arctan", "sinh", "tanh", "degrees", "sign", "rint", "trunc", "fix",
                     "round", "nan_to_num", "sinc", "isnan", "isinf", "isfinite", "negative"):
            if name in ("trunc", "fix", "rint", "round"):
                x, g = data[np.isfinite(data)], f.isel(x=slice(0, 8))
            elif name in ("sinc", "sin"):
                x, g = data[:9], f.isel(x=slice(0, 9))
            else:
                x, g = data, f
            got = g.apply(E.UNARY[name]).to_numpy()
            want = np.asarray(getattr(np, name)(x), float)
            assert np.allclose(got, want, equal_nan=True) or np.array_equal(got, want, equal_nan=True), name
        a, b = f, f.apply(lambda x: -x)
        for name in ("maximum", "minimum", "fmax", "fmin", "greater", "less", "equal", "not_equal"):
            assert np.allclose(binary(E.BINARY[name], a, b).to_numpy(), np.asarray(getattr(np, name)(data, -data), float), equal_nan=True), name
    assert np.allclose(f.isel(x=slice(0, 8)).apply(E.i0).to_numpy(), np.i0(data[:8]))
    assert np.allclose(f.apply(lambda x: E.clip(x, -1, 1)).to_numpy(), np.clip(data, -1, 1), equal_nan=True)


def test_along_an_axis(spark, grid):
    assert np.allclose(axis.cumsum(grid, "x").to_numpy(), FLOATS.cumsum(0)) and np.allclose(axis.cumsum(grid, "y", block=3).to_numpy(), FLOATS.cumsum(1))
    assert np.allclose(axis.cumprod(grid, "y").to_numpy(), FLOATS.cumprod(1)) and np.allclose(axis.diff(grid, "x", 2).to_numpy(), np.diff(FLOATS, 2, 0))
    ones = LabeledFrame.from_numpy(spark, np.ones(100), {"t": C.Interp.from_block(0.0, 100, 0.5, "t")}, ("t",))
    assert np.allclose(axis.differentiate(ones, "t").to_numpy(), 0) and axis.differentiate(ones, "t").shape == (99,)
    assert np.allclose(axis.integrate(ones, "t", midpoints=True).to_numpy(), (np.arange(100) + 1) * 0.5)
    ramp = ones.apply(lambda x: F.col("t__i") * 3.0 + 1)
    assert np.allclose(axis.detrend(ramp, dim="t").to_numpy(), 0, atol=1e-9)
    steps = ones.apply(lambda x: F.when(F.col("t__i") < 50, 5.0).otherwise(7.0))
    assert np.allclose(axis.segment_mean_removal(steps, [0, 50, 100], dim="t").to_numpy(), 0)
    assert np.allclose(axis.sliding_mean_removal(ones, 5.0, dim="t").to_numpy(), 0)
    up = axis.upsample(LabeledFrame.from_numpy(spark, np.ones(3), {"t": C.Interp([0, 2], [0.0, 6.0], "t")}, ("t",)), 3, "t")
    assert up.to_numpy().tolist() == [3, 0, 0, 3, 0, 0, 3, 0, 0] and up.coords["t"].values().tolist() == list(range(9))


def test_sets(spark, grid):
    parts = setops.split(grid, 3, "y")
    assert [p.size("y") for p in parts] == [2, 1, 1] and setops.concat(parts[::-1], "y").equals(setops.concat(parts, "y"))
    assert np.array_equal(setops.concat(parts, "y").to_numpy(), FLOATS)
    both = setops.concat([grid.isel(x=0), grid.isel(x=1)], "x")
    assert both.shape == (2, 4) and both.coords["x"].values().tolist() == [0, 1]
    time = lambda k: C.Sampled(np.array([k * 10.0]), [10], 1.0, "t")
    make = lambda k, m: LabeledFrame.from_numpy(spark, np.full((10, m), float(k)), {"t": time(k)}, ("t", "c"))
    bags = setops.combine_by_coords([make(2, 2), make(0, 2), make(1, 3), make(3, 2)], "t")
    assert [b.shape for b in bags] == [(10, 2), (10, 3), (20, 2)]
    tree = setops.combine_by_field([{"a": [make(0, 2)]}, {"a": [make(1, 2)], "b": [make(0, 1)]}], "t")
    assert tree["a"][0].shape == (20, 2) and tree["b"][0].shape == (10, 1)
    with pytest.raises(ValueError):
        setops.combine_by_field([{"a": 1}, [make(0, 1)]])
    c = Collection(spark.createDataFrame([("das1", 0), ("das2", 0), ("das2", 1)], "instrument string, acquisition int"), ("instrument", "acquisition"))
    assert c.query(instrument="das?", acquisition=0).df.count() == 2 and c.query(acquisition=slice(1, None)).df.count() == 1 and c.query(nothing=3).df.count() == 3


def test_bytes_and_complex_parts(spark, grid):
    assert LabeledFrame.from_bytes(spark, grid.to_bytes()).equals(grid)
    z = grid.apply(lambda x: E.complex_of(x, x * 0))
    assert np.array_equal(E.real_if_close(z).to_numpy(), FLOATS)
    w = grid.apply(lambda x: E.complex_of(x, x))
    assert E.real_if_close(w) is w and np.allclose(w.apply(E.imag).to_numpy(), FLOATS)
    assert grid.isel(x=slice(0, 1)).drop_dims("x").shape == (4,)


def test_settings(spark):
    from stridewell import config

    before = config.get(spark, "n_workers")
    config.put(spark, "n_workers", 3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    config.put(spark, "n_workers", before)
