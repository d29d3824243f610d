import numpy as np
import pytest

from stridewell import coords as C
from stridewell import picking, signal
from stridewell.dsp import design, kernels
from stridewell.frame import LabeledFrame
from stridewell.pack import pack


def response(sos, f):
    z = np.exp(-1j * np.pi * np.asarray(f))
    h = np.ones(len(z), complex)
    for s in sos:
        h *= (s[0] + s[1] * z + s[2] * z**2) / (s[3] + s[4] * z + s[5] * z**2)
    return np.abs(h)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 7, 8])
@pytest.mark.parametrize("btype, cutoff, passed, stopped", [("lowpass", 0.2, 0.0, 0.95), ("highpass", 0.4, 1.0, 0.02), ("bandpass", [0.3, 0.5], None, 0.0), ("bandstop", [0.3, 0.5], 0.0, None)])
def test_butterworth(order, btype, cutoff, passed, stopped):
    sos = design.iir_sos(order, cutoff, btype)
    assert np.allclose(response(sos, np.atleast_1d(cutoff)), np.sqrt(0.5), atol=1e-6)
    if passed is not None:
        assert response(sos, [passed])[0] == pytest.approx(1, abs=1e-6)
    if stopped is not None:
        assert response(sos, [stopped])[0] < 0.35
    b, a = design.iir_ba(order, cutoff, btype)
    x = np.random.default_rng(0).normal(size=(2, 300))
    if order <= 4:
        assert np.allclose(kernels.lfilter(b, a, x)[0], kernels.sosfilt(sos, x)[0], atol=1e-7)


def test_chebyshev_ripple():
    sos = design.iir_sos(8, 0.2, "lowpass", "cheby1", rp=0.05)
    r = response(sos, np.linspace(0, 0.2, 400))
    assert r.max() == pytest.approx(1, abs=1e-6) and r.min() == pytest.approx(10 ** (-0.05 / 20), abs=1e-6)


def test_fir_and_windows():
    h = design.firwin(51, 0.3)
    assert h.sum() == pytest.approx(1) and np.allclose(h, h[::-1])
    for name in ("hann", "hamming", "blackman", "bartlett", "cosine", "tukey", ("kaiser", 5.0), "boxcar", ("gaussian", 3.0)):
        w = design.get_window(name, 21, periodic=False)
        assert np.allclose(w, w[::-1]) and w.max() == pytest.approx(1)
    with pytest.raises(ValueError):
        design.firwin(50, 0.3, "highpass")


def test_zero_phase_keeps_sines_in_place():
    t = np.arange(2000)
    x = np.sin(2 * np.pi * 0.01 * t)[None] + 0.3
    y = kernels.sosfiltfilt(design.iir_sos(4, 0.2), x)
    assert np.allclose(y[:, 100:-100], x[:, 100:-100], atol=1e-3)
    b, a = design.iir_ba(2, 0.2)
    assert np.allclose(kernels.filtfilt(b, a, np.full((1, 50), 3.0)), 3)
    zi = design.sosfilt_zi(design.iir_sos(4, 0.2))
    assert np.allclose(kernels.sosfilt(design.iir_sos(4, 0.2), np.ones((1, 20)), zi)[0], 1)


def test_resampling_of_band_limited_signals():
    t = np.arange(200) / 200
    x = (np.sin(2 * np.pi * 5 * t) + np.cos(2 * np.pi * 3 * t))[None]
    for num in (100, 400, 150, 201):
        u = np.arange(num) / num
        assert np.allclose(kernels.resample(x, num), np.sin(2 * np.pi * 5 * u) + np.cos(2 * np.pi * 3 * u), atol=1e-8)
    y = kernels.resample_poly(x, 3, 2)
    assert y.shape == (1, 300) and np.allclose(y[0, 60:-60], (np.sin(2 * np.pi * 5 * np.arange(300) / 300) + np.cos(2 * np.pi * 3 * np.arange(300) / 300))[60:-60], atol=5e-3)
    assert kernels.decimate(x, 4).shape == (1, 50) and np.allclose(kernels.decimate(x, 4, ftype="fir")[0, 10:-10], x[0, ::4][10:-10], atol=0.05)
    z = kernels.hilbert(np.cos(2 * np.pi * 5 * t)[None])
    assert np.allclose(np.abs(z), 1) and np.allclose(z.imag, np.sin(2 * np.pi * 5 * t))


def test_spectra(spark):
    f = LabeledFrame.from_numpy(spark, np.array([0.0, 1, 0, -1]), {"time": C.Interp.from_block(0.0, 4, 1.0, "time")}, ("time",))
    z = signal.fft(f)
    rows = sorted((r["spectrum__i"], r["value"]["re"], r["value"]["im"]) for r in z.df.collect())
    assert np.allclose([complex(a, b) for _, a, b in rows], [0, 2j, 0, -2j]) and z.coords["spectrum"].values().tolist() == [-0.5, -0.25, 0.0, 0.25]
    r = signal.rfft(f)
    assert np.allclose([complex(x["value"]["re"], x["value"]["im"]) for x in r.df.orderBy("spectrum__i").collect()], [0, -2j, 0])
    assert np.allclose(signal.irfft(r, dim={"spectrum": "time"}).to_numpy(), [0, 1, 0, -1])
    rng = np.random.default_rng(1)
    data = rng.normal(size=(3, 64))
    g = LabeledFrame.from_numpy(spark, data, {"time": C.Sampled.from_block("2023-01-01", 64, 0.01, "time")}, ("lane", "time"))
    s = signal.stft(g, nperseg=16)
    assert s.shape == (3, 7, 9) and s.dims == ("lane", "time", "spectrum") and s.coords["time"].sampling_interval() == pytest.approx(0.08)
    w = design.get_window("hann", 16)
    got = {(x.lane__i, x.time__i, x.spectrum__i): complex(x.value.re, x.value.im) for x in s.df.collect()}
    want = np.fft.rfft(data[2, 24:40] * w) / w.sum()
    assert np.allclose([got[2, 3, k] for k in range(9)], want)


def test_filter_on_frames(spark):
    t = np.arange(400) * 0.01
    data = np.stack([np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 40 * t)], axis=1)
    f = LabeledFrame.from_numpy(spark, data, {"time": C.Sampled.from_block("2023-01-01", 400, 0.01, "time")}, ("time", "lane"))
    y = signal.filter(f, 10.0, "lowpass", zerophase=True, dim="time").to_numpy()
    assert np.abs(y[50:-50, 0] - data[50:-50, 0]).max() < 0.01 and np.abs(y[50:-50, 1]).max() < 0.01
    d = signal.decimate(f, 4, dim="time")
    assert d.shape == (100, 2) and d.coords["time"].sampling_interval() == pytest.approx(0.04)
    assert signal.resample(f, 200, "time").shape == (200, 2) and signal.resample_poly(f, 1, 2, "time").shape == (200, 2)


VECTORS = [([0, 0.1, 0.9, 0.8, 0.2, 0.1, 0.6, 0.7, 0.3, 0.2], [(2, 0.9), (7, 0.7)]), ([1, *[0.9] * 7, 0], [(0, 1.0)]), ([0, 0.9, 0.9], []), ([0.6, float("nan"), 0.7, 0.1], [(2, 0.7)])]


@pytest.mark.parametrize("x, want", VECTORS)
def test_picks(spark, x, want):
    f = LabeledFrame.from_numpy(spark, np.array([x, x]), dims=("lane", "time"))
    for rows in (picking.find_picks(f, 0.5).collect(), picking.trigger_lanes(pack(f), "time", 0.5).collect()):
        assert sorted((r["lane__i"], r["time__i"], r["value"]) for r in rows) == [(k, i, v) for k in (0, 1) for i, v in want]


def test_sql_picks_equal_the_state_machine(spark):
    x = np.round(np.random.default_rng(3).uniform(0, 1, (6, 200)), 1)
    f = LabeledFrame.from_numpy(spark, x, dims=("lane", "time"))
    a = sorted((r["lane__i"], r["time__i"], r["value"]) for r in picking.find_picks(f, 0.7).collect())
    assert a == sorted((k, i, v) for k in range(6) for i, v in kernels.trigger(x[k], 0.7)[0])


def test_selections_with_tapers(spark):
    f = LabeledFrame.from_numpy(spark, np.arange(50.0).reshape(5, 10), {"distance": C.Dense(np.arange(5) * 100.0, "distance"), "time": C.Sampled.from_block("2023-01-01", 10, 1.0, "time")}, ("distance", "time"))
    t0 = f.coords["time"].start
    spans = spark.createDataFrame([(1, t0 + 3 * C.NS, t0 + 7 * C.NS), (2, t0 + 3 * C.NS, t0 + 7 * C.NS), (3, None, t0)], "distance__i long, start long, end long")
    got = {(r["distance__i"], r["time__i"]): r["value"] for r in picking.tapered_selection(f, spans, "time").df.collect()}
    assert [got[0, k] for k in range(5)] == [13, 14, 15, 16, 17] and [got[1, k] for k in range(5)] == [23, 24, 25, 26, 27] and len(got) == 10
    tapered = picking.tapered_selection(f, spans, "time", [0.5, 1.0, 0.5])
    assert tapered.to_numpy().tolist() == [[6.5, 14, 15, 16, 8.5], [11.5, 24, 25, 26, 13.5]]
    assert tapered.coords["distance"].values().tolist() == [100, 200] and tapered.coords["time"].values().tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        picking.tapered_selection(f, spans, "time", np.ones(8))
    with pytest.raises(ValueError):
        picking.tapered_selection(f, spans.filter("start IS NULL"), "time")
    assert [picking.next_fast_len(n) for n in (1, 5, 13, 17, 23, 121)] == [1, 5, 14, 18, 24, 121]
    padded = picking.tapered_selection(f, spans, "time", "hann", 8).df.collect()
    assert len(padded) == 16 and all(r["value"] == 0 for r in padded if r["time__i"] > 4)


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 99), (2, 1)], "k int, t long")
    right = spark.createDataFrame([(1, 4, 1.0), (1, 10, 2.0), (1, 20, 3.0), (1, 120, 4.0)], "k int, t long, value double")
    get = lambda d: {(r.k, r.t): r.match for r in picking.asof(left, right, "t", ["k"], d).collect()}
    assert get("ffill") == {(1, 5): 4, (1, 10): 10, (1, 99): 20, (2, 1): None}
    assert get("bfill") == {(1, 5): 10, (1, 10): 10, (1, 99): 120, (2, 1): None}
    assert get("nearest") == {(1, 5): 4, (1, 10): 10, (1, 99): 120, (2, 1): None}
