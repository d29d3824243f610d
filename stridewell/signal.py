"""Signal processing along one dimension of a labeled frame.

Frequencies are in units of the axis (Hz on time axes).  What windows can say
lives in :mod:`stridewell.axis`; the rest runs on packed lanes.  Filters take
lanes of over ``pack.LANE_SAMPLES`` samples block by block, with equal results;
transforms need whole lanes.
"""

from __future__ import annotations

import numpy as np

from . import coords as C
from . import pack
from .axis import detrend, differentiate, integrate, medfilt, segment_mean_removal, sliding_mean_removal, taper
from .dsp import design, kernels
from .frame import LabeledFrame
from .pack import along, rate

__all__ = [
    "decimate", "detrend", "differentiate", "fft", "filter", "filtfilt", "frames", "hilbert", "ifft", "integrate", "irfft", "lfilter", "medfilt", "per_segment", "resample",
    "resample_poly", "rfft", "segment_mean_removal", "sliding_mean_removal", "sosfilt", "sosfiltfilt", "stft", "taper",
]


def filter(f: LabeledFrame, freq, btype: str, corners: int = 4, zerophase: bool = False, dim: str = "last") -> LabeledFrame:
    """Butterworth filter; the design is made once, on the driver."""
    sos = design.iir_sos(corners, freq, btype, fs=rate(f, dim))
    return sosfiltfilt(sos, f, dim) if zerophase else sosfilt(sos, f, dim)


def _is_long(f: LabeledFrame, dim: str) -> bool:
    """Whether lanes are too long to be one row each."""
    return f.size(dim) > pack.LANE_SAMPLES


def _forward(f: LabeledFrame, dim: str, step) -> LabeledFrame:
    """A causal filter over blocks, whose state goes from block to block."""
    dim = f.axis(dim)

    def stage(x, state, first, last):
        y, state = step(x[None], state)
        return y[0], state

    blocks = pack.run_blocks(pack.pack_blocks(f, dim, pack.BLOCK_SAMPLES), stage)
    return pack.unpack_blocks(blocks, f, dim, pack.BLOCK_SAMPLES)


def _forth_and_back(f: LabeledFrame, dim: str, step, zi: np.ndarray, reach: int, padtype) -> LabeledFrame:
    """A filter in both directions over blocks: the first and the last block carry the lane's turned-over ends."""
    dim = f.axis(dim)
    reach = min(reach, f.size(dim) - 1) if padtype is not None else 0
    if reach >= pack.BLOCK_SAMPLES:
        raise ValueError("the padding must be shorter than a block")

    def pass_over(head: bool):
        def stage(x, state, first, last):
            before = after = 0
            if head and reach:
                whole = x[None]
                if first:
                    whole, before = kernels.extend_side(whole, reach, padtype, True), reach
                if last:
                    after = reach
                    whole = kernels.extend_side(whole, reach, padtype, False, skip=before)
                x = whole[0]
            if not head:
                x = x[::-1]
            if state is None:
                state = zi * x[0]
            y, state = step(x[None], state)
            y = y[0]
            return (y if head else y[::-1]), state

        return stage

    # forward with the padding kept in the outer blocks, backward over all, then the padding falls away
    forth = pack.run_blocks(pack.pack_blocks(f, dim, pack.BLOCK_SAMPLES), pass_over(True))
    back = pack.run_blocks(forth, pass_over(False), backward=True)

    def trim(x, state, first, last):
        return x[reach if first else 0 : len(x) - reach if last else len(x)], None

    return pack.unpack_blocks(pack.run_blocks(back, trim), f, dim, pack.BLOCK_SAMPLES)


def lfilter(b, a, f: LabeledFrame, dim: str = "last", zi=None):
    """Filter from rest; with ``zi`` (see :func:`sosfilt`) also the states after it."""
    if zi is not None:
        return _with_states(f, dim, zi, (max(len(a), len(b)) - 1,), lambda x, z: kernels.lfilter(b, a, x, z))
    if _is_long(f, dim):
        return _forward(f, dim, lambda x, z: kernels.lfilter(b, a, x, z))
    return along(f, dim, lambda x: kernels.lfilter(b, a, x)[0])


def sosfilt(sos, f: LabeledFrame, dim: str = "last", zi=None):
    """Filter from rest.  With ``zi``, lanes begin in that state and the result is
    a pair: the frame and the states after it, a DataFrame of the lanes' index
    columns and ``state``.  ``zi`` is ``...`` (rest), numbers for all lanes, or such a DataFrame."""
    if zi is not None:
        return _with_states(f, dim, zi, (len(sos), 2), lambda x, z: kernels.sosfilt(sos, x, z))
    if _is_long(f, dim):
        return _forward(f, dim, lambda x, z: kernels.sosfilt(sos, x, z))
    return along(f, dim, lambda x: kernels.sosfilt(sos, x)[0])


def _with_states(f: LabeledFrame, dim: str, zi, shape: tuple[int, ...], step):
    """Lanes with their states before them go through one stage, and come out with the states after them."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from .pack import run_lanes, unpack

    dim = f.axis(dim)
    k = int(np.prod(shape))
    rows = pack.pack(f, dim)
    if isinstance(zi, DataFrame):
        rows = rows.join(zi, f.lanes(dim), "left").withColumn("state", F.coalesce("state", F.array_repeat(F.lit(0.0), k)))
    else:
        held = np.zeros(k) if zi is ... else np.broadcast_to(np.asarray(zi, float), shape).ravel()
        rows = rows.withColumn("state", F.array(*[F.lit(float(v)) for v in held]) if k else F.array().cast("array<double>"))
    rows = rows.select(*f.lanes(dim), F.concat("state", "samples").alias("samples"))

    def kernel(x):
        y, z = step(x[:, k:], x[:, :k].reshape(len(x), *shape))
        return np.concatenate([z.reshape(len(x), k), y], axis=1)

    out = run_lanes(rows, [kernel])
    states = out.select(*f.lanes(dim), F.slice("samples", 1, k).alias("state") if k else F.array().cast("array<double>").alias("state"))
    done = out.withColumn("samples", F.expr(f"slice(samples, {k + 1}, greatest(0, size(samples) - {k}))"))
    return unpack(done, f, dim, f.coords, f.extents.get(dim)), states


def filtfilt(b, a, f: LabeledFrame, dim: str = "last", padtype="odd", padlen=None) -> LabeledFrame:
    if _is_long(f, dim):
        reach = 3 * max(len(a), len(b)) if padlen is None else padlen
        return _forth_and_back(f, dim, lambda x, z: kernels.lfilter(b, a, x, z), design.lfilter_zi(b, a), reach, padtype)
    return along(f, dim, lambda x: kernels.filtfilt(b, a, x, padtype, padlen))


def sosfiltfilt(sos, f: LabeledFrame, dim: str = "last", padtype="odd", padlen=None) -> LabeledFrame:
    if _is_long(f, dim):
        reach = kernels.sos_padding(sos) if padlen is None else padlen
        return _forth_and_back(f, dim, lambda x, z: kernels.sosfilt(sos, x, z), design.sosfilt_zi(sos), reach, padtype)
    return along(f, dim, lambda x: kernels.sosfiltfilt(sos, x, padtype, padlen))


def hilbert(f: LabeledFrame, n: int | None = None, dim: str = "last") -> LabeledFrame:
    """Analytic signal as structs of re and im."""
    return along(f, dim, lambda x: kernels.hilbert(x, n), complex_out=True)


def _rebuilt(f: LabeledFrame, dim: str, num: int, step_factor: float):
    c = f.coords.get(dim)
    if c is None or isinstance(c, (C.Column, C.Default)):
        return C.Default(num, dim)
    step = c.sampling_interval(cast=False) * step_factor
    end = c.start + (num - 1) * step
    return C.Interp([0, num - 1] if num > 1 else [0], ([c.start, round(end) if c.is_time else end] if num > 1 else [c.start]), dim, c.is_time)


def resample(f: LabeledFrame, num: int, dim: str = "last", window=None, domain: str = "time") -> LabeledFrame:
    """To ``num`` samples by the Fourier method.  With ``domain='freq'`` the frame holds
    complex spectra (zero frequency first) of the lanes, and complex samples come out."""
    dim = f.axis(dim)
    n = f.size(dim)
    if domain == "freq":
        from .pack import run_lanes, unpack

        coords = {k: c for k, c in f.coords.items() if c.dim != dim} | {dim: _rebuilt(f, dim, num, n / num)}

        def kernel(x):
            return kernels.resample_spectrum(x[:, :n] + 1j * x[:, n:], num, window)

        return unpack(run_lanes(_complex_lanes(f, dim), [kernel], True), f, dim, coords, num)
    if domain != "time":
        raise ValueError("domain must be time or freq")
    return along(f, dim, lambda x: kernels.resample(x, num, window), _rebuilt(f, dim, num, n / num), num)


def resample_poly(f: LabeledFrame, up: int, down: int, dim: str = "last", window=("kaiser", 5.0), padtype="constant", cval=0.0) -> LabeledFrame:
    dim = f.axis(dim)
    num = -(-f.size(dim) * up // down)
    return along(f, dim, lambda x: kernels.resample_poly(x, up, down, window, padtype, cval), _rebuilt(f, dim, num, down / up), num)


def decimate(f: LabeledFrame, q: int, n: int | None = None, ftype: str = "iir", zero_phase: bool = True, dim: str = "last") -> LabeledFrame:
    dim = f.axis(dim)
    c = f.coords.get(dim)
    coord = c.decimate(q) if hasattr(c, "decimate") else C.Default(-(-f.size(dim) // q), dim)
    return along(f, dim, lambda x: kernels.decimate(x, q, n, ftype, zero_phase), coord, -(-f.size(dim) // q))


# -- spectra ---------------------------------------------------------------------------------
def _axes(f: LabeledFrame, dim) -> tuple[str, str]:
    old, new = next(iter(dim.items())) if isinstance(dim, dict) else (dim, "spectrum")
    return f.axis(old), new


def fft(f: LabeledFrame, n: int | None = None, dim={"last": "spectrum"}, norm=None) -> LabeledFrame:  # noqa: B006
    """Two-sided spectrum, zero frequency in the middle."""
    old, new = _axes(f, dim)
    n = n or f.size(old)
    freqs = np.fft.fftshift(np.fft.fftfreq(n, 1 / rate(f, old)))
    return along(f, old, lambda x: np.fft.fftshift(np.fft.fft(x, n, axis=1, norm=norm), axes=1), C.Dense(freqs, new), n, True, new)


def rfft(f: LabeledFrame, n: int | None = None, dim={"last": "spectrum"}, norm=None) -> LabeledFrame:  # noqa: B006
    old, new = _axes(f, dim)
    n = n or f.size(old)
    freqs = np.fft.rfftfreq(n, 1 / rate(f, old))
    return along(f, old, lambda x: np.fft.rfft(x, n, axis=1, norm=norm), C.Dense(freqs, new), n // 2 + 1, True, new)


def _complex_lanes(f: LabeledFrame, dim: str):
    """Packed lanes of a complex frame: real parts, then imaginary parts."""
    from pyspark.sql import functions as F

    from .frame import idx

    pair = F.struct(F.col(idx(dim)).alias("i"), F.col(f.value).alias("v"))
    rows = f.df.groupBy(*f.lanes(dim)).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    both = F.concat(F.transform("p", lambda p: p["v"]["re"]), F.transform("p", lambda p: p["v"]["im"]))
    return rows.select(*f.lanes(dim), both.alias("samples"))


def _inverse(f: LabeledFrame, dim, transform, n: int, complex_out: bool) -> LabeledFrame:
    from .pack import run_lanes, unpack

    old, new = next(iter(dim.items())) if isinstance(dim, dict) else (dim, "signal")
    old = f.axis(old)
    c = f.coords[old]
    step = 1.0 / (c.sampling_interval() * n) if c.size > 1 else 1.0

    def kernel(x):
        half = x.shape[1] // 2
        return transform(x[:, :half] + 1j * x[:, half:])

    labels = np.fft.fftshift(np.fft.fftfreq(n, 1 / (n * step)))
    coords = {k: v for k, v in f.coords.items() if v.dim != old} | {new: C.Dense(labels, new)}
    return unpack(run_lanes(_complex_lanes(f, old), [kernel], complex_out), f, old, coords, n, new)


def ifft(f: LabeledFrame, n: int | None = None, dim={"last": "signal"}, norm=None) -> LabeledFrame:  # noqa: B006
    n = n or f.size(next(iter(dim)))
    return _inverse(f, dim, lambda z: np.fft.ifft(np.fft.ifftshift(z, axes=1), n, axis=1, norm=norm), n, True)


def irfft(f: LabeledFrame, n: int | None = None, dim={"last": "signal"}, norm=None) -> LabeledFrame:  # noqa: B006
    n = n or 2 * (f.size(next(iter(dim))) - 1)
    return _inverse(f, dim, lambda z: np.fft.irfft(z, n, axis=1, norm=norm), n, False)


def per_segment(f: LabeledFrame, run, dim: str = "last", tolerance=None) -> LabeledFrame:
    """``run`` over each stretch of an axis between its discontinuities by itself.

    Stretches become lanes of their own, so all of them are one plan.  ``run``
    takes and gives a frame and must keep the number of samples (filters,
    detrending, running sums, Hilbert).
    """
    from pyspark.sql import functions as F

    from .frame import idx, with_segment

    dim = f.axis(dim)
    c = f.coords[dim]
    cuts = [0, *c.split_indices("discontinuities", tolerance).tolist(), c.size]
    if len(cuts) <= 2:
        return run(f)
    i = idx(dim)
    rows = with_segment(f.df, i, cuts, idx("segment"), "__first").withColumn(i, F.col(i) - F.col("__first")).drop("__first")
    longest = int(np.diff(cuts).max())
    along_ = c.slice(slice(0, min(2, c.size)))
    step = c.sampling_interval(cast=False)
    axis = C.Sampled(np.array([along_.start]), [longest], step, dim, c.is_time)
    others = {k: v for k, v in f.coords.items() if v.dim not in (dim, None) and not isinstance(v, C.Column)}
    apart = f._with(rows, dims=("segment", *f.dims), coords=others | {dim: axis}, extents=f.extents | {"segment": len(cuts) - 1, dim: longest})
    done = run(apart)
    firsts = F.array(*[F.lit(int(a)).cast("long") for a in cuts[:-1]])
    if len(cuts) > 1000:
        starts = f.df.sparkSession.createDataFrame(list(enumerate(cuts[:-1])), f"`{idx('segment')}` long, __first long")
        back = done.df.join(starts, idx("segment"))
    else:
        back = done.df.withColumn("__first", F.get(firsts, F.col(idx("segment")).cast("int")))
    return f._with(back.withColumn(i, F.col(i) + F.col("__first")).drop("__first", idx("segment")), value=done.value)


def frames(f: LabeledFrame, nperseg: int, noverlap: int, dim: str = "last", new_dim: str = "frame") -> LabeledFrame:
    """Overlapping frames of ``nperseg`` samples as a dim of their own; samples after the last whole frame are left out."""
    from pyspark.sql import functions as F

    from .frame import idx

    dim = f.axis(dim)
    hop = nperseg - noverlap
    if not 0 < hop <= nperseg:
        raise ValueError("frames must overlap by less than their length")
    count = max(0, (f.size(dim) - nperseg) // hop + 1)
    i = f"`{idx(dim)}`"
    of = f"sequence(greatest(0L, ({i} - {nperseg} + {hop}) div {hop}), least({count - 1}L, {i} div {hop}))"
    inside = F.expr(f"greatest(0L, ({i} - {nperseg} + {hop}) div {hop}) <= least({count - 1}L, {i} div {hop})")
    rows = f.df.filter(inside).withColumn(idx(new_dim), F.explode(F.expr(of)))
    rows = rows.withColumn(idx(dim), F.col(idx(dim)) - F.col(idx(new_dim)) * hop)
    at = f.dims.index(dim)
    coords = {k: c for k, c in f.coords.items() if c.dim != dim} | {dim: C.Default(nperseg, dim)}
    c = f.coords.get(dim)
    if count and isinstance(c, (C.Sampled, C.Interp, C.Dense)):
        coords[new_dim] = c.take(np.arange(count) * hop)
        coords[new_dim].dim = new_dim
    extents = f.extents | {dim: nperseg, new_dim: count}
    return f._with(rows, dims=(*f.dims[:at], new_dim, *f.dims[at:]), coords=coords, extents=extents)


def stft(f: LabeledFrame, window="hann", nperseg: int = 256, noverlap: int | None = None, nfft: int | None = None, onesided: bool = True,
         dim={"last": "spectrum"}, scaling: str = "spectrum") -> LabeledFrame:  # noqa: B006
    """Short-time spectra; time labels are frame centres, frequency is the last dim."""
    from pyspark.sql import functions as F

    from .frame import idx
    from .pack import run_lanes

    old, new = _axes(f, dim)
    noverlap = nperseg // 2 if noverlap is None else noverlap
    hop, nfft = nperseg - noverlap, nfft or nperseg
    fs = rate(f, old)
    frames = (f.size(old) - nperseg) // hop + 1
    freqs = np.fft.rfftfreq(nfft, 1 / fs) if onesided else np.fft.fftshift(np.fft.fftfreq(nfft, 1 / fs))
    packed = run_lanes(pack.pack(f, old), [lambda x: kernels.stft(x, window, nperseg, noverlap, nfft, onesided, scaling, 1 / fs).reshape(len(x), -1)], True)
    rows = packed.select(*f.lanes(old), F.posexplode("samples").alias("p", f.value))
    rows = rows.withColumn(idx(old), F.expr(f"cast(p div {len(freqs)} as long)")).withColumn(idx(new), F.expr(f"cast(p % {len(freqs)} as long)")).drop("p")
    coords = {k: c for k, c in f.coords.items() if c.dim != old}
    c = f.coords.get(old)
    if c is not None and not isinstance(c, C.Column):
        first = c.start + (nperseg / 2) * c.sampling_interval(cast=False)
        step = hop * c.sampling_interval(cast=False)
        first, step = (round(first), round(step)) if c.is_time else (first, step)
        coords[old] = C.Sampled(np.array([first]), [frames], step, old, c.is_time)
    coords[new] = C.Dense(freqs, new)
    extents = f.extents | {old: frames, new: len(freqs)}
    return f._with(rows, dims=(*f.dims, new), coords=coords, name=None, attrs={}, extents=extents)
