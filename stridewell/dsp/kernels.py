"""Kernels on lanes side by side: arrays of shape (lanes, samples)."""

from __future__ import annotations

import numpy as np

from .design import firwin, get_window, iir_sos, lfilter_zi, sosfilt_zi


def lfilter(b, a, x: np.ndarray, zi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Transposed direct form II; returns the output and the final state (lanes, order)."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    z = np.zeros((len(x), n)) if zi is None else np.pad(np.broadcast_to(zi, (len(x), n - 1)).astype(float), ((0, 0), (0, 1)))
    if not x.shape[1]:
        return np.zeros(x.shape), z[:, :-1].copy()
    if not a[1:].any() and n > 8:  # FIR: a convolution
        full = np.array([np.convolve(row, b) for row in x])
        full[:, : n - 1] += z[:, :-1]
        return full[:, : x.shape[1]], full[:, x.shape[1] : x.shape[1] + n - 1]
    y = np.empty(x.shape)
    columns = np.ascontiguousarray(x.T, dtype=float)
    for t, v in enumerate(columns):
        out = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:] + v[:, None] * b[1:] - out[:, None] * a[1:]
        y[:, t] = out
    return y, z[:, :-1].copy()


def sosfilt(sos, x: np.ndarray, zi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after the other; state (lanes, sections, 2)."""
    z = np.zeros((len(x), len(sos), 2)) if zi is None else np.broadcast_to(zi, (len(x), len(sos), 2)).astype(float).copy()
    y = np.asarray(x, float)
    for k, s in enumerate(sos):
        y, z[:, k] = lfilter(s[:3], s[3:], y, z[:, k])
    return y, z


def _extend(x: np.ndarray, pad: int, padtype: str | None) -> np.ndarray:
    if not pad or padtype is None:
        return x
    if pad >= x.shape[1]:
        raise ValueError("the padding must be shorter than the lane")
    left, right = x[:, pad:0:-1], x[:, -2 : -pad - 2 : -1]
    if padtype == "odd":
        left, right = 2 * x[:, :1] - left, 2 * x[:, -1:] - right
    elif padtype == "constant":
        left, right = np.repeat(x[:, :1], pad, 1), np.repeat(x[:, -1:], pad, 1)
    return np.concatenate([left, x, right], axis=1)


def extend_side(x: np.ndarray, pad: int, padtype: str, left: bool, skip: int = 0) -> np.ndarray:
    """One end of a lane turned over; ``skip`` samples at the beginning are padding already."""
    lane = x[:, skip:]
    if pad >= lane.shape[1]:
        raise ValueError("the padding must be shorter than the lane's outer blocks")
    whole = _extend(lane, pad, padtype)
    return np.concatenate([whole[:, :pad], x], axis=1) if left else np.concatenate([x, whole[:, whole.shape[1] - pad :]], axis=1)


def sos_padding(sos) -> int:
    sos = np.asarray(sos)
    return 3 * int(2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))


def _both_ways(run, zi, x: np.ndarray, pad: int, padtype) -> np.ndarray:
    pad = 0 if padtype is None else pad
    y = _extend(np.asarray(x, float), pad, padtype)
    y = run(y, y[:, 0])
    y = run(y[:, ::-1], y[:, -1])[:, ::-1]
    return y[:, pad : y.shape[1] - pad] if pad else y


def filtfilt(b, a, x, padtype="odd", padlen=None):
    zi = lfilter_zi(b, a)
    pad = 3 * max(len(a), len(b)) if padlen is None else padlen
    return _both_ways(lambda y, y0: lfilter(b, a, y, zi * y0[:, None])[0], zi, x, min(pad, x.shape[1] - 1), padtype)


def sosfiltfilt(sos, x, padtype="odd", padlen=None):
    zi = sosfilt_zi(sos)
    pad = sos_padding(sos) if padlen is None else padlen
    return _both_ways(lambda y, y0: sosfilt(sos, y, zi * y0[:, None, None])[0], zi, x, min(pad, x.shape[1] - 1), padtype)


def hilbert(x, n=None):
    """Analytic signal: negative frequencies removed, positive ones doubled."""
    n = x.shape[1] if n is None else n
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, n, axis=1) * h, axis=1)


def resample(x, num: int, window=None):
    """Fourier method: the spectrum is cut or padded with zeros."""
    n = x.shape[1]
    spectrum = np.fft.rfft(x, axis=1)
    if window is not None:
        spectrum = spectrum * np.fft.ifftshift(get_window(window, n))[: spectrum.shape[1]]
    m = min(n, num)
    kept = np.zeros((len(x), num // 2 + 1), complex)
    kept[:, : m // 2 + 1] = spectrum[:, : m // 2 + 1]
    if m % 2 == 0 and n != num:
        kept[:, m // 2] *= 2 if num < n else 0.5
    return np.fft.irfft(kept, num, axis=1) * (num / n)


def resample_spectrum(spectrum: np.ndarray, num: int, window=None) -> np.ndarray:
    """The same from whole spectra, for complex lanes."""
    n = spectrum.shape[1]
    if window is not None:
        spectrum = spectrum * np.fft.ifftshift(get_window(window, n))
    m = min(n, num)
    kept = np.zeros((len(spectrum), num), complex)
    kept[:, : m // 2 + 1] = spectrum[:, : m // 2 + 1]
    if m > 2:
        kept[:, m // 2 + 1 - m :] = spectrum[:, m // 2 + 1 - m :]
    if m % 2 == 0 and num < n:
        kept[:, m // 2] += spectrum[:, n - m // 2]
    elif m % 2 == 0 and num > n:
        kept[:, m // 2] *= 0.5
        kept[:, num - m // 2] = kept[:, m // 2]
    return np.fft.ifft(kept, axis=1) * (num / n)


def resample_filter(up: int, down: int, window=("kaiser", 5.0)) -> np.ndarray:
    reach = 10 * max(up, down)
    return firwin(2 * reach + 1, 1 / max(up, down), window=window) * up


def resample_poly(x, up: int, down: int, window=("kaiser", 5.0), padtype="constant", cval=0.0):
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down:
        return np.array(x, float)
    offset = {"constant": np.full((len(x), 1), cval or 0.0), "mean": x.mean(1, keepdims=True), "median": np.median(x, 1)[:, None],
              "minimum": x.min(1, keepdims=True), "maximum": x.max(1, keepdims=True)}[padtype]
    h = resample_filter(up, down, window)
    n = x.shape[1]
    raised = np.zeros((len(x), n * up))
    raised[:, ::up] = x - offset
    size = -(-n * up // down)
    half = (len(h) - 1) // 2
    out = np.array([np.convolve(row, h)[half : half + (size - 1) * down + 1 : down] for row in raised])
    return out + offset


def decimate(x, q: int, n: int | None = None, ftype: str = "iir", zero_phase: bool = True):
    """Anti-alias (Chebyshev I of order 8, or a FIR of 20 q + 1 taps), then every q-th sample."""
    if ftype == "iir":
        sos = iir_sos(n or 8, 0.8 / q, ftype="cheby1", rp=0.05)
        y = sosfiltfilt(sos, x) if zero_phase else sosfilt(sos, x)[0]
        return y[:, ::q]
    taps = firwin((n or 20 * q) + 1, 1 / q, window="hamming")
    if zero_phase:
        half = (len(taps) - 1) // 2
        return np.array([np.convolve(row, taps)[half : half + x.shape[1]] for row in x])[:, ::q]
    return lfilter(taps, [1.0], x)[0][:, ::q]


def stft(x, window="hann", nperseg=256, noverlap=None, nfft=None, onesided=True, scaling="spectrum", step=1.0):
    """Windowed spectra (lanes, frames, frequencies) of overlapping frames."""
    noverlap = nperseg // 2 if noverlap is None else noverlap
    hop = nperseg - noverlap
    nfft = nfft or nperseg
    w = get_window(window, nperseg)
    frames = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=1)[:, ::hop] * w
    scale = 1 / w.sum() ** 2 if scaling == "spectrum" else step / np.sum(w**2)
    if onesided:
        return np.fft.rfft(frames, nfft, axis=2) * np.sqrt(scale)
    return np.fft.fftshift(np.fft.fft(frames, nfft, axis=2), axes=2) * np.sqrt(scale)


def trigger(x: np.ndarray, on: float, state: tuple | None = None):
    """Picks of one lane as (place, value), and the open trigger (on?, place, value).

    On above ``on``, off below half of it; a pick is the first largest value in
    between.  Places count from the start of this chunk and may be negative.
    """
    active, place, top = state or (False, 0, 0.0)
    picks = []
    for i, v in enumerate(x.tolist()):
        if active:
            if v > top:
                place, top = i, v
            if v < on / 2:
                picks.append((place, top))
                active = False
        elif v > on:
            active, place, top = True, i, v
    return picks, (active, place - len(x), top)
