"""Windows and filter design from the textbook formulas (analog prototypes and
the bilinear transform)."""

from __future__ import annotations

import numpy as np


def get_window(window, n: int, periodic: bool = True) -> np.ndarray:
    """Window by name, ('kaiser', beta) or given weights. Periodic ones drop the last of n + 1."""
    if not isinstance(window, (str, tuple)):
        w = np.asarray(window, float)
        if len(w) != n:
            raise ValueError("the window has the wrong length")
        return w
    name, *args = (window,) if isinstance(window, str) else window
    if n <= 1:
        return np.ones(max(n, 0))
    m = n + 1 if periodic else n
    k = np.arange(m)
    phase = 2 * np.pi * k / (m - 1)
    if name in ("boxcar", "rectangular"):
        w = np.ones(m)
    elif name in ("hann", "hanning"):
        w = 0.5 - 0.5 * np.cos(phase)
    elif name == "hamming":
        w = 0.54 - 0.46 * np.cos(phase)
    elif name == "blackman":
        w = 0.42 - 0.5 * np.cos(phase) + 0.08 * np.cos(2 * phase)
    elif name == "bartlett":
        w = 1 - np.abs(2 * k / (m - 1) - 1)
    elif name == "cosine":
        w = np.sin(np.pi * (k + 0.5) / m)
    elif name == "tukey":
        alpha = args[0] if args else 0.5
        edge = alpha * (m - 1) / 2
        d = np.minimum(k, m - 1 - k)
        w = np.where(d < edge, 0.5 - 0.5 * np.cos(np.pi * d / max(edge, 1e-12)), 1.0)
    elif name == "kaiser":
        w = np.i0(args[0] * np.sqrt(np.clip(1 - (2 * k / (m - 1) - 1) ** 2, 0, None))) / np.i0(args[0])
    elif name == "gaussian":
        w = np.exp(-0.5 * ((k - (m - 1) / 2) / args[0]) ** 2)
    else:
        raise ValueError(f"unknown window {name}")
    return w[:n]


def _prototype(order: int, ftype: str, rp: float | None) -> tuple[np.ndarray, float]:
    """Poles and gain of the analog low-pass with cut-off 1."""
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    if ftype == "butter":
        return -np.sin(theta) + 1j * np.cos(theta), 1.0
    if ftype == "cheby1":
        eps = np.sqrt(10 ** (0.1 * rp) - 1)
        mu = np.arcsinh(1 / eps) / order
        poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
        gain = np.prod(-poles).real
        return poles, gain / np.sqrt(1 + eps**2) if order % 2 == 0 else gain
    raise ValueError(f"unknown filter type {ftype}")


def iir_zpk(order: int, cutoff, btype: str = "lowpass", ftype: str = "butter", fs: float = 2.0, rp: float | None = None):
    """Zeros, poles and gain of a digital Butterworth or Chebyshev I filter."""
    poles, gain = _prototype(order, ftype, rp)
    w = np.atleast_1d(np.asarray(cutoff, float)) * 2 / fs
    if np.any(w <= 0) or np.any(w >= 1):
        raise ValueError("cut-off frequencies must lie between 0 and half the sampling rate")
    warped = 4 * np.tan(np.pi * w / 2)
    degree = len(poles)
    if btype in ("lowpass", "highpass"):
        (wc,) = warped
        if btype == "lowpass":
            zeros, poles, gain = np.zeros(0, complex), poles * wc, gain * wc**degree
        else:
            gain = gain * np.real(1 / np.prod(-poles))
            zeros, poles = np.zeros(degree, complex), wc / poles
    elif btype in ("bandpass", "bandstop"):
        lo, hi = warped
        width, centre = hi - lo, np.sqrt(lo * hi)
        if btype == "bandpass":
            half = poles * width / 2
            zeros, gain = np.zeros(degree, complex), gain * width**degree
        else:
            gain = gain * np.real(1 / np.prod(-poles))
            half = width / 2 / poles
            zeros = np.concatenate([np.full(degree, 1j * centre), np.full(degree, -1j * centre)])
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles = np.concatenate([half + root, half - root])
    else:
        raise ValueError(f"unknown band type {btype}")
    # bilinear transform at a sampling rate of 2
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    extra = len(poles) - len(zeros)
    zeros, poles = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    return np.concatenate([zeros, -np.ones(extra)]), poles, gain


def _pairs(roots: np.ndarray) -> list[tuple[complex, complex]]:
    """Conjugate pairs, then real roots two by two (one may be left with 0)."""
    upper = sorted(roots[roots.imag > 1e-10], key=lambda r: -abs(r))
    real = sorted(roots[np.abs(roots.imag) <= 1e-10].real, key=lambda r: -abs(r))
    pairs = [(r, np.conj(r)) for r in upper]
    pairs += [(real[k], real[k + 1] if k + 1 < len(real) else 0.0) for k in range(0, len(real), 2)]
    return pairs


def zpk_to_sos(zeros, poles, gain) -> np.ndarray:
    """Second-order sections, poles farthest from the circle first, each with the nearest zeros."""
    pole_pairs = sorted(_pairs(poles), key=lambda p: abs(p[0]))
    zero_pairs = _pairs(zeros)
    sections = []
    for p in reversed(pole_pairs):  # the most resonant chooses first
        z = min(zero_pairs, key=lambda z: abs(z[0] - p[0])) if zero_pairs else (0.0, 0.0)
        if zero_pairs:
            zero_pairs.remove(z)
        sections.append([*np.real(np.poly(z)), *np.real(np.poly(p))])
    sos = np.array(sections[::-1])
    sos[0, :3] *= gain
    return sos


def iir_sos(order: int, cutoff, btype="lowpass", ftype="butter", fs=2.0, rp=None) -> np.ndarray:
    return zpk_to_sos(*iir_zpk(order, cutoff, btype, ftype, fs, rp))


def iir_ba(order: int, cutoff, btype="lowpass", ftype="butter", fs=2.0, rp=None) -> tuple[np.ndarray, np.ndarray]:
    z, p, k = iir_zpk(order, cutoff, btype, ftype, fs, rp)
    return np.real(k * np.poly(z)), np.real(np.poly(p))


def firwin(taps: int, cutoff, btype: str = "lowpass", window="hamming", fs: float = 2.0, scale: bool = True) -> np.ndarray:
    """Linear-phase FIR filter by windowing ideal bands."""
    edges = np.atleast_1d(np.asarray(cutoff, float)) * 2 / fs
    bands = {"lowpass": [(0, edges[0])], "highpass": [(edges[-1], 1)], "bandpass": [(edges[0], edges[-1])], "bandstop": [(0, edges[0]), (edges[-1], 1)]}[btype]
    if bands[-1][1] == 1 and taps % 2 == 0:
        raise ValueError("a filter that passes the highest frequency needs an odd number of taps")
    m = np.arange(taps) - (taps - 1) / 2
    h = sum(b * np.sinc(b * m) - a * np.sinc(a * m) for a, b in bands) * get_window(window, taps, periodic=False)
    if scale:
        a, b = bands[0]
        at = 0.0 if a == 0 else 1.0 if b == 1 else (a + b) / 2
        h = h / np.sum(h * np.cos(np.pi * m * at))
    return h


def lfilter_zi(b, a) -> np.ndarray:
    """State of a filter at rest after a long step of 1."""
    n = max(len(a), len(b))
    a, b = (np.pad(np.asarray(x, float) / a[0], (0, n - len(x))) for x in (a, b))
    if n == 1:
        return np.zeros(0)
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] += np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - companion, b[1:] - a[1:] * b[0])


def sosfilt_zi(sos) -> np.ndarray:
    zi, level = np.zeros((len(sos), 2)), 1.0
    for k, s in enumerate(sos):
        zi[k] = level * lfilter_zi(s[:3], s[3:])
        level *= s[:3].sum() / s[3:].sum()
    return zi
