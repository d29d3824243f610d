"""Synthetic frames for tests and examples."""

from __future__ import annotations

import numpy as np

from . import coords as C
from .frame import LabeledFrame


def wavefronts(spark, shape=(300, 401), start: str = "2023-01-01T00:00:00", step: float = 0.02, spacing: float = 25.0, vp: float = 4000.0, seed: int = 42) -> LabeledFrame:
    """Two arrivals (a P and a slower S wave) of 10 Hz pulses in noise."""
    n, m = shape
    rng = np.random.default_rng(seed)
    t, x = np.arange(n)[:, None] * step, np.arange(m)[None, :] * spacing
    data = 0.01 * rng.standard_normal(shape)
    for speed, size in ((vp, 0.5), (vp / 1.75, 1.0)):
        arrival = 1.0 + np.abs(x - x.mean()) / speed
        a = (np.pi * 10 * (t - arrival)) ** 2
        data += size * (1 - 2 * a) * np.exp(-a)
    axes = {"time": C.Sampled.from_block(start, n, step, "time"), "distance": C.Interp.from_block(0.0, m, spacing, "distance")}
    return LabeledFrame.from_numpy(spark, data, axes, ("time", "distance"), "strain_rate")


def dummy(spark, shape=(1000, 100), seed: int = 0) -> LabeledFrame:
    rng = np.random.default_rng(seed)
    axes = {"time": C.Sampled.from_block("2024-01-01T00:00:00", shape[0], 0.1, "time"), "distance": C.Interp([0, shape[1] - 1], [0.0, 1000.0], "distance")}
    return LabeledFrame.from_numpy(spark, rng.standard_normal(shape), axes, ("time", "distance"))
