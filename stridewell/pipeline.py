"""Stateful operators on lanes, and their composition.

A stage turns a chunk of a lane into a chunk, with a state carried from one
chunk to the next: ``concat(stage(chunks)) == stage(all)``.  The same stages run
on whole lanes (:func:`run_batch`) and on streams
(:mod:`stridewell.streaming.stateful`); a chain is one Python stage, not one a
member.
"""

from __future__ import annotations

import copy
import functools
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .coords import rational
from .dsp import design, kernels
from .frame import LabeledFrame
from .pack import along

State = dict


class Atom:
    """A stage.  ``call(x, state, fs)`` gets (1 x n) and its state (None at first)."""

    def call(self, x: np.ndarray, state: State | None, fs: float) -> tuple[np.ndarray, State]:
        raise NotImplementedError

    #: output samples a second per input sample a second
    def factor(self, fs: float) -> float:
        return 1.0

    def shift(self, fs: float) -> float:
        """Seconds by which labels move."""
        return 0.0

    def __call__(self, x: np.ndarray, state: State | None = None, fs: float = 1.0) -> tuple[np.ndarray, State]:
        return self.call(np.atleast_2d(np.asarray(x, float)), state, fs)

    # a stage may also hold its state itself, for chunks that are handed to it one by one
    state: State | None = None

    def feed(self, x: np.ndarray, fs: float = 1.0) -> np.ndarray:
        """The next chunk; the state stays in the stage."""
        y, self.state = self(x, self.state, fs)
        return y

    @property
    def initialized(self) -> bool:
        return self.state is not None

    def reset(self) -> None:
        self.state = None

    def set_state(self, state: State | None) -> None:
        self.state = copy.deepcopy(state)

    def save_state(self, path: str) -> None:
        """As JSON with arrays in full precision."""
        with open(path, "w", encoding="utf-8") as out:
            json.dump(_plain(self.state), out)

    def load_state(self, path: str) -> None:
        with open(path, encoding="utf-8") as held:
            self.state = _restored(json.load(held))


def _plain(x):
    if isinstance(x, np.ndarray):
        return {"__array": x.ravel().astype(float).tolist(), "shape": list(x.shape)}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x.item() if isinstance(x, np.generic) else x


def _restored(x):
    if isinstance(x, dict):
        return np.array(x["__array"]).reshape(x["shape"]) if "__array" in x else {k: _restored(v) for k, v in x.items()}
    return [_restored(v) for v in x] if isinstance(x, list) else x


class Sequential(Atom):
    """Stages one after the other; callables are wrapped."""

    def __init__(self, atoms, name: str | None = None):
        self.atoms = [a if isinstance(a, Atom) else Partial(a) for a in atoms]
        self.name = name

    def call(self, x, state, fs):
        states = (state or {}).get("members", [None] * len(self.atoms))
        after = []
        for atom, s in zip(self.atoms, states):
            x, s = atom.call(x, s, fs)
            after.append(s)
            fs *= atom.factor(fs)
        return x, {"members": after}

    def factor(self, fs):
        total = 1.0
        for a in self.atoms:
            total *= a.factor(fs * total)
        return total

    def shift(self, fs):
        total = 0.0
        for a in self.atoms:
            total += a.shift(fs)
            fs *= a.factor(fs)
        return total


class Partial(Atom):
    """A function with bound arguments; ``...`` marks the input (default: the first)."""

    def __init__(self, func: Callable, *args, name: str | None = None, **kwargs):
        self.func, self.args, self.kwargs, self.name = func, args, kwargs, name

    def call(self, x, state, fs):
        if ... in self.args or ... in self.kwargs.values():
            args = [x if a is ... else a for a in self.args]
            kwargs = {k: x if v is ... else v for k, v in self.kwargs.items()}
            return self.func(*args, **kwargs), {}
        return self.func(x, *self.args, **self.kwargs), {}


def atomized(func: Callable) -> Callable:
    """Called with ``...`` gives a :class:`Partial`; with an atom, a chain that ends in it; else the result."""

    @functools.wraps(func)
    def wrapper(*args, **kwargs):
        atoms = [a for a in args if isinstance(a, Atom)]
        if atoms:
            rest = [... if a is atoms[0] else a for a in args]
            members = list(atoms[0].atoms) if isinstance(atoms[0], Sequential) else [atoms[0]]
            return Sequential([*members, Partial(func, *rest, **kwargs)])
        if ... in args or ... in kwargs.values():
            return Partial(func, *args, **kwargs)
        return func(*args, **kwargs)

    return wrapper


class LFilter(Atom):
    def __init__(self, b, a):
        self.b, self.a = np.asarray(b, float), np.asarray(a, float)

    def call(self, x, state, fs):
        y, z = kernels.lfilter(self.b, self.a, x, (state or {}).get("z"))
        return y, {"z": z}


class SOSFilter(Atom):
    def __init__(self, sos):
        self.sos = np.asarray(sos, float)

    def call(self, x, state, fs):
        y, z = kernels.sosfilt(self.sos, x, (state or {}).get("z"))
        return y, {"z": z}


class IIRFilter(Atom):
    """Designed for the measured sampling rate on first use."""

    def __init__(self, order: int, cutoff, btype: str = "bandpass", ftype: str = "butter", stype: str = "sos", rp: float | None = None):
        self.spec, self.stype = (order, cutoff, btype, ftype), stype
        self.rp = rp

    @functools.lru_cache(maxsize=8)  # noqa: B019
    def _filter(self, fs: float) -> Atom:
        make = design.iir_sos if self.stype == "sos" else design.iir_ba
        made = make(*self.spec, fs=fs, rp=self.rp)
        return SOSFilter(made) if self.stype == "sos" else LFilter(*made)

    def call(self, x, state, fs):
        return self._filter(fs).call(x, state, fs)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items()}


class FIRFilter(Atom):
    """Windowed FIR; labels move back by half its length."""

    def __init__(self, numtaps: int, cutoff, btype: str = "bandpass", window="hamming", scale: bool = True):
        self.args = (numtaps, cutoff, btype, window)
        self.scale = scale

    def call(self, x, state, fs):
        n, cutoff, btype, window = self.args
        taps = design.firwin(n, cutoff, btype, window, fs, self.scale)
        return LFilter(taps, [1.0]).call(x, state, fs)

    def shift(self, fs):
        return -((self.args[0] - 1) // 2) / fs


class DownSample(Atom):
    """Every q-th sample; the place in the stride is carried on."""

    def __init__(self, factor: int):
        self.q = factor

    def call(self, x, state, fs):
        skip = (state or {}).get("skip", 0)
        y = x[:, skip :: self.q]
        return y, {"skip": (skip - x.shape[1]) % self.q}

    def factor(self, fs):
        return 1 / self.q


class UpSample(Atom):
    """q - 1 zeros after each sample."""

    def __init__(self, factor: int, scale: bool = True):
        self.q, self.scale = factor, scale

    def call(self, x, state, fs):
        y = np.zeros((len(x), x.shape[1] * self.q))
        y[:, :: self.q] = x * (self.q if self.scale else 1)
        return y, {}

    def factor(self, fs):
        return self.q


class ResamplePoly(Atom):
    """To a target rate by up-sampling, a low-pass and down-sampling; nothing if the rate is right."""

    def __init__(self, target: float, maxfactor: int = 100, window=("kaiser", 5.0)):
        self.target, self.maxfactor, self.window = target, maxfactor, window

    def _chain(self, fs: float) -> Sequential:
        up, down = rational(self.target / fs, self.maxfactor)
        if up == down:
            return Sequential([])
        most = max(up, down)
        taps = design.firwin(20 * most + 1, 1 / most, window=self.window)
        return Sequential([UpSample(up), LFilter(taps, [1.0]), DownSample(down)])

    def call(self, x, state, fs):
        return self._chain(fs).call(x, state, fs)

    def factor(self, fs):
        up, down = rational(self.target / fs, self.maxfactor)
        return up / down

    def shift(self, fs):
        up, down = rational(self.target / fs, self.maxfactor)
        return 0.0 if up == down else -10 * max(up, down) / (fs * up)


class Trigger:
    """Threshold picks across chunks: ``call`` gives (place in the whole lane, value) pairs."""

    def __init__(self, thresh: float):
        self.thresh = thresh

    def call(self, x: np.ndarray, state: State | None = None) -> tuple[list[tuple[int, float]], State]:
        state = state or {"offset": 0, "open": None}
        picks, left = kernels.trigger(np.ravel(x), self.thresh, state["open"])
        n = np.size(x)
        return [(state["offset"] + i, v) for i, v in picks], {"offset": state["offset"] + n, "open": left}


class WindowModel(Atom):
    """A model over half-overlapping windows; outputs are averaged where windows overlap.

    ``model``: a function of (windows x nperseg) giving the same shape or, with
    ``phases``, (windows x phases x nperseg); or the path of an ONNX model of
    such shapes.  Samples come out once no further window covers them; with
    phases, a lane becomes as many rows, in their order.
    """

    def __init__(self, model: Callable[[np.ndarray], np.ndarray] | str, nperseg: int, noverlap: int | None = None, blinding: tuple[int, int] = (0, 0),
                 phases: list[str] | None = None):
        self.model, self.nperseg, self.blinding, self.phases = model, nperseg, blinding, phases
        self.noverlap = nperseg // 2 if noverlap is None else noverlap

    def _apply(self, windows: np.ndarray) -> np.ndarray:
        """(windows x phases x nperseg)."""
        run = _onnx(self.model) if isinstance(self.model, str) else self.model
        return np.asarray(run(windows), float).reshape(len(windows), len(self.phases or [0]), self.nperseg)

    def call(self, x, state, fs):
        hop, rows = self.nperseg - self.noverlap, len(self.phases or [0])
        state = copy.deepcopy(state) if state else {"x": np.zeros((len(x), 0)), "sum": np.zeros((len(x) * rows, 0)), "n": np.zeros(0)}
        held = np.concatenate([state["x"], x], axis=1)
        total = np.concatenate([state["sum"], np.zeros((len(x) * rows, held.shape[1] - state["sum"].shape[1]))], axis=1)
        count = np.concatenate([state["n"], np.zeros(held.shape[1] - len(state["n"]))])
        lo, hi = self.blinding[0], self.nperseg - self.blinding[1]
        starts = list(range(0, held.shape[1] - self.nperseg + 1, hop))
        at = starts[-1] + hop if starts else 0
        for lane in range(len(held) if starts else 0):
            windows = np.stack([held[lane, s : s + self.nperseg] for s in starts])
            for s, y in zip(starts, self._apply(windows)):
                total[lane * rows : (lane + 1) * rows, s + lo : s + hi] += y[:, lo:hi]
        for s in starts:
            count[s + lo : s + hi] += 1
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(count[:at] > 0, total[:, :at] / count[:at], np.nan)
        return out, {"x": held[:, at:], "sum": total[:, at:], "n": count[at:]}


@functools.lru_cache(maxsize=4)
def _onnx(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A stored model, loaded once a worker."""
    session = LazyModule("onnxruntime").InferenceSession(path)
    name = session.get_inputs()[0].name
    return lambda windows: session.run(None, {name: np.asarray(windows, np.float32)})[0]


class LazyModule:
    """A module that is imported on first use, with a plain message where it is absent."""

    def __init__(self, name: str):
        self._name = name

    def __getattr__(self, attribute: str):
        import importlib

        try:
            module = importlib.import_module(self._name)
        except ImportError as e:
            raise ImportError(f"{self._name} is needed for this and isn't installed") from e
        return getattr(module, attribute)


def pick_phases(f: LabeledFrame, model: WindowModel, dim: str = "last") -> LabeledFrame:
    """A model's phases over whole lanes: the frame's dims with ``phase`` before the last one."""
    from pyspark.sql import functions as F

    from . import coords as C
    from .frame import idx
    from .pack import pack, run_lanes, unpack

    dim = f.axis(dim)
    phases = model.phases or ["phase"]
    n, hop = f.size(dim), model.nperseg - model.noverlap
    size = (max(0, n - model.nperseg) // hop + 1) * hop if n >= model.nperseg else 0

    def kernel(x):
        return model.call(x, None, 1.0)[0].reshape(len(x), -1)

    packed = run_lanes(pack(f, dim), [kernel])
    each = F.explode(F.expr(f"sequence(0L, {len(phases) - 1}L)")).alias(idx("phase"))
    rows = packed.select(*f.lanes(dim), each, "samples")
    rows = rows.withColumn("samples", F.expr(f"slice(samples, cast({idx('phase')} * {size} + 1 as int), {size})"))
    dims = (*[d for d in f.dims if d != dim], "phase", dim)
    coords = {k: c.slice(slice(0, size)) if c.dim == dim else c for k, c in f.coords.items() if not isinstance(c, C.Column)}
    shell = f._with(rows.withColumn(idx(dim), F.lit(0)), dims=dims, coords=coords | {"phase": C.Dense(np.array(phases, object), "phase")}, extents=f.extents | {"phase": len(phases)})
    return unpack(rows, shell, dim, shell.coords, size)


def run_batch(f: LabeledFrame, atom: Atom, dim: str = "last") -> LabeledFrame:
    """A chain over whole lanes, in one Arrow stage."""
    from . import coords as C

    dim = f.axis(dim)
    c = f.coords.get(dim)
    fs = 1 / c.sampling_interval() if c is not None and not isinstance(c, C.Column) else 1.0
    factor, shift = atom.factor(fs), atom.shift(fs)
    coord = None
    if (factor != 1 or shift) and c is not None and not isinstance(c, C.Column):
        n = f.size(dim)
        size = -(-n // round(1 / factor)) if factor < 1 and abs(1 / factor - round(1 / factor)) < 1e-9 else int(np.ceil(n * factor - 1e-9))
        step = c.sampling_interval(cast=False) / factor
        start = c.start + (round(shift * C.NS) if c.is_time else shift)
        coord = C.Sampled(np.array([start]), [size], round(step) if c.is_time else step, dim, c.is_time)
    return along(f, dim, lambda x: atom.call(x, None, fs)[0], coord)


def transform(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for s in steps:
        df = df.transform(s)
    return df
