"""Coordinates: compressed descriptors of an axis.

A descriptor is driver metadata (tie points or segments), never one entry a
sample, except :class:`Dense` for short axes.  :class:`Column` stands for a
label that lives in a column of the frame itself.  Times are int64 nanoseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

NS = 1_000_000_000


def as_label(value):
    """Times (str, datetime64, Timestamp) as int nanoseconds; other labels as they are."""
    if isinstance(value, (np.datetime64, pd.Timestamp)):
        return int(pd.Timestamp(value).value)
    if isinstance(value, np.generic):
        return value.item()
    return value


def parse_label(value, is_time: bool):
    return int(pd.Timestamp(value).value) if is_time and isinstance(value, str) else as_label(value)


def parse_tolerance(tolerance, is_time: bool):
    """Seconds as nanoseconds on time axes; None is 0."""
    if tolerance is None:
        return 0
    if isinstance(tolerance, (np.timedelta64, pd.Timedelta)):
        return int(pd.Timedelta(tolerance).value)
    return int(round(tolerance * NS)) if is_time else tolerance


class Coordinate:
    """An axis of ``size`` labels. ``dim`` is None for scalars."""

    dim: str | None = None
    kind = ""
    registry: dict[str, type] = {}

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if cls.kind:
            Coordinate.registry[cls.kind] = cls

    # -- shared behaviour, on values() and segments ---------------------------------
    def __len__(self) -> int:
        return self.size

    @property
    def empty(self) -> bool:
        return self.size == 0

    def values(self) -> np.ndarray:
        return self.label(np.arange(self.size))

    @property
    def start(self):
        return as_label(self.label(np.array([0]))[0])

    @property
    def end(self):
        return as_label(self.label(np.array([self.size - 1]))[0])

    def format_index(self, i: int, bounds: str = "raise") -> int:
        i = i + self.size if i < 0 else i
        if bounds == "raise" and not 0 <= i < self.size:
            raise IndexError(f"index {i} out of {self.size}")
        return min(max(i, 0), self.size)

    def at(self, i: int):
        return as_label(self.label(np.array([i]))[0])

    def _below(self, x, with_equal: bool = False) -> int:
        """How many labels lie below x (or at it): halving the index, without listing labels."""
        lo, hi = 0, self.size
        while lo < hi:
            mid = (lo + hi) // 2
            v = self.at(mid)
            if v < x or (with_equal and v == x):
                lo = mid + 1
            else:
                hi = mid
        return lo

    def indexer(self, label, method: str | None = None) -> int:
        """Place of a label: exact (None), nearest (the earlier of two), ffill or bfill; KeyError if there is none."""
        if method not in (None, "nearest", "ffill", "bfill"):
            raise ValueError(f"method must be nearest, ffill or bfill, not {method}")
        x = parse_label(label, self.is_time)
        if not self.monotonic():
            raise NotImplementedError("labels overlap; split at overlaps first")
        at = self._below(x, method == "ffill")
        if method == "ffill":
            at -= 1
        elif method == "nearest" and self.size:
            at = min(max(at, 1), self.size - 1)
            if at and x - self.at(at - 1) <= self.at(at) - x:
                at -= 1
        if not 0 <= at < self.size or (method is None and self.at(at) != x):
            raise KeyError(label)
        return at

    def slice_indexer(self, start=None, stop=None, endpoint: bool = True) -> slice:
        """Half-open index range of labels in [start, stop] ([start, stop) without endpoint)."""
        def place(x, default, method):
            if x is None:
                return default
            try:
                return self.indexer(x, method)
            except KeyError:
                return self.size if method == "bfill" else -1
        lo = place(start, 0, "bfill")
        hi = place(stop, self.size - 1, "ffill") + 1
        if not endpoint and stop is not None and 0 < hi <= self.size and as_label(self.label(np.array([hi - 1]))[0]) == parse_label(stop, self.is_time):
            hi -= 1
        return slice(lo, max(lo, hi))

    @property
    def is_time(self) -> bool:
        return getattr(self, "time", False)

    def monotonic(self) -> bool:
        v = self.values()
        return bool(np.all(v[1:] > v[:-1])) if self.size > 1 and v.dtype.kind in "ifu" else len(set(v.tolist())) == self.size

    def sampling_interval(self, cast: bool = True):
        if self.size < 2:
            return None
        step = (self.end - self.start) / (self.size - 1)
        return step / NS if self.is_time and cast else step

    def ties(self) -> np.ndarray:
        """Index at which each segment starts, the first left out."""
        return np.zeros(0, np.int64)

    def jumps(self) -> np.ndarray:
        """At each tie: label minus the label expected there."""
        return np.zeros(0)

    def split_indices(self, kind: str = "discontinuities", tolerance=False) -> np.ndarray:
        """Segment starts at gaps, overlaps or both. False: every tie of that kind."""
        at, jump = self.ties(), self.jumps()
        if tolerance is False:
            keep = {"discontinuities": np.ones(len(jump), bool), "gaps": jump >= 0, "overlaps": jump < 0}[kind]
        else:
            t = parse_tolerance(tolerance, self.is_time)
            keep = {"discontinuities": np.abs(jump) > t, "gaps": jump > t, "overlaps": jump < -t}[kind]
        return at[keep]

    def discontinuities(self, tolerance=None) -> pd.DataFrame:
        """Last label before and first after each split, their distance, gap or overlap."""
        at = self.split_indices("discontinuities", tolerance)
        before, after = self.label(at - 1), self.label(at)
        delta = after - before
        return pd.DataFrame({"start_index": at - 1, "end_index": at, "start_value": before, "end_value": after, "delta": delta,
                             "type": np.where(delta > 0, "gap", "overlap")})

    def availabilities(self, tolerance=None) -> pd.DataFrame:
        cuts = np.concatenate([[0], self.split_indices("discontinuities", tolerance), [self.size]]).astype(int)
        if not self.size:
            cuts = np.zeros(1, int)
        lo, hi = cuts[:-1], cuts[1:] - 1
        a, b = self.label(lo), self.label(hi)
        return pd.DataFrame({"start_index": lo, "end_index": hi, "start_value": a, "end_value": b, "delta": b - a, "type": "data"})

    def take(self, indexes) -> Coordinate:
        return Dense(self.label(np.asarray(indexes, int)), self.dim, self.is_time)

    def turns(self) -> np.ndarray:
        """First and last index of each stretch in which labels rise evenly."""
        return np.arange(self.size)

    def equals(self, other) -> bool:
        """Same dim and labels, whatever the descriptors: between the turns of both, both rise evenly."""
        if not isinstance(other, Coordinate) or (self.dim, self.size) != (other.dim, other.size):
            return False
        at = np.union1d(self.turns(), other.turns()).astype(np.int64)
        return bool(np.array_equal(self.label(at), other.label(at)))

    def pieces(self, most: int = 0) -> list[tuple] | None:
        """(first index, index after the last, label at the first, step) of each stretch, if there are more than ``most``."""
        return None

    def expr(self, index: SparkColumn) -> SparkColumn:
        """Label of an index column."""
        raise NotImplementedError


@dataclass
class Scalar(Coordinate):
    value: object
    kind = "scalar"
    dim: str | None = None
    size = 1

    def label(self, i):
        return np.array([self.value] * len(i))

    def expr(self, index=None):
        return F.lit(self.value)

    def equals(self, other):
        return isinstance(other, Scalar) and self.value == other.value

    def to_dict(self):
        return {"kind": self.kind, "value": self.value}


@dataclass
class Default(Coordinate):
    """arange(size); its slices are end-exclusive."""

    size: int
    dim: str | None = None
    kind = "default"

    def label(self, i):
        return np.asarray(i)

    def expr(self, index):
        return index

    def turns(self):
        return np.array([0, self.size - 1] if self.size else [], np.int64)

    def monotonic(self):
        return True

    def sampling_interval(self, cast=True):
        return 1

    def indexer(self, label, method=None):
        """A place is its own label; negative ones count from the end."""
        at = int(label) + (self.size if label < 0 else 0)
        if not 0 <= at < self.size:
            raise KeyError(label)
        return at

    def slice_indexer(self, start=None, stop=None, endpoint=True):
        return slice(*slice(start, stop).indices(self.size)[:2])

    def slice(self, s: slice):
        return Default(len(range(*s.indices(self.size))), self.dim)

    def concat(self, other):
        return Default(self.size + other.size, self.dim)

    def to_dict(self):
        return {"kind": self.kind, "size": self.size, "dim": self.dim}


@dataclass
class Dense(Coordinate):
    data: np.ndarray
    dim: str | None = None
    time: bool = False
    kind = "dense"

    def __post_init__(self):
        self.data = np.asarray(self.data)
        if self.data.dtype.kind == "M":
            self.data, self.time = self.data.astype("datetime64[ns]").astype(np.int64), True
        if self.data.dtype == object and not all(isinstance(x, str) for x in self.data):
            raise TypeError("labels must be numbers, times or strings")

    @property
    def size(self):
        return len(self.data)

    def label(self, i):
        return self.data[np.asarray(i, int)]

    def values(self):
        return self.data

    def indexer(self, label, method=None):
        if method is None or self.data.dtype.kind in "UO":
            at = np.flatnonzero(self.data == parse_label(label, self.time))
            if not len(at):
                raise KeyError(label)
            return int(at[0])
        return super().indexer(label, method)

    def div_points(self, tolerance=None):
        """Where labels step by at least the tolerance, with both ends."""
        t = parse_tolerance(tolerance, self.time)
        cuts = np.flatnonzero(np.abs(np.diff(self.data)) >= t) + 1
        return np.concatenate([[0], cuts, [self.size]]).astype(int)

    def ties(self):
        return np.arange(1, self.size)

    def jumps(self):
        d = np.diff(self.data)
        return d - np.median(d) if len(d) else d

    def slice(self, s):
        return Dense(self.data[s], self.dim, self.time)

    def decimate(self, q):
        return self.slice(slice(None, None, q))

    def concat(self, other):
        if self.empty or other.empty:
            return other if self.empty else self
        if (self.data.dtype.kind, self.dim, self.time) != (other.data.dtype.kind, other.dim, other.time):
            raise TypeError("coordinates of different kinds can't be joined")
        return Dense(np.concatenate([self.data, other.data]), self.dim, self.time)

    def shift(self, by):
        return Dense(self.data + by, self.dim, self.time)

    def expr(self, index):
        values = F.array(*[F.lit(as_label(v)) for v in self.data])
        return F.get(values, index.cast("int"))

    def pieces(self, most=0):
        if self.size <= max(most, 1000):
            return None
        labels = self.data.tolist()
        return [(i, i + 1, v, 0 if isinstance(v, int) else "" if isinstance(v, str) else 0.0) for i, v in enumerate(labels)]

    def to_dict(self):
        return {"kind": self.kind, "data": self.data.tolist(), "dim": self.dim, "time": self.time}


@dataclass
class Interp(Coordinate):
    """Piecewise linear between tie points."""

    tie_indices: np.ndarray
    tie_values: np.ndarray
    dim: str | None = None
    time: bool = False
    kind = "interpolated"

    def __post_init__(self):
        self.tie_indices = np.asarray(self.tie_indices, np.int64)
        self.tie_values = np.asarray(self.tie_values)
        if self.tie_values.dtype.kind == "M":
            self.tie_values, self.time = self.tie_values.astype("datetime64[ns]").astype(np.int64), True
        if len(self.tie_indices) != len(self.tie_values):
            raise ValueError("as many tie indices as tie values are needed")
        if len(self.tie_indices) and (self.tie_indices[0] != 0 or np.any(np.diff(self.tie_indices) <= 0)):
            raise ValueError("tie indices must start at 0 and increase")

    @property
    def size(self):
        return int(self.tie_indices[-1]) + 1 if len(self.tie_indices) else 0

    def label(self, i):
        i = np.asarray(i)
        if len(self.tie_indices) == 1:
            return np.repeat(self.tie_values, len(i))
        seg = np.clip(np.searchsorted(self.tie_indices, i, "right") - 1, 0, max(0, len(self.tie_indices) - 2))
        i0, i1 = self.tie_indices[seg], self.tie_indices[seg + 1]
        v0, v1 = self.tie_values[seg], self.tie_values[seg + 1]
        if self.time:  # integers all the way
            return v0 + np.rint((v1 - v0) * ((i - i0) / (i1 - i0))).astype(np.int64)
        return v0 + (i - i0) * ((v1 - v0) / (i1 - i0))

    def monotonic(self):
        return bool(np.all(np.diff(self.tie_values) > 0))

    def turns(self):
        return self.tie_indices

    def pieces(self, most=0):
        if len(self.tie_indices) <= max(most, 1):
            return None
        made = [(i0, i1, v0, (v1 - v0) / (i1 - i0)) for i0, i1, v0, v1 in self.segments()]
        last = as_label(self.tie_values[-1])
        return [*made, (int(self.tie_indices[-1]), int(self.tie_indices[-1]) + 1, last, 0.0)]

    def sampling_interval(self, cast=True):
        di, dv = np.diff(self.tie_indices), np.diff(self.tie_values)
        keep = di != 1 if np.any(di != 1) else np.ones(len(di), bool)
        if not len(di):
            return None
        step = float(np.median(dv[keep] / di[keep]))
        return step / NS if self.time and cast else step

    def ties(self):
        return self.tie_indices[1:][np.diff(self.tie_indices) == 1] if len(self.tie_indices) > 2 else np.zeros(0, np.int64)

    def jumps(self):
        at = self.ties()
        return self.label(at) - self.label(at - 1) - (self.sampling_interval(cast=False) or 0) if len(at) else np.zeros(0)

    def slice(self, s: slice):
        r = range(*s.indices(self.size))
        if r.step < 0:
            raise ValueError("steps must be positive")
        if not len(r):
            return Interp([], self.tie_values[:0], self.dim, self.time)
        inside = self.tie_indices[(self.tie_indices > r[0]) & (self.tie_indices < r[-1])]
        at = np.unique(np.concatenate([[r[0]], inside, [r[-1]]]))
        if r.step > 1:
            at = np.unique(np.clip(r.start + -(-(at - r.start) // r.step) * r.step, r[0], r[-1]))
        return Interp((at - r.start) // r.step, self.label(at), self.dim, self.time)

    def decimate(self, q):
        ties = self.tie_indices - self.tie_indices % q
        for k in range(1, len(ties)):
            if ties[k] <= ties[k - 1]:
                ties[k] = ties[k - 1] + q
        return Interp(ties // q, self.tie_values, self.dim, self.time)

    def simplify(self, tolerance=None):
        """Fewest ties within the tolerance (Douglas-Peucker)."""
        t = parse_tolerance(tolerance, self.time)
        keep = np.zeros(len(self.tie_indices), bool)
        stack = [(0, len(keep) - 1)] if len(keep) else []
        while stack:
            a, b = stack.pop()
            keep[[a, b]] = True
            if b - a < 2:
                continue
            x, y = self.tie_indices[a : b + 1], self.tie_values[a : b + 1].astype(float) - float(self.tie_values[a])
            off = np.abs(y - y[-1] * (x - x[0]) / (x[-1] - x[0]))
            k = int(np.argmax(off))
            if off[k] > t:
                stack += [(a, a + k), (a + k, b)]
        return Interp(self.tie_indices[keep], self.tie_values[keep], self.dim, self.time)

    def concat(self, other):
        if self.empty or other.empty:
            return other if self.empty else self
        if (self.dim, self.time, type(self)) != (other.dim, other.time, type(other)):
            raise TypeError("coordinates of different kinds can't be joined")
        return Interp(np.concatenate([self.tie_indices, other.tie_indices + self.size]), np.concatenate([self.tie_values, other.tie_values]), self.dim, self.time)

    def shift(self, by):
        return Interp(self.tie_indices, self.tie_values + by, self.dim, self.time)

    def segments(self):
        """(i0, i1, v0, v1) of each linear piece."""
        return [(int(a), int(b), as_label(u), as_label(v)) for a, b, u, v in zip(self.tie_indices, self.tie_indices[1:], self.tie_values, self.tie_values[1:])]

    def expr(self, index):
        out = F.lit(as_label(self.tie_values[-1]))
        for i0, i1, v0, v1 in reversed(self.segments()):
            if self.time:
                value = F.lit(v0) + F.round((index - i0) * F.lit((v1 - v0) / (i1 - i0))).cast("long")
            else:
                value = F.lit(v0) + (index - i0) * F.lit((v1 - v0) / (i1 - i0))
            out = F.when((index >= i0) & (index < i1), value).otherwise(out)
        return out

    @classmethod
    def from_block(cls, start, size, step, dim=None):
        t = isinstance(start, (str, np.datetime64, pd.Timestamp))
        v0 = parse_label(start, True) if t else start
        d = parse_tolerance(step, t) if t and not isinstance(step, (int, np.integer)) else step
        return cls([0, size - 1], [v0, v0 + (size - 1) * d], dim, t) if size > 1 else cls([0], [v0], dim, t)

    @classmethod
    def from_array(cls, values, dim=None, tolerance=None):
        return cls(np.arange(len(values)), values, dim).simplify(tolerance)

    def to_dict(self):
        return {"kind": self.kind, "tie_indices": self.tie_indices.tolist(), "tie_values": self.tie_values.tolist(), "dim": self.dim, "time": self.time}


@dataclass
class Sampled(Coordinate):
    """Segments of evenly spaced labels with one step."""

    tie_values: np.ndarray
    tie_lengths: np.ndarray
    step: object
    dim: str | None = None
    time: bool = False
    kind = "sampled"
    offsets: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.tie_values = np.asarray(self.tie_values)
        self.tie_lengths = np.asarray(self.tie_lengths, np.int64)
        if self.tie_values.dtype.kind == "M":
            self.tie_values, self.time = self.tie_values.astype("datetime64[ns]").astype(np.int64), True
            if not isinstance(self.step, (np.timedelta64, pd.Timedelta)):
                raise TypeError("a time axis needs a timedelta step")
        if isinstance(self.step, (np.timedelta64, pd.Timedelta)):
            self.step = int(pd.Timedelta(self.step).value)
        if np.any(self.tie_lengths <= 0) or len(self.tie_lengths) != len(self.tie_values):
            raise ValueError("each segment needs a start and a positive length")
        self.offsets = np.cumsum(self.tie_lengths) - self.tie_lengths

    @property
    def size(self):
        return int(self.tie_lengths.sum())

    def label(self, i):
        i = np.asarray(i)
        seg = np.clip(np.searchsorted(self.offsets, i, "right") - 1, 0, max(0, len(self.offsets) - 1))
        return self.tie_values[seg] + (i - self.offsets[seg]) * self.step

    def sampling_interval(self, cast=True):
        return self.step / NS if self.time and cast else self.step

    def monotonic(self):
        return bool(np.all(self.jumps() > -self.step)) if len(self.tie_values) > 1 else True

    def turns(self):
        return np.union1d(self.offsets, self.offsets + self.tie_lengths - 1)

    def pieces(self, most=0):
        if len(self.tie_values) <= max(most, 1):
            return None
        kind = type(as_label(self.tie_values[0]))
        return [(int(o), int(o + n), as_label(v), kind(self.step)) for o, n, v in zip(self.offsets, self.tie_lengths, self.tie_values)]

    def ties(self):
        return self.offsets[1:]

    def jumps(self):
        ends = self.tie_values + self.tie_lengths * self.step
        return self.tie_values[1:] - ends[:-1]

    def slice(self, s: slice):
        r = range(*s.indices(self.size))
        if r.step < 0:
            raise ValueError("steps must be positive")
        values, lengths = [], []
        for v, o, n in zip(self.tie_values, self.offsets, self.tie_lengths):
            inside = range(len(r))[-(-max(0, o - r.start) // r.step) : -(-max(0, o + n - r.start) // r.step)] if len(r) else range(0)
            if len(inside):
                values.append(v + (r[inside[0]] - o) * self.step)
                lengths.append(len(inside))
        return Sampled(np.array(values, self.tie_values.dtype), lengths, self.step * r.step, self.dim, self.time)

    def decimate(self, q):
        return self.slice(slice(None, None, q))

    def simplify(self, tolerance=None):
        """Join a segment to the running one if it starts within the tolerance of its end."""
        t = parse_tolerance(tolerance, self.time)
        values, lengths = [], []
        for v, n in zip(self.tie_values.tolist(), self.tie_lengths.tolist()):
            if values and abs(v - (values[-1] + lengths[-1] * self.step)) <= t:
                lengths[-1] += n
            else:
                values.append(v)
                lengths.append(n)
        return Sampled(np.array(values, self.tie_values.dtype), lengths, self.step, self.dim, self.time)

    def concat(self, other):
        if self.empty or other.empty:
            return other if self.empty else self
        if (self.dim, self.time, self.step, type(self)) != (other.dim, other.time, other.step, type(other)):
            raise TypeError("coordinates of different kinds or steps can't be joined")
        return Sampled(np.concatenate([self.tie_values, other.tie_values]), np.concatenate([self.tie_lengths, other.tie_lengths]), self.step, self.dim, self.time)

    def shift(self, by):
        return Sampled(self.tie_values + by, self.tie_lengths, self.step, self.dim, self.time)

    def expr(self, index):
        out = None
        for o, n, v in reversed(list(zip(self.offsets.tolist(), self.tie_lengths.tolist(), self.tie_values.tolist()))):
            value = F.lit(v) + (index - o) * F.lit(self.step)
            out = value if out is None else F.when(index < o + n, value).otherwise(out)
        return out

    @classmethod
    def from_block(cls, start, size, step, dim=None):
        t = isinstance(start, (str, np.datetime64, pd.Timestamp))
        return cls([parse_label(start, True) if t else start], [size], parse_tolerance(step, t) if t and not isinstance(step, (int, np.integer)) else step, dim, t)

    def to_dict(self):
        return {"kind": self.kind, "tie_values": self.tie_values.tolist(), "tie_lengths": self.tie_lengths.tolist(), "step": self.step, "dim": self.dim, "time": self.time}


@dataclass
class Column(Coordinate):
    """A label in a column of the frame (long irregular axes stay distributed)."""

    column: str
    dim: str | None = None
    time: bool = False
    kind = "column"
    size = -1

    def equals(self, other):
        return isinstance(other, Column) and (self.column, self.dim) == (other.column, other.dim)

    def expr(self, index=None):
        return F.col(self.column)

    def to_dict(self):
        return {"kind": self.kind, "column": self.column, "dim": self.dim, "time": self.time}


def from_dict(d: dict) -> Coordinate:
    return Coordinate.registry[d["kind"]](**{k: v for k, v in d.items() if k != "kind"})


def coordinate(data, dim: str | None = None) -> Coordinate:
    """A coordinate from what describes it: a coordinate, a dict of ties or a size, an array or a scalar."""
    if isinstance(data, Coordinate):
        return data
    if isinstance(data, tuple) and len(data) == 2 and isinstance(data[0], (str, type(None))):
        return coordinate(data[1], data[0])
    if isinstance(data, dict):
        if "tie_indices" in data:
            return Interp(data["tie_indices"], data["tie_values"], dim)
        if "tie_lengths" in data:
            return Sampled(data["tie_values"], data["tie_lengths"], data["sampling_interval"], dim)
        if "size" in data:
            return Default(data["size"], dim)
        raise ValueError("no coordinate can be made of this")
    if np.ndim(data) == 0:
        return Scalar(as_label(data))
    return Dense(np.asarray(data), dim)


def rational(ratio: float, limit: int = 100) -> tuple[int, int]:
    """Up and down factors closest to a ratio."""
    f = Fraction(ratio).limit_denominator(limit)
    return f.numerator, f.denominator
