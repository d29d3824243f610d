"""Labeled frames: a DataFrame in long layout and a descriptor of its axes.

Each dimension has an index column ``<dim>__i`` (zero-based long); the values are
in ``value``.  Selections become predicates, reductions become aggregates,
arithmetic becomes joins on shared index columns, and everything along an axis
becomes a window over the other axes (the lanes), so that lanes are worked on
side by side.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace


import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coords as C
from .operators.blocks import BROADCAST_ROWS

NAN = float("nan")
#: Pieces of a coordinate up to which its labels are written out as an expression; above, they are joined.
WRITTEN_PIECES = 32
#: Rows of the smaller side of an outer product up to which it goes along with every row of the other.
OUTER_ROWS = 100_000
# Bytes of an item.
ITEM_BYTES = {"double": 8, "bigint": 8, "float": 4, "int": 4, "smallint": 2, "tinyint": 1, "boolean": 1}


def idx(dim: str) -> str:
    return f"{dim}__i"


@dataclass(frozen=True, eq=False)
class LabeledFrame:
    df: DataFrame
    dims: tuple[str, ...]
    coords: dict[str, C.Coordinate] = field(default_factory=dict)
    name: str | None = None
    attrs: dict = field(default_factory=dict)
    value: str = "value"
    extents: dict[str, int] = field(default_factory=dict)

    # -- metadata -----------------------------------------------------------------
    def __post_init__(self):
        missing = [idx(d) for d in self.dims if idx(d) not in self.df.columns]
        if missing:
            raise ValueError(f"index columns missing: {missing}")

    def axis(self, dim: str) -> str:
        """A dimension's name; 'first' and 'last' stand for the outer ones."""
        dim = {"first": self.dims[0], "last": self.dims[-1]}.get(dim, dim) if self.dims else dim
        if dim not in self.dims:
            raise KeyError(dim)
        return dim

    def lanes(self, dim: str) -> list[str]:
        return [idx(d) for d in self.dims if d != dim]

    def size(self, dim: str) -> int:
        dim = self.axis(dim)
        c = self.coords.get(dim)
        if c is not None and c.size >= 0:
            return c.size
        if dim in self.extents:
            return self.extents[dim]
        last = self.df.agg(F.max(idx(dim))).first()[0]
        return 0 if last is None else last + 1

    @property
    def sizes(self) -> dict[str, int]:
        return {d: self.size(d) for d in self.dims}

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.sizes.values())

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def dtype(self) -> str:
        return self.df.schema[self.value].dataType.simpleString()

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()

    @property
    def nbytes(self) -> int:
        """Bytes of the dense array."""
        return math.prod(self.shape) * ITEM_BYTES.get(self.dtype, 8)

    @property
    def values(self) -> np.ndarray:
        return self.to_numpy()

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self.to_numpy().astype(dtype) if dtype is not None else self.to_numpy()

    def _with(self, df: DataFrame, **changes) -> LabeledFrame:
        return replace(self, df=df, **changes)

    def frame(self, labels: bool = True) -> DataFrame:
        """The DataFrame with a label column for each coordinate that has one."""
        df = self.df
        for name, c in self.coords.items() if labels else ():
            if isinstance(c, C.Column):
                df = df.withColumnRenamed(c.column, name) if c.column != name else df
            elif not (isinstance(c, C.Default)):
                df = with_label(df, c, name)
        return df

    def describe(self) -> dict:
        return {"dims": list(self.dims), "coords": {k: c.to_dict() for k, c in self.coords.items()}, "name": self.name, "attrs": self.attrs, "value": self.value}

    def to_dict(self) -> dict:
        rows = self.df.orderBy(*[idx(d) for d in self.dims]).select(*[idx(d) for d in self.dims], self.value).collect()
        return self.describe() | {"data": [tuple(r) for r in rows]}

    @classmethod
    def from_dict(cls, spark, d: dict, kind: str = "double") -> LabeledFrame:
        schema = ", ".join([*(f"`{idx(x)}` long" for x in d["dims"]), f"`{d['value']}` {kind}"])
        df = spark.createDataFrame(d["data"], schema)
        return cls(df, tuple(d["dims"]), {k: C.from_dict(v) for k, v in d["coords"].items()}, d["name"], d["attrs"], d["value"])

    @classmethod
    def from_numpy(cls, spark, data, coords: dict | None = None, dims: tuple | None = None, name: str | None = None, attrs: dict | None = None) -> LabeledFrame:
        import pandas as pd

        data = np.asarray(data)
        made = {}
        for k, v in (coords or {}).items():
            pair = isinstance(v, tuple) and len(v) == 2 and (v[0] is None or isinstance(v[0], str))
            c = C.coordinate(v if pair else (k if (dims is None or k in dims) and np.ndim(v) or isinstance(v, (dict, C.Coordinate)) else None, v))
            if c.dim is None and not isinstance(c, C.Scalar):
                c = replace(c, dim=k)
            made[k] = c
        dims = tuple(dims) if dims else tuple(made[k].dim for k in made if made[k].dim == k) or tuple(f"dim_{i}" for i in range(data.ndim))
        if len(dims) != data.ndim:
            raise ValueError("as many dims as axes are needed")
        for c in made.values():
            if c.dim is not None and c.size != data.shape[dims.index(c.dim)]:
                raise ValueError(f"coordinate along {c.dim} has the wrong length")
        grid = np.meshgrid(*[np.arange(n) for n in data.shape], indexing="ij") if data.ndim else []
        table = pd.DataFrame({idx(d): g.ravel() for d, g in zip(dims, grid)} | {"value": data.ravel()})
        df = spark.createDataFrame(table)
        if data.dtype.kind == "f":  # NaN arrives as null
            df = df.withColumn("value", F.coalesce("value", F.lit(NAN)))
        return cls(df, dims, made, name, attrs or {}, extents=dict(zip(dims, data.shape)))

    def to_numpy(self) -> np.ndarray:
        """The dense array; cells without a row are NaN."""
        table = self.df.select(*[idx(d) for d in self.dims], self.value).toPandas()
        out = np.full(self.shape, NAN) if self.dims else np.array(table[self.value].iloc[0])
        if self.dims:
            out[tuple(table[idx(d)].to_numpy() for d in self.dims)] = table[self.value].to_numpy(dtype=float, na_value=NAN)
        return out

    # -- axes -------------------------------------------------------------------------
    def rename(self, new=None, **names) -> LabeledFrame:
        if isinstance(new, dict):
            names = new | names
        name = self.name if isinstance(new, dict) or new is None else new
        df = self.df
        for a, b in names.items():
            if a in self.dims:
                df = df.withColumnRenamed(idx(a), idx(b))
        to = lambda x: names.get(x, x)
        coords = {to(k): replace(c, dim=to(c.dim)) if c.dim else c for k, c in self.coords.items()}
        return self._with(df, dims=tuple(map(to, self.dims)), coords=coords, name=name, extents={to(k): v for k, v in self.extents.items()})

    def transpose(self, *dims: str) -> LabeledFrame:
        """Another order of the dimensions; ``...`` stands for those not named."""
        dims = dims or tuple(reversed(self.dims))
        if ... in dims:
            rest = [d for d in self.dims if d not in dims]
            at = dims.index(...)
            dims = (*dims[:at], *rest, *dims[at + 1 :])
        if sorted(dims) != sorted(self.dims):
            raise ValueError("dims must be those of the frame")
        return self._with(self.df, dims=tuple(dims))

    @property
    def T(self) -> LabeledFrame:
        return self.transpose()

    def expand_dims(self, dim: str, axis: int = 0) -> LabeledFrame:
        """A new dimension of size 1; a scalar coordinate of that name becomes its label."""
        dims = list(self.dims)
        dims.insert(axis, dim)
        coords = dict(self.coords)
        if isinstance(coords.get(dim), C.Scalar):
            coords[dim] = C.Dense(np.array([coords[dim].value]), dim)
        return self._with(self.df.withColumn(idx(dim), F.lit(0).cast("long")), dims=tuple(dims), coords=coords, extents=self.extents | {dim: 1})

    def swap_dims(self, **names: str) -> LabeledFrame:
        """Make another coordinate along a dimension the one that names it."""
        out = self
        for old, new in names.items():
            if old not in out.dims:
                raise KeyError(old)
            coords = {k: replace(c, dim=new) if c.dim == old else c for k, c in out.coords.items()}
            out = out._with(out.df.withColumnRenamed(idx(old), idx(new)), dims=tuple(new if d == old else d for d in out.dims), coords=coords)
        return out

    def assign_coords(self, coords: dict | None = None, **more) -> LabeledFrame:
        made = {}
        for k, v in ((coords or {}) | more).items():
            c = C.coordinate(v if isinstance(v, tuple) else (k if k in self.dims else None, v))
            if c.dim is None and k in self.dims and not isinstance(c, C.Scalar):
                c = replace(c, dim=k)
            if c.dim is not None and c.dim not in self.dims:
                raise ValueError(f"{c.dim} is not a dimension")
            if c.dim is not None and c.size >= 0 and c.size != self.size(c.dim):
                raise ValueError(f"{k} has the wrong length")
            made[k] = c
        return self._with(self.df, coords=self.coords | made)

    def drop_coords(self, *names: str) -> LabeledFrame:
        return self._with(self.df, coords={k: c for k, c in self.coords.items() if k not in names})

    def drop_dims(self, *names: str) -> LabeledFrame:
        """Dimensions of size 1 (or already constant) leave; their labels too."""
        coords = {k: c for k, c in self.coords.items() if c.dim not in names}
        return self._with(self.df.drop(*[idx(d) for d in names]), dims=tuple(d for d in self.dims if d not in names), coords=coords)

    def to_bytes(self) -> bytes:
        """Descriptor and rows in one Arrow stream, for messages."""
        import pyarrow as pa

        table = self.df.select(*[idx(d) for d in self.dims], self.value).toArrow().replace_schema_metadata({"frame": json.dumps(self.describe())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, spark, raw: bytes) -> LabeledFrame:
        import pyarrow as pa

        table = pa.ipc.open_stream(raw).read_all()
        d = json.loads(table.schema.metadata[b"frame"])
        coords = {k: C.from_dict(v) for k, v in d["coords"].items()}
        return cls(spark.createDataFrame(table), tuple(d["dims"]), coords, d["name"], d["attrs"], d["value"])

    def equals(self, other: LabeledFrame) -> bool:
        """Same dims, labels, names and values (NaN equals NaN)."""
        if (self.dims, self.name, self.attrs, self.dtype) != (other.dims, other.name, other.attrs, other.dtype) or self.coords.keys() != other.coords.keys():
            return False
        if not all(c.equals(other.coords[k]) for k, c in self.coords.items()):
            return False
        cols = [idx(d) for d in self.dims]
        a = self.df.select(*cols, F.col(self.value).alias("v"))
        b = other.df.select(*cols, F.col(other.value).alias("v"))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def load(self) -> LabeledFrame:
        return self._with(self.df.persist())

    copy = lambda self: replace(self)

    # -- selection --------------------------------------------------------------------
    def isel(self, indexers: dict | None = None, drop: bool = False, **more) -> LabeledFrame:
        """By position: int (drops the dim), slice, or array (orthogonal; keeps order and repeats)."""
        out = self
        for dim, at in ((indexers or {}) | more).items():
            out = out._isel(out.axis(dim), at, drop)
        return out

    def _isel(self, dim: str, at, drop: bool) -> LabeledFrame:
        i, n = F.col(idx(dim)), self.size(dim)
        along = {k: c for k, c in self.coords.items() if c.dim == dim}
        rest = {k: c for k, c in self.coords.items() if c.dim != dim}
        if isinstance(at, (int, np.integer)):
            k = int(at) + (n if at < 0 else 0)
            if not 0 <= k < n:
                raise IndexError(f"{at} out of {n} along {dim}")
            if not drop:
                rest |= {name: C.Scalar(C.as_label(c.label(np.array([k]))[0])) for name, c in along.items() if not isinstance(c, C.Column)}
            ext = {d: v for d, v in self.extents.items() if d != dim}
            return self._with(self.df.filter(i == k).drop(idx(dim)), dims=tuple(d for d in self.dims if d != dim), coords=rest, extents=ext)
        if isinstance(at, slice):
            r = range(*at.indices(n))
            if r.step < 0:
                raise ValueError("steps must be positive")
            keep = (i >= r.start) & (i < r.stop)
            if r.step > 1:
                keep &= (i - r.start) % r.step == 0
            moved = {k: c if isinstance(c, C.Column) else c.slice(at) for k, c in along.items()}
            shift = i - r.start if r.step == 1 else F.expr(f"({idx(dim)} - {r.start}) div {r.step}")
            return self._with(self.df.filter(keep).withColumn(idx(dim), shift), coords=rest | moved, extents=self.extents | {dim: len(r)})
        at = [int(k) + (n if k < 0 else 0) for k in at]
        wanted = self.df.sparkSession.createDataFrame(list(enumerate(at)), "new long, old long")
        df = self.df.join(F.broadcast(wanted) if len(at) <= BROADCAST_ROWS else wanted, i == F.col("old")).drop("old", idx(dim)).withColumnRenamed("new", idx(dim))
        moved = {k: c if isinstance(c, C.Column) else c.take(at) for k, c in along.items()}
        return self._with(df, coords=rest | moved, extents=self.extents | {dim: len(at)})

    def sel(self, indexers: dict | None = None, method: str | None = None, endpoint: bool = True, drop: bool = False, **more) -> LabeledFrame:
        """By label: scalar (method None, nearest, ffill, bfill), slice with both ends, or array.

        On an axis with overlaps a slice is taken of each part between them.
        """
        out = self
        for name, at in ((indexers or {}) | more).items():
            c = out.coords[out.axis(name) if name in ("first", "last") else name]
            if isinstance(c, C.Column):
                out = out._sel_column(c, at, method, endpoint)
            elif isinstance(at, slice):
                if at.step is not None:
                    raise NotImplementedError("label slices have no step")
                out = out._sel_slice(c, at, endpoint)
            elif np.ndim(at):
                out = out.isel({c.dim: [c.indexer(x, method) for x in at]}, drop)
            else:
                out = out.isel({c.dim: c.indexer(at, method)}, drop)
        return out

    def _sel_slice(self, c: C.Coordinate, at: slice, endpoint: bool) -> LabeledFrame:
        if c.monotonic():
            return self.isel({c.dim: c.slice_indexer(at.start, at.stop, endpoint)})
        cuts = [0, *c.split_indices("overlaps").tolist(), c.size]
        keep, parts = F.lit(False), []
        for lo, hi in zip(cuts, cuts[1:]):
            s = c.slice(slice(lo, hi)).slice_indexer(at.start, at.stop, endpoint)
            if s.stop > s.start:
                parts.append((lo + s.start, lo + s.stop))
        moved, offset, index = None, 0, F.col(idx(c.dim))
        new = F.lit(None).cast("long")
        for lo, hi in parts:
            inside = (index >= lo) & (index < hi)
            keep, new = keep | inside, F.when(inside, index - (lo - offset)).otherwise(new)
            piece = c.slice(slice(lo, hi))
            moved = piece if moved is None else moved.concat(piece)
            offset += hi - lo
        name = next(k for k, v in self.coords.items() if v is c)
        others = {}
        for k, v in self.coords.items():
            if v.dim == c.dim and v is not c:
                pieces = [v.slice(slice(lo, hi)) for lo, hi in parts] or [v.slice(slice(0, 0))]
                others[k] = pieces[0]
                for piece in pieces[1:]:
                    others[k] = others[k].concat(piece)
        df = self.df.filter(keep).withColumn(idx(c.dim), new)
        return self._with(df, coords=self.coords | others | {name: moved or c.slice(slice(0, 0))}, extents=self.extents | {c.dim: offset})

    def _sel_column(self, c: C.Column, at, method, endpoint) -> LabeledFrame:
        x = F.col(c.column)
        if isinstance(at, slice):
            keep = F.lit(True)
            if at.start is not None:
                keep &= x >= F.lit(C.parse_label(at.start, c.time))
            if at.stop is not None:
                stop = F.lit(C.parse_label(at.stop, c.time))
                keep &= x <= stop if endpoint else x < stop
            return self._with(self.df.filter(keep))
        v = F.lit(C.parse_label(at, c.time))
        if method is None:
            return self._with(self.df.filter(x == v))
        if method not in ("ffill", "bfill", "nearest"):
            raise ValueError(f"method must be nearest, ffill or bfill, not {method}")
        best = {"ffill": F.max(F.when(x <= v, x)), "bfill": F.min(F.when(x >= v, x)), "nearest": F.min(F.struct(F.abs(x - v).alias("d"), x.alias("x")))["x"]}[method]
        found = self.df.agg(best.alias("x")).first()["x"]
        if found is None:
            raise KeyError(at)
        return self._with(self.df.filter(x == F.lit(found)))

    @property
    def loc(self):
        return _Loc(self)

    def __getitem__(self, key):
        if isinstance(key, str):
            return self.coords[key]
        if isinstance(key, dict):
            return self.isel(key)
        key = key if isinstance(key, tuple) else (key,)
        if Ellipsis in key:
            at = key.index(Ellipsis)
            key = (*key[:at], *[slice(None)] * (self.ndim - len(key) + 1), *key[at + 1 :])
        return self.isel(dict(zip(self.dims, key)))

    def where_set(self, indexers: dict, value) -> LabeledFrame:
        """Values replaced in a positional region."""
        keep = F.lit(True)
        for dim, at in indexers.items():
            i, n = F.col(idx(self.axis(dim))), self.size(dim)
            if isinstance(at, slice):
                r = range(*at.indices(n))
                keep &= (i >= r.start) & (i < r.stop) & ((i - r.start) % r.step == 0)
            else:
                keep &= i == (at if at >= 0 else at + n)
        return self._with(self.df.withColumn(self.value, F.when(keep, F.lit(value)).otherwise(F.col(self.value))))

    def coord_frame(self, name: str) -> DataFrame:
        """A coordinate as index and label rows."""
        c = self.coords[name]
        if isinstance(c, C.Column):
            return self.df.select(idx(c.dim), F.col(c.column).alias(name)).distinct()
        rows = self.df.sparkSession.range(c.size).select(F.col("id").alias(idx(c.dim)))
        return with_label(rows, c, name)

    # -- element-wise --------------------------------------------------------------
    def apply(self, f: Callable[[SparkColumn], SparkColumn]) -> LabeledFrame:
        return self._with(self.df.withColumn(self.value, f(F.col(self.value))), name=None, attrs={})

    def __add__(self, o): return binary(lambda a, b: a + b, self, o)
    def __radd__(self, o): return binary(lambda a, b: b + a, self, o)
    def __sub__(self, o): return binary(lambda a, b: a - b, self, o)
    def __rsub__(self, o): return binary(lambda a, b: b - a, self, o)
    def __mul__(self, o): return binary(lambda a, b: a * b, self, o)
    def __rmul__(self, o): return binary(lambda a, b: b * a, self, o)
    def __truediv__(self, o): return binary(divide, self, o)
    def __rtruediv__(self, o): return binary(lambda a, b: divide(b, a), self, o)
    def __floordiv__(self, o): return binary(_named("floor_divide"), self, o)
    def __rfloordiv__(self, o): return binary(_named("floor_divide", True), self, o)
    def __mod__(self, o): return binary(_named("mod"), self, o)
    def __rmod__(self, o): return binary(_named("mod", True), self, o)
    def __pow__(self, o): return binary(lambda a, b: F.pow(a, b), self, o)
    def __rpow__(self, o): return binary(lambda a, b: F.pow(b, a), self, o)
    def __and__(self, o): return binary(_either("&", "bitwise_and"), self, o)
    def __or__(self, o): return binary(_either("|", "bitwise_or"), self, o)
    def __xor__(self, o): return binary(_either("^", "bitwise_xor"), self, o)
    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__
    def __invert__(self): return self.apply((lambda x: ~x) if self.dtype == "boolean" else F.bitwise_not)
    def __lshift__(self, o): return binary(_named("left_shift"), self, o)
    def __rshift__(self, o): return binary(_named("right_shift"), self, o)
    def __eq__(self, o): return binary(_named("equal") if self.dtype in ("double", "float") else lambda a, b: a == b, self, o)
    def __ne__(self, o): return binary(_named("not_equal") if self.dtype in ("double", "float") else lambda a, b: a != b, self, o)
    __hash__ = object.__hash__
    def __pos__(self): return self.apply(lambda x: x)
    def __divmod__(self, o): return self // o, self % o
    def __neg__(self): return self.apply(lambda x: -x)
    def __abs__(self): return self.apply(F.abs)
    def __lt__(self, o): return binary(lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a < b), self, o)
    def __le__(self, o): return binary(lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a <= b), self, o)
    def __gt__(self, o): return binary(lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a > b), self, o)
    def __ge__(self, o): return binary(lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a >= b), self, o)

    # -- reductions ------------------------------------------------------------------
    def reduce(self, how: str, dim: str | None = None, **options) -> LabeledFrame:
        from .reductions import reduce_frame

        return reduce_frame(self, how, dim, **options)

    def __getattr__(self, name: str):
        from .reductions import REDUCTIONS

        if name in REDUCTIONS:
            return lambda dim=None, **options: self.reduce(name, dim, **options)
        raise AttributeError(name)


def _named(name: str, turned: bool = False) -> Callable:
    """An element-wise function by name, its arguments as they are or turned round."""
    def call(a, b):
        from .functions.elementwise import BINARY

        return BINARY[name](b, a) if turned else BINARY[name](a, b)

    return call


def _either(sign: str, bitwise: str) -> Callable:
    """A logical operator on conditions, a bitwise one on whole numbers."""
    def call(a, b, logical=False):
        if not logical:
            return _named(bitwise)(a, b)
        return a & b if sign == "&" else a | b if sign == "|" else a != b

    call.on_conditions = lambda a, b: call(a, b, True)
    return call


def with_segment(df: DataFrame, index: str, cuts: list[int], number: str, start: str) -> DataFrame:
    """Add the number of the segment [cuts[k], cuts[k + 1]) that an index lies in, and its first index."""
    if len(cuts) <= WRITTEN_PIECES:
        at = F.array_size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts[:-1]]), lambda c: c <= F.col(index))) - 1
        return df.withColumn(number, at.cast("long")).withColumn(start, F.get(F.array(*[F.lit(int(c)).cast("long") for c in cuts[:-1]]), F.col(number).cast("int")))
    width = max(1, cuts[-1] // (4 * len(cuts)))
    rows = [(part, k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a for part in range(a // width, (b - 1) // width + 1)]
    table = df.sparkSession.createDataFrame(rows, f"__part long, `{number}` long, `{start}` long, __end long")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    on = (F.expr(f"`{index}` div {width}") == F.col("__part")) & (F.col(index) >= F.col(start)) & (F.col(index) < F.col("__end"))
    return df.join(table, on).drop("__part", "__end")


def with_label(df: DataFrame, c: C.Coordinate, name: str) -> DataFrame:
    """Add the labels of a coordinate; long descriptors are joined on parts of the index."""
    pieces = None if c.dim is None else c.pieces(WRITTEN_PIECES)
    if pieces is None:
        return df.withColumn(name, c.expr(F.col(idx(c.dim)) if c.dim else None))
    width = max(1, c.size // (4 * len(pieces)))
    rows = [(part, *p) for p in pieces for part in range(p[0] // width, (p[1] - 1) // width + 1)]  # some five a piece
    kind = "string" if isinstance(pieces[0][2], str) else "long" if isinstance(pieces[0][2], int) else "double"
    step = "double" if isinstance(c, C.Interp) else kind
    table = df.sparkSession.createDataFrame(rows, f"__part long, __i0 long, __i1 long, __v0 {kind}, __step {step}")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    i = F.col(idx(c.dim))
    on = (F.expr(f"`{idx(c.dim)}` div {width}") == F.col("__part")) & (i >= F.col("__i0")) & (i < F.col("__i1"))
    joined = df.join(table, on, "left")
    if kind == "string":
        label = F.col("__v0")
    else:
        moved = (i - F.col("__i0")) * F.col("__step")
        label = F.col("__v0") + (F.round(moved).cast("long") if isinstance(c, C.Interp) and c.time else moved)
    return joined.withColumn(name, label).drop("__part", "__i0", "__i1", "__v0", "__step")


class _Loc:
    def __init__(self, frame: LabeledFrame):
        self.frame = frame

    def __getitem__(self, key):
        return self.frame.sel(key if isinstance(key, dict) else dict(zip(self.frame.dims, key if isinstance(key, tuple) else (key,))))


def divide(a: SparkColumn, b: SparkColumn) -> SparkColumn:
    """Division as floating point has it: x/0 is infinite, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) == (b.cast("string") != "-0.0"), F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def align(a: LabeledFrame, b: LabeledFrame) -> tuple[str, ...]:
    """The union of dims in order of appearance; shared labels must be equal."""
    for k in a.coords.keys() & b.coords.keys():
        if a.coords[k].dim is not None and not a.coords[k].equals(b.coords[k]):
            raise ValueError(f"coordinates {k} differ")
    return (*a.dims, *[d for d in b.dims if d not in a.dims])


def binary(f: Callable, a: LabeledFrame, b, where: SparkColumn | None = None) -> LabeledFrame:
    """f over two frames, joined on their shared dims and broadcast along the others.

    Without a shared dim the smaller one must be a single value (a full
    reduction), which is joined as a constant.
    """
    f = getattr(f, "on_conditions", f) if a.dtype == "boolean" else f
    if not isinstance(b, LabeledFrame):
        other = F.lit(b)
        return a.apply(lambda x: f(x, other))
    dims = align(a, b)
    shared = [idx(d) for d in a.dims if d in b.dims]
    left = a.df.select(*[idx(d) for d in a.dims], F.col(a.value).alias("__a"))
    right = b.df.select(*[idx(d) for d in b.dims], F.col(b.value).alias("__b"))
    if shared:
        joined = left.join(right, shared)
    elif not b.dims or not a.dims:
        one, many = (right, left) if not b.dims else (left, right)
        joined = many.withColumn("__k", F.lit(0)).join(F.broadcast(one.withColumn("__k", F.lit(0))), "__k").drop("__k")  # a single row
    else:
        joined = _outer(left, right)
    df = joined.select(*[idx(d) for d in dims], f(F.col("__a"), F.col("__b")).alias("value"))
    coords = {k: c for k, c in (b.coords | a.coords).items() if c.dim is not None and not isinstance(c, C.Column)}
    return LabeledFrame(df, dims, coords, extents=b.extents | a.extents)


def _outer(left: DataFrame, right: DataFrame, parts: int = 64) -> DataFrame:
    """Every cell with every cell, which is what an outer product is.

    A side that is counted to be small goes along as one list; else both
    sides are cut into parts and each pair of parts is one key of an equi-join.
    """
    for many, few in ((left, right), (right, left)):
        if few.limit(OUTER_ROWS + 1).count() <= OUTER_ROWS:
            held = few.agg(F.collect_list(F.struct(*few.columns)).alias("__few")).withColumn("__k", F.lit(0))  # one bounded row
            both = many.withColumn("__k", F.lit(0)).join(F.broadcast(held), "__k")
            return both.select(*many.columns, F.explode("__few").alias("__f")).select(*many.columns, *[F.col(f"__f.{c}").alias(c) for c in few.columns])
    each = F.explode(F.expr(f"sequence(0, {parts - 1})"))
    cut = lambda df: F.expr(f"cast(pmod(xxhash64({', '.join(f'`{c}`' for c in df.columns)}), {parts}) as int)")
    a = left.withColumn("__p", cut(left)).withColumn("__q", each)
    b = right.withColumn("__q", cut(right)).withColumn("__p", each)
    return a.join(b, ["__p", "__q"]).drop("__p", "__q")


def choose(cond: Callable[[SparkColumn], SparkColumn], f: Callable, a: LabeledFrame, otherwise: float = NAN) -> LabeledFrame:
    """A ufunc with ``where``: f where the condition holds, else a fixed value."""
    return a.apply(lambda x: F.when(cond(x), f(x)).otherwise(F.lit(otherwise)))


# -- collections -------------------------------------------------------------------------
@dataclass(frozen=True)
class Collection:
    """Frames with one schema, told apart by field columns (strings for mappings, ints for sequences)."""

    df: DataFrame
    fields: tuple[str, ...]

    def query(self, **wanted) -> Collection:
        """Fields by pattern (``*``, ``?``, ``[...]``), number or slice; every named level is filtered."""
        df = self.df
        for name, w in wanted.items():
            if name not in self.fields:
                continue
            c = F.col(name)
            if isinstance(w, slice):
                df = df.filter((c >= (w.start or 0)) & (c < w.stop if w.stop is not None else F.lit(True)))
            elif isinstance(w, int):
                df = df.filter(c == w)
            elif any(s in w for s in "*?["):
                df = df.filter(c.rlike(_glob(w)))
            else:
                df = df.filter(c == w)
        return Collection(df, self.fields)

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Collection:
        return Collection(self.df.transform(f), self.fields)

    def union(self, other: Collection) -> Collection:
        """By fields; levels must be the same."""
        if self.fields != other.fields:
            raise ValueError("collections of different levels")
        return Collection(self.df.unionByName(other.df), self.fields)

    def save(self, folder: str) -> None:
        self.df.write.mode("overwrite").partitionBy(*self.fields).parquet(folder)

    @classmethod
    def open(cls, spark, folder: str, fields: tuple[str, ...]) -> Collection:
        return cls(spark.read.parquet(folder), fields)


def _glob(pattern: str) -> str:
    import re
    from fnmatch import translate

    body = translate(pattern)
    return "^" + re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", body) + "$"


def save_frame(frame: LabeledFrame, folder: str, mode: str = "overwrite", partition: list[str] | None = None, codec: str = "zstd") -> None:
    """The native format: Parquet in ``data`` and the descriptor as JSON in ``frame``."""
    writer = frame.df.write.mode(mode).option("compression", codec)
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{folder}/data")
    spark = frame.df.sparkSession
    spark.createDataFrame([(json.dumps(frame.describe()),)], "frame string").coalesce(1).write.mode("overwrite").json(f"{folder}/frame")


def open_frame(spark, folder: str) -> LabeledFrame:
    d = json.loads(spark.read.schema("frame string").json(f"{folder}/frame").first()["frame"])
    df = spark.read.parquet(f"{folder}/data")
    return LabeledFrame(df, tuple(d["dims"]), {k: C.from_dict(v) for k, v in d["coords"].items()}, d["name"], d["attrs"], d["value"])
