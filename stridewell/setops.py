"""Putting frames together and taking them apart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coords as C
from .frame import LabeledFrame, idx


def _first(f: LabeledFrame, dim: str):
    c = f.coords.get(dim)
    if c is None or isinstance(c, C.Default) or c.size < 1:
        return None
    return c.value if isinstance(c, C.Scalar) else c.start


def concat(frames: Sequence[LabeledFrame], dim: str = "first", tolerance=None, strict: bool = False) -> LabeledFrame:
    """Append along a dimension, in order of first labels; a new one is made of scalars.

    Empty frames are left out.  Other coordinates are those of the first; with
    ``strict`` they must be equal in all.  ``tolerance`` joins segments (False:
    none are).
    """
    frames = [f for f in frames if not (dim in f.dims and f.size(dim) == 0)] or list(frames[:1])
    dim = {"first": frames[0].dims[0], "last": frames[0].dims[-1]}.get(dim, dim)
    if dim not in frames[0].dims:
        frames = [f.expand_dims(dim) for f in frames]
    firsts = [_first(f, dim) for f in frames]
    if all(x is not None for x in firsts):
        frames = [frames[k] for k in sorted(range(len(frames)), key=lambda k: firsts[k])]
    head = frames[0]
    for f in frames[1:]:
        if f.dims != head.dims:
            raise ValueError("frames have different dims")
        if strict and not all(c.equals(f.coords[k]) for k, c in head.coords.items() if c.dim != dim):
            raise ValueError("other coordinates differ")
    offset, parts, along = 0, [], {k: c for k, c in head.coords.items() if c.dim == dim}
    columns = [*[idx(d) for d in head.dims], head.value]
    for n, f in enumerate(frames):
        parts.append(f.df.select(*columns).withColumn(idx(dim), F.col(idx(dim)) + offset))
        offset += f.size(dim)
        if n:
            along = {k: c.concat(f.coords[k]) for k, c in along.items()}
    if tolerance is not False:
        along = {k: c.simplify(tolerance) if hasattr(c, "simplify") else c for k, c in along.items()}
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return head._with(df, coords=head.coords | along, extents=head.extents | {dim: offset})


def _compatible(a: LabeledFrame, b: LabeledFrame, dim: str) -> bool:
    if a.dims != b.dims or a.dtype != b.dtype or any(a.size(d) != b.size(d) for d in a.dims if d != dim):
        return False
    if a.coords.keys() != b.coords.keys() or not all(c.equals(b.coords[k]) for k, c in a.coords.items() if c.dim not in (dim, None)):
        return False
    sa, sb = (f.coords[dim].sampling_interval() if dim in f.coords else None for f in (a, b))
    return sa is None or sb is None or bool(np.isclose(sa, sb))


def combine_by_coords(frames: Sequence[LabeledFrame], dim: str = "first", tolerance=None, squeeze: bool = True):
    """Sort by first label and append runs of compatible frames; a new run begins at each change."""
    name = {"first": frames[0].dims[0], "last": frames[0].dims[-1]}.get(dim, dim)
    if name not in frames[0].dims:
        out = [concat(frames, name, tolerance)]
    else:
        ordered = sorted(frames, key=lambda f: (_first(f, name) is None, _first(f, name) or 0))
        bags: list[list[LabeledFrame]] = []
        for f in ordered:
            if bags and _compatible(bags[-1][-1], f, name):
                bags[-1].append(f)
            else:
                bags.append([f])
        out = [concat(bag, name, tolerance) for bag in bags]
    return out[0] if squeeze and len(out) == 1 else out


def combine_bags(files: DataFrame, signature: Sequence[str], start: str, group: Sequence[str] = ()) -> DataFrame:
    """The same over a table of file metadata: bag numbers by change of signature along ``start``."""
    w = Window.partitionBy(*group).orderBy(start)
    mark = F.struct(*signature)
    change = F.coalesce((mark != F.lag(mark).over(w)).cast("int"), F.lit(0))
    return files.withColumn("__c", change).withColumn("bag", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def combine_by_field(nodes: Sequence[dict | list | LabeledFrame], dim: str = "first", tolerance=None):
    """Union of nested mappings by key and of sequences by place; leaves are combined by coordinates."""
    kinds = {type(n) for n in nodes}
    if len(kinds) > 1:
        raise ValueError("nodes and leaves can't be combined")
    if isinstance(nodes[0], dict):
        keys = list(dict.fromkeys(k for n in nodes for k in n))
        return {k: combine_by_field([n[k] for n in nodes if k in n], dim, tolerance) for k in keys}
    if isinstance(nodes[0], list):
        return combine_by_coords([f for n in nodes for f in n], dim, tolerance, squeeze=False)
    return combine_by_coords(nodes, dim, tolerance)


def split(f: LabeledFrame, by="discontinuities", dim: str = "first", tolerance=None) -> list[LabeledFrame]:
    """Parts of a frame: into N (the first ones one longer), at indices, or at gaps, overlaps or both."""
    dim = f.axis(dim)
    n = f.size(dim)
    if isinstance(by, str):
        cuts = f.coords[dim].split_indices(by, tolerance).tolist()
    elif isinstance(by, int):
        sizes = [n // by + (k < n % by) for k in range(by)]
        cuts = np.cumsum(sizes)[:-1].tolist()
    else:
        cuts = list(by)
    edges = [0, *cuts, n]
    return [f.isel({dim: slice(a, b)}) for a, b in zip(edges, edges[1:])]
