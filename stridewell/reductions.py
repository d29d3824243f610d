"""Reductions over a dimension or over all of them, with NaN rules.

``skipna`` leaves NaN out; a lane of NaN alone gives NaN (0 for sum, 1 for
prod, null for the places of extremes).  Without it NaN wins.  All are
aggregates that combine on the map side, except the exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def _floor_nan(agg: Column, x: Column, skipna: bool) -> Column:
    if skipna:
        return F.coalesce(agg, F.lit(NAN))
    return F.when(F.bool_or(F.isnan(x)), F.lit(NAN)).otherwise(agg)


def expression(how: str, x: Column, place: Column, *, skipna: bool = True, q: float | None = None, ddof: int = 0, weights: Column | None = None) -> Column:
    """The aggregate of values ``x`` at ``place`` (a long: index, or flat index)."""
    known = F.when(~F.isnan(x), x) if skipna else x
    if how == "all":
        return F.coalesce(F.bool_and(x != 0), F.lit(True))
    if how == "any":
        return F.coalesce(F.bool_or(x != 0), F.lit(False))
    if how in ("max", "min"):
        return _floor_nan(getattr(F, how)(known), x, skipna)
    if how in ("argmax", "argmin"):
        if not skipna:  # the first NaN wins
            first_nan = F.min(F.when(F.isnan(x), place))
            return F.coalesce(first_nan, expression(how, x, place))
        pair = F.struct(known.alias("v"), (-place if how == "argmax" else place).alias("p"))
        pair = F.when(known.isNotNull(), pair)
        return -F.max(pair)["p"] if how == "argmax" else F.min(pair)["p"]
    if how == "median":
        return _floor_nan(F.median(known), x, skipna)
    if how in ("percentile", "quantile"):
        return _floor_nan(F.percentile(known, q / 100 if how == "percentile" else q), x, skipna)
    if how == "ptp":
        return _floor_nan(F.max(x) - F.min(x), x, False)
    if how == "mean":
        return _floor_nan(F.avg(known), x, skipna)
    if how == "prod":
        return F.coalesce(F.product(known), F.lit(1.0))
    if how in ("std", "var"):
        name = {("std", 0): "stddev_pop", ("std", 1): "stddev_samp", ("var", 0): "var_pop", ("var", 1): "var_samp"}[how, ddof]
        return _floor_nan(getattr(F, name)(known), x, skipna)
    if how == "sum":
        return F.coalesce(F.sum(known), F.lit(0.0))
    if how == "average":
        w = F.lit(1.0) if weights is None else weights
        return F.sum(w * x) / F.sum(w)
    if how == "count_nonzero":
        return F.count_if(x != 0)
    raise ValueError(how)


REDUCTIONS = [
    "all", "any", "max", "min", "argmax", "argmin", "median", "percentile", "quantile", "ptp", "mean", "prod", "std", "var", "sum", "average", "count_nonzero",
]


def reduce_frame(frame, how: str, dim: str | None = None, **options):
    """``how`` over ``dim``, which goes, or over everything."""
    from .frame import idx

    x = F.col(frame.value)
    if dim is None:
        place, sizes = F.lit(0).cast("long"), None
        if how.startswith("arg"):
            sizes = frame.sizes
            for d in frame.dims:
                place = place * sizes[d] + F.col(idx(d))
        df: DataFrame = frame.df.agg(expression(how, x, place, **options).alias("value"))
        return frame._with(df, dims=(), coords={k: c for k, c in frame.coords.items() if c.dim is None}, value="value", extents={})
    dim = frame.axis(dim)
    df = frame.df.groupBy(*frame.lanes(dim)).agg(expression(how, x, F.col(idx(dim)), **options).alias("value"))
    coords = {k: c for k, c in frame.coords.items() if c.dim != dim}
    extents = {d: n for d, n in frame.extents.items() if d != dim}
    return frame._with(df, dims=tuple(d for d in frame.dims if d != dim), coords=coords, value="value", extents=extents)
