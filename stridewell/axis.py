"""Operations along one axis, as windows over the other axes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import coords as C
from .frame import LabeledFrame, idx


def _window(f: LabeledFrame, dim: str):
    return Window.partitionBy(*f.lanes(dim)).orderBy(idx(dim))


def _step(f: LabeledFrame, dim: str) -> float:
    c = f.coords.get(dim)
    return c.sampling_interval() if c is not None and not isinstance(c, C.Column) else 1.0


def _moved(f: LabeledFrame, dim: str, how) -> dict:
    return {k: how(c) if c.dim == dim and not isinstance(c, C.Column) else c for k, c in f.coords.items()}


def cumsum(f: LabeledFrame, dim: str = "last", skipna: bool = True, block: int | None = None) -> LabeledFrame:
    """Running sum.  With ``block``, long lanes are summed in blocks of that many
    samples and only the blocks' totals run through one window."""
    dim = f.axis(dim)
    x = F.col(f.value)
    x = F.when(F.isnan(x), 0.0).otherwise(x) if skipna else x
    if not block:
        w = _window(f, dim).rowsBetween(Window.unboundedPreceding, 0)
        return f._with(f.df.withColumn(f.value, F.sum(x).over(w)))
    lanes = f.lanes(dim)
    df = f.df.withColumn("__b", F.expr(f"{idx(dim)} div {block}"))
    totals = df.groupBy(*lanes, "__b").agg(F.sum(x).alias("__t"))
    before = Window.partitionBy(*lanes).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*lanes, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__o"))
    inner = Window.partitionBy(*lanes, "__b").orderBy(idx(dim)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__s", F.sum(x).over(inner)).join(totals, [*lanes, "__b"])
    return f._with(df.withColumn(f.value, F.col("__s") + F.col("__o")).drop("__s", "__o", "__b"))


def cumprod(f: LabeledFrame, dim: str = "last", skipna: bool = True) -> LabeledFrame:
    dim = f.axis(dim)
    x = F.col(f.value)
    x = F.when(F.isnan(x), 1.0).otherwise(x) if skipna else x
    w = _window(f, dim).rowsBetween(Window.unboundedPreceding, 0)
    return f._with(f.df.withColumn(f.value, F.product(x).over(w)))


def diff(f: LabeledFrame, dim: str = "last", n: int = 1, label: str = "upper") -> LabeledFrame:
    """n-th difference; labels of the upper or the lower sample."""
    dim = f.axis(dim)
    out = f
    for _ in range(n):
        w = _window(out, dim)
        i = F.col(idx(dim))
        d = F.col(out.value) - F.lag(out.value).over(w)
        df = out.df.withColumn("__d", d).filter(i > 0).withColumn(out.value, F.col("__d")).drop("__d").withColumn(idx(dim), i - 1)
        cut = slice(1, None) if label == "upper" else slice(0, -1)
        out = out._with(df, coords=_moved(out, dim, lambda c: c.slice(cut)), extents={d_: n_ - (d_ == dim) for d_, n_ in out.extents.items()})  # noqa: B023
    return out


def integrate(f: LabeledFrame, dim: str = "last", midpoints: bool = False) -> LabeledFrame:
    """Rectangle rule: running sum times the step."""
    dim = f.axis(dim)
    d = _step(f, dim)
    out = cumsum(f, dim, skipna=False).apply(lambda x: x * d)
    half = d / 2 * (C.NS if dim in f.coords and f.coords[dim].is_time else 1)
    return out._with(out.df, coords=_moved(out, dim, lambda c: c.shift(int(half) if c.is_time else half)) if midpoints else out.coords)


def differentiate(f: LabeledFrame, dim: str = "last", midpoints: bool = False) -> LabeledFrame:
    dim = f.axis(dim)
    d = _step(f, dim)
    out = diff(f, dim, label="lower").apply(lambda x: x / d)
    half = d / 2 * (C.NS if dim in f.coords and f.coords[dim].is_time else 1)
    return out._with(out.df, coords=_moved(out, dim, lambda c: c.shift(int(half) if c.is_time else half)) if midpoints else out.coords)


def detrend(f: LabeledFrame, kind: str = "linear", dim: str = "last") -> LabeledFrame:
    dim = f.axis(dim)
    x, i = F.col(f.value), F.col(idx(dim)).cast("double")
    w = Window.partitionBy(*f.lanes(dim))
    if kind == "constant":
        return f._with(f.df.withColumn(f.value, x - F.avg(x).over(w)))
    slope = F.covar_pop(i, x).over(w) / F.var_pop(i).over(w)
    return f._with(f.df.withColumn(f.value, x - F.avg(x).over(w) - F.coalesce(slope, F.lit(0.0)) * (i - F.avg(i).over(w))))


def window_expr(name: str, k: Column, n, periodic: bool = False) -> Column:
    """Weight k of a window of n: closed forms that stay in the JVM."""
    m = n if periodic else n - 1
    m = m if isinstance(m, Column) else F.lit(float(m))
    phase = 2 * math.pi * k / F.when(m > 0, m)
    cosines = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08)}
    if name == "boxcar":
        return F.lit(1.0)
    if name in ("bartlett", "triang"):
        return 1 - F.abs(2 * k / F.when(m > 0, m) - 1)
    if name == "cosine":
        return F.sin(math.pi * (k + 0.5) / (m + 1))
    terms = cosines[name]
    out = F.lit(terms[0])
    for j, a in enumerate(terms[1:], 1):
        out = out - (-1) ** (j + 1) * a * F.cos(j * phase)
    return F.coalesce(out, F.lit(1.0))


def taper(f: LabeledFrame, window: str = "hann", periodic: bool = False, dim: str = "last") -> LabeledFrame:
    dim = f.axis(dim)
    return f._with(f.df.withColumn(f.value, F.col(f.value) * window_expr(window, F.col(idx(dim)), f.size(dim), periodic)))


def segment_mean_removal(f: LabeledFrame, limits: Sequence[int], window: str = "hann", dim: str = "last") -> LabeledFrame:
    """Subtract each segment's weighted mean; segments are [limits[k], limits[k+1])."""
    dim = f.axis(dim)
    i, x = F.col(idx(dim)), F.col(f.value)
    seg, lo, hi = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (a, b) in enumerate(zip(limits, limits[1:])):
        inside = (i >= a) & (i < b)
        seg, lo, hi = F.when(inside, k).otherwise(seg), F.when(inside, a).otherwise(lo), F.when(inside, b).otherwise(hi)
    w = window_expr(window, i - lo, (hi - lo).cast("double"), periodic=True)
    over = Window.partitionBy(*f.lanes(dim), "__seg")
    df = f.df.withColumn("__seg", seg).withColumn("__w", w)
    mean = F.sum(x * F.col("__w")).over(over) / F.sum("__w").over(over)
    return f._with(df.withColumn(f.value, F.when(F.col("__seg").isNull(), x).otherwise(x - mean)).drop("__seg", "__w"))


def _reflected(f: LabeledFrame, dim: str, k: int, mode: str = "reflect"):
    """Rows of the lanes with k mirrored (or zero) samples on both ends."""
    n, i = f.size(dim), idx(dim)
    if mode == "reflect" and k >= n:
        raise ValueError("the window is longer than the axis")
    left = f.df.filter((F.col(i) >= 1) & (F.col(i) <= k)).withColumn(i, -F.col(i))
    right = f.df.filter((F.col(i) >= n - 1 - k) & (F.col(i) <= n - 2)).withColumn(i, 2 * (n - 1) - F.col(i))
    if mode == "zero":
        left, right = (x.withColumn(f.value, F.lit(0.0)) for x in (left, right))
    return f.df.unionByName(left).unionByName(right), n


def sliding_mean_removal(f: LabeledFrame, wlen: float, window: str = "hann", dim: str = "last") -> LabeledFrame:
    """Subtract a running weighted mean over ``wlen`` (label units), ends mirrored."""
    dim = f.axis(dim)
    n = round(wlen / _step(f, dim))
    n += n % 2 == 0
    k = n // 2
    rows, size = _reflected(f, dim, k)
    w = Window.partitionBy(*f.lanes(dim)).orderBy(idx(dim))
    x = F.col(f.value)
    if window == "boxcar":
        mean = F.avg(x).over(w.rowsBetween(-k, k))
    else:
        from .dsp.design import get_window

        weights = get_window(window, n, periodic=False)
        near = F.collect_list(x).over(w.rowsBetween(-k, k))
        taps = F.array(*[F.lit(float(v)) for v in weights / weights.sum()])
        mean = F.aggregate(F.zip_with(near, taps, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    df = rows.withColumn("__m", mean).filter((F.col(idx(dim)) >= 0) & (F.col(idx(dim)) < size))
    return f._with(df.withColumn(f.value, x - F.col("__m")).drop("__m"))


def medfilt(f: LabeledFrame, kernel: dict[str, int]) -> LabeledFrame:
    """Running median over odd kernels, zeros beyond the ends; several dims at once."""
    kernel = {f.axis(d): k for d, k in kernel.items()}
    if any(k % 2 == 0 for k in kernel.values()):
        raise ValueError("kernel sizes must be odd")
    wide = [d for d, k in kernel.items() if k > 1]
    if len(wide) <= 1:  # one window a lane
        if not wide:
            return f
        (dim,) = wide
        reach = kernel[dim] // 2
        near = F.collect_list(F.col(f.value)).over(_window(f, dim).rowsBetween(-reach, reach))
        padded = F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), F.lit(kernel[dim]) - F.size(near))))
        return f._with(f.df.withColumn(f.value, F.get(padded, F.lit(reach))))
    # one window a dim: neighbours along the first, then the lists of neighbours along the next
    cells = math.prod(kernel.values())
    df = f.df.withColumn("__v", F.array(f.value))
    for d in wide:
        df = df.withColumn("__v", F.flatten(F.collect_list("__v").over(_window(f, d).rangeBetween(-(kernel[d] // 2), kernel[d] // 2))))
    padded = F.array_sort(F.concat("__v", F.array_repeat(F.lit(0.0), F.lit(cells) - F.size("__v"))))
    return f._with(df.withColumn(f.value, F.get(padded, F.lit(cells // 2))).drop("__v"))


def fir(f: LabeledFrame, taps: Sequence[float], dim: str = "last") -> LabeledFrame:
    """Causal FIR filter as a weighted sum of earlier samples (zeros before the start)."""
    dim = f.axis(dim)
    w, x = _window(f, dim), F.col(f.value)
    out = None
    for k, b in enumerate(taps):
        if b:
            term = F.lit(float(b)) * (x if k == 0 else F.coalesce(F.lag(x, k).over(w), F.lit(0.0)))
            out = term if out is None else out + term
    return f._with(f.df.withColumn(f.value, F.lit(0.0) if out is None else out))


def downsample(f: LabeledFrame, q: int, dim: str = "last") -> LabeledFrame:
    return f.isel({f.axis(dim): slice(None, None, q)})


def upsample(f: LabeledFrame, q: int, dim: str = "last", scale: bool = True) -> LabeledFrame:
    """q - 1 zeros after each sample; each segment of the axis gets its own finer step."""
    dim = f.axis(dim)
    i = F.col(idx(dim))
    df = f.df.withColumn("__k", F.explode(F.expr(f"sequence(0, {q - 1})")))
    value = F.when(F.col("__k") == 0, F.col(f.value) * (q if scale else 1)).otherwise(F.lit(0.0))
    df = df.withColumn(f.value, value).withColumn(idx(dim), i * q + F.col("__k")).drop("__k")

    def finer(c):
        if isinstance(c, C.Sampled):
            return C.Sampled(c.tie_values, c.tie_lengths * q, c.step / q if not c.is_time else c.step // q, c.dim, c.time)
        if isinstance(c, C.Interp):
            step = c.sampling_interval(cast=False) / q
            ties = np.append(c.tie_indices[:-1] * q, c.tie_indices[-1] * q + q - 1)
            end = c.tie_values[-1] + (q - 1) * step
            return C.Interp(ties, np.append(c.tie_values[:-1], int(end) if c.is_time else end), c.dim, c.time)
        return C.Default(c.size * q, c.dim)

    return f._with(df, coords=_moved(f, dim, finer), extents={d: n * (q if d == dim else 1) for d, n in f.extents.items()})


def ediff1d(f: LabeledFrame, to_begin: float | None = None, to_end: float | None = None) -> LabeledFrame:
    """Differences of neighbours of the flattened array (last dim fastest), with a value put before or after."""
    flat, n = F.lit(0), 1
    for d in reversed(f.dims):
        flat, n = flat + F.col(idx(d)) * n, n * f.size(d)
    rows = f.df.select(flat.cast("long").alias("k"), F.col(f.value).alias("v"))
    after = rows.select((F.col("k") - 1).alias("k"), F.col("v").alias("w"))
    first = 0 if to_begin is None else 1
    df = rows.join(after, "k").select((F.col("k") + first).alias(idx("flat")), (F.col("w") - F.col("v")).alias(f.value))
    ends = [(k, float(v)) for k, v in ((0, to_begin), (max(0, n - 1) + first, to_end)) if v is not None]
    if ends:
        df = df.unionByName(df.sparkSession.createDataFrame(ends, df.schema))
    return LabeledFrame(df, ("flat",), {}, value=f.value, extents={"flat": max(0, n - 1) + len(ends)})


def trapezoid(f: LabeledFrame, dim: str = "last") -> LabeledFrame:
    """Integral by the trapezoid rule with the axis' step."""
    dim = f.axis(dim)
    pair = (F.col(f.value) + F.lead(f.value).over(_window(f, dim))) / 2 * _step(f, dim)
    df = f.df.withColumn("__p", pair).groupBy(*f.lanes(dim)).agg(F.coalesce(F.sum("__p"), F.lit(0.0)).alias(f.value))
    return f._with(df, dims=tuple(d for d in f.dims if d != dim), coords={k: c for k, c in f.coords.items() if c.dim != dim})
