"""Element-wise functions with NumPy's results on Spark columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NAN = float("nan")


def _nan_if(cond: Column, x: Column) -> Column:
    return F.when(cond, F.lit(NAN)).otherwise(x)


def _log(f: Callable[[Column], Column], at_zero: float = -math.inf, low: float = 0.0) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (x < low), F.lit(NAN)).when(x == low, F.lit(at_zero)).otherwise(f(x))


def whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding to whole numbers as doubles: NaN, infinities and what has no digits after the point stay."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x.cast("double")).otherwise(f(x).cast("double"))


floor, ceil = whole(F.floor), whole(F.ceil)
fix = whole(lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NaN of infinities and by zero."""
    a, b = a.cast("double"), b.cast("double")
    undefined = F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == math.inf)
    rest = a % F.when(b != 0, b)
    by_infinity = F.when((a == 0) | ((a > 0) == (b > 0)), a).otherwise(b)
    finite = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    return F.when(undefined, F.lit(NAN)).when(F.abs(b) == math.inf, by_infinity).otherwise(finite)


def floor_divide(a: Column, b: Column) -> Column:
    from ..frame import divide

    a, b = a.cast("double"), b.cast("double")
    undefined = F.isnan(a) | F.isnan(b) | (F.abs(a) == math.inf)
    exact = (a - mod(a, b)) / F.when(b != 0, b)  # whole but for rounding
    by_infinity = F.when((a == 0) | ((a > 0) == (b > 0)), F.lit(0.0)).otherwise(F.lit(-1.0))
    return F.when(b == 0, divide(a, b)).when(undefined, F.lit(NAN)).when(F.abs(b) == math.inf, by_infinity).otherwise(F.rint(exact))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    y = x if lo is None else F.greatest(x, F.lit(float(lo)))
    return _nan_if(F.isnan(x), y if hi is None else F.least(y, F.lit(float(hi))))


def nan_to_num(x: Column, nan: float = 0.0) -> Column:
    big = 1.7976931348623157e308
    return F.when(F.isnan(x), F.lit(nan)).when(x == math.inf, F.lit(big)).when(x == -math.inf, F.lit(-big)).otherwise(x)


def sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(math.pi * x) / (F.when(x != 0, x) * math.pi))


def sign(x: Column) -> Column:
    return _nan_if(F.isnan(x), F.signum(x))


@F.pandas_udf(DoubleType())
def i0(x: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(np.i0(x.to_numpy()))


# complex values are structs of re and im
def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def conj(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def absolute(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def real_if_close(frame, tol: float = 100.0):
    """The real parts of a complex frame if all imaginary ones are within ``tol`` epsilons; else the frame."""
    im = F.col(frame.value)["im"]
    close = frame.df.agg(F.coalesce(F.bool_and(F.abs(im) < tol * 2.220446049250313e-16), F.lit(True))).first()[0]
    return frame.apply(real) if close else frame


UNARY: dict[str, Callable[[Column], Column]] = {
    "absolute": F.abs, "fabs": F.abs, "negative": lambda x: -x, "positive": lambda x: x, "square": lambda x: x * x,
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "expm1": F.expm1,
    "log": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10), "log1p": _log(F.log1p, low=-1.0),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh,
    "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "degrees": F.degrees, "radians": F.radians,
    "sign": sign, "rint": F.rint, "floor": floor, "ceil": ceil,
    "trunc": fix, "fix": fix, "around": lambda x: F.bround(x, 0), "round": lambda x: F.bround(x, 0), "nan_to_num": nan_to_num, "sinc": sinc,
    "isnan": F.isnan, "isinf": lambda x: F.abs(x) == math.inf, "isfinite": lambda x: ~F.isnan(x) & (F.abs(x) != math.inf),
    "signbit": lambda x: (x < 0) | (x.cast("string") == "-0.0"), "logical_not": lambda x: x == 0, "i0": i0, "invert": lambda x: F.bitwise_not(x),
    "reciprocal": lambda x: F.when(x == 0, F.lit(math.inf)).otherwise(1 / F.when(x != 0, x)),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "power": F.pow,
    "maximum": lambda a, b: _nan_if(F.isnan(a) | F.isnan(b), F.greatest(a, b)), "minimum": lambda a, b: _nan_if(F.isnan(a) | F.isnan(b), F.least(a, b)),
    "fmax": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)),
    "fmin": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b)),
    "arctan2": F.atan2, "hypot": F.hypot,
    "greater": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a > b), "less": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a < b),
    "equal": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a == b), "not_equal": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    "logical_and": lambda a, b: (a != 0) & (b != 0), "logical_or": lambda a, b: (a != 0) | (b != 0), "logical_xor": lambda a, b: (a != 0) != (b != 0),
    "mod": mod, "remainder": mod, "floor_divide": floor_divide, "fmod": lambda a, b: F.when((b == 0) | (F.abs(a) == math.inf), F.lit(NAN)).otherwise(a % F.when(b != 0, b)),
    "copysign": lambda a, b: F.when(UNARY["signbit"](b), -F.abs(a)).otherwise(F.abs(a)), "float_power": F.pow,
    "less_equal": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a <= b), "greater_equal": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a >= b),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "left_shift": lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")),
    "right_shift": lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")),
}


def divmod_(a: Column, b: Column) -> tuple[Column, Column]:
    """Floor quotient and remainder, with the sign of the divisor."""
    return floor_divide(a, b), mod(a, b)


def modf(x: Column) -> tuple[Column, Column]:
    return F.when(F.abs(x) == math.inf, F.lit(0.0)).otherwise(x - fix(x)), fix(x)


def frexp(x: Column) -> tuple[Column, Column]:
    """Mantissa in [0.5, 1) and exponent."""
    e = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(F.when(x != 0, x)))) + 1).cast("int")
    return x / F.pow(F.lit(2.0), e), e
