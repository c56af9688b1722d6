"""Scalar functions for user operators: column expressions where Spark has them, vectorised Python where it hasn't.

Integer functions work on longs and saturate or wrap at 32 bits as named. All take and return columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.pointwise import divide, mask, maximum, minimum, nan, remainder, sign

LOW, HIGH = -(2**31), 2**31 - 1


def _python(function: Callable[[float], float], edge: Callable[[float], float]):
    """A function of Python's math module in Arrow batches; ``edge`` answers where that raises."""

    def one(x: float) -> float:
        try:
            return function(x)
        except (ValueError, OverflowError):
            return edge(x)

    def op(x: Column) -> Column:
        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            return s.map(one, na_action="ignore").astype("float64")

        return run(x.cast("double"))

    return op


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x))


def _wrapped(x: Column) -> Column:
    return F.pmod(x + 2**31, F.lit(2**32)) - 2**31


def _logarithm(base: float):
    from ..operators.pointwise import logarithm

    return lambda x: logarithm(x) / math.log(base)


def _log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(F.when(x > -1, x))).when(x == -1, F.lit(float("-inf"))).otherwise(nan())


MATH: dict[str, Callable[..., Column]] = {
    "acos": F.acos, "acosh": F.acosh, "acospi": lambda x: F.acos(x) / math.pi, "asin": F.asin, "asinh": F.asinh, "asinpi": lambda x: F.asin(x) / math.pi,
    "atan": F.atan, "atan2": F.atan2, "atanh": F.atanh, "atanpi": lambda x: F.atan(x) / math.pi, "atan2pi": lambda y, x: F.atan2(y, x) / math.pi,
    "cbrt": F.cbrt, "ceil": lambda x: F.ceil(x).cast("double"), "copysign": lambda x, y: F.abs(x) * F.when(y < 0, -1.0).otherwise(1.0),
    "cos": F.cos, "cosh": F.cosh, "cospi": lambda x: F.cos(x * math.pi), "erf": _python(math.erf, lambda x: math.nan), "erfc": _python(math.erfc, lambda x: math.nan),
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "exp10": lambda x: F.pow(F.lit(10.0), x), "expm1": F.expm1, "fabs": F.abs,
    "fdim": lambda x, y: F.when(x > y, x - y).otherwise(0.0), "floor": lambda x: F.floor(x).cast("double"), "fma": lambda a, b, c: a * b + c, "fmax": maximum, "fmin": minimum, "fmod": remainder,
    "hypot": F.hypot, "lgamma": _python(math.lgamma, lambda x: math.inf), "log": _logarithm(math.e), "log2": _logarithm(2), "log10": _logarithm(10), "log1p": _log1p,
    "logb": _python(lambda x: float(math.frexp(x)[1] - 1) if x and math.isfinite(x) else (-math.inf if x == 0 else abs(x)), lambda x: math.nan),
    "mad": lambda a, b, c: a * b + c, "maxmag": lambda x, y: F.when(F.abs(x) > F.abs(y), x).when(F.abs(y) > F.abs(x), y).otherwise(maximum(x, y)), "minmag": lambda x, y: F.when(F.abs(x) < F.abs(y), x).when(F.abs(y) < F.abs(x), y).otherwise(minimum(x, y)),
    "nextafter": lambda x, y: _next_after(x, y), "pow": F.pow, "pown": F.pow, "powr": lambda x, y: F.when(x >= 0, F.pow(x, y)).otherwise(nan()),
    "remainder": lambda x, y: x - F.rint(divide(x, y)) * y, "rint": F.rint, "rootn": lambda x, n: sign(x) * F.pow(F.abs(x), divide(F.lit(1.0), n)), "round": lambda x: sign(x) * F.floor(F.abs(x) + 0.5),
    "rsqrt": lambda x: divide(F.lit(1.0), F.sqrt(x)), "sin": F.sin, "sinh": F.sinh, "sinpi": lambda x: F.sin(x * math.pi), "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh, "tanpi": lambda x: F.tan(x * math.pi),
    "tgamma": _python(math.gamma, lambda x: math.inf if x > 0 or x == 0 else math.nan), "trunc": lambda x: sign(x) * F.floor(F.abs(x)),
}


def _next_after(x: Column, y: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([math.nextafter(p, q) for p, q in zip(a, b)])

    return run(x.cast("double"), y.cast("double"))


def _rotate(x: Column, n: Column) -> Column:
    u = F.pmod(x, F.lit(2**32))
    k = F.pmod(n, F.lit(32)).cast("int")
    return _wrapped(F.pmod(F.call_function("shiftleft", u, k), F.lit(2**32)).bitwiseOR(F.call_function("shiftright", u, 32 - k)))


INTEGER: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "abs_diff": lambda x, y: F.abs(x - y), "add_sat": lambda x, y: _clamped(x + y), "sub_sat": lambda x, y: _clamped(x - y),
    "hadd": lambda x, y: F.shiftright(x + y, 1), "rhadd": lambda x, y: F.shiftright(x + y + 1, 1), "clamp": lambda x, lo, hi: F.least(F.greatest(x, lo), hi),
    "clz": lambda x: 32 - F.length(F.regexp_replace(F.bin(F.pmod(x, F.lit(2**32))), "^0+", "")), "mad_hi": lambda a, b, c: F.shiftright(a * b, 32) + c, "mad_sat": lambda a, b, c: _clamped(a * b + c),
    "max": F.greatest, "min": F.least, "mul_hi": lambda x, y: F.shiftright(x * y, 32), "rotate": _rotate, "mad24": lambda a, b, c: _wrapped(a * b + c), "mul24": lambda a, b: _wrapped(a * b),
}


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cross(a: Column, b: Column) -> Column:
    g = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def _length(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


GEOMETRIC: dict[str, Callable[..., Column]] = {
    "dot": _dot, "cross": _cross, "length": _length, "fast_length": _length, "distance": lambda a, b: _length(F.zip_with(a, b, lambda x, y: x - y)), "fast_distance": lambda a, b: _length(F.zip_with(a, b, lambda x, y: x - y)),
    "normalize": lambda a: F.transform(a, lambda x: divide(x, _length(a))), "fast_normalize": lambda a: F.transform(a, lambda x: divide(x, _length(a))),
}
COMMON: dict[str, Callable[..., Column]] = {"radians": F.radians, "degrees": F.degrees, "sign": sign, "clamp": lambda x, lo, hi: minimum(maximum(x, lo), hi)}
RELATIONAL: dict[str, Callable[..., Column]] = {
    "isequal": lambda x, y: mask((x == y) & ~F.isnan(x)), "isnotequal": lambda x, y: mask((x != y) | F.isnan(x)), "isgreater": lambda x, y: mask((x > y) & ~F.isnan(x)), "isgreaterequal": lambda x, y: mask((x >= y) & ~F.isnan(x)),
    "isless": lambda x, y: mask((x < y) & ~F.isnan(y)), "islessequal": lambda x, y: mask((x <= y) & ~F.isnan(y)), "islessgreater": lambda x, y: mask((x != y) & ~F.isnan(x) & ~F.isnan(y)),
    "isfinite": lambda x: mask(~F.isnan(x) & (F.abs(x) < float("inf"))), "isinf": lambda x: mask(F.abs(x) == float("inf")), "isnan": lambda x: mask(F.isnan(x)), "isnormal": lambda x: mask(~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x) >= 2.0**-1022)),
    "isordered": lambda x, y: mask(~F.isnan(x) & ~F.isnan(y)), "isunordered": lambda x, y: mask(F.isnan(x) | F.isnan(y)),
}
#: What scattered values are accumulated by.
ATOMIC: dict[str, Callable[[Column], Column]] = {"add": F.sum, "sub": lambda x: -F.sum(x), "min": F.min, "max": F.max, "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor, "inc": lambda x: F.count(F.lit(1)), "dec": lambda x: -F.count(F.lit(1)), "xchg": F.max, "cmpxchg": F.max}
