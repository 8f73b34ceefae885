"""Element-wise functions as column expressions.

Spark SQL differs from IEEE arithmetic in places: logarithms outside their
domain give NULL, floor turns NaN into 0, division by zero raises, and NaN
equals itself.  The builders here restore the IEEE meaning and stay inside
whole-stage code generation.  Only four special functions, the sign-keeping copy
and the comparison by units in the last place need Python; they are Pandas UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- arithmetic ----------------------------------------------------------------


def negate(x: Column) -> Column:
    return -x


def absolute(x: Column) -> Column:
    return F.abs(x)


def divide(a, b) -> Column:
    """IEEE division: x/0 is infinite, 0/0 is NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    zero = F.when(a == 0, NAN).when(F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def reciprocal(x: Column) -> Column:
    return divide(F.lit(1.0), x)


def int_divide(a, b) -> Column:
    """Truncating integer division; null for a zero divisor."""
    a, b = _c(a), _c(b)
    b = F.nullif(b, F.lit(0))
    return F.try_divide(a - a % b, b).cast("bigint")


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend."""
    return _c(a) % _c(b)


def floor_mod(a, b) -> Column:
    """Remainder with the sign of the divisor."""
    a, b = _c(a), _c(b)
    return ((a % b) + b) % b


def sgn(x: Column) -> Column:
    return F.signum(x).cast("int")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), x))


def minimum(*xs) -> Column:
    return F.least(*map(_c, xs))


def maximum(*xs) -> Column:
    return F.greatest(*map(_c, xs))


def square(x: Column) -> Column:
    return x * x


def power(x, p) -> Column:
    return F.pow(_c(x), _c(p))


def sinc(x: Column, normalized: bool = True) -> Column:
    y = x * math.pi if normalized else x
    return F.when(x == 0, 1.0).otherwise(F.sin(y) / F.when(x == 0, 1.0).otherwise(y))


def factorial(x: Column) -> Column:
    return F.factorial(x.cast("int"))


# -- roots, logarithms, rounding ----------------------------------------------


def sqrt(x: Column) -> Column:
    return F.sqrt(x)


def cbrt(x: Column) -> Column:
    return F.cbrt(x)


def _log(f: Callable[[Column], Column], x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), NAN).when(x > 0, f(x)).when(x == 0, -INF).otherwise(NAN)


def ln(x: Column) -> Column:
    return _log(F.ln, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log1p(x: Column) -> Column:
    """ln(1 + x), accurate near 0."""
    x = x.cast("double")
    return F.when(F.isnan(x), NAN).when(x > -1, F.log1p(x)).when(x == -1, -INF).otherwise(NAN)


def exp(x: Column) -> Column:
    return F.exp(x)


def expm1(x: Column) -> Column:
    return F.expm1(x)


def _whole(f: Callable[[Column], Column], x: Column) -> Column:
    # Values beyond 2**52 are whole already, and do not fit a bigint beyond 2**63.
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= float(1 << 52)), x).otherwise(f(x).cast("double"))


def floor(x: Column) -> Column:
    return _whole(F.floor, x)


def ceil(x: Column) -> Column:
    return _whole(F.ceil, x)


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def round_half_away(x: Column) -> Column:
    return _whole(F.round, x)


def round_decimals(x: Column, places: int) -> Column:
    """``F.round`` of doubles without a decimal number per row, except next to a half.

    Elsewhere both take the same whole number, which divided by a power of ten up to
    10^22 is the double nearest to the decimal.
    """
    t = x * 10.0**places
    whole = F.rint(t)
    return F.when((F.abs(t) < 1e11) & (F.abs(t - whole) < 0.4999), whole / 10.0**places + 0.0).otherwise(F.round(x, places))


# -- trigonometry ----------------------------------------------------------------

UNIVERSAL: dict[str, Callable[[Column], Column]] = {
    "sqrt": sqrt, "cbrt": cbrt, "ln": ln, "log2": log2, "log10": log10, "ln1p": log1p, "exp": exp, "expm1": expm1,
    "arccos": F.acos, "arcsin": F.asin, "arctan": F.atan, "arccosh": F.acosh, "arcsinh": F.asinh, "arctanh": F.atanh,
    "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "floor": floor, "ceil": ceil, "trunc": trunc, "round": round_half_away,
    "degToRad": F.radians, "radToDeg": F.degrees, "fac": factorial, "negate": negate, "abs": absolute,
    "reciprocal": reciprocal, "square": square, "sgn": sgn, "isNaN": F.isnan,
}


def register(name: str, f: Callable[[Column], Column]) -> None:
    """Make a column function available to :meth:`TensorFrame.map` by name."""
    UNIVERSAL[name] = f


# -- special functions (Python) ------------------------------------------------------


def _special(f: Callable[[float], float]):
    def one(x: float) -> float:
        try:
            return f(x)
        except OverflowError:
            return INF
        except ValueError:
            return NAN

    lifted = np.vectorize(one, otypes=[float])

    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(lifted(s.to_numpy(dtype=float)) if len(s) else s.astype(float))

    return lambda x: run(x.cast("double"))


erf, erfc, gamma, lgamma = (_special(f) for f in (math.erf, math.erfc, math.gamma, math.lgamma))
UNIVERSAL.update(erf=erf, erfc=erfc, gamma=gamma, lgamma=lgamma)


def copysign(x: Column, sign: Column) -> Column:
    """|x| with the sign of ``sign``, negative zero included."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.copysign(a.to_numpy(float), b.to_numpy(float)))

    return run(x.cast("double"), sign.cast("double"))


def almost_equal(x: Column, y: Column, ulps: int = 4) -> Column:
    """Equality within ``ulps`` units in the last place."""

    @F.pandas_udf(BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        p, q = a.to_numpy(float), b.to_numpy(float)
        with np.errstate(invalid="ignore"):
            return pd.Series((p == q) | (np.abs(p - q) <= ulps * np.maximum(np.spacing(np.abs(p)), np.spacing(np.abs(q)))))

    return run(x.cast("double"), y.cast("double"))


def classify(x: Column) -> Column:
    """Kind of a float: nan, inf, neginf, zero, negzero, subnormal or normal."""
    x = x.cast("double")
    tiny = 2.2250738585072014e-308
    # Only its text tells a negative zero from the other.
    negative_zero = x.cast("string") == "-0.0"
    return (
        F.when(F.isnan(x), "nan")
        .when(x == INF, "inf")
        .when(x == -INF, "neginf")
        .when((x == 0) & negative_zero, "negzero")
        .when(x == 0, "zero")
        .when(F.abs(x) < tiny, "subnormal")
        .otherwise("normal")
    )


# -- comparison, logic, bits -----------------------------------------------------------


def compare(op: str, a, b, floating: bool = True) -> Column:
    """IEEE comparison: NaN is equal to and ordered with nothing."""
    a, b = _c(a), _c(b)
    out = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if not floating:
        return out
    odd = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(odd, F.lit(op == "!=")).otherwise(out)


def logical(op: str, a: Column, b: Column | None = None) -> Column:
    return {"and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a != b, "not": lambda: ~a}[op]()


def bitwise(op: str, a: Column, b=None) -> Column:
    return {"and": lambda: a.bitwiseAND(b), "or": lambda: a.bitwiseOR(b), "xor": lambda: a.bitwiseXOR(b), "not": lambda: F.bitwise_not(a)}[op]()


def shift_left(x: Column, n) -> Column:
    return F.call_function("shiftleft", x, _c(n))


def shift_right(x: Column, n) -> Column:
    """Arithmetic shift."""
    return F.call_function("shiftright", x, _c(n))


def int_to_bits(x: Column, n: int, msb_first: bool = True) -> Column:
    """The ``n`` low bits as an array of booleans."""
    at = range(n - 1, -1, -1) if msb_first else range(n)
    return F.array(*[shift_right(x.cast("bigint"), k).bitwiseAND(F.lit(1).cast("bigint")) == 1 for k in at])


# -- activations, densities, errors ----------------------------------------------------


def sigmoid(x: Column) -> Column:
    """Written so that neither side overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def sigmoid_backward(gradient: Column, y: Column) -> Column:
    return gradient * y * (1 - y)


def relu_backward(gradient: Column, y: Column) -> Column:
    return F.when(y > 0, gradient).otherwise(0.0)


def tanh_backward(gradient: Column, y: Column) -> Column:
    return gradient * (1 - y * y)


def gauss(x: Column, mean, sigma, norm: bool = False) -> Column:
    """Bell curve; of area one with ``norm``."""
    z = (x - _c(mean)) / _c(sigma)
    out = F.exp(-0.5 * z * z)
    return out / (_c(sigma) * math.sqrt(2 * math.pi)) if norm else out


def _inside(u: Column, y: Column, reach: float = 1.0) -> Column:
    return F.when(F.abs(u) <= reach, y).otherwise(0.0)


#: Half-widths of the kernels; the bell curve is cut off there in density estimates.
REACH: dict[str, float] = {"box": 0.5, "triangular": 1.0, "trigonometric": 0.5, "epanechnikov": 1.0, "gauss": 3.0}

#: Kernels of area one.
KERNELS: dict[str, Callable[[Column], Column]] = {
    "box": lambda u: _inside(u, F.lit(1.0), 0.5),
    "triangular": lambda u: _inside(u, 1 - F.abs(u)),
    "trigonometric": lambda u: _inside(u, 1 + F.cos(u * (2 * math.pi)), 0.5),
    "epanechnikov": lambda u: _inside(u, 0.75 * (1 - u * u)),
    "gauss": lambda u: F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi),
}


def squared_error(y: Column, truth: Column) -> Column:
    return (y - truth) * (y - truth)


def absolute_error(y: Column, truth: Column) -> Column:
    return F.abs(y - truth)


def relative_error(y: Column, truth: Column) -> Column:
    """|y - truth| over the larger magnitude; 0 where both are 0."""
    top = F.greatest(F.abs(y), F.abs(truth))
    return F.when(top == 0, 0.0).otherwise(F.abs(y - truth) / F.when(top == 0, 1.0).otherwise(top))


def numerical_gradient(f: Callable[[Column], Column], x: Column, h: float = 1e-5) -> Column:
    """Central difference."""
    return (f(x + h) - f(x - h)) / (2 * h)
