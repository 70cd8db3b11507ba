"""Element-wise formulas with array-library semantics as Catalyst expressions: one registry, no Python per row.

Each entry builds a Column from operand Columns. Operands of ``real`` formulas are cast to double first. Divisions, logarithms and
shifts are guarded, because Spark raises or gives NULL where arrays hold infinities, NaN or zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .dtypes import truncated



@dataclass(frozen=True)
class Ufunc:
    name: str
    arity: int
    build: Callable[..., Column]
    operands: str  # real: doubles; number: as they are; whole: longs
    result: str  # real, same, bool or long


UFUNCS: dict[str, Ufunc] = {}


def _add(operands: str, result: str, arity: int, **formulas: Callable[..., Column]) -> None:
    for name, build in formulas.items():
        UFUNCS[name] = Ufunc(name, arity, build, operands, result)


def _nan() -> Column:
    return F.lit(float("nan"))


def _inf() -> Column:
    return F.lit(float("inf"))


def isnan(v: Column) -> Column:
    return F.isnan(v.cast("double"))


def _log(f: Callable[[Column], Column], edge: float) -> Callable[[Column], Column]:
    def build(v: Column) -> Column:
        inside = F.when(v > edge, v).otherwise(F.lit(edge + 1.0))
        return F.when(F.isnan(v), _nan()).when(v > edge, f(inside)).when(v == edge, -_inf()).otherwise(_nan())

    return build


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles: signed infinities and NaN for a divisor of zero."""
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    sign = F.when(signbit(b), F.lit(-1.0)).otherwise(F.lit(1.0))
    zero = F.when(F.isnan(a) | (a == 0), _nan()).otherwise(F.signum(a) * sign * _inf())
    return F.when(b == 0, zero).otherwise(a / safe)


def signbit(v: Column) -> Column:
    return v.cast("string").startswith("-")


def _mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; 0 for an integer divisor of zero."""
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    r = a % safe
    return F.when(b == 0, F.lit(0)).when((r != 0) & ((r < 0) != (safe < 0)), r + safe).otherwise(r)


def _floor_divide(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", (a - _mod(a, safe)).cast("bigint"), safe.cast("bigint")))


def _compare(f: Callable[[Column, Column], Column], with_nan: bool = False) -> Callable[[Column, Column], Column]:
    def build(a: Column, b: Column) -> Column:
        return F.when(isnan(a) | isnan(b), F.lit(with_nan)).otherwise(f(a, b))

    return build


def _truth(v: Column) -> Column:
    return v != 0


def _shift(left: bool) -> Callable[[Column, Column], Column]:
    def build(a: Column, n: Column) -> Column:
        k = F.least(F.greatest(n, F.lit(0)), F.lit(63)).cast("int")
        moved = F.call_function("shiftleft" if left else "shiftright", a, k)
        over = F.lit(0).cast("bigint") if left else F.when(a < 0, F.lit(-1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.when(n > 63, over).otherwise(moved)

    return build


@F.pandas_udf(DoubleType())
def _nextafter(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(a.to_numpy(), b.to_numpy()))


def _exponent(v: Column) -> Column:
    """The power of two in v = m * 2**e with 0.5 <= abs(m) < 1."""
    a = F.abs(v)
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))).cast("int") + 1
    m = a / F.pow(F.lit(2.0), guess.cast("double"))
    exact = F.when(m >= 1, guess + 1).when(m < 0.5, guess - 1).otherwise(guess)
    return F.when((v == 0) | F.isnan(v) | (a == _inf()), F.lit(0)).otherwise(exact)


def modf(v: Column) -> tuple[Column, Column]:
    """(fraction, whole part) of a double."""
    return v - truncated(v), truncated(v)


def frexp(v: Column) -> tuple[Column, Column]:
    """(mantissa, exponent) of a double."""
    e = _exponent(v)
    return v / F.pow(F.lit(2.0), e.cast("double")), e


_real = {"exp": F.exp, "exp2": lambda v: F.pow(F.lit(2.0), v), "expm1": F.expm1, "sqrt": F.sqrt, "rint": F.rint, "sin": F.sin, "cos": F.cos, "tan": F.tan}
_add("real", "real", 1, **_real)
_add("real", "real", 1, arcsin=F.asin, arccos=F.acos, arctan=F.atan, sinh=F.sinh, cosh=F.cosh, tanh=F.tanh, arcsinh=F.asinh, arccosh=F.acosh, arctanh=F.atanh, deg2rad=F.radians, rad2deg=F.degrees)
_add("real", "real", 1, log=_log(F.ln, 0.0), log2=_log(F.log2, 0.0), log10=_log(F.log10, 0.0), log1p=_log(F.log1p, -1.0))
_add("real", "real", 1, floor=lambda v: F.floor(v).cast("double"), ceil=lambda v: F.ceil(v).cast("double"), trunc=truncated, fabs=F.abs, reciprocal=lambda v: quotient(F.lit(1.0), v))
_add("real", "real", 1, modf=lambda v: modf(v)[0], frexp=lambda v: frexp(v)[0])
_add("number", "same", 1, absolute=F.abs, conj=lambda v: v, square=lambda v: v * v, negative=lambda v: -v, zeros_like=lambda v: v * 0, ones_like=lambda v: v * 0 + 1, relocate=lambda v: v)
_add("number", "same", 1, sign=lambda v: F.when(isnan(v), v).when(v > 0, F.lit(1)).when(v < 0, F.lit(-1)).otherwise(F.lit(0)))
_add("number", "bool", 1, signbit=signbit, isnan=isnan, isinf=lambda v: F.abs(v.cast("double")) == _inf(), isfinite=lambda v: ~isnan(v) & (F.abs(v.cast("double")) != _inf()), isnat=lambda v: v.isNull(), logical_not=lambda v: v == 0)
_add("whole", "long", 1, invert=F.bitwise_not)
_add("real", "real", 2, arctan2=F.atan2, hypot=F.hypot, divide=quotient, true_divide=quotient, power=F.pow, nextafter=lambda a, b: _nextafter(a, b))
_add("real", "real", 2, logaddexp=lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))), logaddexp2=lambda a, b: F.greatest(a, b) + F.log2(F.lit(1.0) + F.pow(F.lit(2.0), -F.abs(a - b))))
_add("real", "real", 2, copysign=lambda a, b: F.when(signbit(b), -F.abs(a)).otherwise(F.abs(a)), ldexp=lambda a, b: a * F.pow(F.lit(2.0), b))
_add("number", "same", 2, add=lambda a, b: a + b, subtract=lambda a, b: a - b, multiply=lambda a, b: a * b)
_add("number", "same", 2, maximum=F.greatest, minimum=lambda a, b: F.when(isnan(a), a).when(isnan(b), b).otherwise(F.least(a, b)))
_add("number", "same", 2, fmax=lambda a, b: F.when(isnan(a), b).when(isnan(b), a).otherwise(F.greatest(a, b)), fmin=lambda a, b: F.when(isnan(a), b).when(isnan(b), a).otherwise(F.least(a, b)))
_add("whole", "long", 2, remainder=_mod, mod=_mod, fmod=lambda a, b: F.when(b == 0, F.lit(0)).otherwise(a % F.when(b == 0, F.lit(1)).otherwise(b)), floor_divide=_floor_divide)
_add("whole", "long", 2, bitwise_and=lambda a, b: a.bitwiseAND(b), bitwise_or=lambda a, b: a.bitwiseOR(b), bitwise_xor=lambda a, b: a.bitwiseXOR(b), left_shift=_shift(True), right_shift=_shift(False))
_add("number", "bool", 2, greater=_compare(lambda a, b: a > b), greater_equal=_compare(lambda a, b: a >= b), less=_compare(lambda a, b: a < b), less_equal=_compare(lambda a, b: a <= b), equal=_compare(lambda a, b: a == b), not_equal=_compare(lambda a, b: a != b, True))
_add("number", "bool", 2, logical_and=lambda a, b: _truth(a) & _truth(b), logical_or=lambda a, b: _truth(a) | _truth(b), logical_xor=lambda a, b: _truth(a) != _truth(b))
_add("number", "same", 3, clip=lambda v, lo, hi: F.least(F.greatest(v, lo), hi))


def _real_mod(a: Column, b: Column) -> Column:
    """Remainder of doubles with the divisor's sign, NaN for a divisor of zero."""
    r = a % F.when(b == 0, F.lit(1.0)).otherwise(b)
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), _nan()).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


#: Formulas for integers that arrays of reals define otherwise.
REAL_FORMS: dict[str, Callable[..., Column]] = {
    "remainder": _real_mod,
    "mod": _real_mod,
    "fmod": lambda a, b: F.when(b == 0, _nan()).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b)),
    "floor_divide": lambda a, b: F.when(b == 0, quotient(a, b)).otherwise(F.floor(a / F.when(b == 0, F.lit(1.0)).otherwise(b)).cast("double")),
}


def apply(name: str, *operands: Column, real: bool = False) -> Column:
    """The formula ``name`` on operand Columns; ``real``: the operands are reals, which a few formulas treat otherwise."""
    u = UFUNCS[name]
    if real and name in REAL_FORMS:
        return REAL_FORMS[name](*(o.cast("double") for o in operands))
    if len(operands) != u.arity:
        raise TypeError(f"{name} takes {u.arity} operands")
    if u.operands == "real":
        operands = tuple(o.cast("double") for o in operands)
    elif u.operands == "whole":
        operands = tuple(o.cast("bigint") for o in operands)
    return u.build(*operands)
