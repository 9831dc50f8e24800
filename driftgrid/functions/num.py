"""Floating-point helpers with array-library semantics.

Spark orders NaN above every number and raises on division by zero; these wrappers restore the
IEEE behaviour (NaN compares false, x/0 is infinite, log of a negative is NaN).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def as_col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def gt(x, y) -> Column:
    x, y = as_col(x), as_col(y)
    return ~F.isnan(x) & ~F.isnan(y) & (x > y)


def lt(x, y) -> Column:
    x, y = as_col(x), as_col(y)
    return ~F.isnan(x) & ~F.isnan(y) & (x < y)


def ge(x, y) -> Column:
    x, y = as_col(x), as_col(y)
    return ~F.isnan(x) & ~F.isnan(y) & (x >= y)


def maximum(x, y) -> Column:
    x, y = as_col(x), as_col(y)
    return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(F.greatest(x, y))


def minimum(x, y) -> Column:
    x, y = as_col(x), as_col(y)
    return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(F.least(x, y))


def clip(x, lo, hi) -> Column:
    return minimum(maximum(x, lo), hi)


def divide(x, y) -> Column:
    x, y = as_col(x), as_col(y)
    at_zero = (F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF)))
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def log(x) -> Column:
    x = as_col(x)
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def log10(x) -> Column:
    x = as_col(x)
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def sqrt(x) -> Column:
    x = as_col(x)
    return F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(x))


def mod(x, y) -> Column:
    """Remainder with the sign of the divisor; NaN for a zero divisor."""
    x, y = as_col(x), as_col(y)
    safe = F.when(y == 0, F.lit(1.0)).otherwise(y)
    r = x % safe
    fixed = F.when((r != 0) & ((r < 0) != (safe < 0)), r + safe).otherwise(r)
    return F.when(y == 0, F.lit(NAN)).otherwise(fixed)


def cond(test, a, b) -> Column:
    """a where test > 0, else b; a NaN test counts as false."""
    return F.when(gt(test, 0.0), as_col(a)).otherwise(as_col(b))


def finite(x) -> Column:
    x = as_col(x)
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def finite_or_bound(x, lo=None, hi=None) -> Column:
    """NaN -> 0, +Inf -> upper bound or 0, -Inf -> lower bound or 0."""
    x = as_col(x)
    return (F.when(F.isnan(x), F.lit(0.0))
            .when(x == INF, F.lit(float(hi if hi is not None else 0.0)))
            .when(x == -INF, F.lit(float(lo if lo is not None else 0.0)))
            .otherwise(x))


def clamp(x, lo=None, hi=None) -> Column:
    """Raise to lo, then lower to hi; a missing bound is open. NaN stays NaN."""
    x = as_col(x)
    if lo is not None:
        x = maximum(x, float(lo))
    if hi is not None:
        x = minimum(x, float(hi))
    return x


def bounds_of(lo, hi):
    """Scenario bound rule: both zero or absent means unbounded, a lone zero is a bound."""
    if not lo and not hi:
        return None, None
    return lo, hi


def radians(x) -> Column:
    return as_col(x) * F.lit(math.pi / 180.0)
