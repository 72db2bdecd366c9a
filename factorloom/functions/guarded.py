"""Column helpers with one rule for missing values: NULL is missing, and results never raise.

Sessions keep ANSI mode on, so every division here is guarded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Magnitudes below this count as zero in divisions and spreads.
EPS = 1e-12
INF = float("inf")


def number(c: Column) -> Column:
    """A lenient cast: what is no number, and NaN, is missing; infinities stay."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def is_finite(c: Column) -> Column:
    return F.abs(c) < F.lit(INF)  # NaN is above all numbers, NULL stays NULL


def finite(c: Column) -> Column:
    return F.when(is_finite(c), c)


def divide(a: Column, b: Column) -> Column:
    """a / b, missing where b is all but zero."""
    return F.when(F.abs(b) >= EPS, F.try_divide(a, b))


def ratio(a: Column, b: Column) -> Column:
    """a / b by IEEE rules: 0/0 is missing, x/0 is infinite with the sign of x."""
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def both(a: Column, b: Column, keep: Column) -> Column:
    """``keep`` where both ``a`` and ``b`` are finite."""
    return F.when(is_finite(a) & is_finite(b), keep)


def _over(c: Column, w: WindowSpec | None) -> Column:
    return c if w is None else c.over(w)


def pearson(a: Column, b: Column, w: WindowSpec | None = None, pairs: bool = True) -> Column:
    """Correlation of two columns (population moments), missing for under two rows or no spread.

    ``pairs``: only rows where both are finite count; else all non-null rows,
    and an infinite value makes the result missing.
    """
    x, y = (both(a, b, a), both(a, b, b)) if pairs else (F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))
    sx, sy = _over(F.stddev_pop(x), w), _over(F.stddev_pop(y), w)
    spread = (_over(F.count(x), w) >= 2) & (sx > EPS) & (sy > EPS)
    return F.when(spread, finite(F.try_divide(_over(F.covar_pop(x, y), w), sx * sy)))


def covariance(a: Column, b: Column, w: WindowSpec | None = None) -> Column:
    x, y = both(a, b, a), both(a, b, b)
    return F.when(_over(F.count(x), w) >= 2, _over(F.covar_pop(x, y), w))


def average_rank(c: Column, *partition: str | Column) -> Column:
    """Ranks from 1, ties sharing the mean of their places; rows with a missing ``c`` must be gone."""
    from pyspark.sql import Window

    return F.rank().over(Window.partitionBy(*partition).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, c)) - 1) / F.lit(2.0)


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` kept within bounds, missing if missing."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def sharpe(mean: Column, std: Column, n: Column | None = None) -> Column:
    """mean / (std + EPS), times the root of ``n`` if given."""
    out = F.try_divide(mean, std + F.lit(EPS))
    return out if n is None else out * F.sqrt(n.cast("double"))


def plain(x) -> float | None:
    """A driver-side number, NaN as None."""
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)
