"""Column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null where the denominator is zero (or anything is null)."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def corr_or_null(a: Column | str, b: Column | str) -> Column:
    """Aggregate: Pearson correlation, null (not an error) if either is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def finite(c: Column | str) -> Column:
    """NaN and both infinities become null."""
    x = _col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_name(c: Column | str) -> Column:
    """Blank, slash and backslash become underscores, for use in paths."""
    return F.translate(_col(c).cast("string"), "/ \\", "___")


def positive_part(c: Column | str) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def negative_part(c: Column | str) -> Column:
    return F.least(_col(c), F.lit(0.0))


def period_date(year: Column | str) -> Column:
    """First of January of a year number."""
    return F.make_date(_col(year).cast("int"), F.lit(1), F.lit(1))


def later_period(period: Column | str, steps: Column | str, unit: str = "step") -> Column:
    """The period so many steps later: a count or year (``step``), a YYYYMM number (``month``), or a date (``day``)."""
    p, n = _col(period), _col(steps)
    if unit == "month":
        months = F.floor(p / 100) * 12 + p % 100 - 1 + n
        return F.floor(months / 12) * 100 + months % 12 + 1
    if unit == "day":
        return F.date_add(p, n.cast("int"))
    if unit == "step":
        return p + n
    raise ValueError(f"unit must be step, month or day, got {unit!r}")


def order_str(*parts: Column | str) -> Column:
    """A model order as text: ``(p, d, q)`` or ``(P, D, Q, m)``."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[_col(p).cast("string") for p in parts]), F.lit(")"))


def dw_band(c: Column | str) -> Column:
    """Reading of a Durbin-Watson statistic; bands end at 1.5 and 2.5."""
    x = _col(c)
    return (
        F.when(x < 1.5, "positive autocorrelation")
        .when(x < 2.5, "no autocorrelation")
        .when(x.isNotNull(), "negative autocorrelation")
    )


def significant(p: Column | str, level: float = 0.05) -> Column:
    return _col(p) < F.lit(level)


def verdict(p: Column | str, level: float = 0.05) -> Column:
    return F.when(significant(p, level), "significant").when(_col(p).isNotNull(), "not significant")


def dot(weights: Sequence[Column], values: Sequence[Column]) -> Column:
    """Sum of products of two equally long lists of columns."""
    total = F.lit(0.0)
    for w, v in zip(weights, values, strict=True):
        total = total + w * v
    return total
