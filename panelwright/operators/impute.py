"""Median imputation and scaling.

Group statistics go back to the rows by an equi-join whose small side the
planner sizes itself; statistics over the whole table are one row and go back
as scalar subqueries, so no cross join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.median import exact_median, same_keys


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Bring the statistics ``names`` of each group back to its rows."""
    if not by:
        return df.withColumns({n: stats.select(n).scalar() for n in names})
    small = stats.select(*[F.col(k).alias(f"_key_{k}") for k in by], *names)
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by]
    return df.join(small, on, "left").drop(*[f"_key_{k}" for k in by])


def impute_median(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), zero: Sequence[str] = ()
) -> DataFrame:
    """Fill nulls by the group median, then by zero; ``zero`` columns by zero only."""
    cols, by = list(cols), list(by)
    medians = exact_median(df, by, cols)
    names = {c: f"_median_{c}" for c in cols}
    medians = medians.select(*by, *[F.col(c).cast("double").alias(n) for c, n in names.items()])
    filled = attach(df, medians, by, list(names.values()))
    filled = filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(n), F.lit(0.0)) for c, n in names.items()})
    if zero:
        filled = filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in zero})
    return filled.drop(*names.values())


def _nonzero_or_one(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def standardize(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """Subtract the mean, divide by the population deviation (by 1 if that is 0)."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_avg_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_dev_{c}") for c in cols],
    )
    names = [f"_{s}_{c}" for c in cols for s in ("avg", "dev")]
    out = attach(df, stats, by, names)
    out = out.withColumns(
        {f"{c}{suffix}": (F.col(c) - F.col(f"_avg_{c}")) / _nonzero_or_one(F.col(f"_dev_{c}")) for c in cols}
    )
    return out.drop(*names)


def minmax_stats(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), fit_on: Column | None = None
) -> DataFrame:
    """Minimum and range per group, from the rows of ``fit_on`` only if given."""
    def seen(c: str) -> Column:
        return F.col(c) if fit_on is None else F.when(fit_on, F.col(c))

    return df.groupBy(*by).agg(
        *[F.min(seen(c)).alias(f"{c}_min") for c in cols],
        *[F.max(seen(c)).alias(f"{c}_max") for c in cols],
    )


def minmax(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    fit_on: Column | None = None,
    keep_stats: bool = False,
    suffix: str = "",
) -> DataFrame:
    """Scale to [0, 1] by the range of the fitted rows (by 1 if that is 0)."""
    names = [f"{c}_{s}" for c in cols for s in ("min", "max")]
    out = attach(df, minmax_stats(df, cols, by, fit_on), by, names)
    out = out.withColumns(
        {
            f"{c}{suffix}": (F.col(c) - F.col(f"{c}_min")) / _nonzero_or_one(F.col(f"{c}_max") - F.col(f"{c}_min"))
            for c in cols
        }
    )
    return out if keep_stats else out.drop(*names)


def inverse_minmax(value: Column | str, stats: Mapping[str, Column | str]) -> Column:
    """Back from [0, 1] to the original unit."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    lo, hi = col(stats["min"]), col(stats["max"])
    return col(value) * _nonzero_or_one(hi - lo) + lo


__all__ = ["attach", "impute_median", "inverse_minmax", "minmax", "minmax_stats", "same_keys", "standardize"]
