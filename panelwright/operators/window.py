"""Lags, differences, splits, folds, sequence windows and decomposition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.impute import attach
from panelwright.operators.series import numbered, series


def add_lags(
    df: DataFrame,
    cols: Sequence[str],
    n_lags: int = 2,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    layout: str = "panel",
    drop_incomplete: bool = True,
) -> DataFrame:
    """Add ``{col}_lag{k}``: the value k rows (not k calendar periods) earlier.

    Rows with any null are then dropped, and with them rows without an entity.
    """
    s = series(df, by, order, back=n_lags, layout=layout)
    lags = {f"{c}_lag{k}": s.shift(c, k) for k in range(1, n_lags + 1) for c in cols if c in df.columns}
    out = s.finish(s.df.withColumns(lags))
    return out.na.drop() if drop_incomplete else out


def difference(
    df: DataFrame,
    col: str,
    d: int = 1,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    fill: float | None = None,
    name: str | None = None,
    layout: str = "panel",
) -> DataFrame:
    """The d-th difference; undefined leading values are null, or ``fill``."""
    # Binomial weights of repeated differencing, for d = 0, 1, 2.
    weights = {0: [1], 1: [1, -1], 2: [1, -2, 1]}[d]
    s = series(df, by, order, back=d, layout=layout)
    value = reduce(lambda a, b: a + b, [s.shift(col, k) * w for k, w in enumerate(weights)])
    if fill is not None:
        value = F.coalesce(value, F.lit(fill))
    return s.finish(s.df.withColumn(name or f"{col}_diff{d}", value))


def time_split(
    df: DataFrame,
    by: Sequence[str] = ("industry",),
    period: str = "year",
    test_ratio: float = 0.2,
    name: str = "split",
) -> DataFrame:
    """Label rows train or test: the first share of each entity's periods trains."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_rank", F.dense_rank().over(w.orderBy(period))).withColumn(
        "_periods", F.max("_rank").over(w)
    )
    cut = F.greatest(F.lit(1), F.floor(F.col("_periods") * (1 - test_ratio)))
    return ranked.withColumn(name, F.when(F.col("_rank") <= cut, "train").otherwise("test")).drop("_rank", "_periods")


def rolling_folds(
    df: DataFrame,
    by: Sequence[str] = ("industry",),
    order: str = "year",
    n_splits: int = 3,
    min_train: int = 3,
    layout: str = "panel",
) -> DataFrame:
    """Rolling-origin folds: each row once per fold it belongs to, with its role."""
    rows = numbered(df, by, order, layout, "_t", "_n")
    splits = F.least(F.lit(n_splits), F.greatest(F.lit(1), F.floor((F.col("_n") - 2) / 2))).cast("int")
    rows = rows.withColumn("_splits", splits).withColumn("_size", F.floor(F.col("_n") / (F.col("_splits") + 1)))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("_splits"))))
    train_end = F.col("_size") * F.col("fold")
    role = F.when(F.col("_t") <= train_end, "train").when(F.col("_t") <= train_end + F.col("_size"), "test")
    return (
        rows.withColumn("train_end", train_end)
        .withColumn("role", role)
        .filter(F.col("role").isNotNull() & (F.col("train_end") >= min_train))
        .drop("_t", "_n", "_splits", "_size")
    )


def sequence_windows(
    df: DataFrame,
    cols: Sequence[str],
    n_steps: int = 2,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    name: str = "window",
    layout: str = "panel",
) -> DataFrame:
    """Add the previous ``n_steps`` vectors, oldest first; rows without them go."""
    s = series(df, by, order, back=n_steps, layout=layout)
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    past = [s.shift(vector, k) for k in range(n_steps, 0, -1)]
    out = s.df.withColumn(name, F.array(*past))
    full = reduce(lambda a, b: a & b, [F.col(name)[i].isNotNull() for i in range(n_steps)])
    return s.finish(out).filter(full)


def tail_context(df: DataFrame, n: int, by: Sequence[str] = ("industry",), order: str = "year") -> DataFrame:
    """The last ``n`` rows of each series."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def flag_shocks(df: DataFrame, col: str, by: Sequence[str] = ("industry",)) -> DataFrame:
    """Mark values beyond one population deviation of their series, with the sign."""
    sd = df.groupBy(*by).agg(F.stddev_pop(col).alias("threshold"))
    out = attach(df, sd, by, ["threshold"])
    hit = F.coalesce(F.abs(col) > F.col("threshold"), F.lit(False))
    side = F.when(F.col(col) < 0, "tightening").otherwise("improvement")
    return out.withColumn("is_shock", hit).withColumn("direction", F.when(F.col("is_shock"), side))


def durbin_watson(
    res: DataFrame,
    by: Sequence[str],
    order: Sequence[str] | str,
    col: str = "residual",
    layout: str = "panel",
) -> DataFrame:
    """Sum of squared first differences over sum of squares."""
    s = series(res.filter(F.col(col).isNotNull()), by, order, back=1, layout=layout)
    step = F.col(col) - F.col("_prev")
    rows = s.finish(s.df.withColumn("_prev", s.shift(col, 1)))
    return rows.groupBy(*by).agg(
        F.count(col).alias("n_obs"), F.try_divide(F.sum(step * step), F.sum(F.col(col) * F.col(col))).alias("dw")
    )


def decompose(
    df: DataFrame,
    col: str,
    period: int = 1,
    by: Sequence[str] = ("industry",),
    order: str = "year",
    layout: str = "panel",
) -> DataFrame:
    """Additive decomposition: trend, seasonal and residual of each series.

    The trend is a centred moving average over ``max(period, 2)`` rows, its ends
    extended by a line through the nearest ``period`` trend values. Series
    shorter than two periods are left out.
    """
    p = max(period, 2)
    half = p // 2
    rows = numbered(df.filter(F.col(col).isNotNull()), by, order, layout, "_t", "_n", keep_pos=True).filter(
        F.col("_n") >= 2 * p
    )
    s = series(rows, by, order, back=half, ahead=half, layout=layout)
    weights = {k: 1.0 / p for k in range(-half, half + 1)}
    if p % 2 == 0:
        weights[-half] = weights[half] = 0.5 / p
    average = reduce(lambda a, b: a + b, [s.shift(col, k) * w for k, w in weights.items()])
    out = s.finish(s.df.withColumn("_trend", average))

    # Trend values exist for places first..last; each end is fitted on p of them,
    # the far one not counting the very last value.
    first, last = F.lit(half + 1), F.col("_n") - half
    t = F.col("_t")
    at_head = (t >= first) & (t < F.least(first + p, last))
    at_tail = (t < last) & (t >= F.greatest(first, last - p))

    def line(flag, side):
        x, y = F.when(flag, t - 1.0), F.when(flag, F.col("_trend"))
        n, slope = F.count(x), F.regr_slope(y, x)
        # One point only: the smallest coefficients that go through it.
        single = F.max(y) / (F.max(x) * F.max(x) + 1)
        return [
            F.when(n == 1, single * F.max(x)).otherwise(slope).alias(f"_slope_{side}"),
            F.when(n == 1, single).otherwise(F.regr_intercept(y, x)).alias(f"_level_{side}"),
        ]

    ends = out.groupBy(*by).agg(*line(at_head, "head"), *line(at_tail, "tail"))
    out = attach(out, ends, by, [f"_{a}_{b}" for b in ("head", "tail") for a in ("slope", "level")])
    trend = (
        F.when(t < first, F.col("_slope_head") * (t - 1) + F.col("_level_head"))
        .when(t > last, F.col("_slope_tail") * (t - 1) + F.col("_level_tail"))
        .otherwise(F.col("_trend"))
    )
    out = out.withColumn("trend", trend).withColumn("_slot", (t - 1) % p)
    means = out.groupBy(*by, "_slot").agg(F.avg(F.col(col) - F.col("trend")).alias("_mean"))
    level = means.groupBy(*by).agg(F.avg("_mean").alias("_level"))
    seasonal = attach(means, level, by, ["_level"]).select(
        *by, "_slot", (F.col("_mean") - F.col("_level")).alias("seasonal")
    )
    out = attach(out, seasonal, [*by, "_slot"], ["seasonal"])
    return out.withColumn("resid", F.col(col) - F.col("trend") - F.col("seasonal")).select(
        *by, order, F.col(col).alias("observed"), "trend", "seasonal", "resid"
    )
