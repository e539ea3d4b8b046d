"""Autocorrelation, partial autocorrelation, portmanteau test, quantile plot."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.scalar import corr_or_null
from panelwright.functions.special import chi2_sf, normal_ppf
from panelwright.operators.impute import attach
from panelwright.operators.series import numbered, series

# Fixed value: the 97.5% point of the standard normal distribution.
Z95 = 1.959963984540054


def lag_sums(
    df: DataFrame,
    col: str,
    nlags: int,
    by: Sequence[str],
    order: Sequence[str] | str,
    layout: str = "panel",
    min_lags: int = 2,
) -> DataFrame:
    """Per series: ``n_obs``, ``lags`` allowed, and the autocorrelations as an array.

    One pass over the rows with all lags side by side; nothing is exploded.
    ``lags`` is min(nlags, n // 2 - 1); series with fewer than ``min_lags`` go.
    """
    rows = df.filter(F.col(col).isNotNull())
    mean = rows.groupBy(*by).agg(F.avg(col).alias("_mean"), F.count(col).alias("n_obs"))
    rows = attach(rows, mean, by, ["_mean", "n_obs"]).withColumn("_x", F.col(col) - F.col("_mean"))
    s = series(rows, by, order, back=nlags, layout=layout)
    lagged = s.finish(s.df.withColumns({f"_x{k}": s.shift("_x", k) for k in range(1, nlags + 1)}))
    sums = lagged.groupBy(*by).agg(
        F.max("n_obs").alias("n_obs"),
        F.sum(F.col("_x") * F.col("_x")).alias("_c0"),
        *[F.expr(f"coalesce(sum(_x * _x{k}), 0D)").alias(f"_c{k}") for k in range(1, nlags + 1)],
    )
    lags = F.least(F.lit(nlags).cast("long"), F.floor(F.col("n_obs") / 2) - 1).cast("int")
    r = F.expr(f"array({', '.join(f'try_divide(_c{k}, _c0)' for k in range(nlags + 1))})")
    return (
        sums.withColumn("lags", lags)
        .filter(F.col("lags") >= min_lags)
        .select(*by, "n_obs", "lags", F.slice(r, F.lit(1), F.col("lags") + 1).alias("r"))
    )


def acf(
    df: DataFrame,
    col: str,
    nlags: int = 20,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    layout: str = "panel",
) -> DataFrame:
    """Autocorrelations with their 95% band (Bartlett), one row per lag."""
    sums = lag_sums(df, col, nlags, by, order, layout)
    return _acf_band(sums.select(*by, "n_obs", F.posexplode("r").alias("lag", "acf")), by)


def _acf_band(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    # A series has at most nlags + 1 rows here.
    earlier = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(earlier), F.lit(0.0))
    var = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise((1 + 2 * squares) / F.col("n_obs"))
    width = Z95 * F.sqrt(var)
    out = rows.withColumns({"acf_ci_low": F.col("acf") - width, "acf_ci_hi": F.col("acf") + width})
    return out.drop("n_obs")


def partial_from_acf(r: np.ndarray) -> np.ndarray:
    """Yule-Walker partial autocorrelations (m, K + 1, or K + 1 of one series) from autocorrelations, one step per lag for all series.

    NaN beyond the lags of a series (where its autocorrelations are NaN) and
    where the earlier lags leave nothing to explain.
    """
    if r.ndim == 1:
        return partial_from_acf(r[None])[0]
    m, size = r.shape
    out = np.ones((m, size))
    phi = np.zeros((m, size))
    with np.errstate(all="ignore"):
        for k in range(1, size):
            gap = 1 - np.einsum("mi,mi->m", phi[:, 1:k], r[:, 1:k])
            last = (r[:, k] - np.einsum("mi,mi->m", phi[:, 1:k], r[:, k - 1 : 0 : -1])) / np.where(gap == 0, np.nan, gap)
            phi[:, 1:k] = phi[:, 1:k] - last[:, None] * phi[:, k - 1 : 0 : -1]
            phi[:, k] = out[:, k] = last
    return out


def _partial_batches(batches):
    for pdf in batches:
        sizes = pdf["r"].map(len).to_numpy()
        r = np.full((len(pdf), sizes.max(initial=1)), np.nan)
        r[np.arange(r.shape[1]) < sizes[:, None]] = np.concatenate([np.asarray(v, float) for v in pdf["r"]]) if len(pdf) else []
        pdf["pacf"] = [v[:n].tolist() for v, n in zip(partial_from_acf(r), sizes)]
        yield pdf


def pacf(
    df: DataFrame,
    col: str,
    nlags: int = 20,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    layout: str = "panel",
) -> DataFrame:
    """Partial autocorrelations (Yule-Walker) with their 95% band."""
    one = _with_partials(lag_sums(df, col, nlags, by, order, layout))
    return _pacf_band(one.select(*by, "n_obs", F.posexplode("pacf").alias("lag", "pacf"))).drop("n_obs")


def _with_partials(one: DataFrame) -> DataFrame:
    schema = T.StructType([*one.schema.fields, T.StructField("pacf", T.ArrayType(T.DoubleType()))])
    return one.mapInPandas(_partial_batches, schema)


def _pacf_band(rows: DataFrame) -> DataFrame:
    width = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(Z95 / F.sqrt("n_obs"))
    return rows.withColumns({"pacf_ci_low": F.col("pacf") - width, "pacf_ci_hi": F.col("pacf") + width})


def acf_pacf(
    df: DataFrame,
    col: str,
    nlags: int = 20,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    layout: str = "panel",
) -> DataFrame:
    """Both tables side by side, one row per lag, from one pass over the rows."""
    one = _with_partials(lag_sums(df, col, nlags, by, order, layout))
    pairs = F.arrays_zip(F.col("r").alias("acf"), F.col("pacf"))
    rows = one.select(*by, "n_obs", F.posexplode(pairs).alias("lag", "_p"))
    rows = rows.select(*by, "n_obs", "lag", F.col("_p.acf").alias("acf"), F.col("_p.pacf").alias("pacf"))
    return _acf_band(_pacf_band(rows), by).select(
        *by, "lag", "acf", "acf_ci_low", "acf_ci_hi", "pacf", "pacf_ci_low", "pacf_ci_hi"
    )


def ljung_box(
    res: DataFrame,
    by: Sequence[str],
    order: Sequence[str] | str,
    col: str = "residual",
    max_lags: int = 10,
    squared: bool = True,
    layout: str = "panel",
) -> DataFrame:
    """Portmanteau test, by default on squared residuals (ARCH effects)."""
    x = F.col(col)
    rows = res.withColumn("_sq", x * x if squared else x)
    sums = lag_sums(rows, "_sq", max_lags, by, order, layout, min_lags=1)
    n = F.col("n_obs")
    terms = F.transform(F.slice("r", F.lit(2), F.col("lags")), lambda v, i: v * v / (n - i - 1))
    q = n * (n + 2) * F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    out = sums.withColumn("lb_stat", q)
    p = chi2_sf(F.col("lb_stat"), F.col("lags").cast("double"))
    return out.select(*by, "n_obs", "lags", "lb_stat", p.alias("p_value")).withColumn(
        "arch_effects", F.col("p_value") < 0.05
    )


def qq_points(res: DataFrame, by: Sequence[str], col: str = "residual", layout: str = "panel") -> DataFrame:
    """Sorted values against normal quantiles of Filliben's order-statistic medians."""
    rows = res.filter(F.col(col).isNotNull()).select(*by, col)
    if layout != "panel" or not by:
        # Equal values may swap places: their sorted values are the same.
        rows = rows.withColumn("_tie", F.monotonically_increasing_id())
        order = [col, "_tie"]
    else:
        order = [col]
    ranked = numbered(rows, by, order, layout, "i", "n_obs")
    i, n = F.col("i"), F.col("n_obs")
    edge = F.pow(F.lit(0.5), 1 / n)
    # 0.3175 and 0.365 are Filliben's constants.
    prob = F.when(i == n, edge).when(i == 1, 1 - edge).otherwise((i - 0.3175) / (n + 0.365))
    out = ranked.withColumn("prob", prob)
    return out.select(*by, "i", "n_obs", "prob", normal_ppf("prob").alias("theoretical"), F.col(col).alias("sample"))


def qq_line(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Slope, intercept and correlation of the straight line through the points."""
    return points.groupBy(*by).agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        corr_or_null("sample", "theoretical").alias("r"),
    )


