"""Tests on residuals: variance, normality, autocorrelation, and their report."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalar import dot, dw_band
from panelwright.functions.special import chi2_sf_np, f_sf_np
from panelwright.operators.acf import ljung_box
from panelwright.operators.gram import gram, least_squares, map_rows, unpack
from panelwright.operators.impute import attach, standardize
from panelwright.operators.series import numbered
from panelwright.operators.window import durbin_watson
from panelwright.session import settle

_OUT = "lm_stat double, p_value double, f_stat double, f_p_value double, df int"


def _variance_test(row: dict) -> dict:
    g = np.asarray(row["g"], float)
    k = int((np.sqrt(8 * len(g) + 1) - 1) / 2) - 1
    n = int(row["n"])
    full = unpack(g, k + 1)
    xtx, xty, yy = full[:k, :k], full[:k, k], full[k, k]
    if n < 2:
        return {}
    beta, rank, _ = least_squares(xtx, xty)
    tss = yy - xty[0] ** 2 / n
    if tss <= 1e-14 * yy or n <= rank:
        return {}
    rss = max(yy - beta @ xty, 0.0)
    df = rank - 1
    lm = n * (1 - rss / tss)
    f = ((tss - rss) / df) / (rss / (n - rank)) if df and rss else np.nan
    return {
        "lm_stat": float(lm),
        "p_value": float(chi2_sf_np(lm, df)[()]),
        "f_stat": float(f) if np.isfinite(f) else None,
        "f_p_value": float(f_sf_np(f, df, n - rank)[()]) if np.isfinite(f) else None,
        "df": df,
    }


def _regressors(res, by, order, col, exog, layout):
    """Rows with the auxiliary regressors: a centred time trend and its square, or exog."""
    rows = res.filter(F.col(col).isNotNull() & ~F.isnan(col))
    if exog:
        return _whitened(rows, by, exog)
    rows = numbered(rows, by, order, layout, "_t", "_n")
    rows = rows.withColumn("_s", (2 * F.col("_t") - F.col("_n") - 1) / F.col("_n"))
    return rows, [F.col("_s"), F.col("_s") * F.col("_s")]


def _whitened(rows, by, exog):
    """Regressors turned into uncorrelated ones, per group.

    The tests only depend on the space the regressors (and their products) span.
    Uncorrelated columns span the same space, and their moments are well
    conditioned even if the given columns nearly coincide.
    """
    k = len(exog)
    rows = standardize(rows, exog, by, suffix="_std")
    std = [F.col(f"{c}_std") for c in exog]

    def turn(row: dict) -> dict:
        w, v = np.linalg.eigh(unpack(row["g"], k) / max(int(row["n"]), 1))
        size = np.where(w > 1e-13 * max(w[-1], 1e-300), 1 / np.sqrt(np.where(w > 0, w, 1.0)), 0.0)
        return {"_turn": (v * size).T.ravel().tolist()}

    turned = map_rows(gram(rows, by, std), turn, "_turn array<double>", by)
    rows = attach(rows, turned, by, ["_turn"])
    mixed = {f"_e{i}": dot([F.col("_turn")[i * k + j] for j in range(k)], std) for i in range(k)}
    return rows.withColumns(mixed), [F.col(c) for c in mixed]


def _run(rows, by, xs, col):
    # In units of the mean squared residual the statistics are the same and well scaled.
    mean = rows.groupBy(*by).agg(F.avg(F.col(col) * F.col(col)).alias("_ms"))
    rows = attach(rows, mean, by, ["_ms"])
    y = F.when(F.col("_ms") > 0, F.col(col) * F.col(col) / F.col("_ms")).otherwise(0.0)
    moments = gram(rows, by, [F.lit(1.0), *xs, y])
    out = map_rows(moments, _variance_test, _OUT, [*by, "n"])
    return out.withColumnRenamed("n", "n_obs").withColumn("heteroskedastic", F.col("p_value") < 0.05)


def breusch_pagan(
    res: DataFrame,
    by: Sequence[str],
    order: Sequence[str] | str,
    col: str = "residual",
    exog: Sequence[str] | None = None,
    layout: str = "panel",
) -> DataFrame:
    """Studentised test of squared residuals on a quadratic trend or on ``exog``."""
    rows, xs = _regressors(res, by, order, col, exog, layout)
    return _run(rows, by, xs, col)


def white_test(
    res: DataFrame,
    by: Sequence[str],
    order: Sequence[str] | str,
    col: str = "residual",
    exog: Sequence[str] | None = None,
    layout: str = "panel",
) -> DataFrame:
    """Test of squared residuals on all pairwise products of the regressors."""
    rows, xs = _regressors(res, by, order, col, exog, layout)
    base = [F.lit(1.0), *xs]
    products = [base[i] * base[j] for i in range(len(base)) for j in range(i, len(base)) if j]
    return _run(rows, by, products, col)


def jarque_bera(res: DataFrame, by: Sequence[str], col: str = "residual") -> DataFrame:
    """Normality test from population skewness and excess kurtosis."""
    x = F.col(col)
    out = (
        res.filter(x.isNotNull() & ~F.isnan(x))
        .groupBy(*by)
        .agg(F.count(x).alias("n_obs"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))
    )
    stat = F.col("n_obs") / 6 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4)
    out = out.withColumn("statistic", stat).withColumn("p_value", F.exp(-F.col("statistic") / 2))
    return out.withColumn("normal", F.col("p_value") >= 0.05)


def residual_report(
    res: DataFrame, by: Sequence[str], order: Sequence[str] | str, col: str = "residual", layout: str = "panel"
) -> DataFrame:
    """All residual tests of a series in one row, one struct per test."""
    by = list(by)
    order_cols = [order] if isinstance(order, str) else list(order)
    rows = settle(res.select(*dict.fromkeys([*by, *order_cols, col])), "residuals")

    def pack(df, name, *cols):
        return df.select(*by, F.struct(*cols).alias(name))

    tests = ("lm_stat", "p_value", "f_stat", "f_p_value", "heteroskedastic")
    parts = [
        pack(breusch_pagan(rows, by, order_cols, col, layout=layout), "breusch_pagan", *tests),
        pack(white_test(rows, by, order_cols, col, layout=layout), "white", *tests),
        pack(
            ljung_box(rows, by, order_cols, col, layout=layout),
            "ljung_box_squared", "lb_stat", "p_value", "lags", "arch_effects",
        ),
        pack(
            durbin_watson(rows, by, order_cols, col, layout=layout),
            "durbin_watson", F.col("dw").alias("statistic"), dw_band("dw").alias("interpretation"),
        ),
        pack(jarque_bera(rows, by, col), "jarque_bera", "statistic", "p_value", "normal"),
    ]
    out = rows.groupBy(*by).agg(F.count(col).alias("n_obs"))
    for part in parts:
        out = attach(out, part, by, [part.columns[-1]])
    return out
