"""Piecewise-linear trend with regressors, its components and interval band."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.scalar import dot
from panelwright.operators.gram import gram, least_squares_batch, map_batches, sparse_fit, unpack_batch
from panelwright.operators.impute import attach
from panelwright.operators.series import numbered
from panelwright.session import settle

# Fixed value: changepoints lie in the first 80% of the training part.
CHANGE_RANGE = 0.8


def trend_regression(
    df: DataFrame,
    target: str,
    regressors: Sequence[str] = (),
    by: Sequence[str] = ("industry",),
    order: str = "year",
    train: Column | str | None = None,
    changepoints: int = 3,
    level: float = 0.8,
    ridge: float = 1e-3,
    layout: str = "panel",
    sparse: bool = False,
) -> DataFrame:
    """Fit on the training rows, predict all rows: trend, effect, yhat and band.

    The trend is a line with ``changepoints`` evenly spaced kinks; kinks and
    regressors are shrunk by a small ridge penalty. With ``sparse`` only the kinks
    that pay are kept (many may be offered, see ``sparse_fit``), and they, the
    line and the regressors are fitted without shrinkage.
    At most five regressors are meant (see ``priority_features``); they are
    standardised on the training rows.
    """
    rows, fits, trend_terms, reg_terms, _ = _fit(df, target, regressors, by, order, train, changepoints, ridge, layout, sparse)
    by, k = list(by), len(trend_terms) + len(reg_terms)
    rows = attach(rows, fits, by, ["_b", "_sd"])
    b = [F.col("_b")[i] for i in range(k)]
    z = NormalDist().inv_cdf(0.5 + level / 2)
    out = rows.withColumn("trend", dot(b[: len(trend_terms)], trend_terms) * F.col("_scale"))
    out = out.withColumn("effect", dot(b[len(trend_terms) :], reg_terms) * F.col("_scale"))
    out = out.withColumn("yhat", F.col("trend") + F.col("effect"))
    band = F.lit(z) * F.col("_sd") * F.col("_scale")
    return out.select(
        *by, order, "is_train", "actual", "trend", "effect", "yhat",
        (F.col("yhat") - band).alias("yhat_lower"), (F.col("yhat") + band).alias("yhat_upper"),
    )


def trend_changepoints(
    df: DataFrame,
    target: str,
    regressors: Sequence[str] = (),
    by: Sequence[str] = ("industry",),
    order: str = "year",
    train: Column | str | None = None,
    changepoints: int = 25,
    layout: str = "panel",
) -> DataFrame:
    """The kinks that the sparse fit chose: (by, changepoint, period, delta).

    ``period`` is the last period before the slope changes by ``delta`` a row.
    """
    by = list(by)
    rows, fits, terms, _, kinks = _fit(df, target, regressors, by, order, train, changepoints, 0.0, layout, True)
    place = F.array(*[F.lit(float(k)) for k in kinks])
    found = fits.select(*by, F.posexplode(F.slice("_b", 3, len(kinks))).alias("_j", "_d")).filter("_d <> 0")
    found = found.select(*by, (F.col("_j") + 1).alias("changepoint"), place[F.col("_j")].alias("_at"), "_d")
    spans = rows.filter("is_train").groupBy(*by).agg(F.max("_t").alias("_last"), F.first("_scale").alias("_scale"))
    found = attach(found, spans, by, ["_last", "_scale"])
    found = found.withColumn("_t", F.floor(F.col("_at") * (F.col("_last") - 1) + 1e-9) + 1)
    found = attach(found, rows.select(*by, "_t", F.col(order).alias("period")), [*by, "_t"], ["period"])
    return found.select(*by, "changepoint", "period", (F.col("_d") * F.col("_scale") / (F.col("_last") - 1)).alias("delta"))


def _fit(
    df: DataFrame, target: str, regressors: Sequence[str], by: Sequence[str], order: str, train: Column | str | None, changepoints: int,
    ridge: float, layout: str, sparse: bool,
) -> tuple[DataFrame, DataFrame, list[Column], list[Column], list[float]]:
    """Written rows, coefficients (by, _b, _sd) and the terms they belong to."""
    by = list(by)
    is_train = F.expr(train) if isinstance(train, str) else F.lit(True) if train is None else train
    regs = list(regressors)
    rows = df.select(
        *dict.fromkeys([*by, order]), F.col(target).cast("double").alias("actual"),
        is_train.alias("is_train"), *[F.col(c).cast("double").alias(f"_r{i}") for i, c in enumerate(regs)],
    )
    rows = numbered(rows, by, order, layout, "_t", "_n")

    def seen(c: str) -> Column:
        return F.when(F.col("is_train"), F.col(c))

    stats = rows.groupBy(*by).agg(
        F.max(seen("_t")).alias("_last"),
        F.max(F.abs(seen("actual"))).alias("_scale"),
        *[F.avg(seen(f"_r{i}")).alias(f"_m{i}") for i in range(len(regs))],
        *[F.stddev_pop(seen(f"_r{i}")).alias(f"_s{i}") for i in range(len(regs))],
    )
    names = ["_last", "_scale", *[f"_{a}{i}" for i in range(len(regs)) for a in "ms"]]
    rows = attach(rows, stats, by, names)
    clock = (F.col("_t") - 1) / F.greatest(F.col("_last") - 1, F.lit(1))
    kinks = [CHANGE_RANGE * (j + 1) / (changepoints + 1) for j in range(changepoints)]
    trend_terms = [F.lit(1.0), F.col("_clock"), *[F.greatest(F.col("_clock") - k, F.lit(0.0)) for k in kinks]]
    scale = F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1.0)
    scaled = {
        f"_r{i}": F.coalesce(
            (F.col(f"_r{i}") - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0), F.lit(0.0)
        )
        for i in range(len(regs))
    }
    rows = rows.withColumns({**scaled, "_clock": clock, "_scale": scale})
    rows = settle(rows.drop(*[n for n in names if n != "_scale"], "_n"), "trend-rows")
    reg_terms = [F.col(f"_r{i}") for i in range(len(regs))]
    k = len(trend_terms) + len(regs)
    moments = gram(rows, by, [*trend_terms, *reg_terms, F.col("actual") / F.col("_scale")], where=F.col("is_train"))
    penalty = np.array([0.0, 0.0] + [ridge] * (k - 2))
    schema = T.StructType(
        [*[rows.schema[c] for c in by], T.StructField("_b", T.ArrayType(T.DoubleType())), T.StructField("_sd", T.DoubleType())]
    )

    lines = len(trend_terms)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = unpack_batch(pdf["g"], k + 1)
        n = pdf["n"].to_numpy(float)
        xtx, xty, yy = g[:, :k, :k], g[:, :k, k], g[:, k, k]
        if sparse:
            kink = (np.arange(k) >= 2) & (np.arange(k) < lines)
            beta, rss, chosen = sparse_fit(xtx, xty, yy, n, kink)
            return pdf[by].assign(_b=list(beta.tolist()), _sd=np.sqrt(np.maximum(rss, 0) / np.maximum(n - chosen.sum(axis=1), 1)))
        shrunk = xtx + (n[:, None, None] * np.diag(penalty)[None])
        beta = least_squares_batch(shrunk, xty)
        rss = yy - 2 * np.einsum("mi,mi->m", beta, xty) + np.einsum("mi,mij,mj->m", beta, xtx, beta)
        dof = np.maximum(n - k, 1)
        return pdf[by].assign(_b=list(beta.tolist()), _sd=np.sqrt(np.maximum(rss, 0) / dof))

    return rows, settle(map_batches(moments, solve, schema), "trend-fits"), trend_terms, reg_terms, kinks
