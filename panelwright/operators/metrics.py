"""Forecast accuracy, model comparison and selection on tidy forecast tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.special import normal_two_sided

# Fixed value: stands in for a zero denominator in the symmetric percentage error.
SMAPE_FLOOR = 1e-8

METRICS = ["MSE", "RMSE", "MAE", "MAPE", "SMAPE", "MSRE", "R2"]
SEQUENCE_METRICS = ["MSE", "RMSE", "MAE", "MAPE", "SMAPE", "R2"]


def forecast_metrics(
    fc: DataFrame,
    by: Sequence[str],
    actual: str = "actual",
    forecast: str = "forecast",
    r2_const: str = "score",
    msre: bool = True,
) -> DataFrame:
    """All error measures per group in one aggregation.

    Percentage errors skip rows whose actual is zero. For a constant actual,
    R2 is 1 or 0 (perfect or not) with ``r2_const="score"`` and null with
    ``"null"``.
    """
    a, f = F.col(actual), F.col(forecast)
    err = a - f
    rel = F.when(a != 0, err / a)
    both = F.abs(a) + F.abs(f)
    sym = 2 * F.abs(err) / F.when(both == 0, F.lit(SMAPE_FLOOR)).otherwise(both)
    sums = fc.filter(a.isNotNull() & f.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg(err * err).alias("MSE"),
        F.avg(F.abs(err)).alias("MAE"),
        (F.avg(F.abs(rel)) * 100).alias("MAPE"),
        (F.avg(sym) * 100).alias("SMAPE"),
        F.avg(rel * rel).alias("MSRE"),
        F.var_pop(a).alias("_var"),
        F.min(a).alias("_min"),
        F.max(a).alias("_max"),
    )
    constant = F.col("_min") == F.col("_max")
    if r2_const == "null":
        flat = F.lit(None).cast("double")
    else:
        flat = F.when(F.col("MSE") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(constant, flat).otherwise(1 - F.col("MSE") / F.col("_var"))
    names = METRICS if msre else SEQUENCE_METRICS
    out = sums.withColumn("RMSE", F.sqrt("MSE")).withColumn("R2", r2)
    return out.select(*by, "n_obs", *names)


def diebold_mariano(
    fc: DataFrame,
    pairs: Sequence[tuple[str, str]],
    by: Sequence[str] = ("entity",),
    order: str = "period",
    model: str = "model",
    actual: str = "actual",
    forecast: str = "forecast",
) -> DataFrame:
    """Equal-accuracy test of model pairs on their common rows.

    One aggregation puts the models of a row side by side (a pivot over the
    named models), so no self-join is needed.
    """
    names = sorted({m for p in pairs for m in p})
    side = (
        fc.filter(F.col(model).isin(names))
        .groupBy(*by, order)
        .agg(
            F.max(actual).alias("_a"),
            *[F.max(F.when(F.col(model) == m, F.col(forecast))).alias(f"_f{i}") for i, m in enumerate(names)],
        )
    )

    def loss(m: str) -> Column:
        e = F.col("_a") - F.col(f"_f{names.index(m)}")
        return e * e

    diffs = F.array(
        *[F.struct(F.lit(f"{m1}_vs_{m2}").alias("comparison"), (loss(m1) - loss(m2)).alias("d")) for m1, m2 in pairs]
    )
    d = F.col("d")
    stats = (
        side.select(*by, F.inline(diffs))
        .filter(d.isNotNull())
        .groupBy(*by, "comparison")
        .agg(
            F.count(d).alias("n_obs"),
            F.avg(d).alias("_mean"),
            F.var_samp(d).alias("_var"),
            (F.min(d) == F.max(d)).alias("_flat"),
        )
    )
    stat = F.when(F.col("_flat"), F.lit(0.0)).otherwise(F.col("_mean") / F.sqrt(F.col("_var") / F.col("n_obs")))
    out = stats.withColumn("DM_stat", stat)
    p = F.when(F.col("_flat"), F.lit(1.0)).otherwise(normal_two_sided(F.col("DM_stat")))
    return out.select(*by, "comparison", "n_obs", "DM_stat", p.alias("p_value"))


def cv_average(folds: DataFrame, by: Sequence[str], metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Mean of each metric over the folds that have it."""
    return folds.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def best_model(
    perf: DataFrame, metric: str, by: Sequence[str] = ("entity",), model: str = "model", largest: bool | None = None
) -> DataFrame:
    """The winning model per group: smallest metric, or largest for R2.

    Equal scores go to the first model by name.
    """
    largest = metric == "R2" if largest is None else largest
    score = -F.col(metric) if largest else F.col(metric)
    best = F.min(F.when(F.col(metric).isNotNull(), F.struct(score.alias("s"), F.col(model).alias("m"))))
    return (
        perf.groupBy(*by)
        .agg(best.alias("_best"))
        .select(
            *by,
            F.lit(metric).alias("metric"),
            F.col("_best.m").alias("best_model"),
            (-F.col("_best.s") if largest else F.col("_best.s")).alias("best_value"),
        )
    )


def information_criteria(llf: Column, k: Column, n: Column) -> dict[str, Column]:
    """AIC, BIC, AICc and HQIC from log-likelihood, parameters and sample size."""
    aic = 2 * k - 2 * llf
    small = n - k - 1
    return {
        "AIC": aic,
        "BIC": k * F.log(n) - 2 * llf,
        "AICc": F.when(small > 0, aic + 2 * k * (k + 1) / small),
        "HQIC": F.when(n > 1, 2 * k * F.log(F.log(n)) - 2 * llf),
        "LLF": llf,
    }


def gaussian_llf(rss: Column, n: Column) -> Column:
    """Log-likelihood of a least-squares fit at its own variance."""
    return -n / 2 * (F.log(2 * F.pi() * rss / n) + 1)
