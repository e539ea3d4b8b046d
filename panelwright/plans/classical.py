"""The econometric run: factors, lags, models, tests and comparisons in one job graph.

There is no loop over entities or models: both are part of the keys. A series
that cannot be modelled has a status row and no forecasts; it never stops the run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import arma as ar
from panelwright.operators.derive import feature_columns, for_entities
from panelwright.operators.factor import liquidity_factors
from panelwright.operators.impute import attach, impute_median
from panelwright.operators.metrics import METRICS, cv_average, diebold_mariano, forecast_metrics
from panelwright.operators.unitroot import adf
from panelwright.operators.var import fit_var, impulse_response
from panelwright.operators.window import time_split
from panelwright.plans.panel import LIQUIDITY, TARGET, lagged_panel
from panelwright.session import settle

# Smallest training part, and the model pairs that are compared.
MIN_TRAIN = 5
COMPARISONS = [("arima", "sarimax"), ("sarima", "sarimax")]


def feature_panel(panel: DataFrame, n_lags: int = 2, liquidity: Sequence[str] = tuple(LIQUIDITY)) -> DataFrame:
    """Panel with factors and lags, written once: everything later starts here."""
    panel = settle(panel, "panel")
    return settle(lagged_panel(settle(liquidity_factors(panel, liquidity), "factors"), n_lags), "feature-panel")


def adf_table(panel: DataFrame, cols: Sequence[str], by: Sequence[str], order: Sequence[str] | str) -> DataFrame:
    """Unit-root tests of several columns in one run: the column joins the key.

    With ``by=[]`` the panel is pooled into one series per column.
    """
    order_cols = [order] if isinstance(order, str) else list(order)
    keys = [c for c in dict.fromkeys([*by, *order_cols])]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    long = panel.select(*keys, F.inline(cells))
    layout = "panel" if by else "blocks"
    return adf(long, "value", [*by, "column"], order_cols, layout=layout)


def run_models(
    features: DataFrame,
    target: str = TARGET,
    entity: str = "industry",
    period: str = "year",
    models: Mapping[str, ar.Arma] | None = None,
    season: int = 1,
    entities: Sequence[str] | None = None,
    criterion: str = "AIC",
    shock: str = "liquidity_shock_dfm",
    var_cols: Sequence[str] | None = None,
    cv: bool = True,
    refine: bool = True,
    d: int | None = None,
) -> dict[str, DataFrame]:
    """Fit, forecast, score and compare all models for all entities.

    Returns tidy tables: status, fits, best (with information criteria),
    forecasts, residuals, metrics, cv_folds, cv_average, dm, var, irf. Unless
    ``refine`` is off, shock terms of the best fits are estimated by conditional
    least squares; orders, and the folds, use the two-stage estimates. ``d``
    fixes the differencing order that is otherwise tested for.
    """
    by = [entity]
    rows = features if entities is None else for_entities(features, entities, entity)
    rows = time_split(rows, by, period)
    exog = feature_columns(rows, None, None, containing=("lag",))
    models = dict(models or ar.default_models(exog))
    rows = impute_median(rows, exog, [entity, "split"]) if exog else rows
    train_size = F.count(F.when(F.col("split") == "train", 1))
    small = rows.groupBy(entity).agg(train_size.alias("n_train"))
    rows = settle(attach(rows, small, by, ["n_train"]), "split-panel")
    fit_rows = rows.filter(F.col("n_train") >= MIN_TRAIN).drop("n_train")

    is_train = F.col("split") == "train"
    spec = ar.arma_rows(fit_rows, target, by, period, is_train, d, models, season)
    fits = settle(ar.fit_arma(spec), "fits")
    best = settle(ar.select_order(fits, by, criterion), "best")
    errors = None
    if refine:
        best, errors = ar.refine_shocks(spec, best)
    residuals = settle(ar.fitted_values(spec, best, errors), "residuals")
    future = ar.forecast(spec, best, shocks=errors)
    shocks = [shock] if shock in rows.columns else []
    train_part = residuals.select(
        entity, "model", F.lit("train").alias("split"), period, "actual", F.col("fitted").alias("forecast"),
        F.lit("ok").alias("status"),
    )
    test_part = future.select(entity, "model", F.lit("test").alias("split"), period, "actual", "forecast", "status")
    forecasts = train_part.unionByName(test_part)
    if shocks:
        forecasts = attach(forecasts, fit_rows.select(entity, period, shock), [entity, period], [shock])
        forecasts = forecasts.withColumnRenamed(shock, "shock")
    forecasts = settle(forecasts, "forecasts")

    skipped = small.select(
        entity, "n_train", F.when(F.col("n_train") < MIN_TRAIN, "too few training rows").otherwise("ok").alias("_s")
    )
    status = attach(skipped, spec.status.select(entity, "d", "status", "reduced"), by, ["d", "status", "reduced"])
    status = status.select(entity, "n_train", "d", F.coalesce(F.when(F.col("_s") != "ok", F.col("_s")), "status").alias("status"), "reduced")
    out = {
        "status": status,
        "fits": fits,
        "best": best,
        "forecasts": forecasts,
        "residuals": residuals,
        "metrics": forecast_metrics(forecasts, [entity, "model", "split"]),
        "dm": diebold_mariano(
            forecasts.filter("split = 'test'"),
            [p for p in COMPARISONS if set(p) <= set(models)] or [tuple(list(models)[:2])],
            by,
            period,
        )
        if len(models) > 1
        else None,
    }
    if cv:
        train = fit_rows.filter(is_train)
        folds = settle(ar.cross_validate(train, target, by, period, models, season, criterion=criterion, d=d), "cv")
        out["cv_folds"] = folds
        out["cv_average"] = cv_average(folds, [entity, "model"], METRICS)
    cols = var_cols or [c for c in [target, "liquidity_factor_dfm", *LIQUIDITY] if c in rows.columns]
    if len(cols) > 1:
        out["var"] = settle(fit_var(fit_rows.filter(is_train), cols, by, period), "var")
        out["irf"] = impulse_response(out["var"], 10, target, by)
    return {k: v for k, v in out.items() if v is not None}


def information_table(best: DataFrame, entity: str = "industry") -> DataFrame:
    """Orders and information criteria of the selected models."""
    return best.select(entity, "model", "order", "seasonal_order", "AIC", "BIC", "AICc", "HQIC", "LLF")


__all__ = ["adf_table", "feature_panel", "information_table", "run_models"]
