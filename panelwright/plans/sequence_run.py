"""The second model family: trend with regressors, and window forecasters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.derive import SECTION_LABELS, feature_columns, for_entities, priority_features, with_label
from panelwright.operators.impute import impute_median
from panelwright.operators.metrics import forecast_metrics
from panelwright.operators.sequence import sequence_forecast
from panelwright.operators.trend import trend_regression
from panelwright.operators.window import time_split
from panelwright.plans.panel import TARGET
from panelwright.session import settle

MODELS = ("trend", "window", "window_uni")


def run_sequence_models(
    features: DataFrame,
    target: str = TARGET,
    entity: str = "industry",
    period: str = "year",
    models: Sequence[str] = MODELS,
    entities: Sequence[str] | None = None,
    labels: DataFrame | Mapping[str, str] | None = None,
    n_steps: int = 2,
    epochs: int = 300,
    min_train: int = 4,
) -> dict[str, DataFrame]:
    """Tables status (a row per entity), forecasts, metrics, losses, components and features.

    Nulls are filled by each entity's own medians over its whole history, target
    nulls by zero. The multivariate window model scales on all rows, the
    univariate one on its training rows, and predicts one step ahead.
    """
    by = [entity]
    rows = features if entities is None else for_entities(features, entities, entity)
    feats = feature_columns(rows, target, period)
    rows = time_split(impute_median(rows, feats, by, zero=[target]), by, period)
    rows = settle(rows, "sequence-panel")
    n_train = F.count(F.when(F.col("split") == "train", 1))
    refused = F.when(F.col("n_train") < min_train, "too few observations").otherwise("ok")
    status = settle(rows.groupBy(entity).agg(n_train.alias("n_train")).withColumn("status", refused), "sequence-status")
    rows = rows.join(status.filter("status = 'ok'").select(entity), [entity], "left_semi")

    forecasts, losses, used = [], [], []
    out: dict[str, DataFrame] = {"status": status}
    if "trend" in models:
        regs = priority_features(feats, 5)
        comp = settle(
            trend_regression(rows, target, regs, by, period, F.col("split") == "train").withColumn(
                "split", F.when(F.col("is_train"), "train").otherwise("test")
            ),
            "components",
        )
        out["components"] = comp
        forecasts.append(
            comp.select(entity, F.lit("trend").alias("model"), "split", period, "actual", F.col("yhat").alias("forecast"))
        )
        used.append(("trend", regs))
    if "window" in models:
        fc, loss = sequence_forecast(
            rows, target, feats, by, period, n_steps=n_steps, fit_on="all", recursive=True, epochs=epochs,
            min_train=min_train, model="window",
        )
        forecasts.append(fc)
        losses.append(loss)
        used.append(("window", [target, *feats]))
    if "window_uni" in models:
        fc, loss = sequence_forecast(
            rows, target, (), by, period, n_steps=n_steps, fit_on="train", recursive=False, epochs=epochs,
            min_train=min_train, model="window_uni",
        )
        forecasts.append(fc)
        losses.append(loss)
        used.append(("window_uni", [target]))
    stack = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    out["forecasts"] = settle(stack(forecasts), "sequence-forecasts")
    scores = forecast_metrics(out["forecasts"], [entity, "model", "split"], r2_const="null", msre=False)
    out["metrics"] = with_label(scores, SECTION_LABELS if labels is None else labels, entity, f"{entity}_name")
    if losses:
        out["losses"] = stack(losses)
    spark = features.sparkSession
    out["features"] = spark.createDataFrame(
        [(m, i + 1, f) for m, names in used for i, f in enumerate(names)], "model string, position int, feature string"
    )
    return out
