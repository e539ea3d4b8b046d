"""Report tables: the data behind every dashboard view, over tidy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import negative_part, positive_part, verdict
from panelwright.operators.derive import with_label
from panelwright.operators.reshape import complete, pivot_metrics, with_average
from panelwright.operators.window import flag_shocks


def forecast_timeline(fc: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """Actual and forecasts per period with split and shock flag.

    ``fc`` has (entity, model, split, period, actual, forecast, shock). Shocks
    belong to the entity, so they are flagged once per period, not per model.
    """
    series = fc.groupBy(entity, period).agg(F.max("shock").alias("shock"))
    flags = flag_shocks(series, "shock", [entity]).select(entity, period, "is_shock", "direction")
    return fc.join(flags, [entity, period])


def mark_best(perf: DataFrame, metric: str, by: Sequence[str], model: str = "model") -> DataFrame:
    """Metric rows with a flag on the best model of each group."""
    score = F.col(metric).desc_nulls_last() if metric == "R2" else F.col(metric).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(score, model)
    return perf.withColumn("best", F.row_number().over(w) == 1)


def ic_report(ic: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Information criteria per model with the best model by each criterion marked."""
    w = Window.partitionBy(*by)
    marks = {f"best_{c}": F.coalesce(F.col(c) == F.min(c).over(w), F.lit(False)) for c in ("AIC", "BIC", "AICc", "HQIC")}
    return ic.withColumns(marks)


def cv_report(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("entity", "model")) -> DataFrame:
    """Fold metrics followed by their average."""
    return with_average(folds, by, "fold", metrics)


def dm_report(dm: DataFrame, level: float = 0.05) -> DataFrame:
    """Comparison tests with a readable title and a verdict."""
    title = F.initcap(F.translate("comparison", "_", " "))
    return dm.withColumn("title", title).withColumn("verdict", verdict("p_value", level))


def irf_report(irf: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Responses with their positive and negative parts and the sign of the last one."""
    last = F.max_by("response", "horizon").over(Window.partitionBy(*by, "impulse"))
    sign = F.when(last > 0, "positive").when(last < 0, "negative").otherwise("zero")
    return irf.withColumns(
        {"pos": positive_part("response"), "neg": negative_part("response"), "last_sign": sign}
    )


def cross_entity_grid(
    perf: DataFrame,
    metric: str,
    models: Sequence[str],
    labels: DataFrame | Mapping[str, str],
    split: str | None = "test",
    entity: str = "entity",
) -> DataFrame:
    """One row per entity, one column per model; missing models are null."""
    rows = perf if split is None else perf.filter(F.col("split") == split)
    grid = complete(rows.select(entity, "model", metric), entity, "model", models)
    return with_label(pivot_metrics(grid, metric, models, [entity]), labels, code=entity, name=f"{entity}_name")


def training_evidence(loss: DataFrame, by: Sequence[str] = ("entity", "model"), epochs_max: int = 300) -> DataFrame:
    """Loss curve summary: epochs, last losses, and their ratio within bounds."""
    out = loss.groupBy(*by).agg(
        F.max("epoch").alias("epochs_run"),
        F.max_by("train_loss", "epoch").alias("final_train_loss"),
        F.max_by("val_loss", "epoch").alias("final_val_loss"),
    )
    # A train/validation ratio between 0.7 and 1.3 counts as balanced.
    ratio = F.when(F.col("final_val_loss") > 0, F.col("final_train_loss") / F.col("final_val_loss")).when(
        F.col("final_val_loss").isNotNull(), F.lit(1.0)
    )
    return (
        out.withColumn("epochs_max", F.lit(epochs_max))
        .withColumn("stopped_early", F.col("epochs_run") < epochs_max)
        .withColumn("ratio", ratio)
        .withColumn("balanced", (F.col("ratio") > 0.7) & (F.col("ratio") < 1.3))
    )
