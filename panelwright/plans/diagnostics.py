"""The full diagnostic set of every entity and model, as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.acf import acf_pacf, qq_points
from panelwright.operators.aggregate import correlation, covariance, residual_histogram
from panelwright.operators.residual_tests import residual_report
from panelwright.operators.window import decompose


def run_diagnostics(
    train: DataFrame,
    residuals: DataFrame | None,
    target: str,
    liquidity: Sequence[str],
    entity: str = "industry",
    period: str = "year",
    season: int = 1,
    nlags: int = 20,
    min_residuals: int = 5,
) -> dict[str, DataFrame]:
    """Lazily built tables by name; ``manifest`` lists which entity is in which.

    ``residuals`` has (entity, model, period, residual). Series with fewer than
    ``min_residuals`` residuals are left out of the residual tables.
    """
    by = [entity]
    tables = {
        "seasonal_decomposition": decompose(train, target, season, by, period),
        "acf_pacf": acf_pacf(train, target, nlags, by, period),
        "covariance": covariance(train, liquidity, by),
        "correlation": correlation(train, liquidity, by),
    }
    if residuals is not None:
        keys = [entity, "model"]
        res = residuals.filter(F.col("residual").isNotNull()).select(*keys, period, "residual")
        enough = res.groupBy(*keys).agg(F.count("residual").alias("_n")).filter(F.col("_n") >= min_residuals)
        res = res.join(enough.select(*keys), keys, "left_semi")
        tables["residual_tests"] = residual_report(res, keys, period)
        tables["residual_acf_pacf"] = acf_pacf(res, "residual", nlags, keys, period)
        tables["residual_histogram"] = residual_histogram(res, keys)
        tables["residual_quantiles"] = qq_points(res, keys)
    tables["manifest"] = manifest(tables, entity)
    return tables


def manifest(tables: dict[str, DataFrame], entity: str = "industry") -> DataFrame:
    """Rows per (entity, model, table); the model is null for series-level tables."""
    parts = []
    for name, df in tables.items():
        model = F.col("model") if "model" in df.columns else F.lit(None).cast("string")
        keyed = df.select(entity, model.alias("model"), F.lit(name).alias("table"))
        parts.append(keyed.groupBy(entity, "model", "table").agg(F.count(F.lit(1)).alias("n_rows")))
    return reduce(lambda a, b: a.unionByName(b), parts)
