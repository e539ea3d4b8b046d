"""Joins, unions and reshaping of tidy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.impute import attach


def align(actual: DataFrame, forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actual and forecast rows that exist on both sides."""
    return actual.join(forecast, list(keys), "inner")


def complete(df: DataFrame, a: str, b: str, b_values: Sequence[str]) -> DataFrame:
    """Every value of ``a`` with every listed value of ``b``; missing cells are null.

    ``b_values`` is a short list of names (models), so each distinct ``a`` is
    exploded over it; no cross join.
    """
    grid = df.select(a).distinct().withColumn(b, F.explode(F.array(*[F.lit(v) for v in b_values])))
    return attach(grid, df, [a, b], [c for c in df.columns if c not in (a, b)])


def in_periods(df: DataFrame, periods: DataFrame, col: str = "year") -> DataFrame:
    """Rows whose period occurs in the other table (semi-join)."""
    return df.join(periods.select(col), [col], "left_semi")


def pairs_of_models(
    fc: DataFrame, m1: str, m2: str, keys: Sequence[str], model: str = "model", forecast: str = "forecast"
) -> DataFrame:
    """Forecasts of two models next to each other, for rows both have."""
    left = fc.filter(F.col(model) == m1).select(*keys, "actual", F.col(forecast).alias("forecast_1"))
    right = fc.filter(F.col(model) == m2).select(*keys, F.col(forecast).alias("forecast_2"))
    return left.join(right, list(keys))


def order_panel(df: DataFrame, by: Sequence[str] = ("industry", "year")) -> DataFrame:
    """Total order, for the last step before a sink."""
    return df.orderBy(*by)


def sorted_keys(df: DataFrame, col: str = "industry") -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def top_features(df: DataFrame, by: Sequence[str], name: str, score: str, k: int = 5) -> DataFrame:
    """The k best-scored rows of each group, with their rank.

    The planner keeps k candidates per group in each task before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(name))
    ranked = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(*by, "rank", name, score)


def full_timeline(parts: Mapping[str, DataFrame], split: str = "split") -> DataFrame:
    """Stack the splits into one table labelled by split."""
    labelled = [df.withColumn(split, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def with_average(folds: DataFrame, by: Sequence[str], fold: str, metrics: Sequence[str]) -> DataFrame:
    """Fold rows plus one ``Average`` row per group, from one grouping-sets pass."""
    sets = [[*by, fold], list(by)]
    label = F.when(F.grouping(fold) == 1, F.lit("Average")).otherwise(F.concat(F.lit("Fold "), F.col(fold)))
    return (
        folds.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, fold]])
        .agg(label.alias("label"), *[F.avg(m).alias(m) for m in metrics])
        .drop(fold)
    )


def tidy(df: DataFrame, by: Sequence[str], structs: Sequence[str], key: str = "split") -> DataFrame:
    """Struct columns to rows, labelled by column name."""
    cells = F.array(*[F.struct(F.lit(s).alias(key), F.col(s).alias("_v")) for s in structs])
    return df.select(*by, F.inline(cells)).select(*by, key, "_v.*")


def pivot_metrics(
    perf: DataFrame, metric: str, models: Sequence[str], by: Sequence[str] = ("entity",), model: str = "model"
) -> DataFrame:
    """One column per model; the models are named, so no extra pass finds them."""
    return perf.groupBy(*by).pivot(model, list(models)).agg(F.max(metric))


def matrix_to_long(df: DataFrame, row: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A matrix with one column per variable to one row per cell."""
    return df.unpivot([*by, row], list(cols), "col_var", "value").withColumnRenamed(row, "row_var")


def array_to_rows(df: DataFrame, by: Sequence[str], col: str, index: str = "step", value: str = "value") -> DataFrame:
    """Array elements to rows with a 1-based index."""
    return df.select(*by, F.posexplode(col).alias("_i", value)).select(*by, (F.col("_i") + 1).alias(index), value)


__all__ = [
    "align", "array_to_rows", "complete", "full_timeline", "in_periods", "matrix_to_long", "order_panel",
    "pairs_of_models", "pivot_metrics", "sorted_keys", "tidy", "top_features", "with_average",
]
