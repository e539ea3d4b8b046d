"""Panel aggregation, profiles, moments and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalar import corr_or_null
from panelwright.operators.derive import PANEL_MEASURES
from panelwright.operators.impute import attach
from panelwright.operators.median import exact_median, gathered

#: Sketch of a panel's groups: they are many and of a few thousand records, which the default would keep one by one.
SKETCH = 1_000


def aggregate_panel(
    df: DataFrame,
    keys: Sequence[str] = ("year", "industry"),
    measures: Sequence[str] = tuple(PANEL_MEASURES),
    count_as: str = "n_firms",
    accuracy: int | None = None,
) -> DataFrame:
    """Median of each measure and number of records per key.

    Exact by default (see ``exact_median``); with ``accuracy`` the medians are
    sketches of bounded size, in a single pass.
    """
    if accuracy is None:
        rows = gathered(df.select(*dict.fromkeys([*keys, *measures])), keys)
        return exact_median(rows, keys, measures, accuracy=SKETCH, count_as=count_as)
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(m, 0.5, accuracy).alias(m) for m in measures],
        F.count(F.lit(1)).alias(count_as),
    )


def global_series(panel: DataFrame, col: str, period: str = "year") -> DataFrame:
    """Median over all entities, one row per period."""
    return exact_median(panel.filter(F.col(col).isNotNull()), [period], [col])


def panel_profile(panel: DataFrame, entity: str = "industry", period: str = "year") -> DataFrame:
    """One row: sizes and period range of a panel."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(entity).alias("n_entities"),
        F.count_distinct(period).alias("n_periods"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    )


def split_bounds(df: DataFrame, by: Sequence[str] = (), split: str = "split", period: str = "year") -> DataFrame:
    return df.groupBy(*by, split).agg(
        F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count(F.lit(1)).alias("n_rows")
    )


def _pairs(df: DataFrame, cols: Sequence[str], by: Sequence[str], fn, prefix: str) -> DataFrame:
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    upper = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = (
        df.filter(complete)
        .groupBy(*by)
        .agg(*[fn(cols[i], cols[j]).alias(f"{prefix}_{i}_{j}") for i, j in upper])
    )
    cells = [
        F.struct(
            F.lit(cols[i]).alias("row_var"),
            F.lit(cols[j]).alias("col_var"),
            F.col(f"{prefix}_{min(i, j)}_{max(i, j)}").alias("value"),
        )
        for i in range(len(cols))
        for j in range(len(cols))
    ]
    return wide.select(*by, F.inline(F.array(*cells)))


def covariance(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sample covariance matrix over complete rows, one row per cell."""
    return _pairs(df, cols, by, F.covar_samp, "cov")


def correlation(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation matrix over complete rows, one row per cell; null where a column is constant."""
    return _pairs(df, cols, by, corr_or_null, "corr")


def residual_histogram(res: DataFrame, by: Sequence[str], col: str = "residual") -> DataFrame:
    """Density histogram of each series with the mean and deviation of its normal curve.

    The number of equal-width bins is min(30, n // 3 + 1); a constant series is
    centred in a range of width one. Empty bins are kept.
    """
    x = F.col(col)
    lo = F.min(x)
    hi = F.max(x)
    stats = (
        res.groupBy(*by)
        .agg(
            F.count(x).alias("n_obs"),
            F.when(lo == hi, lo - 0.5).otherwise(lo).alias("_lo"),
            F.when(lo == hi, hi + 0.5).otherwise(hi).alias("_hi"),
            F.avg(x).alias("mean"),
            F.stddev_pop(x).alias("sd"),
        )
        .filter(F.col("n_obs") > 0)
        .withColumn("n_bins", F.least(F.lit(30), F.floor(F.col("n_obs") / 3) + 1).cast("int"))
        .withColumn("_width", (F.col("_hi") - F.col("_lo")) / F.col("n_bins"))
    )
    rows = attach(res.filter(x.isNotNull()), stats, by, ["_lo", "_width", "n_bins"])
    bin_of = F.least(F.floor((x - F.col("_lo")) / F.col("_width")), F.col("n_bins") - 1).cast("int")
    counts = rows.groupBy(*by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("_count"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
    full = attach(grid, counts, [*by, "bin"], ["_count"])
    count = F.coalesce(F.col("_count"), F.lit(0))
    return full.select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("left_edge"),
        F.col("_width").alias("width"),
        count.cast("long").alias("n_in_bin"),
        (count / (F.col("n_obs") * F.col("_width"))).alias("density"),
        "mean",
        "sd",
    )
