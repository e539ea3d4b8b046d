"""From statements to the entity-by-period panel and its feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelwright.operators import derive as d
from panelwright.operators.aggregate import aggregate_panel
from panelwright.operators.window import add_lags

# The liquidity measures, and the columns that get lags.
LIQUIDITY = ["current_ratio", "quick_ratio", "cash_ratio"]
TARGET = "free_cash_flow"
LAGGED = [TARGET, *LIQUIDITY, "liquidity_factor_dfm", "liquidity_shock_dfm"]


def clean_statements(
    df: DataFrame, lo: int | None = None, hi: int | None = None, unit: str = "year", date: str = "creation_date"
) -> DataFrame:
    """Keyed, derived, filtered statement rows: a single narrow stage."""
    rows = d.derive_measures(d.with_entity(d.with_period(df, date, unit=unit)))
    if lo is not None and hi is not None:
        rows = d.filter_period(rows, lo, hi, raw=date, unit=unit)
    rows = d.keep(rows, ["year", "industry", *d.KEPT_MEASURES])
    return d.any_nonzero(rows, [c for c in d.KEPT_MEASURES if c in rows.columns])


def build_panel(df: DataFrame, unit: str = "year", lo: int | None = None, hi: int | None = None, **options) -> DataFrame:
    """Statements to panel: medians and record counts per (period, entity)."""
    return aggregate_panel(clean_statements(df, lo, hi, unit), ["year", "industry"], **options)


def lagged_panel(panel: DataFrame, n_lags: int = 2, cols: Sequence[str] = tuple(LAGGED)) -> DataFrame:
    return add_lags(panel, [c for c in cols if c in panel.columns], n_lags)
