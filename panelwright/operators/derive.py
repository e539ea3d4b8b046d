"""From record-level statements to clean, keyed, derived rows (no shuffle)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.scalar import finite, safe_ratio

# Which statement lines make up each measure.
MEASURE_LINES: dict[str, tuple[str, ...]] = {
    "total_assets": ("line_1600",),
    "total_liabilities": ("line_1400", "line_1500"),
    "current_assets": ("line_1200",),
    "current_liabilities": ("line_1500",),
    "cash": ("line_1250",),
    "inventory": ("line_1210",),
    "receivables": ("line_1230",),
    "operating_cash_flow": ("line_4100",),
    "free_cash_flow": ("line_4100", "line_4200"),
    "revenue": ("line_2110",),
    "net_income": ("line_2400",),
}

# Measures kept at record level, and those aggregated to the panel.
KEPT_MEASURES = [
    "free_cash_flow", "operating_cash_flow", "current_ratio", "quick_ratio", "cash_ratio",
    "working_capital", "total_assets", "total_liabilities", "revenue", "net_income",
    "cash", "inventory", "receivables",
]
PANEL_MEASURES = [
    "free_cash_flow", "current_ratio", "quick_ratio", "cash_ratio", "working_capital",
    "total_assets", "total_liabilities", "revenue", "net_income",
]

# Names of the activity sections.
SECTION_LABELS = {
    "A": "Agriculture & Forestry",
    "B": "Mining & Quarrying",
    "C": "Manufacturing",
    "D": "Electricity & Gas Supply",
    "E": "Water Supply & Waste",
    "F": "Construction",
    "G": "Wholesale & Retail Trade",
    "H": "Transportation & Storage",
    "I": "Accommodation & Food",
    "J": "Information & Communications",
    "K": "Financial & Insurance",
    "L": "Real Estate",
    "M": "Professional & Scientific",
    "N": "Administrative Services",
    "O": "Public Administration",
    "P": "Education",
    "Q": "Healthcare & Social",
    "R": "Arts & Entertainment",
    "S": "Other Services",
    "T": "Household Employers",
}

_PERIOD_PARTS = {"year": (1, 4), "month": (1, 7), "day": (1, 10)}


def with_period(df: DataFrame, col: str = "creation_date", name: str = "year", unit: str = "year") -> DataFrame:
    """Integer period from a string, number or date column.

    Strings and dates give ``yyyy``, ``yyyymm`` or ``yyyymmdd`` by ``unit``;
    numbers are taken as the period itself.
    """
    if col not in df.columns:
        raise ValueError(f"cannot derive a period: no column {col!r} among {df.columns}")
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.NumericType):
        return df.withColumn(name, F.col(col).cast("int"))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        c, period = F.col(col), F.year(col)
        if unit in ("month", "day"):
            period = period * 100 + F.month(c)
        if unit == "day":
            period = period * 100 + F.dayofmonth(c)
        return df.withColumn(name, period.cast("int"))
    start, length = _PERIOD_PARTS[unit]
    text = F.translate(F.substring(F.col(col).cast("string"), start, length), "-", "")
    return df.withColumn(name, text.cast("int"))


def with_entity(
    df: DataFrame, section: str = "okved_section", code: str = "okved", name: str = "industry"
) -> DataFrame:
    """Entity key: the section column, else the first two characters of the code."""
    if section in df.columns:
        return df.withColumnRenamed(section, name)
    if code in df.columns:
        return df.withColumn(name, F.substring(F.col(code).cast("string"), 1, 2))
    raise ValueError(f"no entity column: neither {section!r} nor {code!r} among {df.columns}")


def col_or_zero(df: DataFrame, name: str) -> Column:
    """The column, or zero if the table lacks it; nulls in it stay null."""
    return F.col(name).cast("double") if name in df.columns else F.lit(0.0)


def derive_measures(df: DataFrame, lines: Mapping[str, Sequence[str]] = MEASURE_LINES) -> DataFrame:
    """Add the measures, the liquidity ratios and working capital."""
    base = {m: reduce(lambda a, b: a + b, [col_or_zero(df, c) for c in cols]) for m, cols in lines.items()}
    out = df.withColumns(base)
    assets, debts = F.col("current_assets"), F.col("current_liabilities")
    return out.withColumns(
        {
            "current_ratio": safe_ratio(assets, debts),
            "quick_ratio": safe_ratio(assets - F.col("inventory"), debts),
            "cash_ratio": safe_ratio("cash", debts),
            "working_capital": assets - debts,
        }
    )


def raw_range(df: DataFrame, col: str, lo: int, hi: int, unit: str = "year") -> Column | None:
    """The rows of ``filter_period`` as a range of the raw column, which reaches the scan.

    None where the raw values don't sort like their periods: strings other than
    four-digit years, and negative bounds of fractional numbers.
    """
    dtype, c = df.schema[col].dataType, F.col(col)
    if isinstance(dtype, T.IntegralType):
        return c.between(lo, hi)
    if isinstance(dtype, T.NumericType):
        return (c >= lo) & (c < hi + 1) if lo > 0 else None
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        try:
            first, last = (_first_day(p, unit) for p in (lo, hi))
            after = last.replace(year=last.year + 1) if unit == "year" else last + timedelta(days=32 if unit == "month" else 1)
            after = after.replace(day=1) if unit == "month" else after
        except ValueError:
            return None
        return (c >= F.lit(str(first)).cast(dtype)) & (c < F.lit(str(after)).cast(dtype))
    if isinstance(dtype, T.StringType) and unit == "year" and 1000 <= lo <= hi < 9999:
        return (c >= str(lo)) & (c < str(hi + 1))
    return None


def _first_day(period: int, unit: str) -> date:
    if unit == "year":
        return date(period, 1, 1)
    if unit == "month":
        return date(period // 100, period % 100, 1)
    return date(period // 10000, period // 100 % 100, period % 100)


def filter_period(
    df: DataFrame, lo: int, hi: int, col: str = "year", strict: bool = False, raw: str | None = None, unit: str = "year"
) -> DataFrame:
    """Rows with a period in the closed range; ``strict`` raises if none is left.

    ``raw`` names the column that the period was derived from (by ``unit``, see
    ``with_period``): the range is then asked of it too, so that the scan can
    leave out whole row groups and files.
    """
    out = df.filter(F.col(col).between(lo, hi))
    early = raw_range(df, raw, lo, hi, unit) if raw is not None and raw in df.columns else None
    if early is not None:
        out = out.filter(early)
    if strict and out.isEmpty():
        raise ValueError(f"no rows with {col} between {lo} and {hi}")
    return out


def keep(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Only the listed columns, those that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def any_nonzero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where at least one measure is neither null nor zero."""
    tests = [F.coalesce(F.col(c) != 0, F.lit(False)) for c in cols]
    return df.filter(reduce(lambda a, b: a | b, tests))


def for_entities(df: DataFrame, ids: str | Sequence[str], col: str = "industry") -> DataFrame:
    return df.filter(F.col(col).isin([ids] if isinstance(ids, str) else list(ids)))


def feature_columns(
    df: DataFrame, target: str | None = None, period: str | None = None, containing: Sequence[str] = ()
) -> list[str]:
    """Numeric columns but for target and period; optionally by name part."""
    names = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (target, period)
    ]
    return [n for n in names if any(p in n for p in containing)] if containing else names


def priority_features(cols: Sequence[str], k: int = 5) -> list[str]:
    """The first ``k`` names, factor and lag columns before the others."""
    return sorted(cols, key=lambda c: not ("dfm" in c or "lag" in c))[:k]


def with_label(
    df: DataFrame, labels: DataFrame | Mapping[str, str], code: str = "industry", name: str = "industry_name"
) -> DataFrame:
    """Add a label looked up by code; unknown codes are their own label.

    A mapping becomes a literal map in the plan. A label table is left-joined
    and the planner broadcasts it if its measured size allows.
    """
    if isinstance(labels, Mapping):
        pairs = [F.lit(x) for kv in labels.items() for x in kv]
        found = F.try_element_at(F.create_map(*pairs), F.col(code)) if pairs else F.lit(None).cast("string")
        return df.withColumn(name, F.coalesce(found, F.col(code).cast("string")))
    key, label = labels.columns[:2]
    looked = labels.select(F.col(key).alias("_code"), F.col(label).alias("_label"))
    return (
        df.join(looked, F.col(code) == F.col("_code"), "left")
        .withColumn(name, F.coalesce(F.col("_label"), F.col(code).cast("string")))
        .drop("_code", "_label")
    )


def clean_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})


def dropna(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


def with_status(df: DataFrame, by: Sequence[str], col: str, min_rows: int = 4) -> DataFrame:
    """One row per series: size and whether it can be modelled, as a status."""
    n = F.count(col)
    spread = F.max(col) - F.min(col)
    return df.groupBy(*by).agg(
        n.alias("n_obs"),
        F.when(n < min_rows, "too few observations")
        .when(spread == 0, "constant series")
        .otherwise("ok")
        .alias("status"),
    )
