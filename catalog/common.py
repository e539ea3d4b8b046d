"""Inputs shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.derive import PANEL_MEASURES
from panelwright.plans.panel import build_panel
from panelwright.session import shared_folder
from panelwright.sources.star import statements


def month_panel(spark: SparkSession, sf: str, entity: str = "segment") -> DataFrame:
    return build_panel(statements(spark, sf, entity), unit="month")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns: summation order varies between runs and engines."""
    return df.select(
        *[
            F.round(f.name, special.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


ROUNDED_PANEL = ", ".join(f"round({m}, 6) AS {m}" for m in PANEL_MEASURES)
