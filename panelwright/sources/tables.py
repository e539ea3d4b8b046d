"""Readers and writers: statements, panels and tidy result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FORMATS = ("parquet", "csv", "json")


def absent(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there; other failures must not pass for that."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Record-level statement table; columns are pruned by what is used later."""
    return spark.read.parquet(path)


def read_panel(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Panel table, or the fallback source where the panel does not exist yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if fallback is None or not absent(error):
            raise
        return spark.read.parquet(fallback)


def write_panel(df: DataFrame, path: str, partition: str | Sequence[str] = "year", mode: str = "overwrite") -> None:
    """Panel as Parquet, one folder per period, so that period filters prune files.

    Rows are first gathered by period, which keeps the number of files near the
    number of periods; a large period is split by adaptive rebalancing.
    """
    cols = [partition] if isinstance(partition, str) else list(partition)
    df.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Tidy table to CSV (with header), JSON lines or Parquet."""
    if fmt not in _FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", optional: bool = False
) -> DataFrame:
    """Read a tidy table by its schema; an absent optional table is empty."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if not optional or not absent(error):
            raise
        return spark.createDataFrame([], schema)
