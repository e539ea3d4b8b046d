"""A result store: tables written batch by batch, each batch visible at once or not at all.

All tables of a batch are the rows of one job, each row tagged with its table and
holding it as a struct, and go to one folder per table by dynamic partitioning.
One manifest row, moved into place as a single file when its write commits, then
names the batch and the schemas of its tables. Readers list the manifest and open
the named batches only, so a run that dies leaves a folder that nobody reads and
nothing half visible. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.median import same_keys
from panelwright.sources.tables import absent

MANIFEST = "batch string, tables map<string, string>, committed timestamp"


def tagged(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables as one: ``table`` and a struct column per table, null but for a row's own."""
    parts = [df.select(F.lit(name).alias("table"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class RunStore:
    """Batches under ``path/data/batch=<id>/table=<name>``, and ``path/manifest``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        return f"{self.path}/data/batch={batch}"

    def manifest(self) -> DataFrame:
        """One row per committed batch: batch, tables (name and schema), committed; no rows before the first."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException as error:
            if not absent(error):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def stage(self, tables: Mapping[str, DataFrame], batch: str | None = None) -> str:
        """Write a batch's tables in one job; nobody sees them yet. Returns the batch's id."""
        batch = batch or uuid.uuid4().hex
        tagged(tables).write.mode("overwrite").partitionBy("table").parquet(self._folder(batch))
        return batch

    def commit(self, batch: str, tables: Mapping[str, DataFrame]) -> None:
        """Make a staged batch visible, all of its tables at once."""
        names = [F.lit(v) for name, df in tables.items() for v in (name, df.schema.json())]
        row = self.spark.range(1).select(F.lit(batch).alias("batch"), F.create_map(*names).alias("tables"), F.current_timestamp().alias("committed"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def append(self, tables: Mapping[str, DataFrame]) -> str:
        """Stage and commit one batch."""
        batch = self.stage(tables)
        self.commit(batch, tables)
        return batch

    def read(self, table: str) -> DataFrame | None:
        """All committed rows of a table, or None if no batch holds it; a column that a batch lacks is null there."""
        held = self.manifest().select("batch", F.col("tables")[table].alias("schema"), "committed").filter("schema IS NOT NULL")
        # One row per commit of a run.
        held = held.orderBy("committed", "batch").collect()
        if not held:
            return None
        fields: dict[str, T.StructField] = {}
        for r in held:
            for f in T.StructType.fromJson(json.loads(r["schema"])).fields:
                fields.setdefault(f.name, T.StructField(f.name, f.dataType))
        row = T.StructType([T.StructField(table, T.StructType(list(fields.values()))), *[T.StructField(c, T.StringType()) for c in ("batch", "table")]])
        reader = self.spark.read.schema(row).option("basePath", f"{self.path}/data")
        found = reader.parquet(*[self._folder(r["batch"]) for r in held])
        return found.filter(F.col("table") == table).select(*[F.col(table).getField(n).alias(n) for n in fields])

    def pending(self, keys: DataFrame, table: str, done: str | None = None) -> DataFrame:
        """Rows of ``keys`` that no committed row of ``table`` has (of those that fulfil ``done``)."""
        stored = self.read(table)
        return pending(keys, stored if stored is None or done is None else stored.filter(done), keys.columns)


def pending(df: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not yet in the result table (anti-join)."""
    if done is None:
        return df
    seen = done.select(*keys).distinct()
    return df.join(seen, same_keys(df, seen, keys), "left_anti")


def append_pending(df: DataFrame, path: str, keys: Sequence[str], build: Callable[[DataFrame], DataFrame], table: str = "rows") -> DataFrame:
    """Run ``build`` on what the store at ``path`` lacks by ``keys`` and commit its result as one batch.

    Returns the whole stored table. Running it again adds nothing; a build that
    dies adds nothing either.
    """
    store = RunStore(df.sparkSession, path)
    store.append({table: build(pending(df, store.read(table), keys))})
    return store.read(table)
