"""Ordered series: one way to write lags for panels and for very long series.

* ``panel`` layout: ``Window.partitionBy(entity)``. A panel holds one row per
  entity and period, so a window partition is as long as the calendar.
* ``blocks`` layout: for pooled series (no entity) and for record-level series
  where one entity may hold a large share of all rows. Rows are range-sorted,
  numbered, and cut into equal blocks; each block also receives the few rows
  before and after it that its lags reach. Every task gets one block, whatever
  the entity sizes, and results are those of one global window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.operators.impute import attach
from panelwright.session import settle

BLOCK_ROWS = 100_000


def positioned(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_pos``, the row's place in the (by, order) sort of the whole table.

    ``by`` and ``order`` together must identify a row. The sorted table is
    written before it is counted, because range bounds are sampled and a second
    run could draw others.
    """
    keys = [*by, *order]
    ranged = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()),
        "positioned",
    )
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the sort: small, whatever the table's size.
    before = F.sum("_size").over(Window.orderBy("_pid")) - F.col("_size")
    starts = sizes.select("_pid", before.alias("_start"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return ranged.join(F.broadcast(starts), "_pid").withColumn("_pos", F.col("_start") + local).drop(
        "_pid", "_mid", "_start"
    )


@dataclass(frozen=True)
class Series:
    """A table ready for lag expressions."""

    df: DataFrame
    by: tuple[str, ...]
    blocked: bool
    window: WindowSpec
    over: str

    def shift(self, c: Column | str, k: int) -> Column:
        """Value ``k`` rows earlier in the same series (later if negative)."""
        if isinstance(c, str) and k and not self.blocked:
            return F.expr(f"lag(`{c}`, {k}) OVER ({self.over})")
        col = F.col(c) if isinstance(c, str) else c
        if k == 0:
            return col
        value = F.lag(col, k).over(self.window)
        if not self.blocked or not self.by:
            return value
        entity = F.struct(*self.by)
        return F.when(F.lag(entity, k).over(self.window).eqNullSafe(entity), value)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the helper rows and columns."""
        return df.filter("_core").drop("_core", "_block", "_pos") if self.blocked else df


def series(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str] | str,
    back: int = 0,
    ahead: int = 0,
    layout: str = "panel",
    block_rows: int | None = None,
) -> Series:
    """Prepare ``df`` for shifts of up to ``back`` rows back and ``ahead`` rows ahead.

    A table that still has its ``_pos`` (see ``numbered``) is not sorted again.
    """
    by = tuple(by)
    order = [order] if isinstance(order, str) else list(order)
    if layout == "panel" and by:
        over = f"PARTITION BY {_names(by)} ORDER BY {_names(order)}"
        return Series(df, by, False, Window.partitionBy(*by).orderBy(*order), over)
    block_rows = max(block_rows or BLOCK_ROWS, back, ahead)
    pos = df if "_pos" in df.columns else positioned(df, by, order)
    block = F.floor(F.col("_pos") / block_rows)
    inside = F.col("_pos") % block_rows
    targets = F.array_compact(
        F.array(
            block,
            F.when(inside >= block_rows - back, block + 1) if back else F.lit(None).cast("long"),
            F.when(inside < ahead, block - 1) if ahead else F.lit(None).cast("long"),
        )
    )
    rows = pos.withColumn("_own", block).withColumn("_block", F.explode(targets))
    rows = rows.withColumn("_core", F.col("_block") == F.col("_own")).drop("_own")
    over = "PARTITION BY _block ORDER BY _pos"
    return Series(rows, by, True, Window.partitionBy("_block").orderBy("_pos"), over)


def _names(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in cols)


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[str] | str, layout: str = "panel", t: str = "t", n: str = "n",
    keep_pos: bool = False,
) -> DataFrame:
    """Add the 1-based place of each row in its series and the series length.

    ``keep_pos`` leaves the table-wide place of the block layout in ``_pos``.
    """
    order = [order] if isinstance(order, str) else list(order)
    if layout == "panel" and by:
        w = Window.partitionBy(*by)
        return df.withColumn(t, F.row_number().over(w.orderBy(*order)).cast("long")).withColumn(
            n, F.count(F.lit(1)).over(w)
        )
    pos = positioned(df, by, order)
    spans = pos.groupBy(*by).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias(n))
    out = attach(pos, spans, by, ["_first", n]).withColumn(t, F.col("_pos") - F.col("_first") + 1).drop("_first")
    return out if keep_pos else out.drop("_pos")
