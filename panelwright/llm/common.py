"""What the corpus operators share: row keys, written steps, checked broadcasts."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.session import settle

#: A word of a text: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (of two or three numbers each) up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000
#: Bitmaps of 4 KB up to which they are broadcast.
BITMAPS = 16_384


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def keep(df: DataFrame, label: str, wait: float = 0.0) -> DataFrame:
    """Write a step to the shared folder and let go of the shuffles behind it.

    Spark deletes shuffle files once the driver has collected the objects that
    stand for them; asking for that here bounds the disk that a run needs. A
    thread of its own hands back what Python has let go of: without ``wait``
    seconds for that, this step's own shuffles stay until the next one is kept.
    """
    out = settle(df, f"llm-{label}")
    jvm = df.sparkSession.sparkContext._jvm
    del df
    gc.collect()
    jvm.System.gc()
    if wait:
        time.sleep(wait)
        jvm.System.gc()
    return out


def with_rid(docs: DataFrame) -> DataFrame:
    """Add ``rid``, a key of the row itself: doc_id may repeat or be null.

    The key is the row's place in its input partition, so ``docs`` has to be a
    stored table (or a plan without a shuffle above one); reading it again, or
    after an executor is lost, gives the same keys.
    """
    return docs.withColumn("rid", F.monotonically_increasing_id())


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (a stored table is counted cheaply)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def among(df: DataFrame, ids: DataFrame, limit: int = BITMAPS) -> DataFrame:
    """Rows of ``df`` whose ``rid`` is in ``ids`` (rid, may repeat).

    The keys are sent as bitmaps of 32,768 rows each, so that ``df`` need not be
    shuffled; with more than ``limit`` bitmaps it is joined instead. ``rid``
    counts rows within a partition, so bitmaps are dense.
    """
    bit = F.bitmap_bit_position("rid").cast("int")
    bits = ids.groupBy(F.bitmap_bucket_number("rid").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("rid")).alias("_bits"))
    bits = keep(bits, "bits")
    if bits.limit(limit + 1).count() > limit:
        return df.join(ids.distinct(), "rid", "left_semi")
    held = df.withColumn("_bucket", F.bitmap_bucket_number("rid")).withColumn("_bit", bit).join(F.broadcast(bits), "_bucket")
    byte = F.expr("cast(conv(hex(substring(_bits, _bit div 8 + 1, 1)), 16, 10) AS int)")
    return held.filter(F.getbit(byte, F.col("_bit") % 8) == 1).select(*df.columns)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A to Z alone."""
    return F.translate(c, UPPER, LOWER)


def numbered_in(df: DataFrame, key: str, out: str, rid: str = "rid") -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each value of ``key``, by ``rid``.

    No value of ``key`` is gathered: rows are numbered within the input
    partition that ``rid`` carries in its upper bits, and counts per partition
    give the offsets.
    """
    df = df.withColumn("_part", F.shiftright(rid, 33))
    counts = df.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    starts = counts.select(key, "_part", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(rid)) - 1
    return (
        df.withColumn("_place", place)
        .join(starts, [key, "_part"])
        .withColumn(out, F.col("_start") + F.col("_place"))
        .drop("_part", "_start", "_place")
    )
