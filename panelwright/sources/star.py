"""Statement, panel and event inputs derived from a star-schema of sales tables.

One order is one statement: its lines are sums over the order's items. Lines
1600, 1230, 2110 and 2400 are left out on purpose, so that absent lines occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.median import exact_median


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def statements(spark: SparkSession, folder: str, entity: str = "segment") -> DataFrame:
    """Record-level statements; the entity is the market segment or the nation."""
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    # Dealt by order before they are summed: an order's few items stand apart in the table, so partial sums of a task
    # are nearly as many as its items, are wider, and fill its memory.
    items = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", price, disc, tax)
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.sum(price).alias("line_1200"),
            F.sum(price * disc).alias("line_1210"),
            F.sum(price * tax).alias("line_1250"),
            F.sum(price * (1 - disc)).alias("line_4100"),
        )
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    if entity == "nation":
        # Last, so that the other joins carry its number and not its name.
        nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
        joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("n_name")
    else:
        key = F.col("c_mktsegment")
    return joined.select(
        F.col("o_orderkey").alias("statement_id"),
        F.col("o_orderdate").alias("creation_date"),
        key.alias("okved_section"),
        "line_1200",
        "line_1210",
        "line_1250",
        F.col("c_acctbal").alias("line_1400"),
        F.col("o_totalprice").alias("line_1500"),
        "line_4100",
        (-F.col("o_totalprice")).alias("line_4200"),
    )


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and day: median value and number of events."""
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return exact_median(rows, ["event_type", "day"], ["value"], count_as="n_events")
