"""Sources, sinks and incremental builds."""

from pyspark.sql import functions as F

from catalog.common import ROUNDED_PANEL, month_panel, rounded, scratch
from catalog.registry import panel, query, stmt, with_ctes
from panelwright.operators.derive import PANEL_MEASURES
from panelwright.plans.panel import build_panel
from panelwright.sources.star import statements, table
from panelwright.sources.store import append_pending, pending
from panelwright.sources.tables import read_panel, read_statements, read_table, write_panel, write_table

PANEL_SQL = with_ctes(panel(), body=f"SELECT year, industry, {ROUNDED_PANEL}, n_firms FROM panel")


@query(
    "a1_read_statements",
    "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders",
)
def a1(spark, sf):
    rows = read_statements(spark, f"{sf}/orders.parquet")
    return rows.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    "a2_read_panel",
    with_ctes(panel(), body=f"SELECT year, industry, {ROUNDED_PANEL}, n_firms FROM panel"),
)
def a2(spark, sf):
    path = scratch(spark, "panel")
    write_panel(month_panel(spark, sf), path)
    out = read_panel(spark, path, fallback=f"{sf}/orders.parquet")
    return rounded(out.select("year", "industry", *PANEL_MEASURES, "n_firms"))


@query("a3_write_panel", PANEL_SQL)
def a3(spark, sf):
    path = scratch(spark, "panel")
    write_panel(month_panel(spark, sf), path)
    return rounded(read_panel(spark, path).select("year", "industry", *PANEL_MEASURES, "n_firms"))


def _through(spark, sf, fmt):
    path = scratch(spark, fmt)
    df = month_panel(spark, sf)
    write_table(df, path, fmt)
    return rounded(read_table(spark, path, df.schema, fmt).select("year", "industry", *PANEL_MEASURES, "n_firms"))


@query("a4_write_csv", PANEL_SQL)
def a4(spark, sf):
    return _through(spark, sf, "csv")


@query(
    "a5_read_table",
    with_ctes(panel(), body="SELECT industry, count(*) AS n_rows, round(sum(cash_ratio), 6) AS total FROM panel GROUP BY 1"),
)
def a5(spark, sf):
    path = scratch(spark, "csv")
    write_table(month_panel(spark, sf).select("industry", "year", "cash_ratio"), path)
    read = read_table(spark, path, "industry string, year int, cash_ratio double")
    absent = read_table(spark, path + "-absent", read.schema, optional=True)
    out = read.unionByName(absent).groupBy("industry")
    return rounded(out.agg(F.count("*").alias("n_rows"), F.sum("cash_ratio").alias("total")))


@query(
    "a6_json_nested",
    with_ctes(
        panel(),
        body="""SELECT industry, year, round(current_ratio, 6) AS current_ratio, round(quick_ratio, 6) AS quick_ratio,
        round(cash_ratio, 6) AS cash_ratio FROM panel""",
    ),
)
def a6(spark, sf):
    path = scratch(spark, "json")
    nested = month_panel(spark, sf).select(
        "industry", "year", F.struct("current_ratio", "quick_ratio", "cash_ratio").alias("liquidity")
    )
    write_table(nested, path, "json")
    return rounded(read_table(spark, path, nested.schema, "json").select("industry", "year", "liquidity.*"))


@query(
    "a7_pending",
    """
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
    """,
)
def a7(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("a7_append_pending", PANEL_SQL)
def a7_append(spark, sf):
    """Two builds: the second only handles entities the first did not store."""
    path = scratch(spark, "store")
    rows = statements(spark, sf).withColumnRenamed("okved_section", "industry")

    def build(part):
        return build_panel(part.withColumnRenamed("industry", "okved_section"), unit="month")

    append_pending(rows.filter("industry < 'F'"), path, ["industry"], build)
    out = append_pending(rows, path, ["industry"], build)
    return rounded(out.select("year", "industry", *PANEL_MEASURES, "n_firms"))


@query(
    "f5_not_yet_done",
    with_ctes(
        stmt(),
        body="""SELECT DISTINCT industry, cal_month AS year FROM rec
        EXCEPT SELECT industry, cal_month FROM rec WHERE cash_ratio > 0.5""",
    ),
)
def f5(spark, sf):
    from panelwright.plans.panel import clean_statements

    rows = clean_statements(statements(spark, sf), unit="month")
    done = rows.filter("cash_ratio > 0.5")
    return pending(rows.select("industry", "year").distinct(), done, ["industry", "year"])
