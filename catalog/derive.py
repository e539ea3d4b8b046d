"""Projections, filters and scalar expressions."""

from pyspark.sql import functions as F

from catalog.common import month_panel, rounded
from catalog.registry import panel, query, stmt, with_ctes
from panelwright.functions import scalar as s
from panelwright.operators import derive as d
from panelwright.plans.panel import LIQUIDITY, clean_statements, lagged_panel
from panelwright.sources.star import statements, table


@query(
    "b1_period_from_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y,
    CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS m,
    CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS d FROM orders""",
)
def b1(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    for name, unit in (("y", "year"), ("m", "month"), ("d", "day")):
        rows = d.with_period(rows, "o_orderdate", name, unit)
    return rows.drop("o_orderdate")


@query(
    "b1_period_from_text",
    """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS y,
    CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS m, CAST(year(o_orderdate) AS INTEGER) AS num FROM orders""",
)
def b1_text(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"),
        F.year("o_orderdate").cast("double").alias("number"),
    )
    rows = d.with_period(d.with_period(rows, "text", "y"), "text", "m", "month")
    return d.with_period(rows, "number", "num").drop("text", "number")


@query(
    "b2_entity",
    """SELECT c_custkey, c_mktsegment AS by_section, substr(c_mktsegment, 1, 2) AS by_code FROM customer""",
)
def b2(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("okved_section"), F.col("c_mktsegment").alias("okved")
    )
    coded = d.with_entity(rows.drop("okved_section"), name="by_code").drop("okved")
    return d.with_entity(rows.drop("okved"), name="by_section").join(coded, "c_custkey")


@query(
    "b3_col_or_zero",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS present, 0.0::DOUBLE AS absent
    FROM lineitem""",
)
def b3(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("line_1", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        d.col_or_zero(rows, "line_1").alias("present"),
        d.col_or_zero(rows, "line_2").alias("absent"),
    )


MEASURES = ["total_assets", "total_liabilities", "current_assets", "current_liabilities", "cash", "inventory",
            "receivables", "operating_cash_flow", "free_cash_flow", "revenue", "net_income"]


def _round_sql(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query("b4_derive_measures", with_ctes(stmt(), body=f"SELECT statement_id, {_round_sql(MEASURES)} FROM rec"))
def b4(spark, sf):
    return rounded(d.derive_measures(statements(spark, sf)).select("statement_id", *MEASURES))


@query(
    "b5_safe_ratio",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 8) END AS ratio
    FROM lineitem""",
)
def b5(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(s.safe_ratio("l_tax", "l_discount"), 8).alias("ratio"))


@query(
    "b5_liquidity_ratios",
    with_ctes(stmt(), body=f"SELECT statement_id, {_round_sql(LIQUIDITY, 8)} FROM rec"),
)
def b5_ratios(spark, sf):
    return rounded(d.derive_measures(statements(spark, sf)).select("statement_id", *LIQUIDITY), 8)


@query(
    "b6_working_capital",
    with_ctes(stmt(), body="SELECT statement_id, round(working_capital, 6) AS working_capital FROM rec"),
)
def b6(spark, sf):
    return rounded(d.derive_measures(statements(spark, sf)).select("statement_id", "working_capital"))


@query(
    "b7_filter_period",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999",
)
def b7(spark, sf):
    rows = d.with_period(table(spark, sf, "orders"), "o_orderdate")
    return d.filter_period(rows, 1996, 1999, strict=True, raw="o_orderdate").select("o_orderkey", "year")


@query("b8_keep", "SELECT c_custkey, c_mktsegment FROM customer")
def b8(spark, sf):
    return d.keep(table(spark, sf, "customer"), ["c_custkey", "no_such_column", "c_mktsegment"])


@query(
    "b9_any_nonzero",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0",
)
def b9(spark, sf):
    return d.any_nonzero(table(spark, sf, "lineitem"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber")


@query(
    "b10_for_entities",
    with_ctes(
        panel(),
        body="""SELECT industry, year, round(cash_ratio, 6) AS cash_ratio FROM panel
        WHERE industry IN ('BUILDING', 'MACHINERY')""",
    ),
)
def b10(spark, sf):
    rows = d.for_entities(month_panel(spark, sf), ["BUILDING", "MACHINERY"])
    return rounded(rows.select("industry", "year", "cash_ratio"))


@query(
    "b11_feature_columns",
    """SELECT round(sum(l_orderkey), 2) AS l_orderkey, round(sum(l_partkey), 2) AS l_partkey,
    round(sum(l_suppkey), 2) AS l_suppkey, round(sum(l_linenumber), 2) AS l_linenumber,
    round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax,
    round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem""",
)
def b11(spark, sf):
    rows = table(spark, sf, "lineitem")
    cols = d.feature_columns(rows, target="l_quantity", period="l_shipdate")
    return rows.agg(*[F.round(F.sum(c).cast("double"), 2).alias(c) for c in cols])


LAG_PANEL = panel() + """,
lagged AS (
  SELECT *, lag(free_cash_flow, 1) OVER w AS free_cash_flow_lag1, lag(current_ratio, 1) OVER w AS current_ratio_lag1,
    lag(quick_ratio, 1) OVER w AS quick_ratio_lag1, lag(cash_ratio, 1) OVER w AS cash_ratio_lag1,
    lag(free_cash_flow, 2) OVER w AS free_cash_flow_lag2, lag(current_ratio, 2) OVER w AS current_ratio_lag2,
    lag(quick_ratio, 2) OVER w AS quick_ratio_lag2, lag(cash_ratio, 2) OVER w AS cash_ratio_lag2
  FROM panel WINDOW w AS (PARTITION BY industry ORDER BY year)),
lagpanel AS (SELECT * FROM lagged WHERE cash_ratio_lag2 IS NOT NULL)"""


@query(
    "b12_priority_features",
    with_ctes(
        LAG_PANEL,
        body="""SELECT industry, year, round(free_cash_flow_lag1, 6) AS free_cash_flow_lag1,
        round(current_ratio_lag1, 6) AS current_ratio_lag1, round(quick_ratio_lag1, 6) AS quick_ratio_lag1,
        round(cash_ratio_lag1, 6) AS cash_ratio_lag1, round(free_cash_flow_lag2, 6) AS free_cash_flow_lag2 FROM lagpanel""",
    ),
)
def b12(spark, sf):
    rows = lagged_panel(month_panel(spark, sf))
    top = d.priority_features(d.feature_columns(rows, "free_cash_flow", "year"), 5)
    return rounded(rows.select("industry", "year", *top))


@query(
    "b13_label_table",
    """SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN n_name ELSE CAST(c_nationkey AS VARCHAR) END AS industry_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def b13(spark, sf):
    labels = table(spark, sf, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name")
    rows = d.with_label(table(spark, sf, "customer"), labels, code="c_nationkey")
    return rows.select("c_custkey", "industry_name")


@query(
    "b13_label_map",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Mining & Quarrying'
    ELSE c_mktsegment END AS industry_name FROM customer""",
)
def b13_map(spark, sf):
    labels = {"BUILDING": "Construction", "MACHINERY": "Mining & Quarrying"}
    rows = d.with_label(table(spark, sf, "customer"), labels, code="c_mktsegment")
    return rows.select("c_custkey", "industry_name")


@query(
    "b14_safe_name",
    "SELECT DISTINCT p_name, replace(replace(replace(p_name, '/', '_'), ' ', '_'), '\\', '_') AS safe FROM part",
)
def b14(spark, sf):
    return table(spark, sf, "part").select("p_name", s.safe_name("p_name").alias("safe")).distinct()


@query(
    "b15_clean_numeric",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 8) END AS ratio
    FROM lineitem""",
)
def b15(spark, sf):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    ratio = F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount")).otherwise(
        F.when(F.col("l_tax") > 0, inf).otherwise(nan)
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))
    return rounded(d.clean_numeric(rows, ["ratio"]), 8)


@query(
    "b16_dropna",
    "SELECT l_orderkey, l_linenumber, round(l_tax / l_discount, 8) AS ratio FROM lineitem WHERE l_discount <> 0",
)
def b16(spark, sf):
    ratio = F.round(s.safe_ratio("l_tax", "l_discount"), 8)
    return d.dropna(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio")), ["ratio"])


@query(
    "b17_flags",
    """SELECT l_orderkey, l_linenumber, l_discount * 30 < 1.5 AS low,
    CASE WHEN l_discount * 30 < 1.5 THEN 'positive autocorrelation' WHEN l_discount * 30 < 2.5 THEN 'no autocorrelation'
    ELSE 'negative autocorrelation' END AS band, l_tax < 0.05 AS significant,
    CASE WHEN l_tax < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM lineitem""",
)
def b17(spark, sf):
    stat = F.col("l_discount") * 30
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (stat < 1.5).alias("low"), s.dw_band(stat).alias("band"),
        s.significant("l_tax").alias("significant"), s.verdict("l_tax").alias("verdict"),
    )


@query(
    "b18_pos_neg",
    """SELECT c_custkey, greatest(c_acctbal - 4000, 0) AS pos, least(c_acctbal - 4000, 0) AS neg FROM customer""",
)
def b18(spark, sf):
    x = F.col("c_acctbal") - 4000
    return table(spark, sf, "customer").select(
        "c_custkey", s.positive_part(x).alias("pos"), s.negative_part(x).alias("neg")
    )


@query(
    "b19_period_date",
    "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS ds FROM orders",
)
def b19(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", s.period_date(F.year("o_orderdate")).alias("ds"))


@query(
    "b20_order_str",
    """SELECT DISTINCT '(' || l_linenumber || ', ' || CAST(l_quantity AS INTEGER) || ', 0)' AS model_order FROM lineitem""",
)
def b20(spark, sf):
    text = s.order_str("l_linenumber", F.col("l_quantity").cast("int"), F.lit(0))
    return table(spark, sf, "lineitem").select(text.alias("model_order")).distinct()


@query(
    "b21_with_status",
    """SELECT l_orderkey, count(l_discount) AS n_obs, CASE WHEN count(l_discount) < 4 THEN 'too few observations'
    WHEN max(l_discount) = min(l_discount) THEN 'constant series' ELSE 'ok' END AS status FROM lineitem GROUP BY 1""",
)
def b21(spark, sf):
    return d.with_status(table(spark, sf, "lineitem"), ["l_orderkey"], "l_discount")


@query(
    "g1_order_panel",
    with_ctes(panel(), body="SELECT industry, year, n_firms FROM panel ORDER BY industry, year"),
)
def g1(spark, sf):
    from panelwright.operators.reshape import order_panel

    return order_panel(month_panel(spark, sf).select("industry", "year", "n_firms"))


@query(
    "b_clean_statements",
    with_ctes(
        stmt(),
        body="""SELECT cal_year AS year, industry, count(*) AS n_rows, round(sum(cash), 2) AS cash,
        round(sum(inventory), 2) AS inventory FROM rec WHERE cal_year BETWEEN 1996 AND 2000 GROUP BY 1, 2""",
    ),
)
def b_clean(spark, sf):
    rows = clean_statements(statements(spark, sf), 1996, 2000)
    out = rows.groupBy("year", "industry").agg(
        F.count("*").alias("n_rows"), F.sum("cash").alias("cash"), F.sum("inventory").alias("inventory")
    )
    return rounded(out, 2)
