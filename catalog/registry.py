"""Registered queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result for another engine."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body.strip()


# Common table expressions that mirror the statement and panel inputs.
def stmt(entity: str = "segment") -> str:
    key = "c_mktsegment" if entity == "segment" else "n_name"
    extra = "" if entity == "segment" else "JOIN nation ON c_nationkey = n_nationkey"
    return f"""
items AS (
  SELECT l_orderkey, sum(l_extendedprice) AS line_1200, sum(l_extendedprice * l_discount) AS line_1210,
         sum(l_extendedprice * l_tax) AS line_1250, sum(l_extendedprice * (1 - l_discount)) AS line_4100
  FROM lineitem GROUP BY l_orderkey),
stmt AS (
  SELECT o_orderkey AS statement_id, o_orderdate AS creation_date, {key} AS okved_section,
         line_1200, line_1210, line_1250, c_acctbal AS line_1400, o_totalprice AS line_1500, line_4100,
         -o_totalprice AS line_4200
  FROM orders JOIN customer ON o_custkey = c_custkey {extra} JOIN items ON o_orderkey = l_orderkey),
rec AS (
  SELECT statement_id, okved_section AS industry,
         CAST(year(creation_date) AS INTEGER) AS cal_year,
         CAST(year(creation_date) * 100 + month(creation_date) AS INTEGER) AS cal_month,
         0.0::DOUBLE AS total_assets, line_1400 + line_1500 AS total_liabilities, line_1200 AS current_assets,
         line_1500 AS current_liabilities, line_1250 AS cash, line_1210 AS inventory, 0.0::DOUBLE AS receivables,
         line_4100 AS operating_cash_flow, line_4100 + line_4200 AS free_cash_flow, 0.0::DOUBLE AS revenue,
         0.0::DOUBLE AS net_income,
         CASE WHEN line_1500 <> 0 THEN line_1200 / line_1500 END AS current_ratio,
         CASE WHEN line_1500 <> 0 THEN (line_1200 - line_1210) / line_1500 END AS quick_ratio,
         CASE WHEN line_1500 <> 0 THEN line_1250 / line_1500 END AS cash_ratio,
         line_1200 - line_1500 AS working_capital
  FROM stmt)"""


def panel(entity: str = "segment", unit: str = "month") -> str:
    measures = [
        "free_cash_flow", "current_ratio", "quick_ratio", "cash_ratio", "working_capital", "total_assets",
        "total_liabilities", "revenue", "net_income",
    ]
    medians = ", ".join(f"median({m}) AS {m}" for m in measures)
    return (
        stmt(entity)
        + f""",
panel AS (
  SELECT cal_{unit} AS year, industry, {medians}, count(*) AS n_firms
  FROM rec WHERE total_liabilities <> 0 OR cash <> 0 OR operating_cash_flow <> 0 OR free_cash_flow <> 0
     OR current_ratio <> 0 OR quick_ratio <> 0 OR cash_ratio <> 0 OR working_capital <> 0 OR inventory <> 0
  GROUP BY cal_{unit}, industry)"""
    )


EVENT_PANEL = """
evp AS (
  SELECT event_type, CAST(ts AS DATE) AS day, median(value) AS value, count(*) AS n_events
  FROM events GROUP BY ALL)"""


def erfc_sql(x):
    """erfc for 0 <= x < 6 by the series of erf with positive terms."""
    terms = (
        f"exp(2 * i * ln(2) + (2 * i + 1) * ln({x}) - lgamma(2 * i + 2) + lgamma(i + 1) - ({x}) * ({x}))"
    )
    return f"(CASE WHEN {x} <= 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda i: {terms})) END)"


def chi2_sf_sql(x, df):
    """Chi-square tail by the series of the lower incomplete gamma function."""
    z, a = f"(({x}) / 2)", f"(({df}) / 2.0)"
    terms = f"exp(({a} + i) * ln({z}) - {z} - lgamma({a} + i + 1))"
    return f"(CASE WHEN {z} <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 300), lambda i: {terms})) END)"


def normal_cdf_sql(x):
    half = erfc_sql(f"(abs({x}) / sqrt(2))")
    return f"(CASE WHEN {x} < 0 THEN {half} / 2 ELSE 1 - {half} / 2 END)"


def gram_sql(name, source, width, left, start="", step=""):
    """Moments of ``x`` (a list per row of ``source``, with series key ``k``) and what elimination leaves of them.

    ``name`` has (k, p, m): m is the matrix after eliminating the first p columns,
    so its last cell is the residual sum of the regression on those. It ends with
    ``left`` columns to go. ``start`` and ``step`` carry a further value along.
    """
    return f""", {name}_g AS (SELECT k, i, list(v ORDER BY j) AS r FROM (
        SELECT k, i, j, sum(x[i] * x[j]) AS v FROM {source}, range(1, {width} + 1) a(i), range(1, {width} + 1) b(j)
        WHERE i <= len(x) AND j <= len(x) GROUP BY ALL) GROUP BY ALL),
      {name}_m AS (SELECT k, list(r ORDER BY i) AS m FROM {name}_g GROUP BY k),
      {name} AS (SELECT k, 0 AS p, m{start} FROM {name}_m UNION ALL SELECT k, p + 1, list_transform(m, lambda r, i: list_transform(r,
          lambda v, j: CASE WHEN i <= p + 1 OR j <= p + 1 THEN 0 ELSE v - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END)){step}
        FROM {name} WHERE p < len(m) - {left})"""
