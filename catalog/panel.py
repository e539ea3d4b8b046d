"""Imputation, scaling, aggregation, joins and reshaping."""

from pyspark.sql import functions as F

from catalog.common import ROUNDED_PANEL, month_panel, rounded
from catalog.derive import LAG_PANEL
from catalog.registry import EVENT_PANEL, panel, query, with_ctes
from panelwright.operators import aggregate as a
from panelwright.operators import impute as i
from panelwright.operators import reshape as r
from panelwright.operators.derive import PANEL_MEASURES
from panelwright.operators.median import exact_median
from panelwright.operators.window import time_split
from panelwright.plans.panel import LIQUIDITY
from panelwright.sources.star import event_panel, statements, table

RATIO = "CASE WHEN l_discount <> 0 THEN l_tax / l_discount END"


def _ratios(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount")).alias("ratio"),
        F.lit(None).cast("double").alias("void"),
    )


@query(
    "c1_impute_global",
    f"""SELECT l_orderkey, l_linenumber, round(coalesce({RATIO}, (SELECT median({RATIO}) FROM lineitem)), 8) AS ratio,
    0.0::DOUBLE AS void FROM lineitem""",
)
def c1(spark, sf):
    out = i.impute_median(_ratios(spark, sf), ["ratio", "void"])
    return rounded(out.select("l_orderkey", "l_linenumber", "ratio", "void"), 8)


# One row per period with a gap wherever the ratio falls on a rule, so that fills occur.
GAPPED = """gapped AS (
  SELECT industry, year, n_firms, CASE WHEN n_firms % 3 <> 0 THEN cash_ratio END AS cash_ratio,
    CASE WHEN industry <> 'BUILDING' THEN quick_ratio END AS quick_ratio,
    CASE WHEN n_firms % 5 <> 0 THEN free_cash_flow END AS free_cash_flow FROM panel)"""
SPLIT = """, ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY industry ORDER BY year) AS rk FROM {0}),
periods AS (SELECT industry, count(DISTINCT year) AS np FROM {0} GROUP BY 1),
split AS (
  SELECT r.*, CASE WHEN rk <= greatest(1, floor(np * 0.8)) THEN 'train' ELSE 'test' END AS split
  FROM ranked r JOIN periods USING (industry))"""


def _gapped(spark, sf):
    return month_panel(spark, sf).select(
        "industry",
        "year",
        "n_firms",
        F.when(F.col("n_firms") % 3 != 0, F.col("cash_ratio")).alias("cash_ratio"),
        F.when(F.col("industry") != "BUILDING", F.col("quick_ratio")).alias("quick_ratio"),
        F.when(F.col("n_firms") % 5 != 0, F.col("free_cash_flow")).alias("free_cash_flow"),
    )


@query(
    "c2_impute_by_split",
    with_ctes(
        panel(),
        GAPPED + SPLIT.format("gapped"),
        body="""SELECT industry, year, split,
        round(coalesce(cash_ratio, median(cash_ratio) OVER g, 0), 6) AS cash_ratio,
        round(coalesce(quick_ratio, median(quick_ratio) OVER g, 0), 6) AS quick_ratio
        FROM split WINDOW g AS (PARTITION BY industry, split)""",
    ),
)
def c2(spark, sf):
    rows = time_split(_gapped(spark, sf))
    out = i.impute_median(rows, ["cash_ratio", "quick_ratio"], ["industry", "split"])
    return rounded(out.select("industry", "year", "split", "cash_ratio", "quick_ratio"))


@query(
    "c3_impute_by_entity",
    with_ctes(
        panel(),
        GAPPED,
        body="""SELECT industry, year, round(coalesce(cash_ratio, median(cash_ratio) OVER g, 0), 6) AS cash_ratio,
        round(coalesce(quick_ratio, median(quick_ratio) OVER g, 0), 6) AS quick_ratio,
        round(coalesce(free_cash_flow, 0), 6) AS free_cash_flow
        FROM gapped WINDOW g AS (PARTITION BY industry)""",
    ),
)
def c3(spark, sf):
    out = i.impute_median(_gapped(spark, sf), ["cash_ratio", "quick_ratio"], ["industry"], zero=["free_cash_flow"])
    return rounded(out.select("industry", "year", "cash_ratio", "quick_ratio", "free_cash_flow"))


@query(
    "c4_standardize",
    with_ctes(
        panel(),
        body="""SELECT industry, year,
        round((cash_ratio - avg(cash_ratio) OVER ()) / stddev_pop(cash_ratio) OVER (), 6) AS cash_ratio,
        0.0::DOUBLE AS revenue FROM panel""",
    ),
)
def c4(spark, sf):
    out = i.standardize(month_panel(spark, sf), ["cash_ratio", "revenue"])
    return rounded(out.select("industry", "year", "cash_ratio", "revenue"))


@query(
    "c4_standardize_by_entity",
    with_ctes(
        panel(),
        body="""SELECT industry, year,
        round((cash_ratio - avg(cash_ratio) OVER g) / stddev_pop(cash_ratio) OVER g, 6) AS cash_ratio
        FROM panel WINDOW g AS (PARTITION BY industry)""",
    ),
)
def c4_by(spark, sf):
    out = i.standardize(month_panel(spark, sf), ["cash_ratio"], ["industry"])
    return rounded(out.select("industry", "year", "cash_ratio"))


MINMAX = with_ctes(
    panel() + SPLIT.format("panel") + """, stats AS (
      SELECT industry, min(cash_ratio) AS lo, max(cash_ratio) AS hi FROM split WHERE split = 'train' GROUP BY 1)""",
    body="""SELECT industry, year, split, round((cash_ratio - lo) / (hi - lo), 6) AS scaled,
    round(cash_ratio, 6) AS restored, 0.0::DOUBLE AS revenue FROM split JOIN stats USING (industry)""",
)


@query("c5_c6_minmax_and_back", MINMAX)
def c5(spark, sf):
    rows = time_split(month_panel(spark, sf).select("industry", "year", "cash_ratio", "revenue"))
    out = i.minmax(
        rows, ["cash_ratio", "revenue"], ["industry"], F.col("split") == "train", keep_stats=True, suffix="_s"
    )
    back = i.inverse_minmax("cash_ratio_s", {"min": "cash_ratio_min", "max": "cash_ratio_max"})
    return rounded(
        out.select(
            "industry", "year", "split", F.col("cash_ratio_s").alias("scaled"), back.alias("restored"),
            F.col("revenue_s").alias("revenue"),
        )
    )


@query("d1_aggregate_panel", with_ctes(panel(), body=f"SELECT year, industry, {ROUNDED_PANEL}, n_firms FROM panel"))
def d1(spark, sf):
    return rounded(month_panel(spark, sf).select("year", "industry", *PANEL_MEASURES, "n_firms"))


@query(
    "d1_panel_by_nation",
    with_ctes(panel("nation"), body=f"SELECT year, industry, {ROUNDED_PANEL}, n_firms FROM panel"),
)
def d1_nation(spark, sf):
    return rounded(month_panel(spark, sf, "nation").select("year", "industry", *PANEL_MEASURES, "n_firms"))


@query(
    "d1_panel_by_year",
    with_ctes(panel("segment", "year"), body=f"SELECT year, industry, {ROUNDED_PANEL}, n_firms FROM panel"),
)
def d1_year(spark, sf):
    from panelwright.plans.panel import build_panel

    return rounded(build_panel(statements(spark, sf)).select("year", "industry", *PANEL_MEASURES, "n_firms"))


@query(
    "d1_median_of_hot_groups",
    """SELECT l_returnflag, round(median(l_extendedprice), 6) AS l_extendedprice,
    round(median(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END), 8) AS ratio, count(*) AS n_rows
    FROM lineitem GROUP BY 1""",
)
def d1_hot(spark, sf):
    """Groups above the size bound go through the histogram selection."""
    rows = table(spark, sf, "lineitem").withColumn(
        "ratio", F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount"))
    )
    out = exact_median(rows, ["l_returnflag"], ["l_extendedprice", "ratio"], count_as="n_rows")
    return rounded(out, 6, ratio=8)


@query(
    "d2_global_series",
    with_ctes(panel("nation"), body="SELECT year, round(median(cash_ratio), 6) AS cash_ratio FROM panel GROUP BY 1"),
)
def d2(spark, sf):
    return rounded(a.global_series(month_panel(spark, sf, "nation"), "cash_ratio"))


@query(
    "d3_panel_profile",
    with_ctes(
        panel("nation"),
        body="""SELECT count(*) AS n_rows, count(DISTINCT industry) AS n_entities, count(DISTINCT year) AS n_periods,
        min(year) AS first_period, max(year) AS last_period FROM panel""",
    ),
)
def d3(spark, sf):
    return a.panel_profile(month_panel(spark, sf, "nation"))


def _matrix_sql(fn):
    cells = " UNION ALL ".join(
        f"SELECT industry, '{x}' AS row_var, '{y}' AS col_var, round({fn}({x}, {y}), 6) AS value FROM panel GROUP BY industry"
        for x in LIQUIDITY
        for y in LIQUIDITY
    )
    return with_ctes(panel(), body=cells)


@query("d4_covariance", _matrix_sql("covar_samp"))
def d4(spark, sf):
    return rounded(a.covariance(month_panel(spark, sf), LIQUIDITY, ["industry"]))


@query("d5_correlation", _matrix_sql("corr"))
def d5(spark, sf):
    return rounded(a.correlation(month_panel(spark, sf), LIQUIDITY, ["industry"]))


@query(
    "d11_split_bounds",
    with_ctes(
        panel() + SPLIT.format("panel"),
        body="""SELECT industry, split, min(year) AS first_period, max(year) AS last_period, count(*) AS n_rows
        FROM split GROUP BY 1, 2""",
    ),
)
def d11(spark, sf):
    return a.split_bounds(time_split(month_panel(spark, sf)), ["industry"])


@query(
    "d12_residual_histogram",
    """WITH x AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem),
    s AS (SELECT l_returnflag, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS sd,
      CAST(least(30, count(*) // 3 + 1) AS INTEGER) AS nb FROM x GROUP BY 1),
    g AS (SELECT s.*, (hi - lo) / nb AS w, CAST(unnest(range(nb)) AS INTEGER) AS bin FROM s),
    c AS (SELECT x.l_returnflag, CAST(least(floor((v - lo) / ((hi - lo) / nb)), nb - 1) AS INTEGER) AS bin, count(*) AS k
      FROM x JOIN s USING (l_returnflag) GROUP BY 1, 2)
    SELECT l_returnflag, bin, round(lo + bin * w, 4) AS left_edge, round(w, 6) AS width, coalesce(k, 0) AS n_in_bin,
      round(coalesce(k, 0) / (n * w), 10) AS density, round(mean, 4) AS mean, round(sd, 4) AS sd
    FROM g LEFT JOIN c USING (l_returnflag, bin)""",
)
def d12(spark, sf):
    out = a.residual_histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(out, 4, width=6, density=10)


@query(
    "f1_align",
    with_ctes(
        LAG_PANEL,
        body="""SELECT industry, year, round(a.free_cash_flow, 6) AS actual, round(b.free_cash_flow_lag1, 6) AS forecast
        FROM panel a JOIN lagpanel b USING (industry, year)""",
    ),
)
def f1(spark, sf):
    from panelwright.operators.window import add_lags

    rows = month_panel(spark, sf).select("industry", "year", "free_cash_flow", "cash_ratio")
    lagged = add_lags(rows, ["free_cash_flow"], 2)
    fc = lagged.select("industry", "year", F.col("free_cash_flow_lag1").alias("forecast"))
    actual = rows.select("industry", "year", F.col("free_cash_flow").alias("actual"))
    return rounded(r.align(actual, fc, ["industry", "year"]))


@query("f2_label_lookup", "SELECT n_nationkey, n_name, r_name AS industry_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def f2(spark, sf):
    from panelwright.operators.derive import with_label

    labels = table(spark, sf, "region").select("r_regionkey", "r_name")
    out = with_label(table(spark, sf, "nation"), labels, code="n_regionkey")
    return out.select("n_nationkey", "n_name", "industry_name")


@query(
    "f3_complete_grid",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
    k AS (SELECT DISTINCT o_custkey FROM orders),
    p AS (SELECT unnest(['1-URGENT', '2-HIGH', 'none']) AS o_orderpriority)
    SELECT k.o_custkey, p.o_orderpriority, n FROM k CROSS JOIN p LEFT JOIN c
      ON c.o_custkey = k.o_custkey AND c.o_orderpriority = p.o_orderpriority""",
)
def f3(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return r.complete(counts, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "none"])


@query(
    "f4_in_periods",
    with_ctes(
        panel() + SPLIT.format("panel"),
        body="""SELECT industry, year, n_firms FROM panel WHERE year IN (SELECT year FROM split WHERE split = 'test')""",
    ),
)
def f4(spark, sf):
    rows = month_panel(spark, sf)
    test = time_split(rows).filter("split = 'test'")
    return r.in_periods(rows, test).select("industry", "year", "n_firms")


@query(
    "f7_statistics_to_rows",
    """SELECT event_id, round(value, 2) AS value, round(avg(value) OVER (PARTITION BY event_type), 6) AS avg_value,
    min(value) OVER (PARTITION BY event_type) AS min_value FROM events""",
)
def f7(spark, sf):
    rows = table(spark, sf, "events")
    stats = rows.groupBy("event_type").agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"))
    out = i.attach(rows, stats, ["event_type"], ["avg_value", "min_value"])
    return rounded(out.select("event_id", "value", "avg_value", "min_value"), 6, value=2)


@query("g2_sorted_keys", "SELECT DISTINCT n_name FROM nation ORDER BY 1")
def g2(spark, sf):
    return r.sorted_keys(table(spark, sf, "nation"), "n_name")


@query(
    "g3_top_features",
    """SELECT l_returnflag, rank, l_partkey, qty FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY qty DESC, l_partkey) AS INTEGER) AS rank FROM (
        SELECT l_returnflag, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)) WHERE rank <= 5""",
)
def g3(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return r.top_features(sums, ["l_returnflag"], "l_partkey", "qty", 5)


@query(
    "g4_full_timeline",
    with_ctes(panel() + SPLIT.format("panel"), body="SELECT industry, year, n_firms, split FROM split"),
)
def g4(spark, sf):
    rows = time_split(month_panel(spark, sf)).select("industry", "year", "n_firms", F.col("split").alias("s"))
    parts = {name: rows.filter(F.col("s") == name).drop("s") for name in ("train", "test")}
    return r.full_timeline(parts)


@query(
    "g5_with_average",
    """SELECT l_returnflag, CASE WHEN grouping(l_linenumber) = 1 THEN 'Average' ELSE 'Fold ' || l_linenumber END AS label,
    round(avg(l_tax), 8) AS l_tax, round(avg(l_discount), 8) AS l_discount
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag))""",
)
def g5(spark, sf):
    out = r.with_average(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", ["l_tax", "l_discount"])
    return rounded(out, 8)


@query(
    "g6_tidy",
    """SELECT l_returnflag, 'train' AS split, round(avg(l_tax), 8) AS mean, max(l_tax) AS top FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'test', round(avg(l_discount), 8), max(l_discount) FROM lineitem GROUP BY 1""",
)
def g6(spark, sf):
    def cell(c):
        return F.struct(F.avg(c).alias("mean"), F.max(c).alias("top"))

    nested = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        cell("l_tax").alias("train"), cell("l_discount").alias("test")
    )
    return rounded(r.tidy(nested, ["l_returnflag"], ["train", "test"]), 8)


@query(
    "g7_pivot",
    """SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O,
    max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'P') AS P
    FROM orders GROUP BY 1""",
)
def g7(spark, sf):
    return r.pivot_metrics(table(spark, sf, "orders"), "o_totalprice", ["O", "F", "P"], ["o_custkey"], "o_orderstatus")


@query(
    "g8_matrix_to_long",
    """SELECT l_returnflag AS row_var, 'tax' AS col_var, round(avg(l_tax), 8) AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'discount', round(avg(l_discount), 8) FROM lineitem GROUP BY 1""",
)
def g8(spark, sf):
    matrix = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount")
    )
    return rounded(r.matrix_to_long(matrix, "l_returnflag", ["tax", "discount"]), 8)


@query(
    "g9_array_to_rows",
    "SELECT vec_id, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS step, unnest(embedding) AS value FROM embeddings",
)
def g9(spark, sf):
    return r.array_to_rows(table(spark, sf, "embeddings"), ["vec_id"], "embedding")


@query(
    "d2_event_panel",
    with_ctes(EVENT_PANEL, body="SELECT event_type, day, round(value, 6) AS value, n_events FROM evp"),
)
def d2_events(spark, sf):
    return rounded(event_panel(spark, sf))


@query(
    "f6_model_pairs",
    with_ctes(
        LAG_PANEL,
        body="""SELECT industry, year, round(free_cash_flow, 6) AS actual, round(free_cash_flow_lag1, 6) AS forecast_1,
        round(free_cash_flow_lag2, 6) AS forecast_2 FROM lagpanel""",
    ),
)
def f6(spark, sf):
    from catalog.metrics import naive_forecasts

    return rounded(r.pairs_of_models(naive_forecasts(spark, sf), "naive1", "naive2", ["industry", "year"]))


