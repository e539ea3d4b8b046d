"""Accuracy, comparison and selection, fed by naive forecasts of the panel."""

from pyspark.sql import functions as F

from catalog.common import month_panel, rounded
from catalog.derive import LAG_PANEL
from catalog.registry import erfc_sql, query, with_ctes
from panelwright.operators import metrics as m
from panelwright.operators import reshape as r
from panelwright.operators.window import add_lags, time_split

MODELS = ["naive1", "naive2", "zero"]


def naive_forecasts(spark, sf, entity="segment"):
    """Long table of three simple forecasts: last value, the one before, zero."""
    rows = add_lags(month_panel(spark, sf, entity), ["free_cash_flow", "current_ratio", "quick_ratio", "cash_ratio"], 2)
    rows = time_split(rows.withColumnRenamed("free_cash_flow", "actual"))
    cells = [
        F.struct(F.lit(name).alias("model"), value.alias("forecast"))
        for name, value in (
            ("naive1", F.col("free_cash_flow_lag1")),
            ("naive2", F.col("free_cash_flow_lag2")),
            ("zero", F.lit(0.0)),
        )
    ]
    return rows.select("industry", "year", "split", "actual", F.inline(F.array(*cells)))


NAIVE = LAG_PANEL + """,
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY industry ORDER BY year) AS rk FROM lagpanel),
cut AS (SELECT industry, greatest(1, floor(count(DISTINCT year) * 0.8)) AS c FROM lagpanel GROUP BY 1),
sp AS (SELECT r.*, CASE WHEN rk <= c THEN 'train' ELSE 'test' END AS split FROM ranked r JOIN cut USING (industry)),
fc AS (
  SELECT industry, year, split, free_cash_flow AS actual, 'naive1' AS model, free_cash_flow_lag1 AS forecast FROM sp
  UNION ALL SELECT industry, year, split, free_cash_flow, 'naive2', free_cash_flow_lag2 FROM sp
  UNION ALL SELECT industry, year, split, free_cash_flow, 'zero', 0.0 FROM sp)"""

METRIC_COLS = """count(*) AS n_obs, avg((actual - forecast) ** 2) AS MSE, sqrt(avg((actual - forecast) ** 2)) AS RMSE,
  avg(abs(actual - forecast)) AS MAE, 100 * avg(CASE WHEN actual <> 0 THEN abs((actual - forecast) / actual) END) AS MAPE,
  100 * avg(2 * abs(actual - forecast) / CASE WHEN abs(actual) + abs(forecast) = 0 THEN 1e-8
    ELSE abs(actual) + abs(forecast) END) AS SMAPE,
  avg(CASE WHEN actual <> 0 THEN ((actual - forecast) / actual) ** 2 END) AS MSRE,
  CASE WHEN max(actual) = min(actual) THEN {0}
    ELSE 1 - avg((actual - forecast) ** 2) / var_pop(actual) END AS R2"""
SCORE = "CASE WHEN max(abs(actual - forecast)) = 0 THEN 1.0 ELSE 0.0 END"
PERF = NAIVE + f""",
perf AS (SELECT industry, model, split, {METRIC_COLS.format(SCORE)} FROM fc GROUP BY 1, 2, 3)"""
ROUND_METRICS = """round(MSE, 2) AS MSE, round(RMSE, 4) AS RMSE, round(MAE, 4) AS MAE, round(MAPE, 4) AS MAPE,
  round(SMAPE, 4) AS SMAPE, round(MSRE, 4) AS MSRE, round(R2, 6) AS R2"""
DIGITS = {"MSE": 2, "R2": 6}


def naive_metrics(spark, sf, **options):
    return m.forecast_metrics(naive_forecasts(spark, sf), ["industry", "model", "split"], **options)


@query("d6_forecast_metrics", with_ctes(PERF, body=f"SELECT industry, model, split, n_obs, {ROUND_METRICS} FROM perf"))
def d6(spark, sf):
    return rounded(naive_metrics(spark, sf), 4, **DIGITS)


EVENT_FC = """fc AS (
  SELECT event_type, user_id % 7 AS g, CASE WHEN event_type = 'error' THEN 5.0 ELSE value END AS actual,
    CASE WHEN event_type = 'error' THEN 5.0 ELSE avg(value) OVER () END AS forecast FROM events)"""


@query(
    "d7_metrics_null_r2",
    with_ctes(
        EVENT_FC,
        body=f"""SELECT event_type, n_obs, round(MSE, 4) AS MSE, round(RMSE, 4) AS RMSE, round(MAE, 4) AS MAE,
        round(MAPE, 4) AS MAPE, round(SMAPE, 4) AS SMAPE, round(R2, 6) AS R2
        FROM (SELECT event_type, {METRIC_COLS.format('NULL')} FROM fc GROUP BY 1)""",
    ),
)
def d7(spark, sf):
    """Constant actuals (here: all error events) have no R2."""
    from panelwright.sources.star import table

    events = table(spark, sf, "events")
    mean = events.agg(F.avg("value").alias("m")).scalar()
    error = F.col("event_type") == "error"
    fc = events.select(
        "event_type",
        F.when(error, 5.0).otherwise(F.col("value")).alias("actual"),
        F.when(error, 5.0).otherwise(mean).alias("forecast"),
    )
    return rounded(m.forecast_metrics(fc, ["event_type"], r2_const="null", msre=False), 4, R2=6)


DM = NAIVE + """,
loss AS (SELECT industry, year, model, (actual - forecast) ** 2 AS l FROM fc WHERE split = 'test'),
d AS (
  SELECT a.industry, a.model || '_vs_' || b.model AS comparison, a.l - b.l AS d FROM loss a JOIN loss b
  ON a.industry = b.industry AND a.year = b.year AND (a.model, b.model) IN (('naive1', 'naive2'), ('naive1', 'zero'))),
dm AS (SELECT industry, comparison, count(*) AS n_obs, avg(d) / sqrt(var_samp(d) / count(*)) AS DM_stat FROM d GROUP BY 1, 2)"""


def naive_dm(spark, sf):
    fc = naive_forecasts(spark, sf).filter("split = 'test'")
    return m.diebold_mariano(fc, [("naive1", "naive2"), ("naive1", "zero")], ["industry"], "year")


@query("d8_diebold_mariano", with_ctes(DM, body="SELECT industry, comparison, n_obs, round(DM_stat, 6) AS DM_stat FROM dm"))
def d8(spark, sf):
    return rounded(naive_dm(spark, sf).drop("p_value"))


@query(
    "d8_diebold_mariano_p",
    with_ctes(
        DM,
        body=f"""SELECT industry, comparison, n_obs, round(DM_stat, 6) AS DM_stat,
        round({erfc_sql('(abs(DM_stat) / sqrt(2))')}, 6) AS p_value FROM dm""",
    ),
)
def d8_p(spark, sf):
    return rounded(naive_dm(spark, sf))


@query(
    "d9_cv_average",
    with_ctes(
        PERF,
        body="SELECT industry, model, round(avg(RMSE), 4) AS RMSE, round(avg(MAE), 4) AS MAE FROM perf GROUP BY 1, 2",
    ),
)
def d9(spark, sf):
    return rounded(m.cv_average(naive_metrics(spark, sf), ["industry", "model"], ["RMSE", "MAE"]), 4)


def _best_sql(metric, sign):
    return with_ctes(
        PERF,
        body=f"""SELECT industry, split, '{metric}' AS metric, arg_min(model, {sign}{metric}) AS best_model,
        round({sign}min({sign}{metric}), 4) AS best_value FROM perf GROUP BY 1, 2""",
    )


@query("d10_best_model", _best_sql("RMSE", ""))
def d10(spark, sf):
    return rounded(m.best_model(naive_metrics(spark, sf), "RMSE", ["industry", "split"]), 4)


@query("d10_best_model_r2", _best_sql("R2", "-"))
def d10_r2(spark, sf):
    return rounded(m.best_model(naive_metrics(spark, sf), "R2", ["industry", "split"]), 4)


@query(
    "i7_information_criteria",
    with_ctes(
        NAIVE,
        body="""SELECT industry, model, round(2 * 2 - 2 * llf, 4) AS AIC, round(2 * ln(n) - 2 * llf, 4) AS BIC,
        round(2 * 2 - 2 * llf + 2 * 2 * 3 / (n - 3), 4) AS AICc, round(2 * 2 * ln(ln(n)) - 2 * llf, 4) AS HQIC,
        round(llf, 4) AS LLF FROM (
          SELECT industry, model, count(*) AS n,
            -count(*) / 2 * (ln(2 * pi() * sum((actual - forecast) ** 2) / count(*)) + 1) AS llf FROM fc GROUP BY 1, 2)""",
    ),
)
def i7(spark, sf):
    err = F.col("actual") - F.col("forecast")
    sums = naive_forecasts(spark, sf).groupBy("industry", "model").agg(
        F.sum(err * err).alias("rss"), F.count("*").alias("n")
    )
    llf = m.gaussian_llf(F.col("rss"), F.col("n"))
    cols = m.information_criteria(llf, F.lit(2), F.col("n"))
    return rounded(sums.select("industry", "model", *[c.alias(k) for k, c in cols.items()]), 4)


# --- report tables over the metrics ---------------------------------------------------------


@query(
    "j2_metrics_by_model",
    with_ctes(
        PERF,
        body=f"""SELECT industry, model, split, n_obs, {ROUND_METRICS},
        row_number() OVER (PARTITION BY industry, split ORDER BY perf.RMSE, model) = 1 AS best FROM perf""",
    ),
)
def j2(spark, sf):
    from panelwright.plans.reports import mark_best

    return rounded(mark_best(naive_metrics(spark, sf), "RMSE", ["industry", "split"]), 4, **DIGITS)


@query(
    "j10_cross_entity_grid",
    with_ctes(
        PERF,
        body="""SELECT industry, CASE industry WHEN 'BUILDING' THEN 'Construction' ELSE industry END AS industry_name,
        round(max(RMSE) FILTER (model = 'naive1'), 4) AS naive1, round(max(RMSE) FILTER (model = 'naive2'), 4) AS naive2,
        CAST(NULL AS DOUBLE) AS arima FROM perf WHERE split = 'test' GROUP BY 1""",
    ),
)
def j10(spark, sf):
    from panelwright.plans.reports import cross_entity_grid

    perf = naive_metrics(spark, sf)
    out = cross_entity_grid(
        perf, "RMSE", ["naive1", "naive2", "arima"], {"BUILDING": "Construction"}, entity="industry"
    )
    return rounded(out, 4)


@query(
    "j11_sequence_metrics",
    with_ctes(
        PERF,
        body="""SELECT industry, industry AS industry_name, round(max(R2) FILTER (model = 'naive1'), 6) AS naive1,
        round(max(R2) FILTER (model = 'naive2'), 6) AS naive2, round(max(R2) FILTER (model = 'zero'), 6) AS zero,
        arg_max(model, R2) AS best_model FROM perf WHERE split = 'test' GROUP BY 1""",
    ),
)
def j11(spark, sf):
    from panelwright.operators.impute import attach
    from panelwright.plans.reports import cross_entity_grid

    perf = naive_metrics(spark, sf, r2_const="null")
    grid = cross_entity_grid(perf, "R2", MODELS, {}, entity="industry")
    best = m.best_model(perf.filter("split = 'test'"), "R2", ["industry"])
    return rounded(attach(grid, best, ["industry"], ["best_model"]), 6)


@query(
    "j5_dm_verdict",
    with_ctes(
        DM,
        body="""SELECT industry, comparison, round(DM_stat, 6) AS DM_stat,
        CASE WHEN abs(DM_stat) > 1.959963984540054 THEN 'significant' ELSE 'not significant' END AS verdict FROM dm""",
    ),
)
def j5(spark, sf):
    from panelwright.plans.reports import dm_report

    return rounded(dm_report(naive_dm(spark, sf)).select("industry", "comparison", "DM_stat", "verdict"))


@query("f1_timeline", with_ctes(NAIVE, body="SELECT industry, year, split, model, round(forecast, 6) AS forecast FROM fc"))
def f1_timeline(spark, sf):
    parts = naive_forecasts(spark, sf).select("industry", "year", "model", "forecast", F.col("split").alias("s"))
    stacked = r.full_timeline({k: parts.filter(F.col("s") == k).drop("s") for k in ("train", "test")})
    return rounded(stacked)
