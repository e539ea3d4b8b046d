"""Report tables over one model run, and diagnostics."""

from pyspark.sql import functions as F

from catalog.common import month_panel, rounded, scratch
from catalog.metrics import NAIVE, PERF, naive_forecasts, naive_metrics
from catalog.models import AR1, AR1_SQL, ar1_sql, split_panel
from catalog.registry import chi2_sf_sql, panel, query, with_ctes
from catalog.series import PACF_CTES, acf_cte, decomposition_sql
from catalog.tests import ADF_FULL, JB_SQL, adf_sql, trend_sql
from panelwright.operators import aggregate as a
from panelwright.operators import arma as ar
from panelwright.operators import var as va
from panelwright.operators.sequence import sequence_forecast
from panelwright.operators.window import decompose
from panelwright.plans import reports as rp
from panelwright.plans.classical import adf_table, feature_panel, information_table, run_models
from panelwright.plans.diagnostics import run_diagnostics
from panelwright.plans.panel import LIQUIDITY
from panelwright.plans.stored_run import run_reports, run_stored
from panelwright.session import settle


@query(
    "j1_forecast_timeline",
    with_ctes(
        NAIVE + """, sh AS (SELECT DISTINCT industry, year, actual - avg(actual) OVER (PARTITION BY industry) AS s FROM fc),
        fl AS (SELECT *, abs(s) > stddev_pop(s) OVER (PARTITION BY industry) AS hit FROM sh)""",
        body="""SELECT industry, year, split, model, round(actual, 6) AS actual, round(forecast, 6) AS forecast, hit AS is_shock,
        CASE WHEN hit THEN CASE WHEN s < 0 THEN 'tightening' ELSE 'improvement' END END AS direction
        FROM fc JOIN fl USING (industry, year)""",
    ),
)
def j1(spark, sf):
    from panelwright.operators.impute import attach

    fc = settle(naive_forecasts(spark, sf))
    mean = fc.groupBy("industry").agg(F.avg("actual").alias("m"))
    fc = attach(fc, mean, ["industry"], ["m"]).withColumn("shock", F.col("actual") - F.col("m")).drop("m")
    out = rp.forecast_timeline(fc, "industry", "year").drop("shock")
    return rounded(out)


@query(
    "j1_split_bounds",
    with_ctes(
        NAIVE,
        body="""SELECT industry, split, min(year) AS first_period, max(year) AS last_period, count(*) AS n_rows
        FROM fc WHERE model = 'naive1' GROUP BY 1, 2""",
    ),
)
def j1_bounds(spark, sf):
    return a.split_bounds(naive_forecasts(spark, sf).filter("model = 'naive1'"), ["industry"])


@query(
    "j3_ic_report",
    with_ctes(
        AR1_SQL + """, l AS (
          SELECT industry, 'ar1' AS model, n, 3 AS k, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS llf FROM ar
          UNION ALL SELECT industry, 'mean', n, 2, -n / 2.0 * (ln(2 * pi() * tss / n) + 1) FROM ar)""",
        body="""SELECT industry, model, CASE model WHEN 'ar1' THEN '(1, 0, 0)' ELSE '(0, 0, 0)' END AS model_order,
        round(2 * k - 2 * llf, 4) AS AIC, round(k * ln(n) - 2 * llf, 4) AS BIC,
        2 * k - 2 * llf = min(2 * k - 2 * llf) OVER (PARTITION BY industry) AS best_AIC,
        k * ln(n) - 2 * llf = min(k * ln(n) - 2 * llf) OVER (PARTITION BY industry) AS best_BIC FROM l""",
    ),
)
def j3(spark, sf):
    rows = split_panel(spark, sf, "nation", "cash_ratio")
    models = {**AR1, "mean": ar.Arma(max_p=0, max_q=0, intercepts=(True,))}
    spec = ar.arma_rows(rows, "cash_ratio", ["industry"], "year", "split = 'train'", 0, models)
    best = settle(ar.select_order(ar.fit_arma(spec), ["industry"]))
    out = rp.ic_report(information_table(best), ["industry"])
    return rounded(
        out.select("industry", "model", F.col("order").alias("model_order"), "AIC", "BIC", "best_AIC", "best_BIC"), 4
    )


@query(
    "j4_cv_report",
    with_ctes(
        PERF,
        """nf AS (SELECT *, CASE split WHEN 'train' THEN 1 ELSE 2 END AS fold FROM perf)""",
        body="""SELECT industry, model, CASE WHEN grouping(fold) = 1 THEN 'Average' ELSE 'Fold ' || fold END AS label,
        round(avg(RMSE), 4) AS RMSE, round(avg(MAE), 4) AS MAE FROM nf
        GROUP BY GROUPING SETS ((industry, model, fold), (industry, model))""",
    ),
)
def j4(spark, sf):
    folds = naive_metrics(spark, sf).withColumn("fold", F.when(F.col("split") == "train", 1).otherwise(2))
    return rounded(rp.cv_report(folds, ["RMSE", "MAE"], ["industry", "model"]), 4)


@query("j6_irf_report")
def j6(spark, sf):
    var = va.fit_var(month_panel(spark, sf, "nation"), ["free_cash_flow", *LIQUIDITY])
    return rounded(rp.irf_report(va.impulse_response(var), ["industry"]), 2)


ONE_ENTITY = "industry = 'BUILDING'"


@query(
    "j7_decomposition_view",
    "SELECT * FROM (" + decomposition_sql(12) + ") WHERE " + ONE_ENTITY,
)
def j7(spark, sf):
    """One entity's view: the filter reaches the scan of the statements."""
    return rounded(decompose(month_panel(spark, sf).filter(ONE_ENTITY), "cash_ratio", 12))


@query("j7_diagnostics_manifest")
def j7_manifest(spark, sf):
    rows = split_panel(spark, sf, "segment").filter("split = 'train'")
    spec = ar.arma_rows(rows, "free_cash_flow", ["industry"], "year", "split = 'train'", 0, AR1)
    best = settle(ar.select_order(ar.fit_arma(spec), ["industry"]))
    res = settle(ar.fitted_values(spec, best))
    return run_diagnostics(rows, res, "free_cash_flow", LIQUIDITY, season=12)["manifest"]


@query(
    "j8_correlation_view",
    with_ctes(
        panel(),
        body="""SELECT industry, round(corr(current_ratio, quick_ratio), 6) AS current_quick,
        round(covar_samp(current_ratio, cash_ratio), 6) AS cov_current_cash FROM panel GROUP BY 1""",
    ),
)
def j8(spark, sf):
    rows = settle(month_panel(spark, sf))
    corr = a.correlation(rows, LIQUIDITY, ["industry"]).filter("row_var = 'current_ratio' AND col_var = 'quick_ratio'")
    cov = a.covariance(rows, LIQUIDITY, ["industry"]).filter("row_var = 'current_ratio' AND col_var = 'cash_ratio'")
    out = corr.select("industry", F.col("value").alias("current_quick")).join(
        cov.select("industry", F.col("value").alias("cov_current_cash")), "industry"
    )
    return rounded(out)


@query(
    "j9_adf_table",
    with_ctes(
        panel()
        + """, cs AS (SELECT industry || '/' || year AS o, unnest(['free_cash_flow', 'current_ratio', 'quick_ratio', 'cash_ratio']) AS c,
          unnest([free_cash_flow, current_ratio, quick_ratio, cash_ratio]) AS v FROM panel)"""
        + adf_sql("v", "cs", "c", "o"),
        body=f'SELECT k AS "column", {ADF_FULL} FROM adf',
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def j9(spark, sf):
    """The pooled panel, one test per column, all columns in one run."""
    rows = settle(month_panel(spark, sf).select("industry", "year", "free_cash_flow", *LIQUIDITY))
    return rounded(adf_table(rows, ["free_cash_flow", *LIQUIDITY], [], ["industry", "year"]))


@query("j12_training_evidence")
def j12(spark, sf):
    _, losses = sequence_forecast(split_panel(spark, sf), "free_cash_flow", LIQUIDITY, validate=True, min_delta=1e-9)
    return rounded(rp.training_evidence(losses, ["industry", "model"]))


# Residuals of the first-order autoregression on the training part, as ``dm``.
AR1_RESIDUALS = ", dm AS (SELECT industry, year, y - c - phi * p AS e FROM lv JOIN ar USING (industry) WHERE p IS NOT NULL)"
BAND = "CASE WHEN {0} < 1.5 THEN 'positive autocorrelation' WHEN {0} < 2.5 THEN 'no autocorrelation' ELSE 'negative autocorrelation' END"


def residual_tests_sql(where=""):
    """All residual tests of one model per entity."""
    return with_ctes(
        ar1_sql("segment", "free_cash_flow") + AR1_RESIDUALS + trend_sql(4),
        """lm2 AS (SELECT industry, count(*) AS n_obs, corr(y, q1) ** 2 + corr(y, q2) ** 2 AS r2, lm.r2 AS r4 FROM qx4 JOIN lm USING (industry) GROUP BY 1, lm.r2),
        sq AS (SELECT industry, year, e * e AS v FROM dm)""",
        acf_cte("sq", "v", "industry", "year", 10),
        """lb AS (SELECT k AS industry, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)) AS q FROM acfs WHERE lag > 0 GROUP BY 1),
        dw AS (SELECT industry, sum((e - p) ** 2) / sum(e ** 2) AS dw FROM (
          SELECT industry, e, lag(e) OVER (PARTITION BY industry ORDER BY year) AS p FROM dm) GROUP BY 1)""",
        body=f"""SELECT industry, 'ar1' AS model, n_obs, round(n_obs * r2, 6) AS bp_stat, round({chi2_sf_sql('n_obs * r2', 2)}, 6) AS bp_p,
        round(n_obs * r4, 6) AS white_stat, round({chi2_sf_sql('n_obs * r4', 4)}, 6) AS white_p, round(q, 6) AS lb_stat,
        round({chi2_sf_sql('q', 10)}, 6) AS lb_p, round(dw, 6) AS dw_stat, {BAND.format('dw')} AS dw, statistic AS jb_stat, normal
        FROM lm2 JOIN lb USING (industry) JOIN dw USING (industry)
        JOIN ({JB_SQL.format(key="industry", src="(SELECT industry, e AS v FROM dm)", d=6)}) jb USING (industry, n_obs) {where}""",
    )


def residual_tests(tests):
    return rounded(
        tests.select(
            "industry", "model", "n_obs", F.col("breusch_pagan.lm_stat").alias("bp_stat"), F.col("breusch_pagan.p_value").alias("bp_p"),
            F.col("white.lm_stat").alias("white_stat"), F.col("white.p_value").alias("white_p"), F.col("ljung_box_squared.lb_stat").alias("lb_stat"),
            F.col("ljung_box_squared.p_value").alias("lb_p"), F.col("durbin_watson.statistic").alias("dw_stat"),
            F.col("durbin_watson.interpretation").alias("dw"), F.col("jarque_bera.statistic").alias("jb_stat"), F.col("jarque_bera.normal").alias("normal"),
        )
    )


@query("h8_residual_tables", residual_tests_sql())
def h8(spark, sf):
    rows = split_panel(spark, sf, "segment").filter("split = 'train'")
    spec = ar.arma_rows(rows, "free_cash_flow", ["industry"], "year", "split = 'train'", 0, AR1)
    best = settle(ar.select_order(ar.fit_arma(spec), ["industry"]))
    res = settle(ar.fitted_values(spec, best))
    return residual_tests(run_diagnostics(rows, res, "free_cash_flow", LIQUIDITY)["residual_tests"])


def stored_segments(spark, sf):
    """A run of one model over the segments, with all diagnostic tables, in a store of its own."""
    rows = settle(month_panel(spark, sf).select("industry", "year", "free_cash_flow", *LIQUIDITY))
    options = {"d": 0, "cv": False, "var_cols": ["free_cash_flow"]}
    return run_stored(rows, scratch(spark, "store"), AR1, batches=1, season=12, diagnostics=True, **options)


@query("j7_residual_tests_view", residual_tests_sql("WHERE " + ONE_ENTITY))
def j7_tests(spark, sf):
    """The stored tests of one entity and model."""
    return residual_tests(stored_segments(spark, sf).read("residual_tests").filter(ONE_ENTITY))


@query(
    "j7_residual_acf_view",
    with_ctes(
        ar1_sql("segment", "free_cash_flow") + AR1_RESIDUALS,
        acf_cte("dm", "e", "industry", "year", 20) + PACF_CTES,
        body=f"""SELECT industry, 'ar1' AS model, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, round(pacf, 6) AS pacf,
        round(acf + aw, 6) AS acf_ci_hi, round(pacf + pw, 6) AS pacf_ci_hi FROM zp WHERE {ONE_ENTITY}""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def j7_acf(spark, sf):
    """The stored autocorrelations of one entity's residuals."""
    out = stored_segments(spark, sf).read("residual_acf_pacf").filter(ONE_ENTITY)
    return rounded(out.select("industry", "model", "lag", "acf", "pacf", "acf_ci_hi", "pacf_ci_hi"))


@query(
    "i18_resumed_run",
    with_ctes(
        AR1_SQL,
        """te AS (SELECT industry, year, cash_ratio AS actual, row_number() OVER (PARTITION BY industry ORDER BY year) AS h
          FROM split WHERE split = 'test'),
        la AS (SELECT industry, arg_max(y, year) AS yt FROM lv GROUP BY 1),
        fc AS (SELECT industry, 'ar1' AS model, actual, c / (1 - phi) + phi ** h * (yt - c / (1 - phi)) AS f, n, rss, 6 AS k FROM te JOIN ar USING (industry) JOIN la USING (industry)
          UNION ALL SELECT industry, 'mean', actual, mean, n, tss, 4 FROM te JOIN ar USING (industry))""",
        body="""SELECT industry, model, round(sqrt(avg((actual - f) ** 2)), 6) AS RMSE, round(avg(abs(actual - f)), 6) AS MAE,
        round(any_value(n * (ln(2 * pi() * rss / n) + 1) + k), 4) AS AIC, 'ok' AS status FROM fc GROUP BY 1, 2""",
    ),
)
def i18_resumed(spark, sf):
    """A run stopped after two of four batches and taken up again; its reports read the store."""
    rows = settle(month_panel(spark, sf, "nation").select("industry", "year", "cash_ratio"))
    models = {**AR1, "mean": ar.Arma(max_p=0, max_q=0, intercepts=(True,))}
    path = scratch(spark, "store")
    options = {"models": models, "target": "cash_ratio", "batches": 4, "d": 0, "cv": False, "var_cols": ["cash_ratio"]}
    run_stored(rows, path, most=2, **options)
    store = run_stored(rows, path, **options)
    out = run_reports(store)
    test = out["metrics"].filter("split = 'test'").select("industry", "model", "RMSE", "MAE")
    out = test.join(out["information"].select("industry", "model", "AIC"), ["industry", "model"]).join(out["status"].select("industry", "model", "status"), ["industry", "model"])
    return rounded(out, 6, AIC=4)


@query("j_full_run")
def j_full(spark, sf):
    """Every step of the classical run, ending in the comparison tests."""
    out = run_models(feature_panel(month_panel(spark, sf)), season=12)
    return rounded(rp.dm_report(out["dm"]), 6)


