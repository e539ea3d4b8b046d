"""Factor, forecasting, autoregression and sequence models."""

from pyspark.sql import functions as F

from catalog.common import month_panel, rounded
from catalog.metrics import METRIC_COLS, SCORE
from catalog.panel import SPLIT
from catalog.registry import gram_sql, panel, query, with_ctes
from catalog.series import FOLDS
from panelwright.operators import arma as ar
from panelwright.operators import factor as fa
from panelwright.operators import sequence as sq
from panelwright.operators import trend as tr
from panelwright.operators import var as va
from panelwright.operators.window import add_lags, time_split
from panelwright.plans.classical import feature_panel, run_models
from panelwright.plans.panel import LIQUIDITY
from panelwright.plans.reports import training_evidence
from panelwright.plans.sequence_run import run_sequence_models
from panelwright.session import settle
from panelwright.sources.star import table

TRAIN = "split = 'train'"


def split_panel(spark, sf, entity="nation", *cols):
    keep = cols or ("free_cash_flow", *LIQUIDITY, "working_capital")
    return settle(time_split(month_panel(spark, sf, entity)).select("industry", "year", "split", *keep))


# With two columns the first component is their scaled sum or difference.
PCA2 = panel("nation") + """,
zz AS (SELECT industry, year, (cash_ratio - avg(cash_ratio) OVER ()) / stddev_pop(cash_ratio) OVER () AS a,
  (quick_ratio - avg(quick_ratio) OVER ()) / stddev_pop(quick_ratio) OVER () AS b FROM panel),
pf AS (SELECT industry, year, (a + sign((SELECT corr(a, b) FROM zz)) * b) / sqrt(2) AS f FROM zz)"""


@query("i1_pca_two_columns", with_ctes(PCA2, body="SELECT industry, year, round(f, 6) AS factor FROM pf"))
def i1_two(spark, sf):
    out = fa.pca_factor(month_panel(spark, sf, "nation"), ["cash_ratio", "quick_ratio"], name="factor")
    return rounded(out.select("industry", "year", "factor"))


@query("i1_pca_factor")
def i1(spark, sf):
    out = fa.pca_factor(month_panel(spark, sf, "nation"), LIQUIDITY)
    return rounded(out.select("industry", "year", "liquidity_factor_pca"))


@query(
    "i1_factor_variance",
    with_ctes(
        PCA2,
        body="SELECT count(*) AS n, round(1 + abs(corr(a, b)), 6) AS variance, round((1 + abs(corr(a, b))) / 2, 6) AS share FROM zz",
    ),
)
def i1_variance(spark, sf):
    out = fa.factor_loadings(month_panel(spark, sf, "nation"), ["cash_ratio", "quick_ratio"])
    return rounded(out.select("n", "variance", "share"))


@query("i2_dynamic_factor")
def i2(spark, sf):
    return rounded(
        fa.dynamic_factor(month_panel(spark, sf, "nation"), LIQUIDITY).select(
            "industry", "year", "liquidity_factor_dfm", "liquidity_shock_dfm", "factor_innovation"
        )
    )


@query("i2_dynamic_factor_pooled")
def i2_pooled(spark, sf):
    out = fa.dynamic_factor(month_panel(spark, sf, "nation"), LIQUIDITY, [], ["industry", "year"])
    return rounded(out.select("industry", "year", "liquidity_factor_dfm", "liquidity_shock_dfm"))


@query(
    "i3_fallback_factor",
    with_ctes(
        PCA2,
        body="""SELECT industry, year, round(f, 6) AS liquidity_factor_dfm,
        round(coalesce(f - lag(f) OVER (PARTITION BY industry ORDER BY year), 0), 6) AS liquidity_shock_dfm FROM pf""",
    ),
)
def i3(spark, sf):
    rows = fa.pca_factor(month_panel(spark, sf, "nation"), ["cash_ratio", "quick_ratio"])
    out = fa.fallback_factor(rows)
    return rounded(out.select("industry", "year", "liquidity_factor_dfm", "liquidity_shock_dfm"))


AR1 = {"ar1": ar.Arma(max_p=1, max_q=0, min_p=1, intercepts=(True,))}


def ar1_sql(entity="nation", col="cash_ratio"):
    return panel(entity) + SPLIT.format("panel") + f""",
lv AS (SELECT industry, year, {col} AS y, lag({col}) OVER (PARTITION BY industry ORDER BY year) AS p
  FROM split WHERE split = 'train'),
ar AS (SELECT industry, count(*) AS n, regr_slope(y, p) AS phi, regr_intercept(y, p) AS c, avg(y) AS mean,
  regr_syy(y, p) - regr_sxy(y, p) ** 2 / regr_sxx(y, p) AS rss, regr_syy(y, p) AS tss FROM lv WHERE p IS NOT NULL GROUP BY 1)"""


AR1_SQL = ar1_sql()


def ar1(spark, sf):
    rows = split_panel(spark, sf, "nation", "cash_ratio")
    spec = ar.arma_rows(rows, "cash_ratio", ["industry"], "year", TRAIN, 0, AR1)
    return spec, ar.select_order(ar.fit_arma(spec), ["industry"])


@query(
    "i4_ar1_fit",
    with_ctes(
        AR1_SQL,
        body="""SELECT industry, n AS n_obs, round(phi, 6) AS phi, round(rss, 8) AS rss, '(1, 0, 0)' AS model_order,
        round(n * (ln(2 * pi() * rss / n) + 1) + 6, 4) AS AIC FROM ar""",
    ),
)
def i4(spark, sf):
    _, best = ar1(spark, sf)
    out = best.select(
        "industry", "n_obs", F.col("coefs")[1].alias("phi"), "rss", F.col("order").alias("model_order"), "AIC"
    )
    return rounded(out, 6, rss=8, AIC=4)


@query("i4_arma_grid")
def i4_grid(spark, sf):
    """All orders of the plain family with a tested differencing order."""
    rows = split_panel(spark, sf)
    spec = ar.arma_rows(rows, "free_cash_flow", ["industry"], "year", TRAIN, None, {"arima": ar.Arma()})
    fits = ar.fit_arma(spec).select("industry", "order", "with_constant", "n_obs", "n_params", "AIC", "BIC", "status")
    return rounded(fits, 4)


@query("i4_seasonal_fit")
def i4_seasonal(spark, sf):
    rows = split_panel(spark, sf)
    models = {"sarima": ar.Arma(max_p=1, max_q=1, seasonal=True)}
    spec = ar.arma_rows(rows, "free_cash_flow", ["industry"], "year", TRAIN, 0, models, season=12)
    best = ar.select_order(ar.fit_arma(spec), ["industry"])
    return rounded(best.select("industry", "order", "seasonal_order", "n_obs", "n_params", "AIC", "BIC"), 4)


@query(
    "i5_one_regressor",
    with_ctes(
        panel("nation") + SPLIT.format("panel"),
        body="""SELECT industry, regr_count(cash_ratio, quick_ratio) AS n_obs,
        round(regr_slope(cash_ratio, quick_ratio), 6) AS beta, round(regr_intercept(cash_ratio, quick_ratio), 6) AS const
        FROM split WHERE split = 'train' GROUP BY 1""",
    ),
)
def i5_one(spark, sf):
    """A regressor alone (no lags): plain regression."""
    rows = split_panel(spark, sf, "nation", "cash_ratio", "quick_ratio")
    models = {"x": ar.Arma(max_p=0, max_q=0, exog=("quick_ratio",), intercepts=(True,))}
    spec = ar.arma_rows(rows, "cash_ratio", ["industry"], "year", TRAIN, 0, models)
    best = ar.select_order(ar.fit_arma(spec), ["industry"])
    best = best.join(spec.status.select("industry", "_scale"), "industry")
    at = spec.regressors().index("x_quick_ratio")
    scale = F.col("_scale")
    return rounded(
        best.select(
            "industry", "n_obs", (F.col("coefs")[at] * scale).alias("beta"), "const"
        )
    )


@query("i5_lag_regressors")
def i5(spark, sf):
    rows = add_lags(month_panel(spark, sf, "nation"), ["free_cash_flow", *LIQUIDITY], 2)
    exog = [c for c in rows.columns if "lag" in c]
    models = {"sarimax": ar.Arma(max_p=1, max_q=0, exog=tuple(exog))}
    spec = ar.arma_rows(settle(time_split(rows)), "free_cash_flow", ["industry"], "year", TRAIN, 0, models)
    best = ar.select_order(ar.fit_arma(spec), ["industry"])
    return rounded(best.select("industry", "order", "n_obs", "n_params", "AIC"), 4)


@query(
    "i6_select_order",
    with_ctes(
        AR1_SQL,
        body="""SELECT industry, CASE WHEN n * (ln(2 * pi() * rss / n) + 1) + 6 < n * (ln(2 * pi() * tss / n) + 1) + 4
        THEN '(1, 0, 0)' ELSE '(0, 0, 0)' END AS model_order,
        round(least(n * (ln(2 * pi() * rss / n) + 1) + 6, n * (ln(2 * pi() * tss / n) + 1) + 4), 4) AS AIC FROM ar""",
    ),
)
def i6(spark, sf):
    rows = split_panel(spark, sf, "nation", "cash_ratio")
    models = {"ar": ar.Arma(max_p=1, max_q=0, intercepts=(True,))}
    spec = ar.arma_rows(rows, "cash_ratio", ["industry"], "year", TRAIN, 0, models)
    best = ar.select_order(ar.fit_arma(spec), ["industry"], "AIC")
    return rounded(best.select("industry", F.col("order").alias("model_order"), "AIC"), 4)


@query(
    "i7_fit_criteria",
    with_ctes(
        AR1_SQL + ", l AS (SELECT *, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS llf FROM ar)",
        body="""SELECT industry, round(6 - 2 * llf, 4) AS AIC, round(3 * ln(n) - 2 * llf, 4) AS BIC,
        round(6 - 2 * llf + 24.0 / (n - 4), 4) AS AICc, round(6 * ln(ln(n)) - 2 * llf, 4) AS HQIC, round(llf, 4) AS LLF FROM l""",
    ),
)
def i7_fit(spark, sf):
    _, best = ar1(spark, sf)
    return rounded(best.select("industry", "AIC", "BIC", "AICc", "HQIC", "LLF"), 4)


@query(
    "i8_forecast",
    with_ctes(
        AR1_SQL,
        """te AS (SELECT industry, year, cash_ratio AS actual, row_number() OVER (PARTITION BY industry ORDER BY year) AS h
          FROM split WHERE split = 'test'),
        la AS (SELECT industry, arg_max(y, year) AS yt FROM lv GROUP BY 1)""",
        body="""SELECT industry, year, round(actual, 6) AS actual,
        round(c / (1 - phi) + phi ** h * (yt - c / (1 - phi)), 6) AS forecast, 'ok' AS status
        FROM te JOIN ar USING (industry) JOIN la USING (industry)""",
    ),
)
def i8(spark, sf):
    return rounded(ar.forecast(*ar1(spark, sf)).drop("model"))


# The month (YYYYMM) h months after the last one.
LATER = "CAST(((last // 100) * 12 + last % 100 - 1 + h) // 12 * 100 + ((last // 100) * 12 + last % 100 - 1 + h) % 12 + 1 AS INTEGER)"


@query(
    "i8_forecast_horizon",
    with_ctes(
        AR1_SQL,
        "la AS (SELECT industry, arg_max(cash_ratio, year) AS yt, max(year) AS last FROM panel GROUP BY 1)",
        body=f"""SELECT industry, {LATER} AS year,
        round(c / (1 - phi) + phi ** h * (yt - c / (1 - phi)), 6) AS forecast, 'ok' AS status
        FROM ar JOIN la USING (industry), range(1, 13) t(h)""",
    ),
)
def i8_horizon(spark, sf):
    """Twelve months that nobody has seen, from each series' last row."""
    return rounded(ar.forecast(*ar1(spark, sf), h=12, unit="month").drop("model", "actual"))


@query(
    "i8_forecast_horizon_regressor",
    with_ctes(
        panel("nation") + SPLIT.format("panel"),
        """lv AS (SELECT industry, year, cash_ratio AS y, quick_ratio AS x, lag(cash_ratio) OVER (PARTITION BY industry ORDER BY year) AS p
          FROM split WHERE split = 'train'),
        s AS (SELECT industry, avg(y) AS my, avg(x) AS mx, avg(p) AS mp, covar_pop(p, y) AS py, covar_pop(x, y) AS xy,
          covar_pop(p, x) AS px, var_pop(p) AS pp, var_pop(x) AS xx FROM lv WHERE p IS NOT NULL GROUP BY 1),
        b AS (SELECT industry, (py * xx - xy * px) / (pp * xx - px * px) AS phi, (xy * pp - py * px) / (pp * xx - px * px) AS beta, my, mx, mp FROM s),
        la AS (SELECT industry, arg_max(cash_ratio, year) AS yt, max(year) AS last FROM panel GROUP BY 1),
        fx AS (SELECT industry, quick_ratio AS x, row_number() OVER (PARTITION BY industry ORDER BY year DESC) AS back FROM panel
          QUALIFY back <= 12),
        ahead AS (SELECT industry, x, 13 - back AS h FROM fx),
        path AS (SELECT industry, CAST(0 AS BIGINT) AS h, yt AS y FROM la UNION ALL
          SELECT path.industry, path.h + 1, my + phi * (path.y - mp) + beta * (ahead.x - mx)
          FROM path JOIN ahead ON path.industry = ahead.industry AND ahead.h = path.h + 1 JOIN b ON b.industry = path.industry)""",
        body=f"""SELECT industry, {LATER} AS year, round(y, 6) AS forecast, 'ok' AS status
        FROM path JOIN la USING (industry) WHERE h > 0""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def i8_horizon_regressor(spark, sf):
    """An autoregression with a regressor, whose next twelve values are last year's."""
    from pyspark.sql import Window

    rows = split_panel(spark, sf, "nation", "cash_ratio", "quick_ratio")
    models = {"arx": ar.Arma(max_p=1, max_q=0, min_p=1, exog=("quick_ratio",), intercepts=(True,))}
    spec = ar.arma_rows(rows, "cash_ratio", ["industry"], "year", TRAIN, 0, models)
    best = ar.select_order(ar.fit_arma(spec), ["industry"])
    back = F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("year")))
    ahead = rows.withColumn("_back", back).filter("_back <= 12").select("industry", (F.col("year") + 100).alias("year"), "quick_ratio")
    return rounded(ar.forecast(spec, best, 12, ahead, "month").drop("model", "actual"))


AR2 = {"ar2": ar.Arma(max_p=2, max_q=0, min_p=2, intercepts=(True,))}


@query(
    "i4_ar2_at_any_level",
    with_ctes(
        panel("nation") + SPLIT.format("panel"),
        """lv AS (SELECT industry, cash_ratio AS y, lag(cash_ratio) OVER w AS p, lag(cash_ratio, 2) OVER w AS q
          FROM split WHERE split = 'train' WINDOW w AS (PARTITION BY industry ORDER BY year)),
        s AS (SELECT industry, count(*) AS n, covar_pop(p, y) AS py, covar_pop(q, y) AS qy, covar_pop(p, q) AS pq, var_pop(p) AS pp, var_pop(q) AS qq,
          var_pop(y) AS yy FROM lv WHERE q IS NOT NULL GROUP BY 1),
        b AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS phi1, (qy * pp - py * pq) / (pp * qq - pq * pq) AS phi2 FROM s)""",
        body="""SELECT industry, level, round(phi1, 4) AS phi1, round(phi2, 4) AS phi2, round(1e6 * n * (yy - phi1 * py - phi2 * qy), 1) AS rss
        FROM b, (SELECT unnest([100.0, 1e6, 1e8]) AS level)""",
    ),
)
def i4_levels(spark, sf):
    """An autoregression of order two does not depend on the level of its series."""
    rows = split_panel(spark, sf, "nation", "cash_ratio")
    levels = F.explode(F.array(*[F.lit(v) for v in (100.0, 1e6, 1e8)]))
    rows = rows.withColumn("level", levels).withColumn("y", F.col("cash_ratio") * 1000 + F.col("level"))
    keys = ["industry", "level"]
    spec = ar.arma_rows(settle(rows), "y", keys, "year", TRAIN, 0, AR2)
    best = ar.select_order(ar.fit_arma(spec).withColumn("status", F.lit("ok")), keys)
    return rounded(best.select(*keys, F.col("coefs")[1].alias("phi1"), F.col("coefs")[2].alias("phi2"), "rss"), 4, rss=1)


@query("i8_forecast_all_models")
def i8_all(spark, sf):
    rows = split_panel(spark, sf)
    spec = ar.arma_rows(rows, "free_cash_flow", ["industry"], "year", TRAIN, None, ar.default_models(["cash_ratio"]), 12)
    best = ar.select_order(ar.fit_arma(spec), ["industry"])
    return rounded(ar.forecast(spec, best), 2)


@query(
    "i9_fitted_values",
    with_ctes(
        AR1_SQL,
        body="""SELECT industry, year, round(y, 6) AS actual, round(c + phi * p, 6) AS fitted,
        round(y - c - phi * p, 6) AS residual FROM lv JOIN ar USING (industry)""",
    ),
)
def i9(spark, sf):
    return rounded(ar.fitted_values(*ar1(spark, sf)).drop("model"))


@query(
    "i10_cross_validate",
    with_ctes(
        panel("nation") + FOLDS,
        """mm AS (SELECT industry, fold, avg(cash_ratio) AS forecast, count(*) AS train_end FROM folds WHERE role = 'train' GROUP BY 1, 2),
        fc AS (SELECT industry, fold, train_end, cash_ratio AS actual, forecast FROM folds JOIN mm USING (industry, fold, train_end)
          WHERE role = 'test')""",
        body=f"""SELECT industry, fold, train_end, round(MSE, 8) AS MSE, round(RMSE, 6) AS RMSE, round(MAE, 6) AS MAE,
        round(MAPE, 4) AS MAPE, round(SMAPE, 4) AS SMAPE, round(MSRE, 4) AS MSRE, round(R2, 6) AS R2
        FROM (SELECT industry, fold, train_end, {METRIC_COLS.format(SCORE)} FROM fc GROUP BY 1, 2, 3)""",
    ),
)
def i10(spark, sf):
    """The mean model in rolling-origin folds."""
    mean = {"mean": ar.Arma(max_p=0, max_q=0, intercepts=(True,))}
    rows = month_panel(spark, sf, "nation").select("industry", "year", "cash_ratio")
    out = ar.cross_validate(settle(rows), "cash_ratio", ["industry"], "year", mean, d=0)
    out = out.select("industry", "fold", "train_end", "MSE", "RMSE", "MAE", "MAPE", "SMAPE", "MSRE", "R2")
    return rounded(out, 6, MSE=8, MAPE=4, SMAPE=4, MSRE=4)


@query("i10_cross_validate_models")
def i10_models(spark, sf):
    rows = split_panel(spark, sf).filter(TRAIN)
    out = ar.cross_validate(rows, "free_cash_flow", models={"arima": ar.Arma(), "ar": AR1["ar1"]})
    return rounded(out.select("industry", "model", "fold", "train_end", "RMSE", "order", "error"), 2)


VAR2 = panel("nation") + """,
lv AS (SELECT industry, cash_ratio AS a, quick_ratio AS b, lag(cash_ratio) OVER w AS pa, lag(quick_ratio) OVER w AS pb
  FROM panel WINDOW w AS (PARTITION BY industry ORDER BY year)),
cm AS (SELECT industry, count(*) AS n, covar_pop(a, pa) AS aa, covar_pop(a, pb) AS ab, covar_pop(b, pa) AS ba, covar_pop(b, pb) AS bb,
  var_pop(pa) AS vaa, var_pop(pb) AS vbb, covar_pop(pa, pb) AS vab FROM lv WHERE pa IS NOT NULL GROUP BY 1),
cf AS (SELECT industry, n, (aa * vbb - ab * vab) / (vaa * vbb - vab * vab) AS a11, (ab * vaa - aa * vab) / (vaa * vbb - vab * vab) AS a12,
  (ba * vbb - bb * vab) / (vaa * vbb - vab * vab) AS a21, (bb * vaa - ba * vab) / (vaa * vbb - vab * vab) AS a22 FROM cm)"""


@query(
    "i11_fit_var",
    with_ctes(
        VAR2,
        body="""SELECT industry, equation, 1 AS lag, variable, round(value, 6) AS value FROM (
          SELECT industry, 'cash_ratio' AS equation, 'cash_ratio' AS variable, a11 AS value FROM cf
          UNION ALL SELECT industry, 'cash_ratio', 'quick_ratio', a12 FROM cf
          UNION ALL SELECT industry, 'quick_ratio', 'cash_ratio', a21 FROM cf
          UNION ALL SELECT industry, 'quick_ratio', 'quick_ratio', a22 FROM cf)""",
    ),
)
def i11(spark, sf):
    out = va.fit_var(month_panel(spark, sf, "nation"), ["cash_ratio", "quick_ratio"], maxlags=1)
    return rounded(va.var_coefficients(out))


def var_bic_sql(cols, maxlags):
    """For each nation the order by BIC: ``vb`` (industry, p, bic), with standardised columns on the common sample.

    Every order's moments are eliminated column by column; the determinant of
    the residual products is the product of the last pivots.
    """
    k = len(cols)
    z = ", ".join(f"({c} - avg({c}) OVER s) / stddev_pop({c}) OVER s" for c in cols)
    return f""", vz AS (SELECT industry, year, [{z}] AS z FROM panel WINDOW s AS (PARTITION BY industry)),
    vl AS (SELECT industry, count(*) AS n, list(z ORDER BY year) AS zs FROM vz GROUP BY 1),
    vs AS (SELECT industry, {' + '.join(f'ln(stddev_pop({c}))' for c in cols)} AS logs FROM panel GROUP BY 1),
    vx AS (SELECT industry || '/' || p AS k, list_concat([1.0], flatten(list_transform(range(1, p + 1), lambda j: zs[t - j])), zs[t]) AS x
      FROM (SELECT industry, zs, p, unnest(range({maxlags} + 1, n + 1)) AS t FROM vl, range(0, {maxlags} + 1) o(p)))
    {gram_sql("ve", "vx", 1 + k * maxlags + k, 0, ", 0.0::DOUBLE AS logdet", f", logdet + CASE WHEN p >= len(m) - {k} THEN ln(m[p + 1][p + 1]) ELSE 0 END")},
    vb AS (SELECT split_part(ve.k, '/', 1) AS industry, CAST(split_part(ve.k, '/', 2) AS INTEGER) AS p, n - {maxlags} AS rows, n, logs,
      logdet - {k} * ln(n - {maxlags}) + ln(n - {maxlags}) / (n - {maxlags}) * {k} * (1 + {k} * CAST(split_part(ve.k, '/', 2) AS INTEGER)) AS bic
      FROM ve JOIN vl ON vl.industry = split_part(ve.k, '/', 1) JOIN vs ON vs.industry = vl.industry WHERE ve.p = len(ve.m)),
    vp AS (SELECT industry, any_value(n) AS n, greatest(1, arg_min(p, (bic, p))) AS lag_order, min(bic) + 2 * any_value(logs) AS bic FROM vb GROUP BY 1)"""


@query(
    "i11_fit_var_by_bic",
    with_ctes(
        panel("nation") + var_bic_sql(["free_cash_flow", *LIQUIDITY], 5),
        body="""SELECT industry, CAST(lag_order AS INTEGER) AS lag_order, CAST(n - lag_order AS INTEGER) AS n_obs, round(bic, 4) AS bic, 'ok' AS status
        FROM vp""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def i11_bic(spark, sf):
    out = va.fit_var(month_panel(spark, sf, "nation"), ["free_cash_flow", *LIQUIDITY])
    return rounded(out.select("industry", "lag_order", "n_obs", "bic", "status"), 4)


@query(
    "i12_impulse_response_two_lags",
    with_ctes(
        panel("nation") + var_bic_sql(["cash_ratio", "quick_ratio"], 2),
        """fx AS (SELECT industry AS k, list_concat([1.0], flatten(list_transform(range(1, lag_order + 1), lambda j: zs[t - j])), zs[t]) AS x
          FROM (SELECT vl.industry, zs, lag_order, unnest(range(lag_order + 1, vl.n + 1)) AS t FROM vl JOIN vp USING (industry)))
        """ + gram_sql("fe", "fx", 7, 2),
        # Coefficients by elimination above the diagonal too.
        """fj AS (SELECT k, 0 AS p, m FROM fe_m UNION ALL SELECT k, p + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j:
              CASE WHEN i = p + 1 THEN v / m[p + 1][p + 1] ELSE v - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END))
            FROM fj WHERE p < len(m) - 2),
        sds AS (SELECT industry, stddev_pop(cash_ratio) AS s1, stddev_pop(quick_ratio) AS s2 FROM panel GROUP BY 1),
        fc AS (SELECT fj.k AS industry, lag_order, len(m) AS d, m, n - lag_order - (1 + 2 * lag_order) AS dof, s1, s2
          FROM fj JOIN vp ON vp.industry = fj.k JOIN sds ON sds.industry = fj.k WHERE fj.p = len(fj.m) - 2),
        ab AS (SELECT industry, m[2][d - 1] AS a11, m[3][d - 1] * s1 / s2 AS a12, m[2][d] * s2 / s1 AS a21, m[3][d] AS a22,
            CASE WHEN lag_order = 2 THEN m[4][d - 1] ELSE 0 END AS b11, CASE WHEN lag_order = 2 THEN m[5][d - 1] * s1 / s2 ELSE 0 END AS b12,
            CASE WHEN lag_order = 2 THEN m[4][d] * s2 / s1 ELSE 0 END AS b21, CASE WHEN lag_order = 2 THEN m[5][d] ELSE 0 END AS b22,
            sqrt(m[d][d] / dof) * s2 AS shock FROM fc),
        ir AS (SELECT industry, 0 AS h, 0.0::DOUBLE AS y1, 1.0::DOUBLE AS y2, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2 FROM ab
          UNION ALL SELECT ir.industry, h + 1, a11 * y1 + a12 * y2 + b11 * z1 + b12 * z2, a21 * y1 + a22 * y2 + b21 * z1 + b22 * z2, y1, y2
          FROM ir JOIN ab ON ab.industry = ir.industry WHERE h < 10)""",
        body="""SELECT ir.industry, 'quick_ratio' AS impulse, h AS horizon, round(y1 * shock, 6) AS response
        FROM ir JOIN ab ON ab.industry = ir.industry""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def i12_two(spark, sf):
    """Order by BIC up to two, impulses of one residual deviation."""
    out = va.fit_var(month_panel(spark, sf, "nation"), ["cash_ratio", "quick_ratio"], maxlags=2)
    return rounded(va.impulse_response(out, 10, "cash_ratio", scale="sd"))


@query(
    "i12_impulse_response",
    "WITH RECURSIVE" + with_ctes(
        VAR2,
        """ir AS (SELECT industry, 0 AS h, 1.0::DOUBLE AS p1, 0.0::DOUBLE AS p2 FROM cf
          UNION ALL SELECT ir.industry, h + 1, p1 * a11 + p2 * a21, p1 * a12 + p2 * a22 FROM ir JOIN cf USING (industry) WHERE h < 10)""",
        body="SELECT industry, 'quick_ratio' AS impulse, h AS horizon, round(p2, 6) AS response FROM ir",
    )[4:],
)
def i12(spark, sf):
    out = va.fit_var(month_panel(spark, sf, "nation"), ["cash_ratio", "quick_ratio"], maxlags=1)
    return rounded(va.impulse_response(out, 10, "cash_ratio"))


@query("i12_impulse_response_sd")
def i12_sd(spark, sf):
    out = va.fit_var(month_panel(spark, sf, "nation"), ["free_cash_flow", *LIQUIDITY])
    return rounded(va.impulse_response(out, 10, "free_cash_flow", scale="sd"), 2)


@query(
    "i13_trend_line",
    with_ctes(
        panel("nation") + SPLIT.format("panel"),
        """tt AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY year) AS t FROM split),
        ln AS (SELECT industry, regr_slope(cash_ratio, t) AS b, regr_intercept(cash_ratio, t) AS a,
          sqrt((regr_syy(cash_ratio, t) - regr_sxy(cash_ratio, t) ** 2 / regr_sxx(cash_ratio, t)) / (count(*) - 2)) AS sd
          FROM tt WHERE split = 'train' GROUP BY 1)""",
        body="""SELECT industry, year, round(a + b * t, 6) AS yhat, round(a + b * t, 6) AS trend,
        round(a + b * t - 1.2815515655446004 * sd, 6) AS yhat_lower,
        round(a + b * t + 1.2815515655446004 * sd, 6) AS yhat_upper FROM tt JOIN ln USING (industry)""",
    ),
)
def i13_line(spark, sf):
    out = tr.trend_regression(split_panel(spark, sf), "cash_ratio", [], train=TRAIN, changepoints=0)
    return rounded(out.select("industry", "year", "yhat", "trend", "yhat_lower", "yhat_upper"))


@query(
    "i13_trend_one_kink",
    with_ctes(
        panel("nation") + SPLIT.format("panel"),
        """n AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY year) AS t FROM split),
        c AS (SELECT *, (t - 1) / (max(t) FILTER (split = 'train') OVER (PARTITION BY industry) - 1) AS x FROM n),
        d AS (SELECT *, cash_ratio AS y, greatest(x - 0.4, 0) AS h FROM c),
        s AS (SELECT industry, avg(y) AS my, avg(x) AS mx, avg(h) AS mh, covar_pop(x, y) AS xy, covar_pop(h, y) AS hy, covar_pop(x, h) AS xh,
          var_pop(x) AS xx, var_pop(h) AS hh FROM d WHERE split = 'train' GROUP BY 1),
        b AS (SELECT *, (xy * hh - hy * xh) / (xx * hh - xh * xh) AS bx, (hy * xx - xy * xh) / (xx * hh - xh * xh) AS bh FROM s)""",
        body="""SELECT industry, year, round(my + bx * (x - mx) + bh * (h - mh), 6) AS trend FROM d JOIN b USING (industry)""",
    ),
)
def i13_kink(spark, sf):
    """One kink at 40% of the training part, without shrinkage."""
    out = tr.trend_regression(split_panel(spark, sf), "cash_ratio", [], train=TRAIN, changepoints=1, ridge=0.0)
    return rounded(out.select("industry", "year", "trend"))


@query("i13_trend_changepoints")
def i13_changepoints(spark, sf):
    """Which of 25 kinks each nation's trend has."""
    return rounded(tr.trend_changepoints(split_panel(spark, sf), "free_cash_flow", train=TRAIN), 2)


@query("i13_trend_regression")
def i13(spark, sf):
    out = tr.trend_regression(split_panel(spark, sf), "free_cash_flow", LIQUIDITY, train=TRAIN)
    return rounded(out.drop("is_train"), 2)


@query("i14_sequence_forecast")
def i14(spark, sf):
    fc, _ = sq.sequence_forecast(split_panel(spark, sf), "free_cash_flow", LIQUIDITY, fit_on="all")
    return rounded(fc, 2)


@query("i15_univariate_window")
def i15(spark, sf):
    fc, _ = sq.sequence_forecast(split_panel(spark, sf), "free_cash_flow", recursive=False, model="window_uni")
    return rounded(fc, 2)


@query("i16_recursive_rollout")
def i16(spark, sf):
    fc, _ = sq.sequence_forecast(split_panel(spark, sf), "cash_ratio", ["working_capital"])
    return rounded(fc.filter("split = 'test'"), 6)


# One lag of one column: the trained weights are those of the simple regression.
@query(
    "i17_one_step_rollout",
    with_ctes(
        AR1_SQL,
        """al AS (SELECT industry, year, split, cash_ratio AS actual,
          lag(cash_ratio) OVER (PARTITION BY industry ORDER BY year) AS p FROM split)""",
        body="""SELECT industry, year, split, round(actual, 6) AS actual, round(c + phi * p, 6) AS forecast
        FROM al JOIN ar USING (industry) WHERE p IS NOT NULL""",
    ),
)
def i17(spark, sf):
    rows = split_panel(spark, sf, "nation", "cash_ratio")
    fc, _ = sq.sequence_forecast(
        rows, "cash_ratio", n_steps=1, recursive=False, epochs=3000, patience=3000, model="one"
    )
    return rounded(fc.drop("model"))


@query(
    "i16_recursive_one_lag",
    with_ctes(
        AR1_SQL,
        """te AS (SELECT industry, year, cash_ratio AS actual, row_number() OVER (PARTITION BY industry ORDER BY year) AS h
          FROM split WHERE split = 'test'),
        la AS (SELECT industry, arg_max(y, year) AS yt FROM lv GROUP BY 1)""",
        body="""SELECT industry, year, 'test' AS split, round(actual, 6) AS actual,
        round(c / (1 - phi) + phi ** h * (yt - c / (1 - phi)), 6) AS forecast
        FROM te JOIN ar USING (industry) JOIN la USING (industry)
        UNION ALL SELECT industry, year, 'train', round(y, 6), round(c + phi * p, 6)
        FROM lv JOIN ar USING (industry) WHERE p IS NOT NULL""",
    ),
)
def i16_one(spark, sf):
    """Own predictions fed back: with one lag, the path of the simple regression."""
    rows = split_panel(spark, sf, "nation", "cash_ratio")
    fc, _ = sq.sequence_forecast(rows, "cash_ratio", n_steps=1, epochs=3000, patience=3000)
    return rounded(fc.drop("model"))


@query("i18_run_models")
def i18(spark, sf):
    features = feature_panel(month_panel(spark, sf))
    out = run_models(features, season=12, cv=False)
    return rounded(out["metrics"], 4)


@query("i18_run_sequence_models")
def i18_sequence(spark, sf):
    features = feature_panel(month_panel(spark, sf))
    return rounded(run_sequence_models(features)["metrics"], 4)


@query(
    "i19_loss_summary",
    """WITH l AS (SELECT event_type AS entity, 'm' AS model, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS epoch,
      value AS train_loss, value + user_id % 3 AS val_loss FROM events),
    z AS (SELECT entity, model, max(epoch) AS epochs_run, arg_max(train_loss, epoch) AS final_train_loss,
      arg_max(val_loss, epoch) AS final_val_loss FROM l GROUP BY 1, 2)
    SELECT *, 300 AS epochs_max, epochs_run < 300 AS stopped_early, round(final_train_loss / final_val_loss, 8) AS ratio,
      final_train_loss / final_val_loss > 0.7 AND final_train_loss / final_val_loss < 1.3 AS balanced FROM z""",
)
def i19(spark, sf):
    from panelwright.operators.series import numbered

    rows = table(spark, sf, "events").select("event_type", "ts", "event_id", "value", "user_id")
    rows = numbered(rows, ["event_type"], ["ts", "event_id"], "blocks", t="epoch")
    loss = rows.select(
        F.col("event_type").alias("entity"), F.lit("m").alias("model"), "epoch", F.col("value").alias("train_loss"),
        (F.col("value") + F.col("user_id") % 3).alias("val_loss"),
    )
    return rounded(training_evidence(loss), 8)
