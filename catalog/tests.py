"""Unit-root, residual and normality tests."""

from pyspark.sql import functions as F

from catalog.common import month_panel, rounded
from catalog.panel import RATIO
from catalog.registry import chi2_sf_sql, gram_sql, normal_cdf_sql, panel, query, with_ctes
from catalog.series import DEMEANED, acf_cte, demeaned
from panelwright.operators import residual_tests as rt
from panelwright.operators.acf import ljung_box
from panelwright.operators.unitroot import adf, differencing_order
from panelwright.session import settle
from panelwright.sources.star import table


_SURFACE = (
    "(CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau "
    "ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END)"
)
ADF_P_SQL = f"(CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0 ELSE {normal_cdf_sql(_SURFACE)} END)"
ADF0 = """, lv AS (
  SELECT {key}, y, lag(y) OVER ({part} ORDER BY {order}) AS p FROM (SELECT *, {value} AS y FROM {source})),
tau AS (
  SELECT {key}, count(*) AS n_obs,
    regr_slope(y - p, p) / sqrt((regr_syy(y - p, p) - regr_slope(y - p, p) * regr_sxy(y - p, p)) / (count(*) - 2) / regr_sxx(y - p, p)) AS tau
  FROM lv WHERE p IS NOT NULL GROUP BY 1)"""
ADF_COLS = f"""round(tau, 6) AS test_statistic, round({ADF_P_SQL}, 6) AS p_value, CAST(0 AS INTEGER) AS n_lags_used,
  CAST(n_obs AS INTEGER) AS n_obs, round(-2.86154 - 2.8903 / n_obs - 4.234 / n_obs ** 2 - 40.040 / n_obs ** 3, 6) AS crit_5,
  {ADF_P_SQL} < 0.05 AS stationary"""
ADF_OUT = ["test_statistic", "p_value", "n_lags_used", "n_obs", "crit_5", "stationary"]


@query(
    "h1_adf_no_lags",
    with_ctes(
        panel("nation")
        + ADF0.format(key="industry", part="PARTITION BY industry", order="year", value="sum(cash_ratio) OVER (PARTITION BY industry ORDER BY year)", source="panel"),
        body=f"SELECT industry, {ADF_COLS} FROM tau",
    ),
)
def h1_zero(spark, sf):
    """On running sums, which are close to a unit root."""
    from pyspark.sql import Window

    w = Window.partitionBy("industry").orderBy("year")
    rows = month_panel(spark, sf, "nation").withColumn("y", F.sum("cash_ratio").over(w))
    return rounded(adf(settle(rows.select("industry", "year", "y")), "y", lag=0).select("industry", *ADF_OUT))


@query(
    "h1_adf_pooled",
    with_ctes(
        panel("nation")
        + ADF0.format(key="'all' AS g", part="", order="industry, year", value="cash_ratio", source="panel"),
        body=f"SELECT {ADF_COLS} FROM tau",
    ).replace("GROUP BY 1)", "GROUP BY ALL)").replace("SELECT 'all' AS g, count(*)", "SELECT count(*)"),
)
def h1_pooled(spark, sf):
    """The panel as one long series in (entity, period) order."""
    rows = settle(month_panel(spark, sf, "nation").select("industry", "year", "cash_ratio"))
    return rounded(adf(rows, "cash_ratio", [], ["industry", "year"], lag=0).select(*ADF_OUT))


def adf_sql(value, source, key, order, columns=""):
    """Unit-root test with the lag of least AIC, for each series ``k`` (a text) of ``source``.

    Regressors are a constant, the level and the lagged differences, for the
    choice in this order; for the test the level comes last, so that the Schur
    complement of level and newest difference holds its coefficient and error.
    """
    return f""", ys AS (SELECT {key} AS k, {order} AS o, {value} - avg({value}) OVER (PARTITION BY {key}) AS y FROM {source} WHERE {value} IS NOT NULL),
    zs AS (SELECT k, count(*) AS n, stddev_pop(y) AS sd, list(y ORDER BY o) AS z,
      least(CAST(ceil(12 * (count(*) / 100) ** 0.25) AS BIGINT), count(*) // 2 - 2) AS m FROM ys GROUP BY k),
    ts AS (SELECT k, n, sd, m, z, unnest(range(2, n + 1)) AS t FROM zs WHERE n >= 4 AND sd > 0),
    first_x AS (SELECT k, list_concat([1.0, z[t - 1]], list_transform(range(1, m + 1), lambda i: z[t - i] - z[t - i - 1]), [z[t] - z[t - 1]]) AS x
      FROM ts WHERE t >= m + 2)
    {gram_sql("one", "first_x", 40, 1)},
    aics AS (SELECT one.k, p - 2 AS lag, (n - 1 - m) * (ln(2 * pi() * m2 / (n - 1 - m)) + 1) + 2 * p AS aic FROM (
      SELECT k, p, list_extract(list_extract(m, -1), -1) AS m2 FROM one WHERE p >= 2) one JOIN zs ON zs.k = one.k),
    picked AS (SELECT k, arg_min(lag, (aic, lag)) AS lag, min(aic) AS ic FROM aics GROUP BY k),
    second_x AS (SELECT ts.k, list_concat([1.0], list_transform(range(1, lag + 1), lambda i: z[t - i] - z[t - i - 1]), [z[t - 1], z[t] - z[t - 1]]) AS x
      FROM ts JOIN picked ON ts.k = picked.k WHERE t >= lag + 2)
    {gram_sql("two", "second_x", 40, 2)},
    last AS (SELECT two.k, lag, ic, n - 1 - lag AS nobs, list_extract(list_extract(m, -2), -2) AS zz, list_extract(list_extract(m, -2), -1) AS zy,
        list_extract(list_extract(m, -1), -1) AS yy FROM two JOIN picked ON two.k = picked.k JOIN (SELECT k, n FROM zs) ns ON ns.k = two.k
      WHERE p = len(m) - 2),
    adf AS (SELECT k, lag, ic, nobs, zy / zz / sqrt((yy - zy * zy / zz) / (nobs - lag - 2) / zz) AS tau FROM last)"""


ADF_FULL = f"""round(tau, 6) AS test_statistic, round({ADF_P_SQL}, 6) AS p_value, CAST(lag AS INTEGER) AS n_lags_used,
  CAST(nobs AS INTEGER) AS n_obs, round(-3.43035 - 6.5393 / nobs - 16.786 / nobs ** 2 - 79.433 / nobs ** 3, 6) AS crit_1,
  round(-2.86154 - 2.8903 / nobs - 4.234 / nobs ** 2 - 40.040 / nobs ** 3, 6) AS crit_5,
  round(-2.56677 - 1.5384 / nobs - 2.809 / nobs ** 2, 6) AS crit_10, round(ic, 6) AS icbest, {ADF_P_SQL} < 0.05 AS stationary, 'ok' AS status"""


@query(
    "h1_adf",
    with_ctes(panel("nation") + adf_sql("cash_ratio", "panel", "industry", "year"), body=f"SELECT k AS industry, {ADF_FULL} FROM adf").replace(
        "WITH ", "WITH RECURSIVE ", 1
    ),
)
def h1(spark, sf):
    """With the lag chosen by AIC."""
    rows = settle(month_panel(spark, sf, "nation").select("industry", "year", "cash_ratio"))
    return rounded(adf(rows, "cash_ratio"))


@query(
    "h2_differencing_order",
    with_ctes(
        panel("nation")
        + """, ds AS (SELECT industry, year, free_cash_flow AS w0, w0 - lag(w0) OVER s AS w1, w0 - 2 * lag(w0) OVER s + lag(w0, 2) OVER s AS w2
          FROM panel WINDOW s AS (PARTITION BY industry ORDER BY year)),
        dl AS (SELECT industry, year, unnest([0, 1, 2]) AS d, unnest([w0, w1, w2]) AS w FROM ds)"""
        + adf_sql("w", "dl", "industry || '/' || d", "year"),
        body=f"""SELECT industry, CAST(coalesce(min(d) FILTER (WHERE {ADF_P_SQL} < 0.05), 2) AS INTEGER) AS d FROM (
          SELECT split_part(k, '/', 1) AS industry, CAST(split_part(k, '/', 2) AS INTEGER) AS d, tau FROM adf) GROUP BY 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def h2(spark, sf):
    rows = settle(month_panel(spark, sf, "nation").select("industry", "year", "free_cash_flow"))
    return differencing_order(rows, "free_cash_flow")


@query(
    "h3_ljung_box",
    with_ctes(
        panel("nation") + DEMEANED + ", sq AS (SELECT industry, year, e * e AS v FROM dm),"
        + acf_cte("sq", "v", "industry", "year", 10)
        + """, q AS (SELECT k, any_value(n) AS n_obs, CAST(max(lag) AS INTEGER) AS lags,
            any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)) AS s FROM acfs WHERE lag > 0 GROUP BY 1)""",
        body=f"""SELECT k AS industry, n_obs, lags, round(s, 6) AS lb_stat, round({chi2_sf_sql('s', 'lags')}, 6) AS p_value,
        {chi2_sf_sql('s', 'lags')} < 0.05 AS arch_effects FROM q""",
    ),
)
def h3(spark, sf):
    return rounded(ljung_box(settle(demeaned(spark, sf)), ["industry"], "year"))


# Squared residuals on polynomials in time, made orthogonal one after the other, so
# that R2 is the sum of squared simple correlations.
def trend_sql(powers):
    out = """, tr AS (SELECT industry, e * e AS y, (2.0 * row_number() OVER (PARTITION BY industry ORDER BY year)
      - count(*) OVER (PARTITION BY industry) - 1) / count(*) OVER (PARTITION BY industry) AS s FROM dm),
    q0 AS (SELECT industry, y, s, s - avg(s) OVER (PARTITION BY industry) AS q1 FROM tr)"""
    for p in range(2, powers + 1):
        fits = " - ".join(
            f"q{j} * sum(s ** {p} * q{j}) OVER (PARTITION BY industry) / sum(q{j} * q{j}) OVER (PARTITION BY industry)"
            for j in range(1, p)
        )
        out += f""", qx{p} AS (SELECT *, s ** {p} - avg(s ** {p}) OVER (PARTITION BY industry) - {fits} AS q{p}
          FROM {'q0' if p == 2 else f'qx{p - 1}'})"""
    r2 = " + ".join(f"corr(y, q{j}) ** 2" for j in range(1, powers + 1))
    last = "q0" if powers == 1 else f"qx{powers}"
    return out + f", lm AS (SELECT industry, count(*) AS n_obs, {r2} AS r2 FROM {last} GROUP BY 1)"


def _variance_sql(powers):
    return with_ctes(
        panel("nation") + DEMEANED + trend_sql(powers),
        body=f"""SELECT industry, n_obs, round(n_obs * r2, 6) AS lm_stat,
        round({chi2_sf_sql('n_obs * r2', powers)}, 6) AS p_value,
        round((r2 / {powers}) / ((1 - r2) / (n_obs - {powers + 1})), 6) AS f_stat,
        {chi2_sf_sql('n_obs * r2', powers)} < 0.05 AS heteroskedastic FROM lm""",
    )


@query("h4_breusch_pagan", _variance_sql(2))
def h4(spark, sf):
    return rounded(rt.breusch_pagan(settle(demeaned(spark, sf)), ["industry"], "year").drop("f_p_value", "df"))


@query("h5_white", _variance_sql(4))
def h5(spark, sf):
    return rounded(rt.white_test(settle(demeaned(spark, sf)), ["industry"], "year").drop("f_p_value", "df"))


def _exog_sql(exprs, df):
    """Squared deviations of the cash flow on given regressors, made orthogonal in turn."""
    cols = ", ".join(f"{e} AS x{i}" for i, e in enumerate(exprs, 1))
    g = "OVER (PARTITION BY industry)"
    out = f""", o0 AS (SELECT industry, (flow / 1e5) ** 2 AS y, {cols} FROM (
      SELECT *, free_cash_flow - avg(free_cash_flow) {g} AS flow, (current_ratio - avg(current_ratio) {g}) / stddev_pop(current_ratio) {g} AS a,
        (cash_ratio - avg(cash_ratio) {g}) / stddev_pop(cash_ratio) {g} AS b FROM panel))"""
    for p in range(1, len(exprs) + 1):
        fits = "".join(f" - q{j} * sum(x{p} * q{j}) {g} / sum(q{j} * q{j}) {g}" for j in range(1, p))
        out += f", o{p} AS (SELECT *, x{p} - avg(x{p}) {g}{fits} AS q{p} FROM o{p - 1})"
    r2 = " + ".join(f"corr(y, q{j}) ** 2" for j in range(1, len(exprs) + 1))
    out += f", lm AS (SELECT industry, count(*) AS n_obs, {r2} AS r2 FROM o{len(exprs)} GROUP BY 1)"
    return with_ctes(
        panel("nation") + out,
        body=f"""SELECT industry, n_obs, round(n_obs * r2, 6) AS lm_stat, {df} AS df,
        round({chi2_sf_sql('n_obs * r2', df)}, 6) AS p_value,
        round((r2 / {df}) / ((1 - r2) / (n_obs - {df + 1})), 6) AS f_stat,
        {chi2_sf_sql('n_obs * r2', df)} < 0.05 AS heteroskedastic FROM lm""",
    )


def _flow_residuals(spark, sf):
    from panelwright.operators.impute import attach

    rows = settle(month_panel(spark, sf, "nation"))
    mean = rows.groupBy("industry").agg(F.avg("free_cash_flow").alias("m"))
    return attach(rows, mean, ["industry"], ["m"]).withColumn("residual", F.col("free_cash_flow") - F.col("m"))


@query("h4_breusch_pagan_exog", _exog_sql(["a", "b"], 2))
def h4_exog(spark, sf):
    rows = _flow_residuals(spark, sf)
    return rounded(rt.breusch_pagan(rows, ["industry"], "year", exog=["current_ratio", "cash_ratio"]).drop("f_p_value"))


@query("h5_white_exog", _exog_sql(["a", "b", "a * a", "a * b", "b * b"], 5))
def h5_exog(spark, sf):
    rows = _flow_residuals(spark, sf)
    return rounded(rt.white_test(rows, ["industry"], "year", exog=["current_ratio", "cash_ratio"]).drop("f_p_value"))


JB_SQL = """SELECT {key}, n_obs, round(n_obs / 6.0 * (skew ** 2 + kurt ** 2 / 4), {d}) AS statistic,
  round(exp(-n_obs / 12.0 * (skew ** 2 + kurt ** 2 / 4)), 6) AS p_value,
  exp(-n_obs / 12.0 * (skew ** 2 + kurt ** 2 / 4)) >= 0.05 AS normal FROM (
    SELECT {key}, count(*) AS n_obs, avg((v - m) ** 3) / avg((v - m) ** 2) ** 1.5 AS skew,
      avg((v - m) ** 4) / avg((v - m) ** 2) ** 2 - 3 AS kurt FROM (
        SELECT {key}, v, avg(v) OVER (PARTITION BY {key}) AS m FROM {src}) GROUP BY 1)"""


@query(
    "h6_jarque_bera",
    with_ctes(panel("nation") + DEMEANED, body=JB_SQL.format(key="industry", src="(SELECT industry, e AS v FROM dm)", d=6)),
)
def h6(spark, sf):
    return rounded(rt.jarque_bera(demeaned(spark, sf), ["industry"]).drop("skew", "kurtosis"))


@query(
    "h6_jarque_bera_records",
    JB_SQL.format(key="l_returnflag", src=f"(SELECT l_returnflag, {RATIO} AS v FROM lineitem WHERE l_discount <> 0)", d=2),
)
def h6_records(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount")).alias("residual")
    )
    return rounded(rt.jarque_bera(rows, ["l_returnflag"]).drop("skew", "kurtosis"), 6, statistic=2)


@query(
    "h7_residual_report",
    with_ctes(
        panel("nation") + DEMEANED + trend_sql(2),
        body=f"""SELECT industry, n_obs, round(n_obs * r2, 6) AS bp_stat, jb.statistic AS jb_stat, jb.normal,
        dwt.dw, CASE WHEN dwt.dw < 1.5 THEN 'positive autocorrelation' WHEN dwt.dw < 2.5 THEN 'no autocorrelation'
          ELSE 'negative autocorrelation' END AS band
        FROM lm JOIN ({JB_SQL.format(key="industry", src="(SELECT industry, e AS v FROM dm)", d=6)}) jb USING (industry, n_obs)
        JOIN (SELECT industry, round(sum((e - p) ** 2) / sum(e ** 2), 6) AS dw FROM (
          SELECT industry, e, lag(e) OVER (PARTITION BY industry ORDER BY year) AS p FROM dm) GROUP BY 1) dwt USING (industry)""",
    ),
)
def h7(spark, sf):
    out = rt.residual_report(demeaned(spark, sf), ["industry"], "year")
    return rounded(
        out.select(
            "industry", "n_obs", F.col("breusch_pagan.lm_stat").alias("bp_stat"),
            F.col("jarque_bera.statistic").alias("jb_stat"), F.col("jarque_bera.normal").alias("normal"),
            F.col("durbin_watson.statistic").alias("dw"), F.col("durbin_watson.interpretation").alias("band"),
        )
    )


@query(
    "h7_residual_report_white",
    with_ctes(
        panel("nation") + DEMEANED + trend_sql(4),
        body=f"""SELECT industry, n_obs, round(n_obs * r2, 6) AS lm_stat,
        {chi2_sf_sql('n_obs * r2', 4)} < 0.05 AS heteroskedastic FROM lm""",
    ),
)
def h7_white(spark, sf):
    out = rt.residual_report(demeaned(spark, sf), ["industry"], "year")
    return out.select("industry", "n_obs", "white.*").withColumn("lm_stat", F.round("lm_stat", 6)).select(
        "industry", "n_obs", "lm_stat", "heteroskedastic"
    )
