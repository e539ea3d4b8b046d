import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import special as sp
from panelwright.operators import metrics as m
from panelwright.operators import residual_tests as rt
from panelwright.operators.acf import ljung_box
from panelwright.operators.unitroot import adf, differencing_order


def test_tails_of_known_statistics():
    got = sp.chi2_sf_np([1.6168629142041917, 3.3137820585657067, 2.3733361711622463], [2, 4, 3])
    assert np.allclose(got, [0.44555639271764647, 0.5067515798532947, 0.49861738487640483], atol=1e-14)
    got = sp.f_sf_np([0.6569820777057594, 0.5827743664939153], [2, 4], [6, 4])
    assert np.allclose(got, [0.5520714244228643, 0.6931237235952655], atol=1e-13)
    x = np.array([0.5, 3.0, 40.0])
    assert np.allclose(sp.chi2_sf_np(x, 2), np.exp(-x / 2)) and np.allclose(sp.chi2_sf_np(x, 1), [math.erfc(math.sqrt(v / 2)) for v in x])


def test_normal_expression_matches_library(spark):
    xs = [-8.0, -4.1, -1.0, -0.2, 0.0, 0.3, 0.9, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", sp.erfc(F.col("x")).alias("e")).collect():
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-13)


def test_unit_root_surface(spark):
    df = spark.createDataFrame(
        [(-4.418896005897709, 223.0), (0.17808937583853962, 215.0), (3.0, 50.0), (-20.0, 50.0)], "tau double, n double"
    )
    got = df.select(sp.adf_p_value(F.col("tau")).alias("p"), sp.adf_critical(F.col("n"))["crit_5"].alias("c")).collect()
    assert got[0]["p"] == pytest.approx(0.00027479162474247805, abs=1e-15)
    assert got[1]["p"] == pytest.approx(0.9710055692379504, abs=1e-14)
    assert (got[2]["p"], got[3]["p"]) == (1.0, 0.0)
    assert got[0]["c"] == pytest.approx(-2.8745897386146817, abs=1e-14)


def direct_adf(y, lag=None):
    n, d = len(y), np.diff(y)
    limit = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def ols(p, start):
        ts = np.arange(start, n - 1)
        x = np.column_stack([np.ones(len(ts)), y[ts], *[d[ts - i] for i in range(1, p + 1)]])
        b = np.linalg.lstsq(x, d[ts], rcond=None)[0]
        return x, b, d[ts] - x @ b

    if lag is None:
        scores = []
        for p in range(limit + 1):
            _, b, e = ols(p, limit)
            scores.append(len(e) * (math.log(2 * math.pi * (e @ e) / len(e)) + 1) + 2 * len(b))
        lag = int(np.argmin(scores))
    x, b, e = ols(lag, lag)
    return b[1] / math.sqrt(e @ e / (len(e) - len(b)) * np.linalg.inv(x.T @ x)[1, 1]), lag, len(e)


def test_adf_against_least_squares(panel, panel_pdf):
    walk = panel_pdf.sort_values(["industry", "year"]).assign(w=lambda p: p.groupby("industry").y.cumsum())
    df = panel.sparkSession.createDataFrame(walk)
    for col in ("y", "w"):
        got = adf(df, col).toPandas().set_index("industry")
        for e, g in walk.groupby("industry"):
            stat, lag, n = direct_adf(g[col].to_numpy())
            assert (got.n_lags_used[e], got.n_obs[e]) == (lag, n)
            assert got.test_statistic[e] == pytest.approx(stat, abs=1e-8)
    pooled = adf(df, "w", [], ["industry", "year"]).first()
    stat, lag, n = direct_adf(walk.w.to_numpy())
    assert (pooled["n_lags_used"], pooled["n_obs"]) == (lag, n) and pooled["test_statistic"] == pytest.approx(stat, abs=1e-8)


def test_adf_edge_series(spark):
    rows = [("short", i, float(i)) for i in range(3)] + [("flat", i, 2.0) for i in range(30)]
    rows += [("four", i, v) for i, v in enumerate([1.0, 5.0, 2.0, 7.0])] + [("line", i, 3.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "industry string, year int, v double")
    got = {r["industry"]: r["status"] for r in adf(df, "v").collect()}
    assert got["short"] == "too few observations" and got["flat"] == "constant series" and got["four"] == "ok"
    d = {r["industry"]: r["d"] for r in differencing_order(df, "v").collect()}
    assert d["short"] == 0 and d["flat"] == 0 and set(d) == {"short", "flat", "four", "line"}


def test_differencing_order_steps(panel_pdf, spark):
    pdf = panel_pdf.sort_values(["industry", "year"])
    pdf = pdf.assign(w=pdf.groupby("industry").y.transform(lambda v: (v - v.mean() + np.sin(np.arange(60))).cumsum()))
    got = {r["industry"]: r["d"] for r in differencing_order(spark.createDataFrame(pdf), "w").collect()}
    from panelwright.functions.special import normal_cdf_np

    def p(tau):
        z = 2.1659 + 1.4412 * tau + 0.038269 * tau**2 if tau <= -1.61 else 1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3
        return float(normal_cdf_np(z))

    for e, g in pdf.groupby("industry"):
        y, want = g.w.to_numpy(), 2
        for d in range(3):
            if p(direct_adf(y)[0]) < 0.05:
                want = d
                break
            y = np.diff(y)
        assert got[e] == want


def aux_regression(y, x):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    rank = np.linalg.matrix_rank(x)
    r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
    return len(y) * r2, rank - 1, (r2 / (rank - 1)) / ((1 - r2) / (len(y) - rank))


def test_variance_tests(panel, panel_pdf):
    bp = rt.breusch_pagan(panel, ["industry"], "year", "x").toPandas().set_index("industry")
    wh = rt.white_test(panel, ["industry"], "year", "x").toPandas().set_index("industry")
    we = rt.white_test(panel, ["industry"], "year", "x", exog=["y", "z"]).toPandas().set_index("industry")
    for e, g in panel_pdf.sort_values("year").groupby("industry"):
        y, t = g.x.to_numpy() ** 2, np.arange(60) / 60
        lm, df, f = aux_regression(y, np.column_stack([t**0, t, t**2]))
        assert (bp.lm_stat[e], bp.f_stat[e]) == (pytest.approx(lm, rel=1e-7), pytest.approx(f, rel=1e-7))
        assert bp.p_value[e] == pytest.approx(math.exp(-lm / 2), rel=1e-9)
        lm, df, f = aux_regression(y, np.column_stack([t**k for k in range(5)]))
        assert wh.lm_stat[e] == pytest.approx(lm, rel=1e-6) and wh.df[e] == df == 4
        a, b = g.y.to_numpy(), g.z.to_numpy()
        lm, df, f = aux_regression(y, np.column_stack([a**0, a, b, a * a, a * b, b * b]))
        assert we.lm_stat[e] == pytest.approx(lm, rel=1e-6) and we.df[e] == df == 5


def test_report_combines_the_tests(panel, panel_pdf):
    got = rt.residual_report(panel, ["industry"], "year", "x").filter("industry = 'B'").first()
    v = panel_pdf[panel_pdf.industry == "B"].sort_values("year").x.to_numpy()
    assert got["durbin_watson"]["statistic"] == pytest.approx((np.diff(v) ** 2).sum() / (v @ v))
    s = v - v.mean()
    skew, kurt = (s**3).mean() / (s**2).mean() ** 1.5, (s**4).mean() / (s**2).mean() ** 2 - 3
    assert got["jarque_bera"]["statistic"] == pytest.approx(10 * (skew**2 + kurt**2 / 4))
    q = v * v - (v * v).mean()
    r = [q[k:] @ q[:-k] / (q @ q) for k in range(1, 11)]
    lb = 60 * 62 * sum(c * c / (60 - k) for k, c in enumerate(r, 1))
    assert got["ljung_box_squared"]["lb_stat"] == pytest.approx(lb) and got["ljung_box_squared"]["lags"] == 10
    assert ljung_box(panel, ["industry"], "year", "x", layout="blocks").filter("industry = 'B'").first()["lb_stat"] == pytest.approx(lb)


def test_metric_rules(spark):
    fc = spark.createDataFrame(
        [("zeros", 0.0, 1.0), ("zeros", 0.0, 0.0), ("perfect", 3.0, 3.0), ("perfect", 3.0, 3.0), ("flat", 3.0, 4.0), ("flat", 3.0, 3.0),
         ("mixed", 0.0, 1.0), ("mixed", 4.0, 2.0)], "k string, actual double, forecast double",
    )
    got = {r["k"]: r for r in m.forecast_metrics(fc, ["k"]).collect()}
    assert got["zeros"]["MAPE"] is None and got["zeros"]["SMAPE"] == pytest.approx(100.0)
    assert got["perfect"]["R2"] == 1 and got["flat"]["R2"] == 0
    assert (got["mixed"]["MAPE"], got["mixed"]["MSRE"], got["mixed"]["R2"]) == (50.0, 0.25, pytest.approx(1 - 5 / 8))
    strict = {r["k"]: r for r in m.forecast_metrics(fc, ["k"], r2_const="null", msre=False).collect()}
    assert strict["perfect"]["R2"] is None and "MSRE" not in strict["perfect"].asDict()


def test_comparison_of_forecasts(spark):
    rng = np.random.default_rng(0)
    a, f, g = rng.normal(size=(3, 20))
    rows = [("e", i, mod, float(a[i]), float(v[i])) for i in range(20) for mod, v in (("f", f), ("g", g), ("h", f))]
    df = spark.createDataFrame(rows, "entity string, period int, model string, actual double, forecast double")
    got = {r["comparison"]: r for r in m.diebold_mariano(df, [("f", "g"), ("f", "h")]).collect()}
    d = (a - f) ** 2 - (a - g) ** 2
    stat = d.mean() / math.sqrt(d.var(ddof=1) / 20)
    assert got["f_vs_g"]["DM_stat"] == pytest.approx(stat)
    assert got["f_vs_g"]["p_value"] == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)))
    assert (got["f_vs_h"]["DM_stat"], got["f_vs_h"]["p_value"]) == (0.0, 1.0)


def test_best_model_ties_and_nulls(spark):
    df = spark.createDataFrame([("e", "b", 1.0), ("e", "a", 1.0), ("e", "c", None), ("z", "c", None)], "entity string, model string, R2 double")
    got = {r["entity"]: r["best_model"] for r in m.best_model(df, "R2").collect()}
    assert got == {"e": "a", "z": None}


def test_many_lags_block_by_block(panel, panel_pdf, monkeypatch):
    from panelwright.operators import series as se

    plain = adf(panel, "y").toPandas().set_index("industry").sort_index()
    pooled = adf(panel, "y", [], ["industry", "year"]).toPandas()
    monkeypatch.setattr(se, "BLOCK_ROWS", 17)
    wide = adf(panel, "y", layout="blocks").toPandas().set_index("industry").sort_index()
    again = adf(panel, "y", [], ["industry", "year"]).toPandas()
    for a, b in ((plain, wide), (pooled, again)):
        assert np.allclose(a.test_statistic, b.test_statistic, atol=1e-9) and list(a.n_lags_used) == list(b.n_lags_used)


def test_nested_residual_sums_are_those_of_each_regression():
    from panelwright.operators.unitroot import nested_rss

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(6, 40, 5)), rng.normal(size=(6, 40))
    x[2, :, 3] = 2 * x[2, :, 1]  # depends on an earlier one
    rss, bad = nested_rss(np.einsum("mni,mnj->mij", x, x), np.einsum("mni,mn->mi", x, y), (y * y).sum(1))
    for i in range(6):
        for k in range(1, 6):
            if i == 2 and k > 3:
                assert np.isinf(rss[i, k - 1])
                continue
            b = np.linalg.lstsq(x[i, :, :k], y[i], rcond=None)[0]
            assert rss[i, k - 1] == pytest.approx(((y[i] - x[i, :, :k] @ b) ** 2).sum())
    assert bad.sum() == 1 and bad[2, 3]


def chosen_adf(v):
    """Lag by AIC on the common sample, refit on all rows, as plain least squares."""
    n = len(v)
    v, sd = (v - v.mean()) / v.std(), v.std()
    m = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(v)

    def design(lag, first):
        t = np.arange(first, n)
        return np.column_stack([np.ones(len(t)), v[t - 1], *[d[t - 1 - i] for i in range(1, lag + 1)]]), d[t - 1]

    aic = []
    for lag in range(m + 1):
        x, y = design(lag, m + 1)
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        aic.append(len(y) * (math.log(2 * math.pi * (e @ e) / len(y)) + 1 + 2 * math.log(sd)) + 2 * (lag + 2))
    lag = int(np.argmin(aic))
    x, y = design(lag, lag + 1)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b[1] / math.sqrt(e @ e / (len(y) - lag - 2) * np.linalg.inv(x.T @ x)[1, 1]), lag, len(y), min(aic)


def test_series_of_many_lengths_are_fitted_in_one_batch(spark):
    rng = np.random.default_rng(12)
    series = {f"s{n}": rng.normal(size=n).cumsum() + rng.normal(size=n) for n in (12, 17, 23, 40, 41, 100, 333)}
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)]
    odd = {"three": [1.0, 2.0, 4.0], "flat": [3.0] * 30, "line": [float(i) for i in range(30)], "four": [1.0, 3.0, 2.0, 5.0]}
    rows += [(k, i, x) for k, v in odd.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "industry string, year int, y double").repartition(1)
    got = {r["industry"]: r for r in adf(df, "y").collect()}
    for k, v in series.items():
        tau, lag, nobs, ic = chosen_adf(v)
        r = got[k]
        assert (r["status"], r["n_lags_used"], r["n_obs"]) == ("ok", lag, nobs)
        assert r["test_statistic"] == pytest.approx(tau, rel=1e-6) and r["icbest"] == pytest.approx(ic, rel=1e-6)
    assert got["three"]["status"] == "too few observations" and got["flat"]["status"] == "constant series"
    assert got["line"]["status"] in ("singular regressors", "perfect fit") and got["four"]["n_obs"] == 3
