import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import arma as ar
from panelwright.operators import factor as fa
from panelwright.operators import sequence as sq
from panelwright.operators import trend as tr
from panelwright.operators import var as va
from panelwright.operators.window import time_split

TRAIN = "split = 'train'"


@pytest.fixture(scope="module")
def split(panel):
    return time_split(panel).cache()


def each(pdf):
    for e, g in pdf.sort_values(["industry", "year"]).groupby("industry"):
        yield e, g


def kalman(x):
    z = (x - x.mean(0)) / x.std(0)
    c = z.T @ z / len(z)
    w, v = np.linalg.eigh(c)
    lam, v = w[-1], v[:, -1] * np.sign(v[0, -1])
    noise = np.clip(np.diag(c) - lam * v * v, 1e-6, None)
    f = z @ v
    phi = (f[1:] @ f[:-1]) / (f[:-1] @ f[:-1])
    q = ((f[1:] - phi * f[:-1]) ** 2).mean()
    p, s, factor, shock = q / (1 - phi * phi), 0.0, [], []
    for row in z:
        big = np.outer(v, v) * p + np.diag(noise)
        err = row - v * s
        gain = p * v @ np.linalg.inv(big)
        shock.append(err[0] / math.sqrt(big[0, 0]))
        s = s + gain @ err
        factor.append(s)
        p, s = phi * phi * (p - p * (gain @ v)) + q, phi * s
    return f, np.array(factor), np.array(shock)


def test_principal_factor(panel, panel_pdf):
    got = fa.pca_factor(panel, ["y", "x", "z"]).toPandas().sort_values(["industry", "year"])
    want = kalman(panel_pdf.sort_values(["industry", "year"])[["y", "x", "z"]].to_numpy())[0]
    assert np.allclose(got.liquidity_factor_pca, want)
    assert np.corrcoef(got.liquidity_factor_pca, got.y)[0, 1] >= 0
    loads = fa.factor_loadings(panel, ["y", "x", "z"]).first()
    assert got.liquidity_factor_pca.var(ddof=0) == pytest.approx(loads["variance"])


@pytest.mark.parametrize("layout,block", [("panel", 100), ("blocks", 7), ("blocks", 1000)])
def test_dynamic_factor_equals_full_filter(panel, panel_pdf, layout, block):
    got = fa.dynamic_factor(panel, ["y", "x", "z"], layout=layout, block_rows=block).toPandas()
    for e, g in each(panel_pdf):
        _, factor, shock = kalman(g[["y", "x", "z"]].to_numpy())
        mine = got[got.industry == e].sort_values("year")
        assert np.allclose(mine.liquidity_factor_dfm, factor) and np.allclose(mine.liquidity_shock_dfm, shock)


def test_short_panels_fall_back_to_the_principal_factor(panel):
    some = panel.filter("year < 6")
    assert 0 < some.count() < fa.MIN_OBS
    out = fa.liquidity_factors(some, ["y", "x", "z", "absent"]).toPandas().sort_values(["industry", "year"])
    short = out[out.industry == "B"]
    assert np.allclose(short.liquidity_factor_dfm.fillna(0), short.liquidity_factor_pca.fillna(0))
    assert np.allclose(short.liquidity_shock_dfm, short.liquidity_factor_pca.diff().fillna(0))


def test_short_series_of_a_larger_panel_have_their_own_factor(panel):
    some = panel.filter("industry = 'A' OR year < 14")
    out = fa.dynamic_factor(some, ["y", "x", "z"]).toPandas().sort_values(["industry", "year"])
    short = out[out.industry == "B"]
    _, factor, _ = kalman(short[["y", "x", "z"]].to_numpy())
    assert 2 < len(short) < fa.MIN_OBS and np.allclose(short.liquidity_factor_dfm, factor)
    assert out.liquidity_factor_dfm.notna().all()


def direct_var(y, limit=5):
    n, k = y.shape
    m = min(limit, max(1, (n - 1) // k - 1))

    def ols(p, start):
        x = np.column_stack([np.ones(n - start), *[y[start - i : n - i] for i in range(1, p + 1)]])
        b = np.linalg.lstsq(x, y[start:], rcond=None)[0]
        return b, y[start:] - x @ b

    bic = []
    for p in range(m + 1):
        _, e = ols(p, m)
        bic.append(np.linalg.slogdet(e.T @ e / len(e))[1] + math.log(len(e)) / len(e) * (p * k * k + k))
    p = max(1, int(np.argmin(bic)))
    return p, ols(p, p)[0], min(bic)


def test_autoregression_and_responses(panel, panel_pdf):
    cols = ["y", "x", "z"]
    var = va.fit_var(panel, cols).cache()
    got = var.toPandas().set_index("industry")
    irf = va.impulse_response(var, 6, "y").toPandas()
    for e, g in each(panel_pdf):
        p, b, bic = direct_var(g[cols].to_numpy())
        assert got.lag_order[e] == p and got.bic[e] == pytest.approx(bic)
        a = [b[1 + 3 * i : 4 + 3 * i].T for i in range(p)]
        assert np.allclose(np.array(got.coefs[e]).reshape(p, 3, 3), a) and np.allclose(got.intercept[e], b[0])
        phi = [np.eye(3)]
        for h in range(1, 7):
            phi.append(sum(phi[h - j] @ a[j - 1] for j in range(1, min(h, p) + 1)))
        for j, name in enumerate(cols):
            mine = irf[(irf.industry == e) & (irf.impulse == name)].sort_values("horizon").response
            assert len(mine) == 0 if name == "y" else np.allclose(mine, [m[0, j] for m in phi])


def test_autoregression_guards(spark):
    rows = [("few", i, float(i), float(i * i)) for i in range(3)] + [("flat", i, 1.0, float(i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "industry string, year int, a double, b double")
    got = {r["industry"]: r["status"] for r in va.fit_var(df, ["a", "b"]).collect()}
    assert got == {"few": "too few observations", "flat": "constant column"}


@pytest.mark.parametrize("d", [0, 1, 2])
def test_ar2_fit_fitted_and_forecast(split, d):
    models = {"ar2": ar.Arma(max_p=2, max_q=0, min_p=2, intercepts=(True,))}
    rows = ar.arma_rows(split, "y", ["industry"], "year", TRAIN, d, models)
    fits = ar.fit_arma(rows).cache()
    good = fits.withColumn("status", F.lit("ok"))
    best = ar.select_order(good, ["industry"]).cache()
    got = best.toPandas().set_index("industry")
    fc, fit = ar.forecast(rows, best).toPandas(), ar.fitted_values(rows, best).toPandas()
    for e, g in each(split.toPandas()):
        y = g[g.split == "train"].y.to_numpy()
        w = np.diff(y, d) if d else y
        x = np.column_stack([np.ones(len(w) - 2), w[1:-1], w[:-2]])
        b = np.linalg.lstsq(x, w[2:], rcond=None)[0]
        assert np.allclose(np.array(got.coefs[e])[1:], b[1:])
        rss = ((w[2:] - x @ b) ** 2).sum()
        assert got.rss[e] == pytest.approx(rss)
        n = len(w) - 2
        assert got.AIC[e] == pytest.approx(n * (math.log(2 * math.pi * rss / n) + 1) + 8)
        path, lags, tail = [], list(w[-2:]), list(y[-2:])
        for _ in range((g.split == "test").sum()):
            nxt = b[0] + b[1] * lags[-1] + b[2] * lags[-2]
            lags.append(nxt)
            tail.append(nxt if d == 0 else nxt + tail[-1] if d == 1 else nxt + 2 * tail[-1] - tail[-2])
            path.append(tail[-1])
        mine = fc[fc.industry == e].sort_values("year")
        assert np.allclose(mine.forecast, path) and set(mine.status) == {"ok"}
        res = fit[fit.industry == e].sort_values("year").residual.to_numpy()[2 + d :]
        assert np.allclose(res, w[2:] - x @ b)


def test_arma_two_stage_regression(split):
    models = {"arma": ar.Arma(max_p=1, max_q=1, min_p=1, min_q=1, intercepts=(True,))}
    rows = ar.arma_rows(split, "y", ["industry"], "year", TRAIN, 0, models, long_ar=3)
    got = ar.fit_arma(rows).toPandas().set_index("industry")
    for e, g in each(split.toPandas()):
        y = g[g.split == "train"].y.to_numpy()
        n = len(y)
        x = np.column_stack([np.ones(n - 3), *[y[3 - i : n - i] for i in range(1, 4)]])
        shock = np.r_[[np.nan] * 3, y[3:] - x @ np.linalg.lstsq(x, y[3:], rcond=None)[0]]
        x = np.column_stack([np.ones(n - 4), y[3:-1], shock[3:-1]])
        b = np.linalg.lstsq(x, y[4:], rcond=None)[0]
        assert np.allclose(np.array(got.coefs[e])[1:], b[1:])


def test_order_grid_and_unusable_series(spark, split):
    rng = np.random.default_rng(5)
    extra = [("flat", i, 2.0) for i in range(20)] + [("tiny", i, float(i)) for i in range(3)]
    extra += [("nine", i, float(v)) for i, v in enumerate(rng.normal(size=12).cumsum())]
    df = time_split(split.select("industry", "year", "y").unionByName(spark.createDataFrame(extra, "industry string, year long, y double")))
    rows = ar.arma_rows(df, "y", ["industry"], "year", TRAIN, None, {"arima": ar.Arma()})
    status = {r["industry"]: r["status"] for r in rows.status.collect()}
    assert status["flat"] == "constant series" and status["tiny"] == "too few observations" and status["nine"] == "ok"
    fits = ar.fit_arma(rows).cache()
    assert fits.filter("industry = 'A'").count() == 18
    best = ar.select_order(fits, ["industry"]).toPandas().set_index("industry")
    for e in "ABCD":
        ok = fits.filter(f"industry = '{e}' AND status = 'ok'").toPandas()
        assert best.AIC[e] == pytest.approx(ok.AIC.min())
    assert "nine" in best.index and "flat" not in best.index


def test_more_regressors_than_rows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(12, 12)), columns=[f"v{i}_lag1" for i in range(12)])
    pdf = pdf.assign(industry="a", year=range(12), y=rng.normal(size=12).cumsum())
    df = time_split(spark.createDataFrame(pdf))
    models = {"sarimax": ar.Arma(exog=tuple(c for c in pdf if "lag" in c))}
    rows = ar.arma_rows(df, "y", ["industry"], "year", TRAIN, 0, models)
    best = ar.select_order(ar.fit_arma(rows), ["industry"]).cache()
    out = ar.forecast(rows, best).toPandas()
    assert len(out) == 3 and np.isfinite(out.forecast).all()


def test_cross_validation_shapes(split):
    out = ar.cross_validate(split.filter(TRAIN), "y", models={"arima": ar.Arma(max_p=1, max_q=0)}).toPandas()
    assert sorted(out.fold.unique()) == [1, 2, 3] and len(out) == 12
    assert (out.train_end == out.fold * 12).all() and out.RMSE.notna().all()


def test_trend_components(split):
    got = tr.trend_regression(split, "y", ["x"], train=TRAIN, changepoints=2, ridge=0.0).toPandas()
    for e, g in each(split.toPandas()):
        n = (g.split == "train").sum()
        t = np.arange(60) / (n - 1)
        x = (g.x - g.x[:n].mean()) / g.x[:n].std(ddof=0)
        design = np.column_stack([t**0, t, *[np.maximum(t - 0.8 * j / 3, 0) for j in (1, 2)], x])
        b = np.linalg.lstsq(design[:n], g.y.to_numpy()[:n], rcond=None)[0]
        mine = got[got.industry == e].sort_values("year")
        assert np.allclose(mine.yhat, design @ b) and np.allclose(mine.trend, design[:, :4] @ b[:4])
        assert (mine.yhat_upper > mine.yhat).all()


@pytest.mark.parametrize("recursive", [True, False])
def test_window_model(split, recursive):
    fc, loss = sq.sequence_forecast(split, "y", ["x"], recursive=recursive, epochs=20000, patience=20000)
    fc, loss = fc.toPandas(), loss.toPandas()
    for e, g in each(split.toPandas()):
        n = (g.split == "train").sum()
        z = g[["y", "x"]].to_numpy()
        lo, hi = z[:n].min(0), z[:n].max(0)
        z = (z - lo) / (hi - lo)
        x = np.array([np.r_[1, z[i - 1], z[i - 2]] for i in range(2, 60)])
        b = np.linalg.lstsq(x[: n - 2], z[2:n, 0], rcond=None)[0]
        fed, out = z.copy(), list(x[: n - 2] @ b)
        for i in range(n, 60):
            out.append(np.r_[1, fed[i - 1], fed[i - 2]] @ b)
            if recursive:
                fed[i, 0] = out[-1]
        mine = fc[fc.industry == e].sort_values("year")
        assert np.allclose(mine.forecast, np.array(out) * (hi[0] - lo[0]) + lo[0], atol=1e-6)
        curve = loss[loss.industry == e].sort_values("epoch").train_loss
        assert curve.iloc[-1] <= curve.iloc[0] and curve.iloc[-1] == pytest.approx(((z[2:n, 0] - out[: n - 2]) ** 2).mean(), abs=1e-9)


def test_early_stop_and_validation(split):
    _, loss = sq.sequence_forecast(split, "y", validate=True, min_delta=1e-4, patience=5)
    runs = loss.groupBy("industry").agg(F.max("epoch").alias("n"), F.count("val_loss").alias("v")).toPandas()
    assert (runs.n < 300).all() and (runs.n == runs.v).all()


def test_long_autoregression_covers_the_season_and_short_series_are_told(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=12).tolist()
    for e in rng.normal(size=300).tolist():
        y.append(0.9 * y[-12] + e)
    rows = [("long", i, v) for i, v in enumerate(y)] + [("short", i, v * i) for i, v in enumerate(rng.normal(size=7).tolist())]
    df = spark.createDataFrame(rows, "industry string, year long, y double").withColumn("split", F.lit("train"))
    d = spark.createDataFrame([("long", 0), ("short", 2)], "industry string, d int")
    out = ar.arma_rows(df, "y", ["industry"], "year", TRAIN, d, {"s": ar.Arma(seasonal=True)}, season=12)
    status = {r["industry"]: r for r in out.status.collect()}
    assert status["long"].long_ar >= 12 and status["long"].reduced is None
    assert status["short"].d == 2 and status["short"].reduced == "no seasonal terms"
    e = out.df.filter("industry = 'long' AND e0 IS NOT NULL").orderBy("t").toPandas().e0.to_numpy()
    assert abs(np.corrcoef(e[12:], e[:-12])[0, 1]) < 0.2


def test_sequence_run_has_a_status_of_refused_entities(spark):
    from panelwright.plans.sequence_run import run_sequence_models

    rows = [(e, i, float(i * i % 7), float(i)) for e, n in (("A", 12), ("few", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "industry string, year long, y double, x double")
    out = run_sequence_models(df, target="y", models=("window_uni",), labels={}, epochs=3)
    status = {r["industry"]: r["status"] for r in out["status"].collect()}
    assert status == {"A": "ok", "few": "too few observations"}


def test_sparse_trend_finds_planted_kinks_among_many(spark):
    """Two planted kinks of 25 and none, with regressors and noise; the others are exactly zero."""
    rng = np.random.default_rng(21)
    t = np.arange(150) / 119
    hinge = lambda j: np.maximum(t - 0.8 * j / 26, 0)
    x = rng.normal(size=150)
    planted = {"two": {7: -4.0, 18: 6.0}, "one": {13: 5.0}, "none": {}}
    out = []
    for e, kinks in planted.items():
        y = 1 + 2 * t + sum(b * hinge(j) for j, b in kinks.items()) + 0.3 * x + 0.01 * rng.normal(size=150)
        out.append(pd.DataFrame({"industry": e, "year": 1000 + np.arange(150), "y": 50 * y, "x": x}))
    df = spark.createDataFrame(pd.concat(out)).withColumn("split", F.when(F.col("year") < 1120, "train").otherwise("test")).cache()
    got = tr.trend_changepoints(df, "y", ["x"], train=TRAIN).collect()
    assert {e: {r.changepoint for r in got if r.industry == e} for e in planted} == {e: set(k) for e, k in planted.items()}
    for r in got:
        assert r.delta == pytest.approx(50 * planted[r.industry][r.changepoint] / 119, rel=0.05)
        assert r.period == 1000 + int(0.8 * r.changepoint / 26 * 119)
    fit = tr.trend_regression(df, "y", ["x"], train=TRAIN, changepoints=25, sparse=True).toPandas()
    two = fit[fit.industry == "two"].sort_values("year")
    design = np.column_stack([t**0, t, hinge(7), hinge(18), (x - x[:120].mean()) / x[:120].std()])
    y = out[0].y.to_numpy()
    b = np.linalg.lstsq(design[:120], y[:120], rcond=None)[0]
    assert np.allclose(two.yhat, design @ b)
    sd = np.sqrt(((y - design @ b)[:120] ** 2).sum() / 115)
    assert np.allclose(two.yhat_upper - two.yhat, 1.2815515655 * sd)


def test_sparse_fit_finds_the_best_small_set():
    """Against all sets of up to three of the columns."""
    from itertools import combinations

    from panelwright.operators.gram import sparse_fit

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(4, 80, 8)), rng.normal(size=(4, 80))
    x[:, :, 0] = 1.0
    y[0] += x[0, :, 3] * 2
    y[1] += x[1, :, 2] - x[1, :, 6]
    y[2] += 0.3 * x[2, :, 5]
    xtx, xty = np.einsum("mni,mnj->mij", x, x), np.einsum("mni,mn->mi", x, y)
    beta, rss, chosen = sparse_fit(xtx, xty, (y * y).sum(1), np.full(4, 80.0), np.arange(8) > 0)
    for i in range(4):
        found = []
        for size in range(4):
            for more in combinations(range(1, 8), size):
                xs = x[i][:, [0, *more]]
                b = np.linalg.lstsq(xs, y[i], rcond=None)[0]
                e = ((y[i] - xs @ b) ** 2).sum()
                found.append((80 * math.log(e / 80) + (1 + size) * math.log(80) + 2 * size * math.log(7), more, e))
        _, more, e = min(found)
        assert set(np.flatnonzero(chosen[i])) == {0, *more} and rss[i] == pytest.approx(e)
        assert np.allclose(beta[i][~chosen[i]], 0)


def threshold_series(rng, n):
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = (0.9 if y[i - 1] < 0 else -0.9) * y[i - 1] + (1 if y[i - 1] < 0 else -1) + 0.05 * rng.normal()
    return y


@pytest.mark.parametrize("recursive", [True, False])
def test_hidden_units_bend_where_a_line_cannot(spark, recursive):
    rng = np.random.default_rng(14)
    out = [pd.DataFrame({"industry": e, "year": np.arange(200), "y": threshold_series(rng, 200), "x": rng.normal(size=200)}) for e in "AB"]
    out.append(pd.DataFrame({"industry": "few", "year": np.arange(3), "y": 1.0, "x": 0.0}))
    df = time_split(spark.createDataFrame(pd.concat(out))).cache()
    one = sq.sequence_forecast(df, "y", ["x"], recursive=False, epochs=2000, patience=2000)
    bent = sq.sequence_forecast(df, "y", ["x"], recursive=recursive, epochs=2000, patience=2000, hidden=40)
    assert {r.industry: r.status for r in bent.status.collect()} == {"A": "ok", "B": "ok", "few": "too few observations"}
    fc, loss = (t.toPandas() for t in bent)
    assert (loss.groupby("industry").train_loss.last() < loss.groupby("industry").train_loss.first()).all()
    error = lambda t: np.sqrt(((t.actual - t.forecast) ** 2).mean())
    if not recursive:
        line = one[0].filter("split = 'test'").toPandas()
        assert error(fc[fc.split == "test"]) < 0.75 * error(line)
    # The layer and the feeding back, row by row.
    layer = sq.Layer(40, 2, 2)
    weights = layer.weights()
    for e, g in each(df.filter("industry <> 'few'").toPandas()):
        g = g.sort_values("year")
        n = (g.split == "train").sum()
        z = g[["y", "x"]].to_numpy()
        lo, hi = z[:n].min(0), z[:n].max(0)
        z = (z - lo) / (hi - lo)
        rows = np.array([np.r_[1, z[i - 1], z[i - 2]] for i in range(2, 200)])
        full = np.concatenate([rows, layer.outputs(rows, weights)], axis=1)
        y = z[2:, 0]
        beta, _, _ = sq.train_epochs(*(m[None] for m in (full[: n - 2].T @ full[: n - 2], full[: n - 2].T @ y[: n - 2], y[: n - 2] @ y[: n - 2])), 2000, 2000)
        fed, want = z.copy(), []
        for i in range(2, 200):
            x = np.r_[1, fed[i - 1], fed[i - 2]][None]
            want.append(float((np.concatenate([x, layer.outputs(x, weights)], axis=1) @ beta[0])[0]))
            if recursive and i >= n:
                fed[i, 0] = want[-1]
        mine = fc[fc.industry == e].sort_values("year").forecast
        assert np.allclose(mine, np.array(want) * (hi[0] - lo[0]) + lo[0], atol=1e-6)
