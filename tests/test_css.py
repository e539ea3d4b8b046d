"""Shock terms by conditional least squares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import arma as ar
from panelwright.operators import css

ALL = "true"


def shocks_of(z, beta, theta):
    e = np.zeros(len(z))
    for i in range(len(z)):
        past = sum(t * e[i - j] for j, t in enumerate(theta, 1) if i >= j)
        e[i] = z[i, 0] - z[i, 1:] @ beta - past
    return e


def test_filters_and_products_are_the_recursions():
    rng = np.random.default_rng(0)
    z, beta, theta, lags = rng.normal(size=(30, 3)), np.array([0.3, -0.2]), np.array([0.5, 0.0, -0.3]), np.array([1, 3])
    g, e = css.products(z, theta, beta, lags, np.zeros((3, 6)))
    assert np.allclose(e, shocks_of(z, beta, theta))
    point = np.r_[beta, 0.5, -0.3]

    def at(p):
        return shocks_of(z, p[:2], np.array([p[2], 0.0, p[3]]))

    slopes = np.column_stack([-(at(point + d) - at(point - d)) / 2e-6 for d in 1e-6 * np.eye(4)])
    full = np.column_stack([slopes, e])
    assert np.allclose(g, full.T @ full, atol=1e-6)
    # In two blocks: the state carries over, and is an affine map of the one before.
    _, first = css.run_filters(z[:12], theta, np.zeros((3, 6)))
    g2, e2 = css.products(z[12:], theta, beta, lags, first)
    g1, e1 = css.products(z[:12], theta, beta, lags, np.zeros((3, 6)))
    assert np.allclose(np.r_[e1, e2], e) and np.allclose(g1 + g2, g)
    _, offset = css.run_filters(z[12:], theta, np.zeros((3, 6)))
    _, end = css.run_filters(z[12:], theta, first)
    a = css.state_matrix(theta, 18) @ css._as_column_state(first, 3, 3) + css._as_column_state(offset, 3, 3)
    assert np.allclose(a, css._as_column_state(end, 3, 3))


def simulate(rng, n, phi=0.0, theta=0.0, seasonal=0.0, mean=0.0):
    e, w = rng.normal(size=n + 60), np.zeros(n + 60)
    for i in range(12, n + 60):
        w[i] = phi * w[i - 1] + e[i] + theta * e[i - 1] + seasonal * e[i - 12]
    return mean + w[60:]


def frame(spark, series):
    pdf = pd.concat([pd.DataFrame({"industry": k, "year": np.arange(len(v)), "y": v}) for k, v in series.items()], ignore_index=True)
    return spark.createDataFrame(pdf).repartition(4)


def test_simulated_models_are_recovered_at_any_level(spark):
    rng = np.random.default_rng(7)
    base = simulate(rng, 3000, phi=0.6, theta=0.5)
    series = {f"{m:g}": base + m for m in (0.0, 1e2, 1e6, 1e8)}
    models = {"arma": ar.Arma(max_p=1, max_q=1, min_p=1, min_q=1, intercepts=(True,))}
    rows = ar.arma_rows(frame(spark, series), "y", ["industry"], "year", ALL, 0, models)
    first = ar.select_order(ar.fit_arma(rows), ["industry"]).cache()
    best, shocks = ar.refine_shocks(rows, first)
    got = {r.industry: r for r in best.collect()}
    for r in got.values():
        assert r.coefs[1] == pytest.approx(0.6, abs=0.05) and r.coefs[2] == pytest.approx(0.5, abs=0.05)
        assert np.allclose(r.coefs[1:], got["0"].coefs[1:], atol=1e-6)
    assert got["1e+06"].const / (1 - got["1e+06"].coefs[1]) == pytest.approx(1e6, rel=1e-6)
    start = {r.industry: r for r in first.collect()}
    assert all(got[k].n_obs == start[k].n_obs and got[k].edf == start[k].edf for k in got)
    fit = ar.fitted_values(rows, best, shocks).filter("industry = '100'").orderBy("year").toPandas()
    assert fit.residual.iloc[50:].std() == pytest.approx(1.0, abs=0.05)
    r = got["100"]
    level = r.const / (1 - r.coefs[1])
    path = [r.const + r.coefs[1] * series["100"][-1] + r.coefs[2] * fit.residual.iloc[-1]]
    for _ in range(4):
        path.append(level + r.coefs[1] * (path[-1] - level))
    ahead = ar.forecast(rows, best, 5, shocks=shocks).filter("industry = '100'").orderBy("year").toPandas()
    assert np.allclose(ahead.forecast, path)


def test_refined_fits_are_minima_and_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    series = {"s": simulate(rng, 700, phi=0.3, seasonal=0.6, theta=0.4, mean=5), "t": simulate(rng, 260, theta=-0.5, seasonal=0.3), "u": simulate(rng, 90, phi=0.5)}
    models = {"m": ar.Arma(max_p=1, max_q=1, min_p=1, min_q=1, seasonal=True, intercepts=(True,)), "zero": ar.Arma(max_p=1, max_q=2, min_p=1, min_q=2, intercepts=(False,))}
    df = frame(spark, series)
    rows = ar.arma_rows(df, "y", ["industry"], "year", F.col("year") < 10_000, 0, models, season=12)
    fits = ar.fit_arma(rows).filter("(model = 'zero') OR (sp = 0 AND sq = 1)")
    first = ar.select_order(fits, ["industry"]).cache()
    best, shocks = ar.refine_shocks(rows, first)
    names = rows.regressors()
    status = {r.industry: r for r in rows.status.collect()}
    starts = {(r.industry, r.model): r for r in first.collect()}
    for r in best.collect():
        s = status[r.industry]
        y = (series[r.industry] - s._center) / s._scale
        e = {x.t: x.e for x in shocks.filter(f"industry = '{r.industry}' AND model = '{r.model}'").collect()}
        t0 = min(e)
        assert sorted(e) == list(range(t0, len(y) + 1)) and r.n_obs == len(e)
        b = dict(zip(names, r.coefs))

        def total(b, y=y, t0=t0, e=None):
            err = np.zeros(len(y) + 1)
            for t in range(t0, len(y) + 1):
                past = sum(b[f"e{i}"] * err[t - i] for i in (1, 2)) + b["es"] * err[t - 12] * (t >= 12)
                err[t] = y[t - 1] - b["one"] - b["w1"] * y[t - 2] - past
            return (err**2).sum(), err[t0:]

        ss, err = total(b)
        assert r.rss == pytest.approx(ss * s._scale**2) and np.allclose(err, [e[t] for t in sorted(e)])
        moved = [n for n in ("w1", "e1", "e2", "es") if b[n]] + (["one"] if r.with_constant else [])
        for n in moved:
            for d in (-1e-3, 1e-3):
                other = {**b, n: b[n] + d}
                if n == "w1" and not r.with_constant:  # about zero: the constant goes with the slope
                    other["one"] = b["one"] + d * s._center / s._scale
                assert total(other)[0] > ss
        before = dict(zip(names, starts[r.industry, r.model].coefs))
        assert total(before)[0] >= ss - 1e-9
    monkeypatch.setattr(css, "BLOCK", 64)
    again, more = ar.refine_shocks(rows, first)
    one = best.orderBy("industry", "model").toPandas()
    two = again.orderBy("industry", "model").toPandas()
    assert np.allclose(np.vstack(one.coefs), np.vstack(two.coefs), atol=1e-6) and np.allclose(one.AIC, two.AIC)
    a, b = (x.orderBy("industry", "model", "t").toPandas().e for x in (shocks, more))
    assert np.allclose(a, b, atol=1e-6)


def test_fits_without_shocks_pass(spark):
    rng = np.random.default_rng(1)
    rows = ar.arma_rows(frame(spark, {"a": simulate(rng, 60, phi=0.5)}), "y", ["industry"], "year", ALL, 0, {"ar": ar.Arma(max_p=1, max_q=0, min_p=1)})
    best = ar.select_order(ar.fit_arma(rows), ["industry"])
    same, shocks = ar.refine_shocks(rows, best)
    assert same.collect() == best.collect() and shocks.count() == 0
    assert ar.forecast(rows, same, 3, shocks=shocks).count() == 3
