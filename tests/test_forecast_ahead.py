"""Recursions as scans over blocks, and forecasts beyond the data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.scalar import later_period
from panelwright.operators import arma as ar
from panelwright.operators import companion

ALL = "true"


def direct(state, coefs, d, x):
    size, lags, y = len(coefs), list(state[: len(coefs)]), [state[len(coefs) + 1], state[len(coefs)]]
    for v in x:
        w = v + float(np.dot(coefs, lags))
        lags = [w, *lags][:size]
        y.append(w + [0, y[-1], 2 * y[-1] - y[-2]][d])
    return np.array(y[2:])


def systems(seed, count=7, size=3):
    rng = np.random.default_rng(seed)
    coefs = rng.uniform(-1, 1, (count, size)) / size
    return rng, coefs, rng.integers(0, 3, count), rng.normal(size=(count, size + 2))


def test_steps_and_block_matrices_are_the_recursion():
    rng, coefs, d, state = systems(1)
    x = rng.normal(size=(7, 50))
    path, end = companion.walk(state, coefs, d, x)
    for i in range(7):
        assert np.allclose(path[i], direct(state[i], coefs[i], d[i], x[i]))
    _, offset = companion.walk(np.zeros_like(state), coefs, d, x)
    assert np.allclose(np.einsum("mij,mj->mi", companion.block_matrices(coefs, d, 50), state) + offset, end)


@pytest.mark.parametrize("block", [1, 4, 7, 1024])
def test_paths_do_not_depend_on_the_blocks(spark, block):
    rng, coefs, d, state = systems(2, 6)
    lengths = [1, 4, 7, 8, 21, 40]
    x = [rng.normal(size=n) for n in lengths]
    keys = ["a", "b", None, "d", "e", "f"]
    steps = [(k, j + 1, float(v), (j, k)) for k, v_ in zip(keys, x) for j, v in enumerate(v_)]
    steps = spark.createDataFrame(steps, "k string, step long, x double, row struct<j:int,name:string>").repartition(5)
    starts = spark.createDataFrame([(k, a.tolist(), s.tolist(), int(e)) for k, a, s, e in zip(keys, coefs, state, d)], "k string, coefs array<double>, state array<double>, d int")
    got = companion.affine_paths(steps, starts, ["k"], block).collect()
    assert len(got) == sum(lengths) and all(r.ok and r.row.name == r.k for r in got)
    for i, k in enumerate(keys):
        mine = [r.value for r in sorted((r for r in got if r.k == k), key=lambda r: r.row.j)]
        assert np.allclose(mine, direct(state[i], coefs[i], d[i], x[i]))


def test_a_path_that_explodes_is_marked_as_a_whole(spark):
    steps = spark.createDataFrame([(k, j, 1.0, (j,)) for k in ("up", "calm") for j in range(1, 60)], "k string, step long, x double, row struct<j:int>")
    starts = spark.createDataFrame([("up", [1e9], [1.0, 0.0, 0.0], 0), ("calm", [0.5], [1.0, 0.0, 0.0], 0)], "k string, coefs array<double>, state array<double>, d int")
    got = companion.affine_paths(steps, starts, ["k"], 8).groupBy("k").agg(F.collect_set("ok").alias("ok")).collect()
    assert {r.k: r.ok for r in got} == {"up": [False], "calm": [True]}


def test_later_periods(spark):
    df = spark.createDataFrame([(199511, 3), (200012, 1), (199901, 24)], "p int, n int")
    assert [r[0] for r in df.select(later_period("p", "n", "month")).collect()] == [199602, 200101, 200101]
    assert [str(r[0]) for r in df.select(later_period(F.make_date(F.lit(2000), F.lit(2), F.lit(28)), "n", "day")).collect()] == ["2000-03-02", "2000-02-29", "2000-03-23"]
    with pytest.raises(ValueError, match="unit"):
        later_period("p", "n", "week")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    out = []
    for e in "AB":
        x = rng.normal(size=80).cumsum()
        y = np.zeros(80)
        for i in range(1, 80):
            y[i] = 0.5 * y[i - 1] + 0.7 * x[i] + rng.normal()
        out.append(pd.DataFrame({"industry": e, "year": np.arange(80) + 1900, "y": 3 + y, "x": x}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("d", [0, 1, 2])
def test_horizon_goes_on_where_held_out_rows_would_be(spark, panel, d, monkeypatch):
    """Forecasts of unseen periods equal those of the same periods held out, when both start from the training part."""
    monkeypatch.setattr(companion, "BLOCK", 5)
    whole = spark.createDataFrame(panel).repartition(3)
    models = {"arx": ar.Arma(max_p=2, max_q=1, min_p=1, exog=("x",), intercepts=(True,))}
    seen = whole.filter("year < 1968")
    held = ar.arma_rows(whole, "y", ["industry"], "year", F.col("year") < 1968, d, models, long_ar=3)
    blind = ar.arma_rows(seen, "y", ["industry"], "year", ALL, d, models, long_ar=3)
    best = ar.select_order(ar.fit_arma(blind).withColumn("status", F.lit("ok")), ["industry"]).cache()
    want = ar.forecast(held, best).toPandas().sort_values(["industry", "year"])
    future = whole.filter("year >= 1968").select("industry", "year", "x", F.lit(1).alias("y"))
    got = ar.forecast(blind, best, 12, future).toPandas().sort_values(["industry", "year"])
    assert got.year.tolist() == want.year.tolist() and len(got) == 24
    assert np.allclose(got.forecast, want.forecast) and got.actual.isna().all() and set(got.status) == {"ok"}


def test_seasonal_horizon_is_the_recursion(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=4).tolist()
    for e in rng.normal(size=76).tolist():
        y.append(2 + 0.6 * y[-4] + e)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(y)], "industry string, year int, y double")
    models = {"s": ar.Arma(max_p=1, max_q=1, min_p=1, min_q=1, seasonal=True, intercepts=(True,))}
    rows = ar.arma_rows(df, "y", ["industry"], "year", ALL, 0, models, season=4, long_ar=4)
    fits = ar.fit_arma(rows).filter("sp = 1 AND sq = 1")
    best = ar.select_order(fits, ["industry"]).cache()
    b = dict(zip(rows.regressors(), best.first()["coefs"]))
    scale, center = rows.status.first()["_scale"], rows.status.first()["_center"]
    shocks = [r.e0 or 0.0 for r in rows.df.orderBy("t").select("e0").collect()]
    w, out = [(v - center) / scale for v in y], []
    for _ in range(9):
        nxt = b["one"] + b["w1"] * w[-1] + b["ws"] * w[-4] + b["e1"] * shocks[-1] + b["es"] * shocks[-4]
        w.append(nxt)
        shocks.append(0.0)
        out.append(nxt * scale + center)
    got = ar.forecast(rows, best, 9).orderBy("year").toPandas()
    assert got.year.tolist() == list(range(80, 89)) and np.allclose(got.forecast, out)


def test_horizon_errors_and_fallbacks(spark, panel):
    whole = spark.createDataFrame(panel)
    flat = spark.createDataFrame([("flat", 1900 + i, 2.0, float(i)) for i in range(20)] + [("few", 1900, 1.0, 1.0)], "industry string, year long, y double, x double")
    df = whole.select("industry", "year", "y", "x").unionByName(flat)
    models = {"ar": ar.Arma(max_p=1, max_q=0, min_p=1, intercepts=(True,))}
    rows = ar.arma_rows(df, "y", ["industry"], "year", ALL, 0, models)
    best = ar.select_order(ar.fit_arma(rows), ["industry"]).cache()
    with pytest.raises(ValueError, match="h must be"):
        ar.forecast(rows, best, 0)
    got = ar.forecast(rows, best, 3).toPandas()
    assert len(got) == 12
    zero = got[got.industry.isin(["flat", "few"])]
    assert (zero.forecast == 0).all() and set(zero.status) == {"fallback_zero"}
    assert sorted(zero[zero.industry == "flat"].year) == [1920, 1921, 1922] and sorted(zero[zero.industry == "few"].year) == [1901, 1902, 1903]
    exog = {"arx": ar.Arma(max_p=1, max_q=0, min_p=1, exog=("x",), intercepts=(True,))}
    rows = ar.arma_rows(whole, "y", ["industry"], "year", ALL, 0, exog)
    best = ar.select_order(ar.fit_arma(rows), ["industry"]).cache()
    with pytest.raises(ValueError, match="are needed"):
        ar.forecast(rows, best, 3)
    future = spark.createDataFrame([(e, 1980 + i, v) for e in "AB" for i, v in enumerate([1.0, None, 5.0, float("nan")])], "industry string, year int, x double")
    with pytest.raises(ValueError, match="h=3 rows"):
        ar.forecast(rows, best, 3, future)
    with pytest.raises(ValueError, match="h=4 rows"):
        ar.forecast(rows, best, 4, future.filter("industry = 'A'"))
    # Gaps are filled by the median of the given rows.
    filled = future.withColumn("x", F.when(F.isnan("x") | F.col("x").isNull(), 3.0).otherwise(F.col("x")))
    a, b = (ar.forecast(rows, best, 4, f).orderBy("industry", "year").toPandas().forecast for f in (future, filled))
    assert np.allclose(a, b)
    gone = best.withColumn("coefs", F.transform("coefs", lambda v: v * float("inf")))
    out = ar.forecast(rows, gone, 4, filled).toPandas()
    assert set(out.status) == {"fallback_zero"} and (out.forecast == 0).all()
