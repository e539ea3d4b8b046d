"""The result store and the resumable run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import arma as ar
from panelwright.operators.window import add_lags
from panelwright.plans import stored_run as sr
from panelwright.sources.store import RunStore


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(9)
    out = []
    for k, e in enumerate("ABCD"):
        x = rng.normal(size=40).cumsum()
        y = np.zeros(40)
        for i in range(1, 40):
            y[i] = 0.5 * y[i - 1] + 0.2 * k * x[i] + rng.normal()
        out.append(pd.DataFrame({"industry": e, "year": np.arange(40), "free_cash_flow": y + 4, "cash_ratio": x}))
    out.append(pd.DataFrame({"industry": "flat", "year": np.arange(20), "free_cash_flow": 1.0, "cash_ratio": np.arange(20.0)}))
    out.append(pd.DataFrame({"industry": "few", "year": np.arange(5), "free_cash_flow": [1.0, 3, 2, 4, 1], "cash_ratio": 1.0}))
    return add_lags(spark.createDataFrame(pd.concat(out, ignore_index=True)), ["free_cash_flow", "cash_ratio"], 1).cache()


MODELS = {"arima": ar.Arma(max_p=1, max_q=0, min_p=1, intercepts=(True,)), "sarimax": ar.Arma(max_p=1, max_q=0, exog=("cash_ratio_lag1",), intercepts=(True,))}
OPTIONS = {"models": MODELS, "batches": 2, "d": 0, "cv": False, "var_cols": ["free_cash_flow", "cash_ratio"]}
SORT = ["industry", "model", "split", "year"]


def rows_of(df, digits=8):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()), key=repr)


def test_a_batch_is_seen_as_a_whole_or_not_at_all(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("x", [1.0])], "k string, n array<double>")
    assert store.read("a") is None and store.manifest().count() == 0
    left = store.stage({"a": a, "b": b})
    assert store.read("a") is None and store.pending(a.select("k"), "a").count() == 2
    store.commit(left, {"a": a, "b": b})
    assert rows_of(store.read("a")) == [("x", 1), ("y", 2)] and store.read("b").first()["n"] == [1.0]
    # A table without rows, one with another column, and one that dies on the way.
    store.append({"a": spark.createDataFrame([("z", 3, "more")], "k string, n int, extra string"), "b": b.limit(0)})
    assert sorted(map(tuple, store.read("a").select("k", "n", "extra").collect())) == [("x", 1, None), ("y", 2, None), ("z", 3, "more")]
    assert store.read("b").count() == 1 and store.read("c") is None
    with pytest.raises(Exception, match="no rows here"):
        store.append({"a": a, "b": a.select(F.raise_error(F.lit("no rows here")).alias("k"))})
    assert store.read("a").count() == 3 and store.manifest().count() == 2
    assert [r.k for r in store.pending(spark.createDataFrame([("x",), ("q",), (None,)], "k string"), "a").orderBy("k").collect()] == [None, "q"]


def test_a_resumed_run_equals_a_full_one(spark, features, tmp_path):
    full = sr.run_stored(features, str(tmp_path / "full"), **OPTIONS)
    path = str(tmp_path / "part")
    first = sr.run_stored(features, path, most=1, **OPTIONS)
    done = {r[0] for r in first.read("status").select("industry").distinct().collect()}
    assert 0 < len(done) < 6
    first.stage({"status": first.read("status")})  # what a run that died leaves behind
    part = sr.run_stored(features, path, **OPTIONS)
    for table in ("status", "forecasts", "best", "var", "irf"):
        assert rows_of(part.read(table)) == rows_of(full.read(table)), table
    batches = part.manifest().count()
    assert sr.run_stored(features, path, **OPTIONS).manifest().count() == batches
    status = {(r.industry, r.model): r.status for r in part.read("status").collect()}
    assert len(status) == 12
    assert {status["flat", m] for m in MODELS} == {"constant series"} and {status["few", m] for m in MODELS} == {"too few training rows"}
    assert {status[e, m] for e in "ABCD" for m in MODELS} == {"ok"}


def light_run(part, target, entity, period, models, season, **options):
    """The tables of a run without its work."""
    names = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    rows = part.groupBy(entity).agg(F.count(F.lit(1)).alias("n_train"))
    every = rows.select(entity, names)
    test = every.select(entity, "model", F.lit("test").alias("split"), F.lit(1).alias(period), F.lit("ok").alias("status"))
    status = rows.select(entity, "n_train", F.lit(0).alias("d"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reduced"))
    return {"status": status, "best": every, "forecasts": test, "var": rows}


def test_another_model_is_added_to_what_is_there(spark, features, tmp_path, monkeypatch):
    monkeypatch.setattr(sr, "run_models", light_run)
    path = str(tmp_path / "more")
    sr.run_stored(features, path, **{**OPTIONS, "models": {"arima": MODELS["arima"]}})
    store = sr.run_stored(features, path, **OPTIONS)
    full = sr.run_stored(features, str(tmp_path / "whole"), **OPTIONS)
    for table in ("status", "forecasts", "best", "var"):
        assert rows_of(store.read(table)) == rows_of(full.read(table)), table


def test_failures_are_rows_and_are_tried_again(spark, features, tmp_path, monkeypatch):
    path = str(tmp_path / "bad")

    def broken(part, *args, **options):
        if part.filter("industry = 'A'").count():
            raise ValueError("no luck")
        return light_run(part, *args, **options)

    monkeypatch.setattr(sr, "run_models", broken)
    with pytest.raises(ValueError, match="no luck"):
        sr.run_stored(features, path, **OPTIONS)
    store = sr.run_stored(features, path, isolate=True, **OPTIONS)
    bad = store.read("status").filter("status LIKE 'failed%'")
    assert {r.status for r in bad.collect()} == {"failed: ValueError"} and bad.filter("industry = 'A'").count() == 2
    monkeypatch.setattr(sr, "run_models", light_run)
    store = sr.run_stored(features, path, **OPTIONS)
    now = sr.latest_status(store)
    assert now.count() == 12 and now.filter("status LIKE 'failed%'").count() == 0


def test_reports_and_diagnostics_read_the_store(spark, features, tmp_path):
    store = sr.run_stored(features, str(tmp_path / "r"), diagnostics=True, liquidity=["cash_ratio"], **{**OPTIONS, "cv": True, "batches": 1})
    out = sr.run_reports(store, labels={e: f"name {e}" for e in "ABCD"})
    assert set(out) == {"status", "metrics", "information", "comparisons", "folds", "fold_averages", "responses", "grid"}
    assert out["metrics"].filter("best AND split = 'test'").count() == 4 and out["comparisons"].count() == 4
    assert {"arima", "sarimax"} <= set(out["grid"].columns) and out["folds"].filter("RMSE IS NOT NULL").count() > 12
    listed = {(r.table, r.industry, r.model) for r in store.read("manifest").collect()}
    assert ("residual_tests", "A", "arima") in listed and ("seasonal_decomposition", "B", None) in listed
    res = store.read("residual_tests").filter("industry = 'A' AND model = 'arima'").first()
    assert res["jarque_bera"]["statistic"] > 0
