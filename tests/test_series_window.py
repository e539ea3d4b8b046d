import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import acf as ac
from panelwright.operators import window as w
from panelwright.operators.series import numbered, series


def same(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False, rtol=1e-9)


def test_block_layout_equals_panel_layout(panel):
    keys = ["industry", "year"]
    same(w.add_lags(panel, ["y", "x"], 3), w.add_lags(panel, ["y", "x"], 3, layout="blocks"), keys)
    same(w.difference(panel, "y", 2), w.difference(panel, "y", 2, layout="blocks"), keys)
    same(w.decompose(panel, "y", 6), w.decompose(panel, "y", 6, layout="blocks"), keys)
    same(ac.acf(panel, "y", 8), ac.acf(panel, "y", 8, layout="blocks"), ["industry", "lag"])
    same(numbered(panel, ["industry"], "year"), numbered(panel, ["industry"], "year", "blocks"), keys)


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_small_blocks_and_both_directions(panel, panel_pdf, block):
    s = series(panel, ["industry"], "year", back=2, ahead=1, layout="blocks", block_rows=block)
    got = s.finish(s.df.withColumns({"b2": s.shift("y", 2), "a1": s.shift("y", -1)})).toPandas()
    got = got.sort_values(["industry", "year"]).reset_index(drop=True)
    g = panel_pdf.sort_values(["industry", "year"]).groupby("industry").y
    assert len(got) == len(panel_pdf)
    assert np.allclose(got.b2, g.shift(2), equal_nan=True) and np.allclose(got.a1, g.shift(-1), equal_nan=True)


def test_pooled_series_of_one_entity_equals_its_own(panel):
    one = panel.filter("industry = 'A'")
    same(w.add_lags(one, ["y"], 2, [], "year"), w.add_lags(one, ["y"], 2), ["year"])


def test_lags_are_positional_and_complete(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("a", 6, 3.0), (None, 1, 1.0), (None, 2, 2.0)], "industry string, year int, v double")
    out = w.add_lags(df, ["v", "absent"], 1).orderBy("year").collect()
    assert [(r["year"], r["v_lag1"]) for r in out] == [(5, 1.0), (6, 2.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 12])
def test_split_and_folds_follow_the_rules(spark, n):
    df = spark.range(n).select(F.lit("a").alias("industry"), F.col("id").cast("int").alias("year"))
    train = w.time_split(df).filter("split = 'train'").count()
    assert train == max(1, int(n * 0.8))
    got = w.rolling_folds(df).toPandas()
    splits = min(3, max(1, (n - 2) // 2))
    size = n // (splits + 1)
    want = []
    for i in range(1, splits + 1):
        if size * i < 3 or size == 0:
            continue
        want += [(i, y, "train") for y in range(size * i)] + [(i, y, "test") for y in range(size * i, min(n, size * (i + 1)))]
    assert sorted(zip(got.fold, got.year, got.role)) == sorted(want)


def test_sequence_windows_and_tail(panel, panel_pdf):
    got = w.sequence_windows(panel, ["y", "x"], 2).filter("industry = 'C'").orderBy("year").collect()
    p = panel_pdf[panel_pdf.industry == "C"]
    assert len(got) == 58
    assert got[0]["window"] == p[["y", "x"]].iloc[:2].to_numpy().tolist()
    assert sorted(r["year"] for r in w.tail_context(panel, 3).filter("industry = 'C'").collect()) == list(p.year.iloc[-3:])


def test_shock_flags(panel, panel_pdf):
    got = w.flag_shocks(panel, "x").toPandas()
    sd = panel_pdf.groupby("industry").x.transform(lambda v: v.std(ddof=0))
    assert got.is_shock.sum() == (panel_pdf.x.abs() > sd).sum()
    assert set(got[got.is_shock & (got.x < 0)].direction) == {"tightening"}


@pytest.mark.parametrize("n,period", [(4, 1), (5, 2), (9, 3), (30, 12), (24, 12), (31, 7)])
def test_decomposition_against_direct_formula(spark, n, period):
    y = np.random.default_rng(n).normal(size=n) + np.arange(n)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "industry string, year int, v double")
    got = w.decompose(df, "v", period).orderBy("year").toPandas()
    p = max(period, 2)
    filt = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
    trend = np.full(n, np.nan)
    h = p // 2
    trend[h : n - h] = np.convolve(y, filt, "valid")
    first, last = h, n - h - 1
    for lo, hi, at in ((first, min(first + p, last), range(first)), (max(first, last - p), last, range(last + 1, n))):
        k, c = np.linalg.lstsq(np.c_[np.arange(lo, hi), np.ones(hi - lo)], trend[lo:hi], rcond=None)[0]
        for i in at:
            trend[i] = k * i + c
    means = np.array([(y - trend)[i::p].mean() for i in range(p)])
    seasonal = np.resize(means - means.mean(), n)
    assert np.allclose(got.trend, trend) and np.allclose(got.seasonal, seasonal)
    assert np.allclose(got.resid, y - trend - seasonal)


def test_too_short_series_are_left_out(spark):
    df = spark.createDataFrame([("a", i, 1.0 * i) for i in range(3)], "industry string, year int, v double")
    assert w.decompose(df, "v").isEmpty() and ac.acf(df, "v").isEmpty() and ac.pacf(df, "v").isEmpty()


def test_partial_autocorrelation_solves_yule_walker(panel, panel_pdf):
    got = ac.acf_pacf(panel, "y", 6).filter("industry = 'D'").orderBy("lag").toPandas()
    y = panel_pdf[panel_pdf.industry == "D"].y.to_numpy()
    x = y - y.mean()
    r = np.array([x[k:] @ x[: len(x) - k] for k in range(7)]) / (x @ x)
    assert np.allclose(got.acf, r)
    for k in range(1, 7):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        assert got.pacf[k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1], abs=1e-12)
    width = 1.959963984540054 * np.sqrt((1 + 2 * np.cumsum(np.r_[0, r[1:-1] ** 2])) / 60)
    assert np.allclose(got.acf_ci_hi[1:] - got.acf[1:], width) and got.acf_ci_hi[0] == 1


def test_known_bands_and_partials():
    # Published outcome for nine observations, three lags.
    r = np.array([1.0, 0.28884456143346976, 0.11324370587145938, 0.19259096695918168])
    assert np.allclose(ac.partial_from_acf(r), [1, 0.2888445614334698, 0.03252622669790195, 0.16552008077212027], atol=1e-14)


def test_quantile_points(panel, panel_pdf):
    from statistics import NormalDist

    got = ac.qq_points(panel, ["industry"], "y").filter("industry = 'A'").orderBy("i").toPandas()
    v = np.sort(panel_pdf[panel_pdf.industry == "A"].y)
    n = len(v)
    p = np.r_[1 - 0.5 ** (1 / n), (np.arange(2, n) - 0.3175) / (n + 0.365), 0.5 ** (1 / n)]
    assert np.allclose(got["sample"], v)
    assert np.allclose(got.theoretical, [NormalDist().inv_cdf(q) for q in p])
    line = ac.qq_line(ac.qq_points(panel, ["industry"], "y", layout="blocks"), ["industry"]).filter("industry = 'A'").first()
    assert line["slope"] == pytest.approx(np.polyfit(got.theoretical, v, 1)[0])
