import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.operators.aggregate import aggregate_panel, correlation, covariance, residual_histogram
from panelwright.operators.impute import impute_median, inverse_minmax, minmax, standardize
from panelwright.operators.median import exact_median


def median_of(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    return exact_median(df, [], ["v"], **kw).first()["v"]


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [1.0, 2.0], [5.0, 5.0, 5.0, 5.0], [0.0, 0.0, 0.0, 1e9], [-1e300, 1e300, 3.0, 4.0],
        [1e-300, 2e-300, 3e-300], [float(i) for i in range(1001)], [1.0] * 500 + [2.0] * 500,
        [2.0 ** i for i in range(-40, 41)],
    ],
)
def test_bracketed_selection_is_exact(spark, values):
    want = float(np.median(values)) if max(map(abs, values)) < 1e200 else 3.5
    assert median_of(spark, values, accuracy=16) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_selection_equals_numpy(spark, values):
    got = median_of(spark, values, accuracy=8)
    assert got == pytest.approx(np.median(values), rel=1e-12, abs=1e-12)


def test_hot_and_cold_groups_with_null_keys(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {"k": ["hot"] * 400 + ["cold"] * 21 + [None] * 90, "a": rng.normal(size=511), "b": rng.integers(0, 4, 511) * 1.0}
    )
    pdf.loc[pdf.index % 7 == 0, "a"] = np.nan
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in pdf.itertuples(index=False)],
                               "k string, a double, b double").withColumn("void", F.lit(None).cast("double"))
    out = {r["k"]: r for r in exact_median(df, ["k"], ["a", "b", "void"], accuracy=50, count_as="n").collect()}
    for key, part in (("hot", pdf[pdf.k == "hot"]), ("cold", pdf[pdf.k == "cold"]), (None, pdf[pdf.k.isna()])):
        assert out[key]["a"] == pytest.approx(part.a.median(), rel=1e-12)
        assert out[key]["b"] == part.b.median() and out[key]["void"] is None and out[key]["n"] == len(part)


def test_panel_accuracy_option(spark, panel):
    exact = aggregate_panel(panel, ["industry"], ["y"]).orderBy("industry").toPandas()
    near = aggregate_panel(panel, ["industry"], ["y"], accuracy=10000).orderBy("industry").toPandas()
    assert np.allclose(exact.y, near.y, atol=0.2) and list(exact.n_firms) == [60] * 4


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None, None), ("a", None, None, 1.0), ("a", 5.0, None, 3.0), ("b", None, None, None), ("b", 8.0, None, 2.0)],
        "k string, v double, w double, t double",
    )
    got = impute_median(df, ["v", "w"], ["k"], zero=["t"]).orderBy("k", "v").toPandas()
    assert list(got.v) == [1, 3, 5, 8, 8] and list(got.w) == [0] * 5 and got.t.isna().sum() == 0
    glob = impute_median(df, ["v", "w"]).toPandas()
    assert sorted(glob.v) == [1, 5, 5, 5, 8]
    z = standardize(glob_df := spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "v double, c double"), ["v", "c"]).toPandas()
    assert sorted(z.v) == [-1, 1] and list(z.c) == [0, 0]
    m = minmax(glob_df, ["v", "c"], keep_stats=True)
    back = m.select(inverse_minmax("v", {"min": "v_min", "max": "v_max"}).alias("r"), "c").toPandas()
    assert sorted(back.r) == [1, 3] and list(back.c) == [0, 0]


def test_moments_match_pandas(panel, panel_pdf):
    for fn, name in ((covariance, "cov"), (correlation, "corr")):
        got = fn(panel, ["y", "x", "z"], ["industry"]).filter("industry = 'B'").toPandas()
        want = getattr(panel_pdf[panel_pdf.industry == "B"][["y", "x", "z"]], name)()
        for r in got.itertuples():
            assert r.value == pytest.approx(want.loc[r.row_var, r.col_var], rel=1e-10)


def test_histogram_matches_numpy(spark, panel, panel_pdf):
    got = residual_histogram(panel, ["industry"], "y").filter("industry = 'A'").orderBy("bin").toPandas()
    v = panel_pdf[panel_pdf.industry == "A"].y
    want, edges = np.histogram(v, bins=21, density=True)
    assert np.allclose(got.density, want) and np.allclose(got.left_edge, edges[:-1])
    flat = spark.createDataFrame([("c", 2.0)] * 3, "industry string, y double")
    assert residual_histogram(flat, ["industry"], "y").agg(F.sum("n_in_bin")).first()[0] == 3


def test_large_groups_with_infinities_and_nan_end_as_small_ones_do(spark):
    rng = np.random.default_rng(5)
    inf, nan = float("inf"), float("nan")
    groups = {
        "inf": [*rng.normal(size=300).tolist(), inf, -inf, inf],
        "nan": [*map(float, range(301)), nan],
        "mostly inf": [inf] * 200 + [1.0] * 100,
        "half": [1.0, 2.0, inf, inf] * 50,
        "both": [-inf, inf] * 60,
        "wide": [10.0 ** (i % 600 - 300) * (-1) ** i for i in range(1201)],
        "tiny": [5e-324 * i for i in range(200)] + [0.0] * 7,
        "huge": [1.7e308, -1.7e308] * 100 + [1.6e308],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    small = {r.g: r.v for r in df.groupBy("g").agg(F.median("v").alias("v")).collect()}
    default = {r.g: r.v for r in exact_median(df, ["g"], ["v"]).collect()}
    large = {r.g: r.v for r in exact_median(df, ["g"], ["v"], accuracy=10).collect()}
    for g in groups:
        assert default[g] == pytest.approx(small[g], rel=1e-15, nan_ok=True), g
        assert large[g] == pytest.approx(small[g], rel=1e-15, nan_ok=True), g


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """With quantiles far off the middle the first bracket has no middle rank; the result is the same."""
    from panelwright.operators import median

    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 801), ("b", 300), ("c", 1)) for v in rng.normal(size=n)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    real, seen = median._bracketed, []

    def off(rows, by, n_cols, accuracy, share):
        seen.append(share)
        if len(seen) == 1:  # as if the sketch had erred
            monkeypatch.setattr(median.F, "percentile_approx", lambda c, p, a, f=median.F.percentile_approx: f(c, median.F.array(median.F.lit(0.9), median.F.lit(0.95)), a))
            out = real(rows, by, n_cols, accuracy, share)
            monkeypatch.setattr(median.F, "percentile_approx", approx)
            return out
        return real(rows, by, n_cols, accuracy, share)

    approx = median.F.percentile_approx
    monkeypatch.setattr(median, "_bracketed", off)
    got = {r.g: r.v for r in exact_median(df, ["g"], ["v"]).collect()}
    assert len(seen) == 2 and seen[1] > seen[0]
    for g in "abc":
        assert got[g] == pytest.approx(np.median([v for k, v in rows if k == g]), rel=1e-12)


def test_median_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_median(df, ["g"], ["v"]).count() == 0
    assert exact_median(df, [], ["v"], count_as="n").collect()[0].asDict() == {"v": None, "n": 0}


def test_panel_records_are_computed_once_and_meet_by_group(spark):
    """Medians of many groups: one run over the records, and a group's sketches come from one task."""
    from panelwright.operators.median import gathered

    n, groups = 2400, 60
    seen = spark.sparkContext.accumulator(0)

    def note(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(11)
    values = rng.normal(size=n).round(2).tolist()
    keys = [i * 7 % groups or None for i in range(n)]
    df = spark.createDataFrame(list(zip(keys, values)), "k long, v double").repartition(40)
    dear = df.withColumn("v", F.udf(note, "double")("v"))
    got = {r.k: (r.v, r.n_firms) for r in aggregate_panel(dear, ["k"], ["v"]).collect()}
    assert seen.value == n
    want = pd.DataFrame({"k": [-1 if k is None else k for k in keys], "v": values}).groupby("k").v.agg(["median", "size"])
    assert {-1 if k is None else k: v for k, v in got.items()} == {k: (pytest.approx(r["median"], rel=1e-12), r["size"]) for k, r in want.iterrows()}
    files = gathered(df, ["k"]).select("k", F.input_file_name().alias("file")).groupBy("k").agg(F.count_distinct("file").alias("f"))
    assert files.agg(F.max("f"), F.count(F.lit(1))).first()[:] == (1, groups)


def test_a_large_group_is_cut_over_several_tasks(spark):
    from panelwright.operators.median import gathered

    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rng = np.random.default_rng(12)
    values = rng.normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"k": ["hot"] * 19_000 + ["cold"] * 1_000, "v": values})).repartition(16)
    try:
        spark.conf.set(name, "32k")
        rows = gathered(df, ["k"])
        assert rows.filter("k = 'hot'").select(F.input_file_name()).distinct().count() > 2
        got = {r.k: r.v for r in aggregate_panel(df, ["k"], ["v"]).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {"hot": pytest.approx(np.median(values[:19_000]), rel=1e-12), "cold": pytest.approx(np.median(values[19_000:]), rel=1e-12)}


def test_rows_meet_few_brackets_without_a_shuffle(spark, monkeypatch):
    """Also where the planner would not broadcast by itself; with many brackets they are joined. Same medians."""
    from panelwright.operators import median

    plans, settle = [], median.settle

    def seen(df, label="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(median, "settle", seen)
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"k": rng.integers(0, 30, 3000), "v": rng.normal(size=3000), "w": rng.integers(0, 9, 3000).astype(float)})
    df, want = spark.createDataFrame(pdf), pdf.groupby("k")[["v", "w"]].median()
    try:
        spark.conf.set(name, "-1")
        for held, joins in ((median.HELD, "BroadcastHashJoin"), (59, "SortMergeJoin")):
            monkeypatch.setattr(median, "HELD", held)
            plans.clear()
            got = {r.k: (r.v, r.w) for r in median.exact_median(df, ["k"], ["v", "w"]).collect()}
            assert got == {k: (pytest.approx(r.v, rel=1e-12), r.w) for k, r in want.iterrows()}
            # The rows are joined below the counts.
            assert joins in plans[-1].rpartition("HashAggregate")[2]
    finally:
        spark.conf.set(name, before)


def test_items_are_dealt_by_order_before_they_are_summed(spark, tmp_path):
    """No partial sums per task: items of an order stand apart, so they would be as many as the items."""
    from panelwright.sources.star import statements

    tables = {
        "customer": ([(1, 7, 5.0, "A"), (2, None, 1.0, None)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(10, 1, 100.0, "2020-01-05"), (11, 2, 50.0, None), (None, 1, 3.0, "2020-01-05"), (12, None, 3.0, None)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string"),
        "lineitem": ([(10, 4.0, 0.5, 0.25), (11, 8.0, None, 0.0), (10, 2.0, 0.0, 0.5), (None, 1.0, 0.0, 0.0), (10, None, 0.1, 0.1), (10, 4.0, 0.5, 0.25)], "l_orderkey long, l_extendedprice double, l_discount double, l_tax double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = statements(spark, str(tmp_path))
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in line]
    assert len(at) == 1 and "Aggregate" not in "".join(lines[at[0] :])
    got = {r.statement_id: (r.okved_section, r.line_1200, r.line_1210, r.line_1250, r.line_4100) for r in out.collect()}
    assert got == {10: ("A", 10.0, 4.0, 3.0, 6.0), 11: (None, 8.0, None, 0.0, None)}
