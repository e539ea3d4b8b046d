import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import scalar as s
from panelwright.operators import derive as d
from panelwright.plans.panel import build_panel
from panelwright.sources.store import append_pending, pending
from panelwright.sources.tables import read_panel, read_table, write_panel, write_table


def rows(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=repr)


def test_period_from_every_type(spark):
    df = spark.sql("SELECT '2015-03-09' AS t, 2016 AS i, 2017.0D AS f, DATE'2018-12-31' AS d")
    for col, want in (("t", 2015), ("i", 2016), ("f", 2017), ("d", 2018)):
        assert d.with_period(df, col).first()["year"] == want
    assert d.with_period(df, "t", unit="month").first()["year"] == 201503
    assert d.with_period(df, "d", unit="day").first()["year"] == 20181231
    with pytest.raises(ValueError, match="period"):
        d.with_period(df, "absent")


def test_bad_period_text_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        d.with_period(spark.sql("SELECT 'n/a-' AS t"), "t").collect()


def test_entity_section_code_or_error(spark):
    df = spark.sql("SELECT 'C' AS okved_section, '62.01' AS okved")
    assert d.with_entity(df).first()["industry"] == "C"
    assert d.with_entity(df.drop("okved_section")).first()["industry"] == "62"
    with pytest.raises(ValueError):
        d.with_entity(df.select(F.lit(1).alias("a")))


def test_absent_column_is_zero_but_null_stays(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS line_1400, 5.0D AS line_1500")
    out = d.derive_measures(df).first()
    assert out["total_assets"] == 0.0 and out["total_liabilities"] is None
    assert out["current_ratio"] == 0.0


def test_zero_denominator_and_non_finite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert rows(df.select(s.safe_ratio("a", "b"))) == [(0.5,), (None,), (None,)]
    odd = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (2.0,), (None,)], "a double")
    assert rows(odd.select(s.finite("a"))) == [(2.0,), (None,), (None,), (None,), (None,)]


def test_filters(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, None, None), (3, None, 1.0)], "year int, a double, b double")
    assert rows(d.any_nonzero(df, ["a", "b"]), "year") == [(3,)]
    assert d.filter_period(df, 2, 3).count() == 2
    with pytest.raises(ValueError):
        d.filter_period(df, 9, 10, strict=True)
    assert d.keep(df, ["b", "nope", "year"]).columns == ["b", "year"]
    assert d.dropna(df, ["b"]).count() == 1


def test_feature_selection(spark):
    df = spark.sql("SELECT 1 AS year, 'A' AS industry, 1D AS t, 2D AS a, 3D AS t_lag1, 4D AS f_dfm")
    assert d.feature_columns(df, "t", "year") == ["a", "t_lag1", "f_dfm"]
    assert d.feature_columns(df, None, None, ["lag"]) == ["t_lag1"]
    assert d.priority_features(["a", "t_lag1", "b", "f_dfm"], 3) == ["t_lag1", "f_dfm", "a"]


def test_labels_and_names(spark):
    df = spark.createDataFrame([("A",), ("Z",), (None,)], "industry string")
    assert rows(d.with_label(df, {"A": "Farming"})) == [("A", "Farming"), ("Z", "Z"), (None, None)]
    table = spark.createDataFrame([("A", "Farming")], "c string, l string")
    assert rows(d.with_label(df, table)) == [("A", "Farming"), ("Z", "Z"), (None, None)]
    text = spark.createDataFrame([("a/b c\\d",)], "t string")
    assert text.select(s.safe_name("t")).first()[0] == "a_b_c_d"


def test_flags(spark):
    df = spark.createDataFrame([(1.49,), (1.5,), (2.5,), (None,)], "x double")
    got = [r[0] for r in df.select(s.dw_band("x")).collect()]
    assert got == ["positive autocorrelation", "no autocorrelation", "negative autocorrelation", None]
    status = d.with_status(
        spark.createDataFrame([("a", 1.0)] * 3 + [("b", 2.0)] * 5 + [("c", float(i)) for i in range(4)], "k string, v double"),
        ["k"],
        "v",
    )
    assert rows(status, "k", "status") == [("a", "too few observations"), ("b", "constant series"), ("c", "ok")]


def test_panel_keeps_null_entities(spark):
    df = spark.createDataFrame(
        [("2015-01-01", "A", 4.0, 2.0), ("2015-02-01", "A", 8.0, 2.0), ("2015-02-01", None, 1.0, 1.0), ("2015-01-01", "B", 0.0, 0.0)],
        "creation_date string, okved_section string, line_1200 double, line_1500 double",
    )
    out = rows(build_panel(df), "industry", "current_ratio", "n_firms")
    assert out == [("A", 3.0, 2), (None, 1.0, 1)]


def test_round_trips(spark, panel, tmp_path):
    small = panel.filter("industry IN ('A', 'B')")
    for fmt in ("csv", "json", "parquet"):
        write_table(small, str(tmp_path / fmt), fmt)
        assert rows(read_table(spark, str(tmp_path / fmt), small.schema, fmt)) == rows(small)
    assert read_table(spark, str(tmp_path / "none"), small.schema, optional=True).isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, str(tmp_path / "none"), small.schema)
    write_panel(small, str(tmp_path / "panel"))
    assert rows(read_panel(spark, str(tmp_path / "panel")), *small.columns) == rows(small)
    assert read_panel(spark, str(tmp_path / "gone"), str(tmp_path / "parquet")).count() == small.count()


def test_incremental_build_adds_only_missing(spark, panel, tmp_path):
    path = str(tmp_path / "store")
    calls = []

    def build(part):
        calls.append(sorted(r[0] for r in part.select("industry").distinct().collect()))
        return part.groupBy("industry").agg(F.count("*").alias("n"))

    append_pending(panel.filter("industry < 'C'"), path, ["industry"], build)
    out = append_pending(panel, path, ["industry"], build)
    again = append_pending(panel, path, ["industry"], build)
    assert calls == [["A", "B"], ["C", "D"], []]
    assert rows(again) == rows(out) == [(e, 60) for e in "ABCD"]
    assert pending(panel, None, ["industry"]) is panel


def test_a_build_that_dies_leaves_nothing(spark, panel, tmp_path):
    path = str(tmp_path / "dies")

    def half(part):
        return part.select("industry", F.when(F.col("industry") == "B", F.raise_error(F.lit("died"))).otherwise(1).alias("n"))

    with pytest.raises(Exception, match="died"):
        append_pending(panel, path, ["industry"], half)
    out = append_pending(panel, path, ["industry"], lambda part: part.groupBy("industry").agg(F.count("*").alias("n")))
    assert rows(out) == [(e, 60) for e in "ABCD"]


def test_period_range_reaches_the_scan(spark, tmp_path):
    """The range on the raw column is pushed down and keeps the same rows, for every type of raw column."""
    days = "SELECT id, date_add(DATE'1998-12-25', cast(id * 9 AS int)) AS d FROM range(120)"
    df = spark.sql(f"SELECT id, d, cast(d AS timestamp) AS ts, cast(d AS string) AS s, year(d) AS i, cast(year(d) + 0.5 AS double) AS f FROM ({days})")
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for col in ("d", "ts", "s", "i", "f"):
        for unit, lo, hi in (("year", 1999, 2000), ("month", 199902, 200012), ("day", 19990227, 20000301)):
            if col in ("i", "f") and unit != "year":
                continue
            keyed = d.with_period(df, col, unit=unit)
            plain = d.filter_period(keyed, lo, hi)
            early = d.filter_period(keyed, lo, hi, raw=col, unit=unit)
            assert rows(early, "id") == rows(plain, "id") and early.count() > 0, (col, unit)
            plan = early._jdf.queryExecution().executedPlan().toString()
            assert (f"GreaterThanOrEqual({col}," in plan) == (col != "s" or unit == "year"), (col, unit)
