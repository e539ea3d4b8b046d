import __spark_entry__ as entry


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(sql) <= set(queries)


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 300 and df.columns[:2] == ["year", "industry"]


def test_oracle_subset_agrees(spark):
    import duckdb

    from tools.check_oracle import rows_of

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("orders", "customer", "lineitem", "nation", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("d1_aggregate_panel", "e3_time_split", "b5_safe_ratio", "d8_diebold_mariano_p", "i8_forecast"):
        df = entry.queries()[name](spark, folder)
        res = con.execute(entry.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall()), name
