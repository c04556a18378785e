import __spark_entry__ as entry


def test_flagship_and_registry(spark):
    assert entry.entry(spark).count() == 80
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 50


def test_some_queries_equal_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sql = entry.oracle_sql()
    for name in ("sim_edges_plain", "sim_edges_encoded", "components", "rescore_edges"):
        rows = entry.queries()[name](spark, sf).toPandas()
        want = con.execute(sql[name]).df()
        columns = sorted(want.columns)
        assert sorted(rows.columns) == columns
        as_rows = lambda x: sorted(tuple(round(float(v), 6) for v in r) for r in x[columns].itertuples(index=False))
        assert as_rows(rows) == as_rows(want), name
