import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    if entry.llm is not None:
        assert all(sum(n.startswith(f"op{k}_") for n in queries) == 1 for k in range(1, 11))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_acctbal"] and 0 < df.count() <= 20
