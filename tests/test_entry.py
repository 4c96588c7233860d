import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"cutoff", "customerID", "ISIN"}
    assert df.count() > 0


def test_registry_contract():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(s) >= 40
    for name, sql in s.items():
        assert sql.strip().upper().startswith("WITH"), name
