import __spark_entry__ as E


def test_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["tag", "pixel_id", "value"] and df.count() == 64
    assert set(E.oracle_sql()) <= set(E.queries())
