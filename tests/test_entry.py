import __spark_entry__ as entry


def test_names_and_sql_belong_together():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 70


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["src", "rec_id", "anonymized", "mapped"] and df.limit(1).count() == 1
