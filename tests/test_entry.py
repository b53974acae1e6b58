import __spark_entry__ as entry


def test_names_and_flagship(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    got = entry.entry(spark)
    assert got.columns == ["series_id", "start", "excess_kurtosis", "acf_abs_1", "acf_abs_20", "leverage", "drift", "variance_ratio_20"] and got.count() == 13
