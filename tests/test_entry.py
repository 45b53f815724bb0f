import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["workspace_id", "frontend", "handler", "match", "metadata"]
    assert found.count() == 150
