import __spark_entry__ as entry


def test_entry_runs_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).columns == ["doc_id", "item_id", "hits", "score", "bucket"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
