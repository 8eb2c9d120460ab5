import __spark_entry__ as entry


def test_registry_and_flagship(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert len(queries) > 70 and set(oracle) <= set(queries)
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score", "n_matched"]
