"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(isinstance(s, str) for s in sql.values())
    assert all(callable(q) for q in queries.values())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
