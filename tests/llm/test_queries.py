"""Every numbered operator has one query; SQL is text and names a query."""

from recordspark.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and all(isinstance(s, str) for s in ORACLE_SQL.values())
