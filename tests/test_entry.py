"""The driver's entry: with and without the pipeline modules."""

import __spark_entry__ as E
from lodestone.plans import registry


def test_absent_modules_are_skipped(monkeypatch):
    monkeypatch.setattr(E, "find_spec", lambda name: None)
    assert E.queries() == registry.QUERIES and E.oracle_sql() == registry.ORACLE_SQL


def test_every_sql_names_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and all(callable(f) for f in registry.QUERIES.values())
