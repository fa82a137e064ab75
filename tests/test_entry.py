import importlib


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
