"""The driver's contract: queries exist, have SQL of the same columns, and the flagship runs."""

import __spark_entry__ as entry


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"Symbol", "Date", "Place"} <= set(rows[0].asDict())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
