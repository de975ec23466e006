"""Queries against their SQL, on the smallest data."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from barlake.sources.shared import shared_path

DATA = Path("/root/testdata/sf0.001")


def by_sql(name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in got.description], got.fetchall()


def same(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    columns, want = by_sql(name)
    assert df.columns == columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got and got == sorted(want, key=key)


def test_threshold_score(spark):
    same(spark, "threshold_score")


@pytest.mark.parametrize("name", ["plan_views", "top5_alignment", "shadow_frame", "card_join", "rebalance_diff"])
def test_few_columns_are_written(spark, monkeypatch, name):
    """Tables between steps hold what the query reads of some 90 columns, and the scores are computed once."""
    from barlake.plans import queries

    paths = []
    monkeypatch.setattr(queries, "shared_path", lambda s, n: paths.append(shared_path(s, n)) or paths[-1])
    same(spark, name)
    tables = {p.rsplit("/", 1)[-1].rsplit("-", 1)[0]: spark.read.parquet(p).columns for p in paths}
    assert max(len(c) for c in tables.values()) <= 40 and "Beta_252D" not in tables["signals"]
    assert sum("/signals-" in p for p in paths) == 1
