"""Incremental tables and streams: keyed appends heal, freezes keep, late files repair."""

import datetime as dt

from barlake.sources import tables
from barlake.streaming import events as ev

D = lambda d: dt.date(2024, 1, d)
SCHEMA = "Date date, Symbol string, Price double"


def test_history_append_is_idempotent_and_heals(spark):
    old = spark.createDataFrame([(D(1), "A", 1.0), (D(1), "A", 1.0), (D(2), "A", 2.0)], SCHEMA)
    new = spark.createDataFrame([(D(2), "A", 5.0), (D(3), "A", 3.0)], SCHEMA)
    once = tables.history_append(old, new, ["Date", "Symbol"])
    twice = tables.history_append(once, new, ["Date", "Symbol"])
    want = [(D(1), 1.0), (D(2), 5.0), (D(3), 3.0)]
    for t in (once, twice):
        assert sorted((r.Date, r.Price) for r in t.collect()) == want


def test_freeze_keeps_history(spark):
    old = spark.createDataFrame([(D(1), "A", 1.0)], SCHEMA)
    new = spark.createDataFrame([(D(1), "A", 9.0), (D(2), "A", 2.0)], SCHEMA)
    assert sorted(r.Price for r in tables.price_cache_update(old, new).collect()) == [1.0, 2.0]
    assert sorted(r.Price for r in tables.price_cache_update(old, new, freeze=False).collect()) == [2.0, 9.0]


def test_business_day_gaps_and_schema(spark):
    df = spark.createDataFrame([(D(1),), (D(5),), (D(8),)], "Date date")  # Monday, Friday, Monday
    assert sorted(r.Date for r in tables.business_day_gaps(df).collect()) == [D(2), D(3), D(4)]
    out = tables.project_to_schema(spark.createDataFrame([("x", "1")], "symbol string, Price string"), spark.createDataFrame([], SCHEMA).schema)
    assert out.columns == ["Date", "Symbol", "Price"] and out.first().Price == 1.0 and out.first().Date is None


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    for k in range(3):
        rows = [(k * 10 + i, dt.datetime(2024, 1, 1 + (k + i) % 3, i), "view", 1.0) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = ev.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet")
    got = ev.last_of_key(ev.landed(ev.flow_windows(stream, "30 days"), "w", "update"), ["Day", "event_type"])
    assert sum(r.n for r in got.collect()) == 30 and got.count() == 3
