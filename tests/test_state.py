"""Streams over several landed files, with late and replayed ones, against the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barlake.streaming import events as ev
from barlake.streaming import state

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


def stream(spark, tmp_path, schema, landings):
    for k, rows in enumerate(landings):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_bars_repair_matured_rows(spark, tmp_path):
    """Four landings: early, late and better bars; equal to the bars read at once."""
    rnd = random.Random(1)
    bars = [(s, T(d).date(), float(rnd.randrange(1, 99))) for s in "AB" for d in range(40) if rnd.random() > 0.2]
    rnd.shuffle(bars)
    bars += [("A", T(400).date(), 0.0), ("A", T(401).date(), 5.0)]
    late = [("A", T(-5).date(), 7.0), ("A", bars[0][1], 1000.0), ("C", T(1).date(), 3.0), (None, T(1).date(), 3.0), ("B", T(2).date(), None)]
    landings = [bars[:20], bars[20:50], bars[50:], late]
    got = {}
    log = ev.landed(state.matured(stream(spark, tmp_path, "Symbol string, Date date, Price double", landings), (1, 5)), "matured", "update")
    assert log.select("_batch").distinct().count() == 4
    for r in ev.last_of_key(log, ["Symbol", "Signal_Date", "Horizon_Days"]).collect():
        got[r.Symbol, r.Signal_Date, r.Horizon_Days] = r.Gross_Forward_Return
    best, want = {}, {}
    for s, d, p in bars + late:
        if s and p is not None:
            best.setdefault(s, {})[d] = max(p, best.get(s, {}).get(d, p))
    for s, of in best.items():
        days = sorted(of)
        for i, d in enumerate(days):
            for h in (1, 5):
                want[s, d, h] = of[days[i + h]] / of[d] - 1 if i + h < len(days) and of[d] else None
    assert got == pytest.approx(want)


def test_an_older_story_that_lands_last_is_first_seen(spark, tmp_path):
    landings = [[("k1", 5, T(10)), ("k2", 6, T(11)), ("k1", 4, T(12))], [("k1", 9, T(10)), ("k1", 3, T(10)), (None, 1, T(1)), ("k3", 2, None)], [("k2", 1, T(2)), ("k1", 2, T(11))]]
    log = ev.landed(state.first_seen(stream(spark, tmp_path, "Cluster_Key string, id long, First_Seen timestamp", landings)), "seen", "update")
    got = {r.Cluster_Key: (r.id, r.First_Seen) for r in ev.last_of_key(log, ["Cluster_Key"]).collect()}
    assert got == {"k1": (3, T(10)), "k2": (1, T(2))}
    assert log.where("Cluster_Key = 'k2'").count() == 2 and log.where("Cluster_Key = 'k1' and _batch = 2").count() == 0


def test_clusters_expire(spark, tmp_path):
    """A cluster that is not seen for long is forgotten: a story of it opens it anew."""
    landings = [[("k", 1, T(0))], [("x", 2, T(500))], [("y", 3, T(501))], [("k", 9, T(502))]]
    log = ev.landed(state.first_seen(stream(spark, tmp_path, "Cluster_Key string, id long, First_Seen timestamp", landings), keep_days=30), "expired", "update")
    assert [(r.id, r.First_Seen) for r in log.where("Cluster_Key = 'k'").orderBy("_batch").collect()] == [(1, T(0)), (9, T(502))]


SCHEMA = "Date int, Symbol string, Price double"
LANDINGS = [[(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)], [(2, "A", 30.0), (3, "C", 4.0)], [(1, "A", 100.0), (1, None, 9.0), (9, "Z", 1.0)]]


@pytest.mark.parametrize("newest", [True, False])
def test_upserts_by_bucket_equal_the_batch(spark, tmp_path, newest):
    order = [F.col("_landed").desc() if newest else F.col("_landed"), F.col("Price")]
    got = state.upserted(stream(spark, tmp_path, SCHEMA, LANDINGS), "upserts", ["Date", "Symbol"], order, buckets=4)
    want = {}
    for rows in LANDINGS:
        for d, s, p in rows:
            if newest or (d, s) not in want:
                want[d, s] = p
    assert {(r.Date, r.Symbol): r.Price for r in got.collect()} == want and got.columns == ["Date", "Symbol", "Price"]


def test_a_replayed_batch_changes_nothing_and_buckets_are_left_alone(spark):
    table = state.BucketTable(spark, "replay", ["Date", "Symbol"], [F.col("_landed").desc()], buckets=16)
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in LANDINGS]
    for k, f in enumerate(frames):
        table.upsert(f, k)
        table.upsert(f, k)
    rows = sorted(table.table(2, frames[0]).collect(), key=str)
    assert len(rows) == 6 and rows == sorted(table.table(2, frames[0]).collect(), key=str)
    touched = lambda k: {b for b, v in table._versions(k + 1).items() if v == k}
    assert 0 < len(touched(1)) <= 2 and len(table._versions(3)) >= len(touched(2)) and sorted(r.Price for r in table.table(0, frames[0]).collect()) == [1.0, 2.0, 3.0]
    empty = state.BucketTable(spark, "none", ["Date", "Symbol"], [F.col("_landed").desc()])
    assert empty.table(-1, frames[0]).count() == 0


def test_clusters_of_a_bucket_are_kept_apart(spark, tmp_path):
    """Many clusters in two buckets: firsts, late ones and expiry are those of each cluster by itself."""
    rnd = random.Random(6)
    landings = [[(f"k{rnd.randrange(40)}", n * 100 + i, T(n * 10 + rnd.randrange(5))) for i in range(60)] for n in range(3)]
    got, want, known = {}, {}, {}
    log = ev.landed(state.first_seen(stream(spark, tmp_path, "Cluster_Key string, id long, First_Seen timestamp", landings), buckets=2), "apart", "update")
    for r in log.collect():
        got[r.Cluster_Key, r._batch] = (r.First_Seen, r.id)
    for n, rows in enumerate(landings):
        before = dict(known)
        for k, i, t in rows:
            known[k] = min(known.get(k, (t, i)), (t, i))
        want |= {(k, n): v for k, v in known.items() if before.get(k) != v}
    assert got == want
    away = [[("a", 1, T(0)), ("b", 2, T(300))], [("c", 3, T(600))], [("b", 4, T(601)), ("d", 5, T(602))], [("a", 6, T(603))]]
    log = ev.landed(state.first_seen(stream(spark, tmp_path / "away", "Cluster_Key string, id long, First_Seen timestamp", away), keep_days=30, buckets=1), "away", "update")
    assert [(r.Cluster_Key, r.id) for r in log.orderBy("_batch", "id").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 5), ("a", 6)]  # b lands anew before it is forgotten
