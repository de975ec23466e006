"""Signals and ranks against formulas written out for small hand-made frames."""

import datetime as dt
import random

import pytest

from barlake.functions.frames import percent_rank
from barlake.operators import alphas, scoring, signals, validation


@pytest.fixture(scope="module")
def bars(spark):
    rnd = random.Random(7)
    rows = []
    for s in range(12):
        p = 100.0
        for d in range(80):
            p *= 1 + rnd.gauss(0, 0.02)
            rows.append((f"S{s}", dt.date(2024, 1, 1) + dt.timedelta(days=d), p, p * 1.01, p * 0.99, p, p, 1000.0 + d))
    return spark.createDataFrame(rows, "Symbol string, Date date, Open double, High double, Low double, Close double, Price double, Volume double")


def test_percent_rank_averages_ties_and_skips_nulls(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("d", 1, 1.0), ("d", 2, 2.0), ("d", 3, 2.0), ("d", 4, None)], "Date string, i int, x double")
    got = {r.i: r.p for r in df.withColumn("p", percent_rank(F.col("x"), "Date")).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: pytest.approx(2.5 / 3), 3: pytest.approx(2.5 / 3), 4: None}


def test_rsi_is_50_without_losses(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(d + 1)) for d in range(30)]
    df = spark.createDataFrame(rows, "Symbol string, Date date, Price double")
    assert {r.RSI_14 for r in signals.rsi(df).collect()} == {50.0}


def test_moving_average_needs_half_its_rows(bars):
    got = [r.MA_20D for r in signals.moving_averages(bars.where("Symbol = 'S1'")).orderBy("Date").collect()]
    price = [r.Price for r in bars.where("Symbol = 'S1'").orderBy("Date").collect()]
    assert got[:9] == [None] * 9 and got[9] == pytest.approx(sum(price[:10]) / 10)
    assert got[40] == pytest.approx(sum(price[21:41]) / 20)


def test_mature_signals_enter_at_the_next_bar_and_name_reasons(spark):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, d), float(d)) for d in (2, 3, 5, 8, 9, 10, 11)], "Symbol string, Date date, Price double")
    sig = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1)), ("A", dt.date(2024, 1, 4)), ("A", dt.date(2024, 1, 20)), ("B", dt.date(2024, 1, 4))], "Symbol string, Date date"
    ).selectExpr("*", "1d as Confidence_Adjusted_Score", "1d as Final_Score", "'Stock' as Universe", "'Yes' as Opportunity_Eligible", "1d as Avg_Traded_Value_20D")
    got = {(r.Symbol, r.Signal_Date.day): r for r in validation.mature_signals(sig, bars, (5,)).collect()}
    assert got["A", 1].Gross_Forward_Return == pytest.approx(10 / 2 - 1)
    assert got["A", 4].Entry_Date == dt.date(2024, 1, 5) and got["A", 4].Reason == "Forward bar not available yet"
    assert got["A", 20].Reason == "No price on or after signal date" and got["B", 4].Reason == "No price history for symbol"


def test_quantiles_have_interpolated_edges(spark):
    rows = [(f"S{i:02d}", dt.date(2024, 1, 1), 5, 0.01 * i, float(i), "Yes") for i in range(11)]
    df = spark.createDataFrame(rows, "Symbol string, Signal_Date date, Horizon_Days int, Net_Forward_Return double, Confidence_Adjusted_Score double, Opportunity_Eligible string")
    got = [r.Score_Quintile for r in validation.assign_buckets(df).orderBy("Symbol").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert validation.assign_buckets(df.limit(9)).count() == 0


def test_final_score_never_changes_official_order(spark):
    base = [("d", s, "G", "Yes", cas, fin) for s, cas, fin in (("A", 50.0, 1.0), ("B", 60.0, 0.0), ("C", 50.0, 9.0))]
    schema = "Date string, Symbol string, Universe_Group string, Opportunity_Eligible string, Confidence_Adjusted_Score double, Final_Score double"
    for flip in (1, -1):
        df = spark.createDataFrame([(*r[:5], flip * r[5]) for r in base], schema)
        assert [r.Symbol for r in scoring.official_rank(df).orderBy("Rank").collect()] == ["B", "A", "C"]


def test_asof_overlay_takes_the_last_value_on_or_before(spark):
    s = spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 3, 6)], "Symbol string, Date date")
    o = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0), ("A", dt.date(2024, 1, 3), 2.0), ("A", dt.date(2024, 1, 5), None)], "Symbol string, Date date, v double")
    assert [r.v for r in alphas.asof_overlay(s, o, "v").orderBy("Date").collect()] == [None, 2.0, 2.0]


def test_alpha_up_ratio(bars):
    got = alphas.alpha(bars.where("Symbol = 'S3'"), "up_ratio").orderBy("Date").collect()
    p = [r.Close for r in bars.where("Symbol = 'S3'").orderBy("Date").collect()]
    assert got[-1].value == pytest.approx(sum(p[i] > p[i - 1] for i in range(len(p) - 21, len(p))) / 21)


def test_verdict_gates(spark):
    row = dict(Horizon_Days=10, Validation_Dates=40, Effective_Dates=30.0, Avg_Obs=80.0, Hit_Rate=0.8, Adjusted_TStat=4.0, Avg_Spread=0.02, Boot_Prob_Positive=0.99)
    cases = [({}, "Validation Positive"), ({"Validation_Dates": 5}, "Insufficient History"), ({"Effective_Dates": 3.0}, "Insufficient Independent History"), ({"Avg_Obs": 9.0}, "Insufficient Breadth"), ({"Boot_Prob_Positive": 0.1}, "No Proven Edge Yet"), ({"Avg_Spread": -0.05, "Adjusted_TStat": -1.0}, "Validation Negative")]
    for change, want in cases:
        df = spark.createDataFrame([row | change])
        assert validation.verdict(validation.bayes_shrink(df)).first().Verdict == want


@pytest.mark.parametrize("n, least, strict, to, stretch", [(5, 1, True, 0, 4096), (5, 3, False, 0, 7), (4, 1, True, -1, 4), (1, 1, False, 0, 1), (3, 2, True, -2, 5)])
def test_moving_ranks_do_not_depend_on_stretches(spark, n, least, strict, to, stretch):

    rnd = random.Random(n)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), rnd.choice([None, float("nan"), 1.0, 2.0, rnd.random()])) for s, m in (("A", 60), ("B", 3), ("C", 1)) for d in range(m)]
    got = {(r.Symbol, r.Date): r.Share for r in signals.share_below(spark.createDataFrame(rows, "Symbol string, Date date, Value double"), n, least, strict, to, stretch).collect()}
    want, key = {}, lambda v: (v != v, v if v == v else 0.0)
    for s in "ABC":
        of = [(d, v) for x, d, v in rows if x == s and v is not None]
        for i, (d, v) in enumerate(of):
            frame = [w for j, (_, w) in enumerate(of) if i + to - n < j <= i + to]
            hits = sum(key(w) < key(v) if strict else key(w) <= key(v) for w in frame)
            want[s, d] = hits / len(frame) * 100 if len(frame) >= least and frame else None
    assert got == want
    assert signals.share_below(spark.createDataFrame([], "Symbol string, Date date, Value double"), n, least).count() == 0
