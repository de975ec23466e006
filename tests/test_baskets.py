"""Baskets, weights and news against plain Python, where SQL cannot express them or cases are rare."""

import datetime as dt

import numpy as np
import pytest

from barlake.operators import alphas, backtest, evaluation, metadata

D = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)


def test_equal_risk_weights_are_cut_and_add_up():
    cov = np.full((5, 5), 0.5) + np.eye(5) * 0.5
    assert backtest.equal_risk(cov) == pytest.approx([0.2] * 5)
    rnd = np.random.default_rng(1)
    s = rnd.uniform(0.1, 0.5, 5)
    w = backtest.equal_risk(cov * np.outer(s, s), most=0.3)
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    once = backtest.equal_risk(np.diag(s**2), most=1.0, rounds=1)
    assert once == pytest.approx(s**-2 / (s**-2).sum())


def test_risk_parity_of_several_dates(spark):
    picks = spark.createDataFrame([(D(d), s) for d in range(3) for s in "ABC"], "Date date, Symbol string")
    sigma = spark.createDataFrame([("A", 0.1), ("B", 0.2), ("C", 0.4)], "Symbol string, Sigma double")
    corr = spark.createDataFrame([("A", "B", 0.0), ("A", "C", 0.0), ("B", "C", 0.0)], "Symbol_A string, Symbol_B string, corr double")
    got = backtest.risk_parity(picks, sigma, corr, target=9.0, most=1.0).collect()
    assert len(got) == 9 and sum(r.Weight for r in got) == pytest.approx(3) and sum(r.Risk_Contribution for r in got) == pytest.approx(3)
    shrunk = backtest.risk_parity(picks, sigma, corr, target=0.01, most=1.0).collect()
    assert sum(r.Weight for r in shrunk) < 1


def test_the_gate_fails_closed(spark):
    empty = lambda s: spark.createDataFrame([], s)
    args = [empty("Symbol_A string, Symbol_B string, corr double"), empty("Symbol string, Weight double, Max_Loss_Pct double"), empty("Symbol string, Sector string"), empty("Variant string, Hit_Rate double"), empty("alpha string"), "risk-off", empty("Symbol string, Event_Risk string"), "No Proven Edge Yet"]
    got = backtest.portfolio_gate(*args).first()
    assert got.Verdict == "Downgrade_To_Watch" and all(x in got.Reasons for x in ("missing evidence", "RISK_OFF", "not positive"))


def test_expected_value_refuses_missing_columns_and_verdicts(spark):
    rows = spark.createDataFrame([(10, 0.1)] * 40, "Horizon_Days int, Net_Forward_Return double")
    assert backtest.expected_value(rows, "Validation Positive").first().EV_Per_Trade == pytest.approx(0.1)
    for args in (("Validation Positive", 10, {"Bucket": "x"}), ("Unknown",), ("Validation Positive", 5)):
        got = backtest.expected_value(rows, *args).first()
        assert got.EV_Per_Trade is None and got.Status.startswith("EV unavailable")


def test_pandas_alphas_are_registered_by_name(spark):
    bars = spark.createDataFrame([("A", D(d), float(d), float(d + 1)) for d in range(5)], "Symbol string, Date date, Open double, Close double")
    alphas.register_pandas_alpha("gap_size", "reversal", lambda f: f["Close"] - f["Open"])
    assert {r.value for r in alphas.pandas_alpha(bars, "gap_size").collect()} == {1.0}


def test_weekdays_between_dates(spark):
    days = [(D(a), D(b)) for a in range(8) for b in range(a - 2, a + 25, 3)]
    df = spark.createDataFrame(days, "a date, b date")
    from pyspark.sql import functions as F

    for r in df.withColumn("n", metadata.business_days(F.col("a"), F.col("b"))).collect():
        want = sum((r.a + dt.timedelta(days=i)).weekday() < 5 for i in range(1, (r.b - r.a).days + 1))
        assert r.n == (want if r.b >= r.a else None)


def test_risk_flags_take_the_data_flag_of_the_sources(spark):
    from barlake.operators import scoring

    flags = ["Complete", "NAV missing; Tracking error unavailable; tracking difference available", "Tracking error unavailable; tracking difference available", "Tracking disclosure unavailable from current AMFI feed", None]
    fields = "Opportunity_Eligible string, Absolute_Momentum_Pass boolean, Volatility_20D double, Current_Drawdown_60D double, Zero_Volume_Days_60D double, Above_20DMA boolean, Above_50DMA boolean, RSI_14 double, NAV_Premium_Discount double, NAV double"
    rows = [(k, u, f, "Yes", True, 0.1, 0.0, 0.0, True, True, 50.0, 0.0, None) for k, f in enumerate(flags) for u in ("ETF", "Stock")]
    got = {(r.k, r.Universe): r.f for r in spark.createDataFrame(rows, "k int, Universe string, ETF_Quality_Data_Flag string, " + fields).withColumn("f", scoring.risk_flags(True)).collect()}
    assert [got[k, "ETF"] for k in range(5)] == [[], ["ETF quality data incomplete"], ["ETF tracking error unavailable; using tracking difference"], ["ETF tracking disclosure unavailable from current AMFI feed"], []]
    assert all(not got[k, "Stock"] for k in range(5))


def test_volatility_at_the_money(spark):
    from barlake.sources import readers

    chain = '{"underlying": 10.5, "data": [{"strike": 10, "ce": 0.2, "pe": null}, {"strike": 11, "ce": 9, "pe": 9}, {"strike": 10, "ce": 0.1, "pe": 0.3}, {"strike": null, "ce": 5, "pe": 5}]}'
    rows = [("A", D(0), chain), ("B", D(0), '{"underlying": 1, "data": [{"strike": 1, "ce": 0, "pe": -1}]}'), ("C", D(0), "broken"), ("D", D(0), None), ("E", D(0), '{"underlying": 1, "data": []}')]
    got = {r.Symbol: (r.Strikes, r.IV) for r in readers.atm_iv(spark.createDataFrame(rows, "Symbol string, Date date, json string")).collect()}
    assert got == {"A": (2, 0.3), "B": (1, None)}


def test_evidence_holds_a_row_of_each_table(spark):
    import json

    from barlake.operators import changes

    cards = spark.createDataFrame([(D(0), "A", 1, None), (D(0), "B", 2, "x"), (D(1), "A", 1, "y")], "Date date, Symbol string, Place int, Sector string")
    sizes = spark.createDataFrame([("A", 0.5, None), ("A", 0.4, 7)], "Symbol string, Weight double, Shares int")
    flows = spark.createDataFrame([], "Symbol string, Net string")
    got = {(r.Date, r.Symbol): json.loads(r.Evidence) for r in changes.evidence_rows(cards, {"sizing": sizes, "flow": flows}).collect()}
    assert got == {(D(0), "A"): {"Place": 1, "Sector": None, "sizing": {"Weight": 0.4, "Shares": 7}, "flow": None}, (D(0), "B"): {"Place": 2, "Sector": "x", "sizing": None, "flow": None}, (D(1), "A"): {"Place": 1, "Sector": "y", "sizing": {"Weight": 0.4, "Shares": 7}, "flow": None}}


def test_evidence_computes_the_scores_once(spark, monkeypatch):
    from barlake.plans import queries, reports
    from barlake.sources.shared import shared_path

    paths = []
    monkeypatch.setattr(queries, "shared_path", lambda s, n: paths.append(n) or shared_path(s, n))
    assert reports.evidence_rows(spark, "/root/testdata/sf0.001").columns == ["Date", "Symbol", "Evidence"]
    assert paths.count("signals") == 1
