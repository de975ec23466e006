"""The trade plan under the verdict that validation gives."""

import datetime as dt


def test_trade_plan_follows_the_computed_verdict(spark, monkeypatch):
    # imported here, as the package needs a session
    from barlake.plans import queries as plans
    from barlake.plans import trade

    row = ("A", dt.date(2024, 1, 1), 100.0, 2.0, 0.2, 50.0, "Yes", True, "Clean", "")
    scored = spark.createDataFrame([row], "Symbol string, Date date, Price double, ATR_14 double, Volatility_20D double, RSI_14 double, Opportunity_Eligible string, Absolute_Momentum_Pass boolean, Risk_Flag string, Key_Risk string")
    monkeypatch.setattr(trade, "all_scores", lambda *_: scored)
    monkeypatch.setattr(trade.scoring, "labels", lambda df: df)
    want = {("Validation Positive", 10): "Review - evidence gated", ("Validation Negative", 10): "Watch only - validation not positive", ("Validation Positive", 5): "Watch only - validation not positive"}
    for (verdict, days), status in want.items():
        monkeypatch.setattr(trade, "verdicts", lambda *_, v=verdict, d=days: spark.createDataFrame([(d, v)], "Horizon_Days int, Verdict string"), raising=False)
        assert [r.Trade_Status for r in plans.queries()["trade_plan"](spark, "").collect()] == [status]


def test_the_plan_matures_its_own_horizon_from_the_scored_rows(spark, monkeypatch):
    """What is matured are the rows of the plan's horizon that all horizons and the bars give; the lines are not read again."""
    from barlake import panel
    from barlake.operators import validation
    from barlake.plans import trade

    assign, data, got = validation.assign_buckets, "/root/testdata/sf0.001", []
    scored = trade.scored(spark, data)
    want = validation.mature_signals(scored, panel.bars(spark, data)).where(f"Horizon_Days = {trade.HORIZON}")
    monkeypatch.setattr(panel, "bars", None)
    monkeypatch.setattr(trade.validation, "assign_buckets", lambda m: got.append(m) or assign(m))
    trade.verdicts(spark, data, scored)
    assert want.count() and sorted(map(str, got[0].collect())) == sorted(map(str, want.collect()))
