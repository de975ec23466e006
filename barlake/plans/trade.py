"""Registered queries of the trade plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators import scoring, tradeplan, validation
from barlake.plans import sql
from barlake.plans.queries import all_scores, r4, register, table

_ATR = f"""{sql.SCORES}, ta as (select *, case when ATR_14 > 0 then ATR_14 when Volatility_20D > 0 then Price * greatest(0.015::double, least(Volatility_20D / sqrt(252.0), 0.05::double)) else Price * 0.02 end as Plan_ATR,
  case when ATR_14 > 0 then 'ATR-based' when Volatility_20D > 0 then 'ATR missing; volatility fallback' else 'ATR missing; 2 pct price fallback' end as ATR_Basis from scores where Price > 0)"""


@register("atr_fallback", f"with {_ATR} select Symbol, Date, {sql.r4('Plan_ATR')}, ATR_Basis from ta")
def atr_fallback(spark, sf_dir):
    return tradeplan.atr_fallback(all_scores(spark, sf_dir, *scoring.PLANNED).where("Price > 0")).select("Symbol", "Date", *r4("Plan_ATR"), "ATR_Basis")


_ZONE = f"""{_ATR}, tz as (select *, case when Plan_ATR is null or Plan_ATR <= 0 then 0 when not Absolute_Momentum_Pass then 1 when RSI_14 >= 75 then 2 when RSI_14 >= 70 then 3 else 4 end as k from ta),
zone as (select *, case when k > 0 then greatest(0.0::double, Price + ([0.0, -1.0, -1.0, -0.75, -0.25])[k + 1]::double * Plan_ATR) end as Buy_Low, case when k > 0 then greatest(0.0::double, Price + ([0.0, -0.5, -0.5, -0.25, 0.1])[k + 1]::double * Plan_ATR) end as Buy_High from tz)"""


@register("buy_zone", f"with {_ZONE} select Symbol, Date, {sql.r4('Buy_Low', 'Buy_High')}, (['No buy zone; missing price/ATR', 'Failed momentum; only monitor deep pullback', 'Overbought; wait for deeper pullback', 'RSI elevated; pullback entry preferred', 'Near-current entry zone'])[k + 1] as Buy_Note from zone")
def buy_zone(spark, sf_dir):
    df = tradeplan.atr_fallback(all_scores(spark, sf_dir, *scoring.PLANNED).where("Price > 0"))
    return tradeplan.buy_zone(df).select("Symbol", "Date", *r4("Buy_Low", "Buy_High"), "Buy_Note")


#: Horizon in days whose verdict counts for the plan, as in the reference. Fixed value.
HORIZON = 10


def planned(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The trade plan of scored rows under the verdict of HORIZON; without one there is too little history."""
    own = verdicts.where(F.col("Horizon_Days") == HORIZON).agg(F.coalesce(F.first("Verdict"), F.lit("Insufficient History")).alias("Verdict"))
    return tradeplan.trade_plan(scoring.labels(scored).crossJoin(F.broadcast(own)), F.col("Verdict"))


def verdicts(spark, sf_dir, scored: DataFrame) -> DataFrame:
    """The verdict of HORIZON; horizons are judged each by itself. There is a scored row for each bar, with its price."""
    matured = validation.mature_signals(scored, scored.select("Symbol", "Date", "Price"), (HORIZON,))
    spreads = table(validation.spread_by_date(validation.assign_buckets(matured)), "spreads")
    return validation.verdict(validation.bayes_shrink(validation.spread_summary(spreads, validation.bootstrap_spread(spreads))))


def scored(spark, sf_dir) -> DataFrame:
    """What the plan and its verdict read of the scores, written once."""
    some = ("Opportunity_Rank", "Confidence_Adjusted_Score", "Final_Score", "Confidence_Score", "Opportunity_Score", "Safety_Score", "Score_Consistency_4W", "ETF_Quality_Score")
    base = ("Date", "Symbol", "Universe", "Opportunity_Eligible", "Absolute_Momentum_Pass", "RSI_14", "NAV", "TER", "AUM_Cr", "Tracking_Error", "Tracking_Difference", "Market_Regime")
    return table(all_scores(spark, sf_dir, *scoring.PLANNED, *scoring.MATURED).select(*base, *scoring.PLANNED, *scoring.MATURED, *some), "scores")


@register("trade_plan")
def trade_plan(spark, sf_dir):
    rows = scored(spark, sf_dir)
    plan = planned(rows, verdicts(spark, sf_dir, rows))
    return plan.select("Symbol", "Date", *r4("Stop", "Target_1", "Target_2", "Target_1_Pct", "Reward_Risk"), "Trade_Status")
