"""Trade levels of scored rows, as column expressions over all dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of the flags that keep a row on watch. Fixed values.
SERIOUS = ("high drawdown", "high volatility", "illiquid", "low liquidity", "nav premium", "quality data incomplete", "elevated volatility")


def atr_fallback(df: DataFrame) -> DataFrame:
    """Plan_ATR and ATR_Basis: the mean true range, else a day's volatility between 1.5 and 5 % of the price, else 2 % of it."""
    p, a, v = F.col("Price"), F.col("ATR_14"), F.col("Volatility_20D")
    by_atr, by_vol = p.isNotNull() & (a > 0), p.isNotNull() & (v > 0)
    value = F.when(by_atr, a).when(by_vol, p * F.greatest(F.lit(0.015), F.least(v / F.sqrt(F.lit(252.0)), F.lit(0.05)))).otherwise(p * 0.02)
    basis = F.when(by_atr, "ATR-based").when(by_vol, "ATR missing; volatility fallback").when(p.isNotNull(), "ATR missing; 2 pct price fallback").otherwise("No price/ATR available")
    return df.withColumns({"Plan_ATR": value, "ATR_Basis": basis})


def buy_zone(df: DataFrame) -> DataFrame:
    """Buy_Low, Buy_High and Buy_Note around the price, deeper where momentum failed or the RSI is high."""
    p, a, rsi = F.col("Price"), F.col("Plan_ATR"), F.col("RSI_14")
    deep = ~F.coalesce("Absolute_Momentum_Pass", F.lit(False))
    case = F.when(p.isNull() | a.isNull() | (a <= 0), 0).when(deep, 1).when(rsi >= 75, 2).when(rsi >= 70, 3).otherwise(4)
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), case + 1)
    edge = lambda *xs: F.when(case > 0, F.greatest(F.lit(0.0), p + pick(0.0, *xs) * a))
    notes = ("No buy zone; missing price/ATR", "Failed momentum; only monitor deep pullback", "Overbought; wait for deeper pullback", "RSI elevated; pullback entry preferred", "Near-current entry zone")
    return df.withColumns({"Buy_Low": edge(-1.0, -1.0, -0.75, -0.25), "Buy_High": edge(-0.5, -0.5, -0.25, 0.10), "Buy_Note": pick(*notes)})


def trade_status(verdict: Column) -> Column:
    """Avoid, watch or review, by the first rule that applies."""
    text = F.lower(F.concat_ws(" ", "Risk_Flag", "Key_Risk"))
    serious = text.rlike("|".join(SERIOUS))
    return (
        F.when(F.lower(F.coalesce("Opportunity_Eligible", F.lit("Yes"))) != "yes", "Avoid for now - not opportunity eligible")
        .when(~F.coalesce("Absolute_Momentum_Pass", F.lit(False)), "Avoid for now - failed absolute momentum")
        .when(F.col("RSI_14") >= 75, "Watch only - overbought")
        .when(serious, "Watch only - risk flag present")
        .when(F.coalesce(verdict, F.lit("")) != "Validation Positive", "Watch only - validation not positive")
        .otherwise("Review - evidence gated")
    )


def trade_plan(df: DataFrame, verdict: Column) -> DataFrame:
    """Levels and state of every row with a price: stop, two targets, and what a round trip leaves of the first."""
    df = buy_zone(atr_fallback(df.where("Price > 0")))
    p, a = F.col("Price"), F.col("Plan_ATR")
    df = df.withColumns({"Stop": p - 1.5 * a, "Target_1": p + 1.5 * a, "Target_2": p + 2.5 * a})
    return df.withColumns({"Target_1_Pct": F.col("Target_1") / p - 1, "Reward_Risk": (F.col("Target_2") - p) / F.nullif(p - F.col("Stop"), F.lit(0.0)), "Trade_Status": trade_status(verdict)})


def hold_days(text: Column, momentum: Column) -> Column:
    """(low, high): the first two whole numbers of a text, the only one twice, else 5 to 15 days where momentum is 80 or more, else 10 to 30."""
    n = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"))
    pair = lambda a, b: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"))
    first = F.get(n, F.lit(0))
    return F.when(F.size(n) >= 2, pair(first, F.get(n, F.lit(1)))).when(F.size(n) == 1, pair(first, first)).when(momentum >= 80, pair(F.lit(5), F.lit(15))).otherwise(pair(F.lit(10), F.lit(30)))


def model_edge(summary: DataFrame) -> DataFrame:
    """(Horizon_Days, Edge_Pct_Per_Day): the mean spread by day in percent, only where the verdict is positive."""
    edge = F.when(F.col("Verdict") == "Validation Positive", F.col("Avg_Spread") / F.col("Horizon_Days") * 100)
    return summary.select("Horizon_Days", edge.alias("Edge_Pct_Per_Day"))


def official_top5(plan: DataFrame, n: int = 5) -> DataFrame:
    """(Date, Place, Symbol, Trade_Status): the first n rows of each date that are not to be avoided, in canonical order."""
    from barlake.operators.scoring import canonical_order

    kept = plan.where(~F.coalesce(F.col("Trade_Status"), F.lit("")).startswith("Avoid"))
    return kept.withColumn("Place", canonical_order(kept)).where(F.col("Place") <= n).select("Date", "Place", "Symbol", "Trade_Status")


def plan_views(plan: DataFrame, reviewable: int = 25, others: int = 100) -> DataFrame:
    """(Date, View, Place, Symbol): the first reviewable rows of each date, and the first of those to avoid or watch, by score."""
    view = F.when(F.col("Trade_Status").startswith("Review"), "review").otherwise("avoid_watch")
    order = Window.partitionBy("Date", "View").orderBy(F.round("Confidence_Adjusted_Score", 10).desc_nulls_last(), "Symbol")
    df = plan.withColumn("View", view).withColumn("Place", F.row_number().over(order).cast("long"))
    return df.where(F.col("Place") <= F.when(F.col("View") == "review", reviewable).otherwise(others)).select("Date", "View", "Place", "Symbol")
