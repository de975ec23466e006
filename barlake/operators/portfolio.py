"""Portfolio inputs: styles, correlations, flows and deals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.frames import correlation, percent_rank, rows


def style_score(bars: DataFrame) -> DataFrame:
    """(Date, Symbol, Style_Score): mean of two returns and inverse volatility, each as (percentile - 0.5) * 2, over what there is."""
    w = Window.partitionBy("Symbol").orderBy("Date")
    past = lambda n: F.col("Close") / F.nullif(F.lag("Close", n).over(w), F.lit(0.0)) - 1
    df = bars.withColumns({"r21": past(21), "r63": past(63), "_r": past(1)})
    df = df.withColumn("iv", 1 / F.nullif(F.when(F.count("_r").over(rows(20)) >= 20, F.stddev_pop("_r").over(rows(20))), F.lit(0.0)))
    parts = {k: (percent_rank(F.col(k), "Date") - 0.5) * 2 for k in ("r21", "r63", "iv")}
    df = df.withColumns({f"p_{k}": v for k, v in parts.items()})
    some = F.array_compact(F.array("p_r21", "p_r63", "p_iv"))
    return df.withColumn("Style_Score", F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(some), F.lit(0))).where("Style_Score is not null").select("Date", "Symbol", "Style_Score")


def pairwise_corr(bars: DataFrame, picks: DataFrame, window: int = 60) -> DataFrame:
    """(Symbol_A, Symbol_B, corr): correlation of the last `window` returns of the picked symbols, pairs in order, null as 0.

    Only the picks' returns meet, by date; a pick list of n symbols gives n * n / 2 pairs a date.
    """
    w = Window.partitionBy("Symbol").orderBy("Date")
    df = bars.join(F.broadcast(picks.select("Symbol").distinct()), "Symbol", "left_semi").withColumn("ret", F.col("Close") / F.lag("Close").over(w) - 1)
    last = F.row_number().over(Window.partitionBy("Symbol").orderBy(F.col("Date").desc()))
    df = df.withColumn("_k", last).where((F.col("_k") <= window) & F.col("ret").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("Symbol"))).where(F.col("_n") >= max(10, window // 2))
    a = df.select("Date", F.col("Symbol").alias("Symbol_A"), F.col("ret").alias("ra"))
    b = df.select("Date", F.col("Symbol").alias("Symbol_B"), F.col("ret").alias("rb"))
    both = a.join(b, "Date").where("Symbol_A < Symbol_B")
    return both.groupBy("Symbol_A", "Symbol_B").agg(F.coalesce(correlation("ra", "rb"), F.lit(0.0)).alias("corr"))


def flow_regime(flows: DataFrame, n: int = 5, at: float = 500.0) -> DataFrame:
    """(Date, FII_Net_5D, DII_Net_5D, FII_Regime): sums over the last n rows, for every date. One row a date."""
    w = Window.partitionBy(F.lit(1)).orderBy("Date").rowsBetween(1 - n, 0)
    df = flows.withColumns({"FII_Net_5D": F.sum("FII_Net").over(w), "DII_Net_5D": F.sum("DII_Net").over(w)})
    label = F.when(F.col("FII_Net_5D") > at, "Net_Buying").when(F.col("FII_Net_5D") < -at, "Net_Selling").otherwise("Mixed")
    return df.select("Date", "FII_Net_5D", "DII_Net_5D", label.alias("FII_Regime"))


def bulk_deal_net(deals: DataFrame, as_of: str, days: int = 30, at: float = 0.5, unit: float = 1e7) -> DataFrame:
    """(Symbol, Buy_Value, Sell_Value, N_Deals, Net_Flag) of the `days` up to as_of; values in units of `unit`."""
    recent = deals.where((F.col("Date") >= F.date_sub(F.lit(as_of).cast("date"), days)) & F.col("Symbol").isNotNull())
    value, side = F.col("Qty") * F.col("Price") / unit, F.upper(F.substring("Buy_Sell", 1, 1))
    agg = recent.groupBy("Symbol").agg(F.coalesce(F.sum(F.when(side == "B", value)), F.lit(0.0)).alias("Buy_Value"), F.coalesce(F.sum(F.when(side == "S", value)), F.lit(0.0)).alias("Sell_Value"), F.count(F.lit(1)).alias("N_Deals"))
    gap = F.col("Buy_Value") - F.col("Sell_Value")
    return agg.withColumn("Net_Flag", F.when(gap > at, "Buy").when(gap < -at, "Sell").otherwise("None"))


def flow_confirmation(picks: DataFrame, deals: DataFrame, regime: str) -> DataFrame:
    """(Symbol, Institutional_Confirmation): Yes, No, Mixed or Unknown from the symbol's deals and the flow regime."""
    flag = F.coalesce("Net_Flag", F.lit("Unknown"))
    r = F.lit(regime)
    label = F.when((flag == "Buy") & (r == "Net_Buying"), "Yes").when((flag == "Sell") | (r == "Net_Selling"), "No").when((flag == "Unknown") & (r == "Unknown"), "Unknown").otherwise("Mixed")
    return picks.select("Symbol").join(deals, "Symbol", "left").select("Symbol", label.alias("Institutional_Confirmation"))


def avg_abs_offdiag(corr: DataFrame) -> DataFrame:
    """(Pairs, Avg_Abs_Corr) of correlations of pairs."""
    return corr.agg(F.count(F.lit(1)).alias("Pairs"), F.avg(F.abs("corr")).alias("Avg_Abs_Corr"))
