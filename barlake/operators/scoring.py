"""Cross-sectional scores and ranks, for every date at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.frames import clip, flag
from barlake.functions.ranks import Keep, score, share, with_ranks

#: Score weights by kind of instrument. Fixed values.
STOCK_WEIGHTS = {"Opportunity_Score": 0.50, "Safety_Score": 0.35, "Score_Consistency_4W": 0.05, "Market_Regime_Score": 0.10}
ETF_WEIGHTS = {"Opportunity_Score": 0.42, "Safety_Score": 0.25, "ETF_Quality_Score": 0.18, "Score_Consistency_4W": 0.05, "Market_Regime_Score": 0.10}
#: Thresholds of the rules. Fixed values.
PASS_21D, LEAST_5D, NAV_PREMIUM_MAX, TER_GOOD, TRACKING_GOOD, AUM_GOOD = 0.0, -0.02, 0.02, 0.005, 0.02, 100.0
OVERBOUGHT, OVERSOLD, MAX_VOL_STOCK, MAX_VOL_ETF, MAX_DRAWDOWN = 75, 30, 0.60, 0.70, -0.20
FAILED_CAP = 64.9


def is_etf() -> Column:
    return F.lower(F.coalesce("Universe", F.lit(""))) == "etf"


def etf_quality_join(df: DataFrame, quality: DataFrame) -> DataFrame:
    """Fund data by symbol; the price's premium over the net asset value, here a fixed gap from the price."""
    df = df.join(quality, "Symbol", "left").withColumn("NAV", F.col("Price") * (1 + F.col("NAV_Gap")))
    return df.withColumn("NAV_Premium_Discount", F.col("Price") / F.nullif(F.col("NAV"), F.lit(0.0)) - 1)


def absolute_momentum() -> Column:
    """Both returns reach their thresholds and the price lies above its mean of 20 or 50; a missing return fails."""
    above = F.coalesce("Above_20DMA", F.lit(False)) | F.coalesce("Above_50DMA", F.lit(False))
    return (F.coalesce("Return_21D", F.lit(-999.0)) >= PASS_21D) & (F.coalesce("Return_5D", F.lit(-999.0)) >= LEAST_5D) & above


def threshold_score(ranks: str, x: Column, good: float, higher_is_better: bool) -> Column:
    """Percentile score, raised to 75 where x meets its threshold."""
    p = score(ranks, higher_is_better)
    return F.when((x >= good) if higher_is_better else (x <= good), F.greatest(p, F.lit(75.0))).otherwise(p)


#: Columns beside the ranked ones that scores and ranks are made of.
BASE = (
    "Date", "Symbol", "Universe", "Universe_Group", "Opportunity_Eligible", "Absolute_Momentum_Pass", "Trend_Score", "RSI_14", "Mapping_Status", "NAV", "TER", "AUM_Cr",
    "Tracking_Error", "Tracking_Difference", "Market_Regime", "Market_Regime_Score",
)
#: What labels, the trade plan, the shadow score and maturation read of the scored rows besides.
LABELLED = ("Volatility_20D", "Current_Drawdown_60D", "Zero_Volume_Days_60D", "Above_20DMA", "Above_50DMA", "NAV_Premium_Discount")
PLANNED = (*LABELLED, "Price", "ATR_14")
SHADOWED = ("Return_5D", "Return_21D", "Return_63D", "Volatility_20D", "Price", "MA_50D", "MA_200D", "Benchmark_Return_21D", "Current_Drawdown_60D")
MATURED = ("Avg_Traded_Value_20D",)


def official_score(df: DataFrame, keep: Keep) -> DataFrame:
    """Component scores, final and confidence-adjusted score of every symbol at every date.

    Needs the signals, the instrument's columns, the fund columns, Market_Regime(_Score) and Score_Consistency_4W (null: 50). keep(df, name) writes a table and returns it.
    """
    return final_score(component_scores(df, keep))


#: Component -> the column that it ranks.
RANKED = {
    "_momentum": "Momentum_Raw", "_strength": "Relative_Strength_21D", "_vol": "Volatility_20D", "_dd": "Current_Drawdown_60D", "_mdd": "Max_Drawdown_60D", "_zero": "Zero_Volume_Days_60D",
    "_liq": "Avg_Traded_Value_20D", "_nav": "_premium", "_aum": "AUM_Cr", "_ter": "TER", "_te": "_tracking",
}


def component_scores(df: DataFrame, keep: Keep, columns: Iterable[str] | None = None, most: int | None = None, shadowed: bool = False) -> DataFrame:
    """All scores that the final score is blended from, but for consistency. The rows are written once; their components are ranked in one pass, by date.

    columns: what of df is asked for besides the columns that scores are made of; where it is given, nothing else is written and returned. most: as in with_ranks.
    shadowed: with what shadow_score and shadow_frame add to a row, ranked in the same pass; df has SHADOWED, and columns name them.
    """
    z = F.lit(0.0)
    raw = 0.25 * F.coalesce("Return_5D", z) + 0.45 * F.coalesce("Return_21D", z) + 0.30 * F.coalesce("Return_63D", z)
    trend = 20 * flag(F.col("Above_10DMA")) + 25 * flag(F.col("Above_20DMA")) + 30 * flag(F.col("Above_50DMA")) + 25 * flag(F.col("MA_20D") > F.col("MA_50D"))
    df = df.withColumns(
        {
            "Absolute_Momentum_Pass": absolute_momentum(),
            "Momentum_Raw": raw,
            "Trend_Score": trend,
            "_tracking": F.coalesce("Tracking_Error", F.abs("Tracking_Difference")),
            "_premium": F.abs("NAV_Premium_Discount"),
        }
    )
    passed = df.columns
    if columns is not None:
        passed = [c for c in df.columns if c in {*BASE, "_tracking", "_premium", *columns}]
        df = df.select(*passed, *(c for c in RANKED.values() if c not in passed))
    ranked = {k: F.col(c) for k, c in RANKED.items()} | ({"_m": risk_adjusted_momentum()} if shadowed else {})
    df = with_ranks(keep(df, "signals"), ranked, keep, most, passed)
    if shadowed:
        df = _shadow_columns(df, "_m", "_vol").withColumn("Neutral_Inputs", neutral_inputs())
    df = df.withColumns(
        {
            "Momentum_Score": score("_momentum", True), "Relative_Strength_Score": score("_strength", True), "_vol": score("_vol", False), "_dd": score("_dd", True), "_mdd": score("_mdd", True),
            "_zero": score("_zero", False), "_liq": score("_liq", True), "_nav": threshold_score("_nav", F.col("_premium"), NAV_PREMIUM_MAX, False),
            "_aum": threshold_score("_aum", F.col("AUM_Cr"), AUM_GOOD, True), "_ter": threshold_score("_ter", F.col("TER"), TER_GOOD, False), "_te": threshold_score("_te", F.col("_tracking"), TRACKING_GOOD, False),
        }
    )
    penalty = F.when(F.col("RSI_14") > OVERBOUGHT, 25.0).when(F.col("RSI_14") < OVERSOLD, 10.0).otherwise(0.0)
    trust = F.when(F.col("Mapping_Status") == "Verified", 1.0).when(F.col("Mapping_Status") == "Suggested", 0.75).otherwise(0.5)
    te = F.when(F.col("Tracking_Error").isNull() & F.col("Tracking_Difference").isNotNull(), F.col("_te") * 0.85).otherwise(F.col("_te"))
    fund = clip((0.30 * F.col("_nav") + 0.25 * F.col("_aum") + 0.25 * F.col("_ter") + 0.20 * te) * trust, 0, 100)
    df = df.withColumns(
        {
            "Opportunity_Score": clip(0.40 * F.col("Momentum_Score") + 0.35 * F.col("Trend_Score") + 0.25 * F.col("Relative_Strength_Score"), 0, 100),
            "Liquidity_Score": clip(0.80 * F.col("_liq") + 0.20 * F.col("_zero"), 0, 100),
            "Risk_Score": clip(0.50 * F.col("_vol") + 0.35 * F.col("_dd") + 0.15 * F.col("_mdd") - penalty, 0, 100),
            "ETF_Quality_Score": F.when(is_etf(), fund).otherwise(100.0),
            "Confidence_Score": confidence(),
        }
    ).withColumn("Safety_Score", clip(0.70 * F.col("Risk_Score") + 0.30 * F.col("Liquidity_Score"), 0, 100))
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def final_score(df: DataFrame) -> DataFrame:
    """Final_Score and Confidence_Adjusted_Score of rows with component scores; Score_Consistency_4W counts as 50 where it is null."""
    df = df.withColumn("Score_Consistency_4W", F.coalesce("Score_Consistency_4W", F.lit(50.0)))
    blend = lambda w: sum((F.lit(v) * F.col(k) for k, v in w.items()), F.lit(0.0))
    final = F.when(is_etf(), blend(ETF_WEIGHTS)).otherwise(blend(STOCK_WEIGHTS))
    final = clip(F.when(F.col("Absolute_Momentum_Pass"), final).otherwise(F.least(final, F.lit(FAILED_CAP))), 0, 100)
    return df.withColumns({"Final_Score": final, "Confidence_Adjusted_Score": clip(final * F.col("Confidence_Score") / 10, 0, 100)})


def scored_with_consistency(df: DataFrame, keep: Keep, columns: Iterable[str] | None = None, most: int | None = None, shadowed: bool = False) -> DataFrame:
    """Scores whose consistency comes from the scores of the 28 days before, those taken with the default of 50. columns, most, shadowed: as in component_scores."""
    first = final_score(component_scores(df, keep, columns, most, shadowed).withColumn("Score_Consistency_4W", F.lit(None).cast("double")))
    return final_score(first.withColumn("Score_Consistency_4W", consistency_score(F.col("Confidence_Adjusted_Score"))))


def confidence() -> Column:
    """10 less what is missing or adverse, between 1 and 10."""
    less = lambda cond, by: F.when(F.coalesce(cond, F.lit(False)), by).otherwise(0.0)
    gone = lambda c: F.col(c).isNull()
    etf = is_etf()
    total = (
        less(etf & gone("NAV"), 1.5) + less(etf & gone("AUM_Cr"), 1.0) + less(etf & gone("TER"), 1.0)
        + less(etf & gone("Tracking_Error") & gone("Tracking_Difference"), 1.0) + less(etf & gone("Tracking_Error") & ~gone("Tracking_Difference"), 0.25)
        + less(etf & F.coalesce("Mapping_Status", F.lit("")).isin("Review", "Missing", ""), 1.5)
        + less(F.col("Market_Regime") == "Risk-Off", 1.0) + less(F.col("RSI_14") > OVERBOUGHT, 1.0)
    )
    return clip(10 - total, 1, 10)


def _data_rules(told: bool) -> tuple:
    """What a fund's data lack: as the flag of its sources says, of which the first kind counts, or from the fields themselves where there is no such flag."""
    etf, gone = is_etf(), lambda c: F.col(c).isNull()
    known = ("ETF quality data incomplete", "ETF tracking error unavailable; using tracking difference", "ETF tracking disclosure unavailable from current AMFI feed")
    if not told:
        lacking = gone("NAV") | gone("AUM_Cr") | gone("TER") | (gone("Tracking_Error") & gone("Tracking_Difference"))
        return (etf & lacking, known[0]), (etf & ~lacking & gone("Tracking_Error"), known[1])
    said = lambda text: F.contains(F.lower(F.coalesce("ETF_Quality_Data_Flag", F.lit(""))), F.lit(text))
    lacking = said("nav missing") | said("aum missing") | said("ter missing") | said("tracking quality metric missing")
    other = said("tracking error unavailable") & said("tracking difference available")
    return (etf & lacking, known[0]), (etf & ~lacking & other, known[1]), (etf & ~lacking & ~other & said("tracking disclosure unavailable"), known[2])


def risk_flags(told: bool = False) -> Column:
    """The rules that apply, in order, as an array; joined by `; ` for display, `Clean` where none applies. told: whether rows have ETF_Quality_Data_Flag."""
    ineligible = F.lower(F.coalesce("Opportunity_Eligible", F.lit("Yes"))) == "no"
    etf = is_etf()
    rules = (
        (ineligible, "Parking/debt ETF - excluded from opportunity ranking"),
        (~F.coalesce("Absolute_Momentum_Pass", F.lit(False)), "Absolute momentum filter failed"),
        (F.col("Volatility_20D") > F.when(etf, MAX_VOL_ETF).otherwise(MAX_VOL_STOCK), "High volatility"),
        (F.col("Current_Drawdown_60D") < MAX_DRAWDOWN, "High drawdown"),
        (F.col("Zero_Volume_Days_60D") >= 5, "Illiquid/zero-volume days"),
        (~F.col("Above_20DMA") & ~F.col("Above_50DMA"), "Weak trend"),
        (F.col("RSI_14") > OVERBOUGHT, "Overbought RSI"),
        (etf & (F.abs("NAV_Premium_Discount") > NAV_PREMIUM_MAX), "High NAV premium/discount"),
        *_data_rules(told),
    )
    return F.array_compact(F.array(*(F.when(cond, F.lit(text)) for cond, text in rules)))


def labels(df: DataFrame) -> DataFrame:
    """Risk_Flag, Bucket, Reason and Key_Risk of scored rows."""
    df = df.withColumn("Risk_Flags", risk_flags("ETF_Quality_Data_Flag" in df.columns))
    df = df.withColumn("Risk_Flag", F.when(F.size("Risk_Flags") == 0, "Clean").otherwise(F.array_join("Risk_Flags", "; ")))
    parked = F.lower(F.coalesce("Opportunity_Eligible", F.lit("Yes"))) == "no"
    s, clean = F.col("Final_Score"), F.col("Risk_Flag") == "Clean"
    bucket = (
        F.when(parked, "Parking / Not Opportunity").when(~F.col("Absolute_Momentum_Pass"), "Avoid")
        .when((s >= 80) & clean & (F.col("Confidence_Score") >= 7), "Top Candidate")
        .when((s >= 75) & ~clean, "High Potential but Risky").when(s >= 65, "Candidate").when(s >= 55, "Watch").otherwise("Avoid")
    )
    said = lambda pairs: F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in pairs)))
    why = said(
        (
            (~F.col("Absolute_Momentum_Pass"), "failed absolute momentum filter"),
            (F.col("Opportunity_Score") >= 70, "strong opportunity score"),
            (F.col("Safety_Score") >= 70, "strong safety/liquidity profile"),
            (F.col("Score_Consistency_4W") >= 65, "recent score consistency"),
            ((F.col("ETF_Quality_Score") >= 70) & is_etf(), "acceptable ETF quality score"),
            (F.col("Market_Regime") == "Risk-On", "supportive market regime"),
        )
    )
    parking = "parking/debt ETF; useful for cash parking, not short-term high-return opportunity"
    reason = F.when(parked, parking).when(F.size(why) == 0, "mixed signals; review before action").otherwise(F.array_join(why, ", "))
    risks = said(((F.col("Confidence_Score") < 7, "lower confidence due to missing data"), (F.col("RSI_14") > OVERBOUGHT, "overbought RSI"), (F.col("Volatility_20D") > 0.35, "elevated volatility")))
    key = F.when(~clean, F.col("Risk_Flag")).when(F.size(risks) == 0, "No major technical risk flagged").otherwise(F.array_join(risks, "; "))
    return df.withColumns({"Bucket": bucket, "Reason": reason, "Key_Risk": key})


def official_rank(df: DataFrame) -> DataFrame:
    """Rank, Group_Rank and Opportunity_Rank by confidence-adjusted score, then symbol; Raw_Score_Rank by final score."""
    score = F.round("Confidence_Adjusted_Score", 10)
    order = (score.desc_nulls_last(), F.col("Symbol"))
    eligible = F.lower(F.trim(F.coalesce("Opportunity_Eligible", F.lit("")))) == "yes"
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    raw = F.row_number().over(Window.partitionBy("Date").orderBy(F.round("Final_Score", 10).desc_nulls_last(), "Symbol")).cast("long")
    df = df.repartition("Date").withColumn("_eligible", eligible)  # serves all four orders, and others by date after them
    return df.withColumns(
        {"Rank": place("Date"), "Group_Rank": place("Date", "Universe_Group"), "Opportunity_Rank": F.when(F.col("_eligible"), place("Date", "_eligible")), "Raw_Score_Rank": raw}
    ).drop("_eligible")


def canonical_order(df: DataFrame) -> Column:
    """Place within a date: valid positive opportunity ranks first, then by score and symbol."""
    valid = F.col("Opportunity_Rank") > 0
    order = (F.coalesce(valid, F.lit(False)).desc(), F.when(valid, F.col("Opportunity_Rank")).asc_nulls_last(), F.round("Confidence_Adjusted_Score", 10).desc_nulls_last(), F.col("Symbol"))
    return F.row_number().over(Window.partitionBy("Date").orderBy(*order)).cast("long")


def top_official(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n eligible rows of each date in canonical order."""
    eligible = df.where(F.lower(F.trim("Opportunity_Eligible")) == "yes")
    return eligible.withColumn("Place", canonical_order(eligible)).where(F.col("Place") <= n)


def rank_changes(df: DataFrame) -> DataFrame:
    """Rank and score against the symbol's row before."""
    w = Window.partitionBy("Symbol").orderBy("Date")
    df = df.withColumns({"Previous_Rank": F.lag("Rank").over(w), "Previous_Score": F.lag("Confidence_Adjusted_Score").over(w)})
    return df.withColumns({"Rank_Change": F.col("Previous_Rank") - F.col("Rank"), "Score_Change": F.col("Confidence_Adjusted_Score") - F.col("Previous_Score")})


def _days_before(days: int):
    return Window.partitionBy("Symbol").orderBy(F.unix_date("Date")).rangeBetween(-days, -1)


def consistency_score(s: Column) -> Column:
    """Mean less 1.5 deviations of the score over the 28 days before, 50 where there is none."""
    w = _days_before(28)
    return F.coalesce(clip(F.avg(s).over(w) - 1.5 * F.coalesce(F.stddev_samp(s).over(w), F.lit(0.0)), 0, 100), F.lit(50.0))


def consistency(scores: DataFrame, score: str = "Confidence_Adjusted_Score") -> DataFrame:
    """By symbol and date: mean, change and consistency of the score over the 28 days before, times in the top 25 over 56 days."""
    s, w = F.col(score), _days_before(28)
    return scores.withColumns(
        {
            "Score_Mean_4W": F.avg(s).over(w),
            "Score_Change_4W": F.last(s).over(w) - F.first(s).over(w),
            "Score_Consistency_4W": consistency_score(s),
            "Top25_Count_8W": F.coalesce(F.sum(F.when(F.col("Rank") <= 25, 1).otherwise(0)).over(_days_before(56)), F.lit(0)).cast("long"),
        }
    )


def blended_momentum() -> Column:
    """Mean of the returns that there are, by weight."""
    parts = ((0.20, "Return_5D"), (0.50, "Return_21D"), (0.30, "Return_63D"))
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for w, c in parts), F.lit(0.0))
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for w, c in parts), F.lit(0.0)) / F.nullif(total, F.lit(0.0))


def risk_adjusted_momentum() -> Column:
    return blended_momentum() / F.when(F.col("Volatility_20D") > 0.02, F.col("Volatility_20D")).otherwise(0.02)


def neutral_inputs() -> Column:
    """The inputs that a row lacks."""
    return F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in ("Return_5D", "Return_21D", "Return_63D", "Volatility_20D", "MA_200D")))


def shadow_score(df: DataFrame, keep: Keep, most: int | None = None) -> DataFrame:
    """Opportunity score of the shadow model: momentum by volatility, ranked, with trend and strength factors and penalties. most: as in with_ranks."""
    df = df.withColumns({"Blended_Momentum": blended_momentum(), "Risk_Adj_Momentum": risk_adjusted_momentum()})
    df = with_ranks(df, {"_m": F.col("Risk_Adj_Momentum"), "_v": F.col("Volatility_20D")}, keep, most)
    return _shadow_columns(df, "_m", "_v").drop("_m", "_v")


def _shadow_columns(df: DataFrame, momentum: str, volatility: str) -> DataFrame:
    """df with the shadow score, from the ranks of both."""
    df = df.withColumns({"Momentum_Pctile": share(momentum) * 100, "Vol_Pctile": share(volatility) * 100})
    trend = F.when((F.col("Price") >= F.col("MA_50D")) & (F.col("MA_200D").isNull() | (F.col("Price") >= F.col("MA_200D"))), 1.0).otherwise(0.85)
    strong = F.when(F.col("Return_21D") >= F.col("Benchmark_Return_21D"), 1.0).otherwise(0.90)
    penalty = (
        F.coalesce(F.col("Vol_Pctile") / 100 * 15, F.lit(0.0))
        + F.coalesce(F.least(F.abs("Current_Drawdown_60D") * 100, F.lit(1.0)) * 7.5, F.lit(0.0))
        + F.when(F.col("RSI_14") >= 75, 12.0).otherwise(0.0)
    )
    base = F.when(F.col("Momentum_Pctile").isNotNull(), clip(F.col("Momentum_Pctile") * trend * strong - penalty, 0, 100))
    cap = F.when(F.col("Return_21D").isNull() | (F.col("Return_21D") <= 0), 49.9).when(F.col("Return_5D") <= -0.08, 59.9).otherwise(100.0)
    return df.withColumn("Shadow_Score", F.when(base.isNotNull(), F.least(base, cap)))


def fundamental_blend(df: DataFrame, weight: float = 0.15, least_coverage: float = 0.60) -> DataFrame:
    """The shadow score mixed with a fundamental score, unless the row is a fund, lacks one, or has too few fields."""
    keep = is_etf() | F.col("Fundamental_Score").isNull() | (F.coalesce("Fundamental_Coverage", F.lit(1.0)) < least_coverage)
    return df.withColumn("Blended_Score", F.when(keep, F.col("Shadow_Score")).otherwise((1 - weight) * F.col("Shadow_Score") + weight * F.col("Fundamental_Score")))


def sector_neutralize(df: DataFrame, factor: str, least: int = 5) -> DataFrame:
    """Z-scores within the date's sectors of at least `least` members, other rows raw, then z-scores over the date."""
    x = F.col(factor)
    z = lambda v, w: F.when(F.coalesce(F.stddev_pop(v).over(w), F.lit(0.0)) < 1e-12, F.when(v.isNotNull(), 0.0)).otherwise((v - F.avg(v).over(w)) / F.stddev_pop(v).over(w))
    sector, date = Window.partitionBy("Date", "Sector"), Window.partitionBy("Date")
    df = df.withColumns({"Sector_Members": F.count(x).over(sector), "_z": z(x, sector)})
    df = df.withColumn("_v", F.when(F.col("Sector_Members") >= least, F.col("_z")).otherwise(x))
    return df.withColumn("Neutral", z(F.col("_v"), date)).drop("_z", "_v")


def sector_rotation(df: DataFrame) -> DataFrame:
    """(Date, Sector, Sector_Return_21D, Excess_21D, Sector_Rank): sectors by their mean 21-row return against the benchmark."""
    agg = df.groupBy("Date", "Sector").agg(F.avg("Return_21D").alias("Sector_Return_21D"), F.avg("Benchmark_Return_21D").alias("_b")).where("Sector_Return_21D is not null")
    agg = agg.withColumn("Excess_21D", F.col("Sector_Return_21D") - F.col("_b")).drop("_b")
    order = Window.partitionBy("Date").orderBy(F.round("Excess_21D", 10).desc_nulls_last(), "Sector")
    return agg.withColumn("Sector_Rank", F.row_number().over(order).cast("long"))


def display_order(df: DataFrame, veto: DataFrame, column: str = "Confidence_Adjusted_Score") -> DataFrame:
    """(Date, Symbol, Place): rows with a numeric score that no veto (Symbol) excludes, by score, then symbol."""
    kept = df.where(F.col(column).try_cast("double").isNotNull()).join(veto.select("Symbol").distinct().hint("shuffle_hash"), "Symbol", "left_anti")
    order = Window.partitionBy("Date").orderBy(F.round(F.col(column).cast("double"), 10).desc(), "Symbol")
    return kept.select("Date", "Symbol", F.row_number().over(order).cast("long").alias("Place"))


#: Thresholds of the low-risk list. Fixed values.
LOW_RISK = {"Risk_Score": 65, "Final_Score": 60, "Return_21D": 0.0}


def ranked_views(df: DataFrame, n: int = 25) -> DataFrame:
    """(Date, View, Place, Symbol): the first n of seven lists of each date. df: labelled scores.

    All lists are cut in one pass: a row counts once in each list that it belongs to.
    """
    yes = F.lower(F.trim("Opportunity_Eligible")) == "yes"
    low = yes & (F.col("Bucket") != "Avoid")
    for name, least in LOW_RISK.items():
        low &= F.col(name) >= least
    review = is_etf() & (F.col("AUM_Cr").isNull() | F.col("TER").isNull() | F.col("NAV").isNull())
    lists = {"opportunities": yes, "etfs": yes & is_etf(), "stocks": yes & ~is_etf(), "low_risk": low, "quality_review": review, "parking": F.lower(F.trim("Opportunity_Eligible")) == "no", "avoid": F.col("Bucket") == "Avoid"}
    view = F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in lists.items()))))
    each = df.select("Date", "Symbol", view.alias("View"), "Confidence_Adjusted_Score", "Risk_Score")
    first = F.when(F.col("View") == "low_risk", F.round("Risk_Score", 10)).desc_nulls_last()
    order = Window.partitionBy("Date", "View").orderBy(first, F.round("Confidence_Adjusted_Score", 10).desc_nulls_last(), "Symbol")
    return each.withColumn("Place", F.row_number().over(order).cast("long")).where(F.col("Place") <= n).select("Date", "View", "Place", "Symbol")


def shadow_frame(df: DataFrame) -> DataFrame:
    """Shadow scores and ranks beside the official ones: V4_CAS, V4_Rank of eligible rows, the difference in rank, and inputs that were neutral.

    df: official scores with Shadow_Score; Neutral_Inputs is taken from it where it is there.
    """
    neutral = F.col("Neutral_Inputs") if "Neutral_Inputs" in df.columns else neutral_inputs()
    df = df.withColumns({"V4_CAS": F.col("Shadow_Score") * F.col("Confidence_Score") / 10, "Neutral_Inputs": neutral, "_e": F.lower(F.trim("Opportunity_Eligible")) == "yes"})
    order = Window.partitionBy("Date", "_e").orderBy(F.round("V4_CAS", 10).desc_nulls_last(), "Symbol")
    rank = F.when(F.col("_e"), F.row_number().over(order).cast("long"))
    return df.withColumn("V4_Rank", rank).withColumn("Rank_Delta", F.col("Opportunity_Rank") - F.col("V4_Rank")).drop("_e")
