"""Registered queries of the library's own operators, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake import panel
from barlake.functions import ranks
from barlake.operators import alphas, scoring, signals, validation
from barlake.plans import sql
from barlake.sources.shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, text: str | None = None):
    def add(f: Query) -> Query:
        _queries[name] = f
        if text:
            _sql[name] = text
        return f

    return add


def r4x(x) -> F.Column:
    return F.round(x + sql.NUDGE, 4)


def r4(*names: str) -> list:
    return [r4x(F.col(n)).alias(n) for n in names]


def sized_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """All signals, the benchmark, and the rows of the date that has most. Bars stay in their symbols' tasks from the lines to the signals; only the row a date is written."""
    b = panel.bars(spark, sf_dir)
    days = table(panel.sessions(b), "sessions")
    bench = days.select("Date", "Benchmark_Close")
    return signals.signals(b, bench), bench, days.agg(F.max("Symbols")).first()[0] or 0


def all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_signals(spark, sf_dir)[0]


def all_scores(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The scoring chain at every date: signals, instruments, fund data, regime, scores, ranks; of the signals the columns that scores are made of and those named."""
    return _all_scores(spark, sf_dir, columns, False)


def all_shadow_scores(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """all_scores with Shadow_Score and Neutral_Inputs, from one pass by date."""
    return _all_scores(spark, sf_dir, (*scoring.SHADOWED, *columns), True)


def _all_scores(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], shadowed: bool) -> DataFrame:
    df, bench, most = sized_signals(spark, sf_dir)
    df = df.join(panel.master(spark, sf_dir).hint("merge"), "Symbol", "left")
    df = scoring.etf_quality_join(df, panel.etf_quality(spark, sf_dir).hint("merge"))
    df = df.join(F.broadcast(signals.market_regime(bench)), "Date", "left")  # a row a date
    return scoring.official_rank(scoring.scored_with_consistency(df, table, columns, most, shadowed))


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is used more than once: lineage and plan end there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scores_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns named of all scores, written once."""
    return table(all_scores(spark, sf_dir, *columns).select("Date", "Symbol", *columns), "scores")


def _signal_query(name: str, *columns: str, exact: tuple[str, ...] = ()) -> None:
    out = ["Symbol", "Date", *exact]
    text = f"with {sql.SIGNALS} select {', '.join(out)}, {sql.r4(*columns)} from signals"
    register(name, text)(lambda spark, sf_dir: all_signals(spark, sf_dir).select(*out, *r4(*columns)))


_signal_query("returns", "Daily_Return", *(f"{k}_{n}D" for n in signals.HORIZONS for k in ("Return", "Benchmark_Return", "Relative_Strength")))
_signal_query("moving_averages", *(f"MA_{n}D_Hundreds" for n in signals.AVERAGES), exact=tuple(f"Above_{n}DMA" for n in signals.AVERAGES))
_signal_query("volatility", "Volatility_20D", "Volatility_60D")
_signal_query("drawdown", "Current_Drawdown_60D", "Max_Drawdown_60D", "Max_Drawdown_252D")
_signal_query("rsi", "RSI_14")
_signal_query("liquidity", "Traded_Lakh", "Avg_Traded_Lakh_20D", "Volume_Ratio_20D", "Zero_Volume_Days_60D")
_signal_query("beta", "Beta_252D")
_signal_query("atr_levels", "ATR_14", "ATR_Stop_Level", "ATR_Target_1", "ATR_Target_2", "Risk_Reward_Ratio_2")


@register("enrich_bars", f"with {sql.BARS}, {sql.MASTER} select Symbol, Date, round(Price + 0.00000137::double, 4) as Price, Name, Universe, Universe_Group, Sector, round(Benchmark_Close + 0.00000137::double, 4) as Benchmark_Close from bars left join master using (Symbol) left join bench using (Date)")
def enrich_bars(spark, sf_dir):
    b = panel.bars(spark, sf_dir)
    df = signals.enrich_bars(b, panel.master(spark, sf_dir), panel.benchmark(b))
    return df.select("Symbol", "Date", *r4("Price"), "Name", "Universe", "Universe_Group", "Sector", *r4("Benchmark_Close"))


@register("latest_rows", f"with {sql.SIGNALS} select Symbol, Date, History_Days, round(Price + 0.00000137::double, 4) as Price, round(RSI_14 + 0.00000137::double, 4) as RSI_14 from (select *, row_number() over (partition by Symbol order by Date desc) as k, count(*) over (partition by Symbol) as n from signals) where k = 1 and n >= 90")
def latest_rows(spark, sf_dir):
    return signals.latest_rows(all_signals(spark, sf_dir)).select("Symbol", "Date", "History_Days", *r4("Price", "RSI_14"))


@register("market_regime", f"with {sql.BARS}, {sql.REGIME} select Date, Market_Regime, Market_Regime_Score from regime")
def market_regime(spark, sf_dir):
    return signals.market_regime(panel.benchmark(panel.bars(spark, sf_dir)))


@register("breadth", f"with {sql.BARS}, x as (select Date, Price, {sql.rolling('avg(Price)', 'Price', 50, 50)} as ma from bars) select Date, round(avg(case when Price > ma then 1.0::double else 0.0 end) * 100 + 0.00000137::double, 4) as Breadth_Pct, count(*) as Symbols from x where ma is not null group by Date")
def breadth(spark, sf_dir):
    return signals.breadth(panel.bars(spark, sf_dir)).select("Date", *r4("Breadth_Pct"), "Symbols")


@register("percentile_score", f"with {sql.SIGNALS} select Symbol, Date, round({sql.ps('Return_21D', True, 'Date')} + 0.00000137::double, 4) as Up, round({sql.ps('Volatility_20D', False, 'Date')} + 0.00000137::double, 4) as Down from signals")
def percentile_score(spark, sf_dir):
    df, _, most = sized_signals(spark, sf_dir)
    return ranks.with_ranks(df, {"up": F.col("Return_21D"), "down": F.col("Volatility_20D")}, table, most, ("Date", "Symbol")).select("Symbol", "Date", r4x(ranks.score("up", True)).alias("Up"), r4x(ranks.score("down", False)).alias("Down"))


_SCORE = ("Momentum_Score", "Trend_Score", "Relative_Strength_Score", "Opportunity_Score", "Risk_Score", "Liquidity_Score", "Safety_Score", "ETF_Quality_Score", "Final_Score")


@register("official_score", f"with {sql.SCORES} select Symbol, Date, Absolute_Momentum_Pass, {sql.r4(*_SCORE)} from scores")
def official_score(spark, sf_dir):
    return all_scores(spark, sf_dir).select("Symbol", "Date", "Absolute_Momentum_Pass", *r4(*_SCORE))


@register("confidence_adjust", f"with {sql.SCORES} select Symbol, Date, {sql.r4('Confidence_Score', 'Confidence_Adjusted_Score')} from scores")
def confidence_adjust(spark, sf_dir):
    return all_scores(spark, sf_dir).select("Symbol", "Date", *r4("Confidence_Score", "Confidence_Adjusted_Score"))


@register("official_rank", f"with {sql.SCORES} select Symbol, Date, Rank, Group_Rank, Opportunity_Rank, Raw_Score_Rank from scores")
def official_rank(spark, sf_dir):
    return all_scores(spark, sf_dir).select("Symbol", "Date", "Rank", "Group_Rank", "Opportunity_Rank", "Raw_Score_Rank")


@register("top_official", f"with {sql.SCORES} select Symbol, Date, Opportunity_Rank as Place, round(Confidence_Adjusted_Score + 0.00000137::double, 4) as Confidence_Adjusted_Score from scores where elig and Opportunity_Rank <= 5")
def top_official(spark, sf_dir):
    return scoring.top_official(all_scores(spark, sf_dir)).select("Symbol", "Date", "Place", *r4("Confidence_Adjusted_Score"))


@register("rank_changes", f"with {sql.SCORES}, p as (select *, lag(Rank) over w as Previous_Rank, lag(Confidence_Adjusted_Score) over w as ps from scores window w as (partition by Symbol order by Date)) select Symbol, Date, Rank, Previous_Rank, Previous_Rank - Rank as Rank_Change, round(Confidence_Adjusted_Score - ps + 0.00000137::double, 4) as Score_Change from p")
def rank_changes(spark, sf_dir):
    return scoring.rank_changes(all_scores(spark, sf_dir)).select("Symbol", "Date", "Rank", "Previous_Rank", "Rank_Change", *r4("Score_Change"))


@register("risk_flags", f"""with {sql.SCORES}, f as (select *, list_filter([case when lower(Opportunity_Eligible) = 'no' then 'Parking/debt ETF - excluded from opportunity ranking' end, case when not Absolute_Momentum_Pass then 'Absolute momentum filter failed' end,
  case when Volatility_20D > (case when etf then 0.70 else 0.60 end) then 'High volatility' end, case when Current_Drawdown_60D < -0.20 then 'High drawdown' end, case when Zero_Volume_Days_60D >= 5 then 'Illiquid/zero-volume days' end,
  case when not Above_20DMA and not Above_50DMA then 'Weak trend' end, case when RSI_14 > 75 then 'Overbought RSI' end, case when etf and abs(NAV_Premium_Discount) > 0.02 then 'High NAV premium/discount' end,
  case when etf and (NAV is null or AUM_Cr is null or TER is null or (Tracking_Error is null and Tracking_Difference is null)) then 'ETF quality data incomplete' end,
  case when etf and NAV is not null and AUM_Cr is not null and TER is not null and Tracking_Error is null and Tracking_Difference is not null then 'ETF tracking error unavailable; using tracking difference' end], lambda x: x is not null) as fl from scores)
select Symbol, Date, case when len(fl) = 0 then 'Clean' else array_to_string(fl, '; ') end as Risk_Flag from f""")
def risk_flags(spark, sf_dir):
    return scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED)).select("Symbol", "Date", "Risk_Flag")


@register("buckets_reason_key_risk")
def buckets_reason_key_risk(spark, sf_dir):
    return scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED)).select("Symbol", "Date", "Bucket", "Reason", "Key_Risk")


_C4 = "over (partition by Symbol order by Date range between interval 28 day preceding and interval 1 day preceding)"
_C8 = "over (partition by Symbol order by Date range between interval 56 day preceding and interval 1 day preceding)"


@register("consistency", f"""with {sql.SCORES}, k as (select Symbol, Date, Rank, avg(Confidence_Adjusted_Score) {_C4} as m, coalesce(stddev_samp(Confidence_Adjusted_Score) {_C4}, 0) as sd, last_value(Confidence_Adjusted_Score) {_C4} - first_value(Confidence_Adjusted_Score) {_C4} as ch,
  coalesce(sum(case when Rank <= 25 then 1 else 0 end) {_C8}, 0)::bigint as Top25_Count_8W from scores)
select Symbol, Date, round(m + 0.00000137::double, 4) as Score_Mean_4W, round(ch + 0.00000137::double, 4) as Score_Change_4W, round(coalesce(least(greatest(m - 1.5 * sd, 0.0::double), 100.0::double), 50.0) + 0.00000137::double, 4) as Score_Consistency_4W, Top25_Count_8W from k""")
def consistency(spark, sf_dir):
    return scoring.consistency(all_scores(spark, sf_dir)).select("Symbol", "Date", *r4("Score_Mean_4W", "Score_Change_4W", "Score_Consistency_4W"), "Top25_Count_8W")


@register("shadow_score", f"""with {sql.SCORES}, h0 as (select *, (0.20 * coalesce(Return_5D, 0) + 0.50 * coalesce(Return_21D, 0) + 0.30 * coalesce(Return_63D, 0)) / nullif((case when Return_5D is not null then 0.2::double else 0 end) + (case when Return_21D is not null then 0.5::double else 0 end) + (case when Return_63D is not null then 0.3::double else 0 end), 0) as bm from scores),
h1 as (select *, bm / (case when Volatility_20D > 0.02 then Volatility_20D else 0.02 end) as ram from h0), h2 as (select *, {sql.pr('ram', 'Date')} * 100 as mp, {sql.pr('Volatility_20D', 'Date')} * 100 as vp from h1),
h3 as (select *, case when mp is not null then least(greatest(mp * (case when Price >= MA_50D and (MA_200D is null or Price >= MA_200D) then 1.0 else 0.85 end) * (case when Return_21D >= Benchmark_Return_21D then 1.0 else 0.9 end)
  - (coalesce(vp / 100 * 15, 0) + coalesce(least(abs(Current_Drawdown_60D) * 100, 1.0) * 7.5, 0) + (case when RSI_14 >= 75 then 12.0 else 0.0 end)), 0.0::double), 100.0::double) end as base from h2)
select Symbol, Date, round(mp + 0.00000137::double, 4) as Momentum_Pctile, round(vp + 0.00000137::double, 4) as Vol_Pctile, round(case when base is not null then least(base, case when Return_21D is null or Return_21D <= 0 then 49.9::double when Return_5D <= -0.08 then 59.9 else 100.0 end) end + 0.00000137::double, 4) as Shadow_Score from h3""")
def shadow_score(spark, sf_dir):
    df, _, most = sized_signals(spark, sf_dir)
    return scoring.shadow_score(df.select("Date", "Symbol", "RSI_14", *scoring.SHADOWED), table, most).select("Symbol", "Date", *r4("Momentum_Pctile", "Vol_Pctile", "Shadow_Score"))


@register("sector_rotation", f"with {sql.SCORES}, g as (select Date, Sector, avg(Return_21D) as s, avg(Benchmark_Return_21D) as b from scores group by 1, 2) select Date, Sector, round(s + 0.00000137::double, 4) as Sector_Return_21D, round(s - b + 0.00000137::double, 4) as Excess_21D, row_number() over (partition by Date order by round(s - b, 10) desc nulls last, Sector) as Sector_Rank from g where s is not null")
def sector_rotation(spark, sf_dir):
    df = all_signals(spark, sf_dir).join(panel.master(spark, sf_dir), "Symbol", "left")
    return scoring.sector_rotation(df).select("Date", "Sector", *r4("Sector_Return_21D", "Excess_21D"), "Sector_Rank")


for _name in alphas.REGISTRY:
    register(f"alpha_{_name}", sql.alpha(_name))(lambda spark, sf_dir, k=_name: alphas.alpha(panel.bars(spark, sf_dir), k).select("Date", "Symbol", *r4("value")))


@register("alpha_zoo", f"with {sql.PANEL}, z as (select Date, Symbol, {sql.pr('value', 'Date', 'alpha')} * 100 as p from panel) select Date, Symbol, round(avg(p) + 0.00000137::double, 4) as Zoo_Score, count(p) as Zoo_Coverage from z group by 1, 2")
def alpha_zoo(spark, sf_dir):
    wide = table(alphas.alpha_columns(panel.bars(spark, sf_dir)), "alphas")
    return alphas.zoo_columns(wide, tuple(alphas.REGISTRY), table, ranks.largest(wide)).select("Date", "Symbol", *r4("Zoo_Score"), "Zoo_Coverage")


def matured(spark, sf_dir):
    return validation.mature_signals(all_scores(spark, sf_dir, *scoring.MATURED), panel.bars(spark, sf_dir))


def _detail(spark, sf_dir):
    return validation.assign_buckets(matured(spark, sf_dir))


def _spreads(spark, sf_dir):
    return validation.spread_by_date(_detail(spark, sf_dir))


_RETURNS = ("Gross_Forward_Return", "Round_Trip_Cost", "Net_Forward_Return")


@register("mature_signals", f"with {sql.MATURED} select Symbol, Signal_Date, Horizon_Days, Entry_Date, Exit_Date, {sql.r4(*_RETURNS)}, Reason from matured")
def mature_signals(spark, sf_dir):
    return matured(spark, sf_dir).select("Symbol", "Signal_Date", "Horizon_Days", "Entry_Date", "Exit_Date", *r4(*_RETURNS), "Reason")


_SYM = ("Hit_Rate", "Avg_Net", "Median_Net", "Worst_Net", "Best_Net", "Avg_Gross", "Avg_Cost")


@register("per_symbol_summary", f"with {sql.MATURED} select Symbol, Horizon_Days, count(*) as Obs, round(avg(case when Net_Forward_Return > 0 then 1.0::double else 0.0 end) + 0.00000137::double, 4) as Hit_Rate, round(avg(Net_Forward_Return) + 0.00000137::double, 4) as Avg_Net, round(quantile_cont(Net_Forward_Return, 0.5) + 0.00000137::double, 4) as Median_Net, round(min(Net_Forward_Return) + 0.00000137::double, 4) as Worst_Net, round(max(Net_Forward_Return) + 0.00000137::double, 4) as Best_Net, round(avg(Gross_Forward_Return) + 0.00000137::double, 4) as Avg_Gross, round(avg(Round_Trip_Cost) + 0.00000137::double, 4) as Avg_Cost from matured where Net_Forward_Return is not null group by 1, 2")
def per_symbol_summary(spark, sf_dir):
    return validation.per_symbol_summary(matured(spark, sf_dir)).select("Symbol", "Horizon_Days", "Obs", *r4(*_SYM))


@register("maturation_progress", f"with {sql.MATURED} select Horizon_Days, count(Net_Forward_Return) as Matured, count(*) filter (Reason = 'Forward bar not available yet') as Pending, count(*) filter (Reason is not null and Reason != 'Forward bar not available yet') as Unmatchable, round(count(Net_Forward_Return) / count(*)::double + 0.00000137::double, 4) as Matured_Rate from matured group by 1")
def maturation_progress(spark, sf_dir):
    return validation.maturation_progress(matured(spark, sf_dir)).select("Horizon_Days", "Matured", "Pending", "Unmatchable", *r4("Matured_Rate"))


@register("assign_buckets", f"with {sql.DETAIL} select Symbol, Signal_Date, Horizon_Days, Score_Rank_On_Date, round(Score_Percentile_On_Date + 0.00000137::double, 4) as Score_Percentile_On_Date, Bucket_TopN, Score_Decile, Score_Quintile from detail")
def assign_buckets(spark, sf_dir):
    return _detail(spark, sf_dir).select("Symbol", "Signal_Date", "Horizon_Days", "Score_Rank_On_Date", *r4("Score_Percentile_On_Date"), "Bucket_TopN", "Score_Decile", "Score_Quintile")


_PERF = ("Avg_Net_Return", "Median_Net_Return", "Hit_Rate_Net", "Worst_Net_Return", "Best_Net_Return", "Std_Net_Return", "Avg_Gross_Return", "Avg_Cost", "Avg_Final_Score")


@register("bucket_performance", f"""with {sql.DETAIL}, e as (select Horizon_Days, unnest(['Score_Quintile', 'Score_Decile', 'Bucket_TopN', 'All']) as Bucket_Type, unnest(['Q' || Score_Quintile, 'D' || Score_Decile, Bucket_TopN, 'All Eligible']) as Bucket, Net_Forward_Return as x, Gross_Forward_Return as g, Round_Trip_Cost as c, Final_Score as f from detail)
select Horizon_Days, Bucket_Type, Bucket, count(x) as Obs, round(avg(x) + 0.00000137::double, 4) as Avg_Net_Return, round(quantile_cont(x, 0.5) + 0.00000137::double, 4) as Median_Net_Return, round(avg(case when x > 0 then 1.0::double else 0.0 end) + 0.00000137::double, 4) as Hit_Rate_Net, round(min(x) + 0.00000137::double, 4) as Worst_Net_Return, round(max(x) + 0.00000137::double, 4) as Best_Net_Return,
  round(stddev_samp(x) + 0.00000137::double, 4) as Std_Net_Return, round(avg(g) + 0.00000137::double, 4) as Avg_Gross_Return, round(avg(c) + 0.00000137::double, 4) as Avg_Cost, round(avg(f) + 0.00000137::double, 4) as Avg_Final_Score from e group by 1, 2, 3""")
def bucket_performance(spark, sf_dir):
    return validation.bucket_performance(_detail(spark, sf_dir), table).select("Horizon_Days", "Bucket_Type", "Bucket", "Obs", *r4(*_PERF))


_SPREAD = ("All_Avg", "Top_Quintile", "Bottom_Quintile", "Top10", "Top25", "TopMinusBottom", "Top10MinusAll", "Top25MinusAll")


@register("spread_by_date", f"with {sql.SPREADS} select Signal_Date, Horizon_Days, Obs_All, Obs_Top, Obs_Bottom, {sql.r4(*_SPREAD)} from spreads")
def spread_by_date(spark, sf_dir):
    return _spreads(spark, sf_dir).select("Signal_Date", "Horizon_Days", "Obs_All", "Obs_Top", "Obs_Bottom", *r4(*_SPREAD))


_BOOT = ("Boot_Mean", "Boot_P5", "Boot_P95", "Boot_Prob_Positive")


@register("bootstrap_spread", f"with {sql.BOOT} select Horizon_Days, {sql.r4(*_BOOT)} from boot")
def bootstrap_spread(spark, sf_dir):
    return validation.bootstrap_spread(_spreads(spark, sf_dir)).select("Horizon_Days", *r4(*_BOOT))


_SUMMARY = ("Gap_Days", "Overlap_Factor", "Effective_Dates", "Avg_Spread", "Median_Spread", "Std_Spread", "TStat", "Adjusted_TStat", "Hit_Rate", "Avg_Top10MinusAll", "Hit_Top10", "Avg_Top25MinusAll", "Hit_Top25", "Avg_Obs", *_BOOT)


def _summary(spark, sf_dir):
    s = table(_spreads(spark, sf_dir), "spreads")
    return validation.spread_summary(s, validation.bootstrap_spread(s))


@register("spread_summary", f"with {sql.SUMMARY} select Horizon_Days, Validation_Dates, {sql.r4(*_SUMMARY)} from summary")
def spread_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("Horizon_Days", "Validation_Dates", *r4(*_SUMMARY))


@register("verdict", f"with {sql.SUMMARY} select Horizon_Days, Shrunk_Hit, Shrunk_T, Shrunk_Spread, Verdict, Evidence_Grade from verdicts")
def verdict(spark, sf_dir):
    return validation.verdict(validation.bayes_shrink(_summary(spark, sf_dir))).select("Horizon_Days", "Shrunk_Hit", "Shrunk_T", "Shrunk_Spread", "Verdict", "Evidence_Grade")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
