"""Registered queries of labels, ranked lists, the trade plan, shadow comparison, fundamentals and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.functions import frames, ranks
from barlake.operators import changes, fundamentals, portfolio, scoring, signals, tradeplan, validation
from barlake.plans import sql, trade
from barlake.plans.more import AS_OF
from barlake.plans.queries import all_scores, all_shadow_scores, all_signals, matured, r4, r4x, register, scores_table, table

_JOIN = "array_to_string(list_filter([{}], lambda x: x is not null), '{}')"
LABELS = f"""lab0 as (select *, {_JOIN.format("case when lower(Opportunity_Eligible) = 'no' then 'Parking/debt ETF - excluded from opportunity ranking' end, case when not Absolute_Momentum_Pass then 'Absolute momentum filter failed' end, case when Volatility_20D > (case when etf then 0.70 else 0.60 end) then 'High volatility' end, case when Current_Drawdown_60D < -0.20 then 'High drawdown' end, case when Zero_Volume_Days_60D >= 5 then 'Illiquid/zero-volume days' end, case when not Above_20DMA and not Above_50DMA then 'Weak trend' end, case when RSI_14 > 75 then 'Overbought RSI' end, case when etf and abs(NAV_Premium_Discount) > 0.02 then 'High NAV premium/discount' end, case when etf and (NAV is null or AUM_Cr is null or TER is null or (Tracking_Error is null and Tracking_Difference is null)) then 'ETF quality data incomplete' end, case when etf and NAV is not null and AUM_Cr is not null and TER is not null and Tracking_Error is null and Tracking_Difference is not null then 'ETF tracking error unavailable; using tracking difference' end", '; ')} as fl from scores),
lab1 as (select *, case when fl = '' then 'Clean' else fl end as Risk_Flag, lower(Opportunity_Eligible) = 'no' as parked from lab0),
lab2 as (select *, case when parked then 'Parking / Not Opportunity' when not Absolute_Momentum_Pass then 'Avoid' when Final_Score >= 80 and Risk_Flag = 'Clean' and Confidence_Score >= 7 then 'Top Candidate' when Final_Score >= 75 and Risk_Flag != 'Clean' then 'High Potential but Risky'
  when Final_Score >= 65 then 'Candidate' when Final_Score >= 55 then 'Watch' else 'Avoid' end as Bucket,
  {_JOIN.format("case when not Absolute_Momentum_Pass then 'failed absolute momentum filter' end, case when Opportunity_Score >= 70 then 'strong opportunity score' end, case when Safety_Score >= 70 then 'strong safety/liquidity profile' end, case when Score_Consistency_4W >= 65 then 'recent score consistency' end, case when ETF_Quality_Score >= 70 and etf then 'acceptable ETF quality score' end, case when Market_Regime = 'Risk-On' then 'supportive market regime' end", ', ')} as why,
  {_JOIN.format("case when Confidence_Score < 7 then 'lower confidence due to missing data' end, case when RSI_14 > 75 then 'overbought RSI' end, case when Volatility_20D > 0.35 then 'elevated volatility' end", '; ')} as risks from lab1),
labels as (select *, case when parked then 'parking/debt ETF; useful for cash parking, not short-term high-return opportunity' when why = '' then 'mixed signals; review before action' else why end as Reason,
  case when Risk_Flag != 'Clean' then Risk_Flag when risks = '' then 'No major technical risk flagged' else risks end as Key_Risk from lab2)"""


@register("buckets_reason_key_risk", f"with {sql.SCORES}, {LABELS} select Symbol, Date, Bucket, Reason, Key_Risk from labels")
def buckets_reason_key_risk(spark, sf_dir):
    return scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED)).select("Symbol", "Date", "Bucket", "Reason", "Key_Risk")


PLAN = f"""{sql.SUMMARY}, {LABELS},
own as (select coalesce(max(Verdict), 'Insufficient History') as Verdict from verdicts where Horizon_Days = 10),
tp0 as (select l.*, own.Verdict, case when ATR_14 > 0 then ATR_14 when Volatility_20D > 0 then Price * greatest(0.015::double, least(Volatility_20D / sqrt(252.0), 0.05::double)) else Price * 0.02 end as Plan_ATR from labels l cross join own where Price > 0),
plan as (select *, Price - 1.5 * Plan_ATR as Stop, Price + 1.5 * Plan_ATR as Target_1, Price + 2.5 * Plan_ATR as Target_2, (Price + 1.5 * Plan_ATR) / Price - 1 as Target_1_Pct, (Price + 2.5 * Plan_ATR - Price) / nullif(Price - (Price - 1.5 * Plan_ATR), 0) as Reward_Risk,
  case when lower(coalesce(Opportunity_Eligible, 'Yes')) != 'yes' then 'Avoid for now - not opportunity eligible' when not Absolute_Momentum_Pass then 'Avoid for now - failed absolute momentum' when RSI_14 >= 75 then 'Watch only - overbought'
  when regexp_matches(lower(Risk_Flag || ' ' || Key_Risk), 'high drawdown|high volatility|illiquid|low liquidity|nav premium|quality data incomplete|elevated volatility') then 'Watch only - risk flag present' when Verdict != 'Validation Positive' then 'Watch only - validation not positive' else 'Review - evidence gated' end as Trade_Status from tp0)"""


def plan(spark, sf_dir):
    scored = trade.scored(spark, sf_dir)
    return trade.planned(scored, trade.verdicts(spark, sf_dir, scored))


_LEVELS = ("Stop", "Target_1", "Target_2", "Target_1_Pct", "Reward_Risk")
register("trade_plan", f"with {PLAN} select Symbol, Date, {sql.r4(*_LEVELS)}, Trade_Status from plan")(trade.trade_plan)
_CANON = "row_number() over (partition by Date order by (coalesce(Opportunity_Rank, 0) > 0) desc, case when Opportunity_Rank > 0 then Opportunity_Rank end asc nulls last, round(Confidence_Adjusted_Score, 10) desc nulls last, Symbol)"


@register("official_top5", f"with {PLAN}, k as (select *, {_CANON} as Place from plan where Trade_Status not like 'Avoid%') select Date, Place, Symbol, Trade_Status from k where Place <= 5")
def official_top5(spark, sf_dir):
    return tradeplan.official_top5(plan(spark, sf_dir))


@register("plan_views", f"""with {PLAN}, v as (select Date, Symbol, case when Trade_Status like 'Review%' then 'review' else 'avoid_watch' end as View, Confidence_Adjusted_Score from plan),
k as (select *, row_number() over (partition by Date, View order by round(Confidence_Adjusted_Score, 10) desc nulls last, Symbol) as Place from v) select Date, View, Place, Symbol from k where Place <= case when View = 'review' then 25 else 100 end""")
def plan_views(spark, sf_dir):
    return tradeplan.plan_views(plan(spark, sf_dir))


@register("model_edge", f"with {sql.SUMMARY} select Horizon_Days, {sql.r4x("case when Verdict = 'Validation Positive' then Avg_Spread / Horizon_Days * 100 end")} as Edge_Pct_Per_Day from verdicts")
def model_edge(spark, sf_dir):
    from barlake.plans.queries import _summary

    verdicts = validation.verdict(validation.bayes_shrink(_summary(spark, sf_dir)))
    return tradeplan.model_edge(verdicts).select("Horizon_Days", *r4("Edge_Pct_Per_Day"))


_NUM = "regexp_extract_all(p_name || ' ' || p_type || case when p_partkey % 3 = 0 then ' 7 to 21' when p_partkey % 3 = 1 then ' 12' else '' end, '\\d+')"


@register("hold_days", f"with n as (select p_partkey, {_NUM} as n, p_retailprice as m from part) select p_partkey, case when len(n) >= 1 then n[1]::bigint when m >= 1200 then 5 else 10 end as low, case when len(n) >= 2 then n[2]::bigint when len(n) = 1 then n[1]::bigint when m >= 1200 then 15 else 30 end as high from n")
def hold_days(spark, sf_dir):
    """Texts with two numbers, one and none; the retail price stands in for momentum, 1,200 for its 80."""
    p = panel.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    text = F.concat("p_name", F.lit(" "), "p_type", F.when(k == 0, " 7 to 21").when(k == 1, " 12").otherwise(""))
    return p.select("p_partkey", tradeplan.hold_days(text, F.col("p_retailprice") / 15).alias("h")).select("p_partkey", "h.*")


_VETO = f"veto as (select 'S' || user_id as Symbol from events where event_type in ('purchase', 'signup', 'error') group by 1 having sum(case when event_type = 'error' then -value else value end) < 0)"


def veto(spark, sf_dir):
    """Symbols of users whose errors outweigh their purchases and signups."""
    e = panel.table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    net = F.sum(F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")))
    return e.groupBy(panel.symbol("user_id").alias("Symbol")).agg(net.alias("net")).where("net < 0").select("Symbol")


@register("display_order", f"with {sql.SCORES}, {_VETO} select Date, Symbol, row_number() over (partition by Date order by round(Confidence_Adjusted_Score, 10) desc, Symbol) as Place from scores where Symbol not in (select Symbol from veto)")
def display_order(spark, sf_dir):
    return scoring.display_order(all_scores(spark, sf_dir), veto(spark, sf_dir))


@register("ranked_views", f"""with {sql.SCORES}, {LABELS},
v as (select Date, Symbol, Risk_Score, Confidence_Adjusted_Score, unnest(list_filter([case when elig then 'opportunities' end, case when elig and etf then 'etfs' end, case when elig and not etf then 'stocks' end, case when elig and Bucket != 'Avoid' and Risk_Score >= 65 and Final_Score >= 60 and Return_21D >= 0 then 'low_risk' end,
  case when etf and (AUM_Cr is null or TER is null or NAV is null) then 'quality_review' end, case when parked then 'parking' end, case when Bucket = 'Avoid' then 'avoid' end], lambda x: x is not null)) as View from labels),
k as (select *, row_number() over (partition by Date, View order by case when View = 'low_risk' then round(Risk_Score, 10) end desc nulls last, round(Confidence_Adjusted_Score, 10) desc nulls last, Symbol) as Place from v) select Date, View, Place, Symbol from k where Place <= 25""")
def ranked_views(spark, sf_dir):
    return scoring.ranked_views(scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED, "Return_21D")))


@register("risk_flag_changes", f"""with {sql.SCORES}, {LABELS}, p as (select Date, Symbol, Risk_Flag, lag(Risk_Flag) over (partition by Symbol order by Date) as Previous_Flag from labels)
select Date, Symbol, case when Risk_Flag = 'Clean' then 'cleared' when Previous_Flag = 'Clean' then 'new' else 'changed' end as Change, Risk_Flag, Previous_Flag from p where Previous_Flag is not null and Risk_Flag != Previous_Flag""")
def risk_flag_changes(spark, sf_dir):
    return changes.risk_flag_changes(scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED)))


@register("candidate_filter", f"with {sql.SCORES}, {LABELS} select Date, Symbol, Bucket, Risk_Flag from labels where upper(Symbol || ' ' || Name) like '%1%' and etf is false and elig and Risk_Flag != 'Clean' and Bucket = 'Candidate'")
def candidate_filter(spark, sf_dir):
    df = scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED, "Name"))
    return changes.candidate_filter(df, text="1", universe="Stock", bucket="Candidate", eligible=True, flagged=True).select("Date", "Symbol", "Bucket", "Risk_Flag")


_SHADOW = f"""h0 as (select *, (0.20 * coalesce(Return_5D, 0) + 0.50 * coalesce(Return_21D, 0) + 0.30 * coalesce(Return_63D, 0)) / nullif((case when Return_5D is not null then 0.2::double else 0 end) + (case when Return_21D is not null then 0.5::double else 0 end) + (case when Return_63D is not null then 0.3::double else 0 end), 0) as bm from scores),
h1 as (select *, bm / (case when Volatility_20D > 0.02 then Volatility_20D else 0.02 end) as ram from h0), h2 as (select *, {sql.pr('ram', 'Date')} * 100 as mp, {sql.pr('Volatility_20D', 'Date')} * 100 as vp from h1),
h3 as (select *, case when mp is not null then least(greatest(mp * (case when Price >= MA_50D and (MA_200D is null or Price >= MA_200D) then 1.0 else 0.85 end) * (case when Return_21D >= Benchmark_Return_21D then 1.0 else 0.9 end)
  - (coalesce(vp / 100 * 15, 0) + coalesce(least(abs(Current_Drawdown_60D) * 100, 1.0) * 7.5, 0) + (case when RSI_14 >= 75 then 12.0 else 0.0 end)), 0.0::double), 100.0::double) end as base from h2),
h4 as (select *, case when base is not null then least(base, case when Return_21D is null or Return_21D <= 0 then 49.9::double when Return_5D <= -0.08 then 59.9 else 100.0 end) end as Shadow_Score from h3),
h5 as (select *, Shadow_Score * Confidence_Score / 10 as V4_CAS, concat_ws(',', case when Return_5D is null then 'Return_5D' end, case when Return_21D is null then 'Return_21D' end, case when Return_63D is null then 'Return_63D' end, case when Volatility_20D is null then 'Volatility_20D' end, case when MA_200D is null then 'MA_200D' end) as Neutral_Inputs from h4),
h6 as (select *, case when elig then row_number() over (partition by Date, elig order by round(V4_CAS, 10) desc nulls last, Symbol) end as V4_Rank from h5), shadow as (select *, Opportunity_Rank - V4_Rank as Rank_Delta from h6)"""


def _shadow_scores(spark, sf_dir):
    some = ("Date", "Symbol", "Universe", "Opportunity_Eligible", "Opportunity_Rank", "Confidence_Score", "Shadow_Score", "Neutral_Inputs")
    return all_shadow_scores(spark, sf_dir).select(*some)


def shadow(spark, sf_dir):
    return scoring.shadow_frame(_shadow_scores(spark, sf_dir))


@register("shadow_frame", f"with {sql.SCORES}, {_SHADOW} select Date, Symbol, {sql.r4('V4_CAS')}, V4_Rank, Rank_Delta, Neutral_Inputs from shadow")
def shadow_frame(spark, sf_dir):
    return shadow(spark, sf_dir).select("Date", "Symbol", *r4("V4_CAS"), "V4_Rank", "Rank_Delta", "Neutral_Inputs")


_COMPARE = "cmp as (select Date, count(*) as N, case when isnan(corr(Opportunity_Rank, V4_Rank)) then null else corr(Opportunity_Rank, V4_Rank) end as Spearman, count(*) filter (Opportunity_Rank <= 25 and V4_Rank <= 25) / nullif(count(*) filter (Opportunity_Rank <= 25 or V4_Rank <= 25), 0)::double as Jaccard, avg(abs(Opportunity_Rank - V4_Rank)) as Mean_Abs_Delta from shadow where Opportunity_Rank is not null and V4_Rank is not null group by 1)"


@register("shadow_compare", f"with {sql.SCORES}, {_SHADOW}, {_COMPARE} select Date, N, {sql.r4('Spearman', 'Jaccard', 'Mean_Abs_Delta')} from cmp")
def shadow_compare(spark, sf_dir):
    return changes.shadow_compare(shadow(spark, sf_dir)).select("Date", "N", *r4("Spearman", "Jaccard", "Mean_Abs_Delta"))


@register("overlap_summary", f"with {sql.SCORES}, {_SHADOW}, o as (select Date, coalesce(Opportunity_Rank <= 20, false) as a, coalesce(V4_Rank <= 20, false) as b from shadow) select Date, count(*) filter (a and b) as Overlap, count(*) filter (b and not a) as Added, count(*) filter (a and not b) as Dropped from o group by 1")
def overlap_summary(spark, sf_dir):
    return changes.overlap_summary(shadow(spark, sf_dir))


@register("matured_delta", f"with {sql.MATURED}, d as (select Horizon_Days, Exit_Date as Date, count(*) as Delta from matured where Net_Forward_Return is not null group by 1, 2) select Horizon_Days, Date, sum(Delta) over (partition by Horizon_Days order by Date)::bigint as Matured, Delta from d")
def matured_delta(spark, sf_dir):
    return changes.matured_delta(matured(spark, sf_dir))


_DIFF = f"""top as (select Date, Symbol from scores where Opportunity_Rank <= 5), pd as (select Date, lag(Date) over (order by Date) as pd from (select distinct Date from top)),
was as (select pd.Date, top.Symbol from top join pd on top.Date = pd.pd), bothd as (select Date, Symbol, max(n) as n, max(w) as w from (select Date, Symbol, 1 as n, 0 as w from top union all select Date, Symbol, 0, 1 from was) group by 1, 2),
d1 as (select b.*, s.Confidence_Adjusted_Score as s, p.Confidence_Adjusted_Score as p, b.Symbol in (select Symbol from veto) as v from bothd b join pd using (Date) left join scores s on s.Date = b.Date and s.Symbol = b.Symbol left join scores p on p.Date = pd.pd and p.Symbol = b.Symbol),
diff as (select Date, Symbol, case when n = 1 and w = 1 then 'hold' when n = 1 then 'entry' else 'exit' end as Action, concat_ws('; ', case when v then 'sentiment veto' end, case when s is null then 'dropped from universe' when s < p - 3 then 'score decay' end) as why from d1)"""


def _diff(spark, sf_dir):
    scored = scores_table(spark, sf_dir, "Opportunity_Rank", "Confidence_Adjusted_Score")
    return changes.rebalance_diff(scored.where("Opportunity_Rank <= 5"), scored, veto(spark, sf_dir))


@register("rebalance_diff", f"with {sql.SCORES}, {_VETO}, {_DIFF} select Date, Symbol, Action, case when Action = 'exit' then (case when why = '' then 'outranked' else why end) end as Reason from diff")
def rebalance_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@register("rebalance_summary", f"with {sql.SCORES}, {_VETO}, {_DIFF} select Date, count(*) filter (Action = 'hold') as Holds, count(*) filter (Action = 'entry') as Entries, count(*) filter (Action = 'exit') as Exits, round(count(*) filter (Action = 'entry') / greatest(count(*) filter (Action != 'exit'), 1)::double * 100, 1) as Turnover_Pct from diff group by 1")
def rebalance_summary(spark, sf_dir):
    return changes.rebalance_summary(_diff(spark, sf_dir))


FUND = f"""{sql.MASTER}, fl0 as (select l_suppkey as k, avg(l_extendedprice / l_quantity) as u, avg(l_discount) as d, avg(l_tax) as t, avg(l_quantity) as q, quantile_cont(l_quantity, 0.5) as m from lineitem group by 1),
fund as (select 'S' || k as Symbol, Sector, case when k % 7 != 0 then round(u / 100 + 0.0000000137::double, 6) end as PE, case when k % 5 != 0 then round(d * 4 + 0.0000000137::double, 6) end as ROE, case when k % 6 != 0 then round(t * 10 + 0.0000000137::double, 6) end as DebtToEquity,
  case when k % 9 != 0 then round(q / 50 - 0.5 + 0.0000000137::double, 6) end as EarningsGrowth, case when k % 4 != 0 then round(d + t + 0.0000000137::double, 6) end as ProfitMargin, round(m * u / 2550 + 0.0000000137::double, 6) as Self_Median_PE from fl0 left join master on master.Symbol = 'S' || k)"""
_W = "(case when count({0}) over () >= 5 then least(greatest({0}, quantile_cont({0}, 0.02) over ()), quantile_cont({0}, 0.98) over ()) else {0} end)"
_QUALITY = f"""f1 as (select *, {', '.join(f'{_W.format(m)} as w_{m}' for m, _, _ in fundamentals.METRICS)} from fund), f2 as (select *, 1 as one, {', '.join((f"{sql.pr('w_' + m, '1')} * 100" if up else f"(1 - {sql.pr('w_' + m, '1')}) * 100") + f' as p_{m}' for m, _, up in fundamentals.METRICS)} from f1),
quality_score as (select *, ({' + '.join(f'coalesce(p_{m}, 0) * {w}' for m, w, _ in fundamentals.METRICS)}) / nullif({' + '.join(f'(case when p_{m} is not null then {w} else 0 end)' for m, w, _ in fundamentals.METRICS)}, 0) as Fundamental_Score, ({' + '.join(f'(p_{m} is not null)::int' for m, _, _ in fundamentals.METRICS)}) / 5.0::double as Fundamental_Coverage from f2)"""


@register("fundamental_quality", f"with {FUND}, {_QUALITY} select Symbol, {sql.r4('Fundamental_Score', 'Fundamental_Coverage')} from quality_score")
def fundamental_quality(spark, sf_dir):
    return fundamentals.fundamental_quality(panel.fundamentals(spark, sf_dir)).select("Symbol", *r4("Fundamental_Score", "Fundamental_Coverage"))


_Z = "(case when count({0}) over () >= 3 then {1} * (case when coalesce(stddev_pop({0}) over (), 0) < 1e-12 then (case when {0} is not null then 0.0::double end) else ({0} - avg({0}) over ()) / stddev_pop({0}) over () end) end)"


@register("fundamental_zscore", f"with {FUND}, z0 as (select Symbol, list_filter([{', '.join(_Z.format(m, 1 if up else -1) for m, _, up in fundamentals.METRICS)}], lambda x: x is not null) as z from fund) select Symbol, {sql.r4x('case when len(z) >= 2 then least(greatest(list_avg(z), -3.0::double), 3.0::double) end')} as Fundamental_Z, {sql.r4x('len(z) / 5.0::double')} as Z_Coverage from z0")
def fundamental_zscore(spark, sf_dir):
    return fundamentals.fundamental_zscore(panel.fundamentals(spark, sf_dir)).select("Symbol", *r4("Fundamental_Z", "Z_Coverage"))


@register("valuation_flag", f"""with {FUND}, s as (select Sector, quantile_cont(PE, 0.5) as sm from fund group by 1), v as (select Symbol, PE, case when Self_Median_PE > 0 then (case when PE < Self_Median_PE * 0.85 then 1 when PE > Self_Median_PE * 1.15 then -1 else 0 end) end as a, case when sm > 0 then (case when PE < sm * 0.85 then 1 when PE > sm * 1.15 then -1 else 0 end) end as b from fund left join s on s.Sector is not distinct from fund.Sector)
select Symbol, case when PE is null or PE <= 0 or (a is null and b is null) then 'Unknown' when coalesce(a, 0) + coalesce(b, 0) >= 1 then 'Cheap' when coalesce(a, 0) + coalesce(b, 0) <= -1 then 'Expensive' else 'Fair' end as Valuation from v""")
def valuation_flag(spark, sf_dir):
    return fundamentals.valuation_flag(panel.fundamentals(spark, sf_dir)).select("Symbol", "Valuation")


@register("fundamentals_table", f"with {FUND}, n as (select Symbol, (PE is not null)::int + (ROE is not null)::int + (DebtToEquity is not null)::int + (EarningsGrowth is not null)::int + (ProfitMargin is not null)::int as n from fund) select master.Symbol, case when n = 5 then 'complete' when n > 0 then 'partial' else 'missing' end as Coverage_Status from master left join n using (Symbol)")
def fundamentals_table(spark, sf_dir):
    return fundamentals.fundamentals_table(panel.fundamentals(spark, sf_dir).drop("Sector"), panel.master(spark, sf_dir)).select("Symbol", "Coverage_Status")


_FUND_ONLY = FUND.replace(sql.MASTER + ",", "")


@register("fundamental_blend", f"""with {sql.SCORES}, {_SHADOW}, {_FUND_ONLY}, {_QUALITY} select s.Date, s.Symbol, {sql.r4x("case when etf or Fundamental_Score is null or coalesce(Fundamental_Coverage, 1) < 0.6 then Shadow_Score else 0.85 * Shadow_Score + 0.15 * Fundamental_Score end")} as Blended_Score from shadow s left join quality_score q using (Symbol)""")
def fundamental_blend(spark, sf_dir):
    q = fundamentals.fundamental_quality(panel.fundamentals(spark, sf_dir)).select("Symbol", "Fundamental_Score", "Fundamental_Coverage")
    df = _shadow_scores(spark, sf_dir).join(q.hint("shuffle_hash"), "Symbol", "left")
    return scoring.fundamental_blend(df).select("Date", "Symbol", *r4("Blended_Score"))


_NZ = "case when coalesce(stddev_pop({0}) over ({1}), 0) < 1e-12 then (case when {0} is not null then 0.0::double end) else ({0} - avg({0}) over ({1})) / stddev_pop({0}) over ({1}) end"


@register("sector_neutralize", f"with {sql.SCORES}, n0 as (select Date, Symbol, Return_21D as x, count(Return_21D) over (partition by Date, Sector) as Sector_Members, {_NZ.format('Return_21D', 'partition by Date, Sector')} as z from scores), n1 as (select *, case when Sector_Members >= 5 then z else x end as v from n0) select Date, Symbol, Sector_Members, {sql.r4x(_NZ.format('v', 'partition by Date'))} as Neutral from n1")
def sector_neutralize(spark, sf_dir):
    df = all_signals(spark, sf_dir).join(panel.master(spark, sf_dir), "Symbol", "left")
    return scoring.sector_neutralize(df, "Return_21D").select("Date", "Symbol", "Sector_Members", *r4("Neutral"))


@register("sector_rs", f"with {sql.SCORES}, g as (select Date, Sector, avg(Return_21D) as s, avg(Benchmark_Return_21D) as b from scores group by 1, 2) select Date, Sector, case when round(s - b, 10) >= 0.10 then 1.05 when round(s - b, 10) <= -0.03 then 0.95 else 1.0 end::double as Sector_Multiplier from g where s is not null and b is not null")
def sector_rs(spark, sf_dir):
    return signals.sector_rs(all_signals(spark, sf_dir).join(panel.master(spark, sf_dir), "Symbol", "left"))


@register("threshold_score", f"with {sql.SCORES} select Symbol, Date, round({sql._threshold('TER', '0.005', False)} + 0.00000137::double, 4) as Score from scores")
def threshold_score(spark, sf_dir):
    df = table(panel.bars(spark, sf_dir).select("Symbol", "Date").join(panel.etf_quality(spark, sf_dir).select("Symbol", "TER").hint("merge"), "Symbol", "left"), "terms")
    met = df.join(ranks.component_ranks(df, {"_ter": F.col("TER")}, table).hint("merge"), ["Date", "Symbol"], "left")
    return met.select("Symbol", "Date", r4x(scoring.threshold_score("_ter", F.col("TER"), scoring.TER_GOOD, False)).alias("Score"))


@register("etf_quality_join", f"with {sql.SCORES} select Symbol, Date, {sql.r4('NAV', 'NAV_Premium_Discount')}, Mapping_Status from scores")
def etf_quality_join(spark, sf_dir):
    return scoring.etf_quality_join(panel.bars(spark, sf_dir), panel.etf_quality(spark, sf_dir)).select("Symbol", "Date", *r4("NAV", "NAV_Premium_Discount"), "Mapping_Status")


@register("absolute_momentum", f"with {sql.SCORES} select Symbol, Date, Absolute_Momentum_Pass from scores")
def absolute_momentum(spark, sf_dir):
    return all_signals(spark, sf_dir).select("Symbol", "Date", scoring.absolute_momentum().alias("Absolute_Momentum_Pass"))


@register("cost_model", f"""with {sql.SCORES} select Symbol, Date, case when etf then (case when Avg_Traded_Value_20D is null then 0.005 when Avg_Traded_Value_20D < 2e7 then 0.01 when Avg_Traded_Value_20D < 1e8 then 0.005 else 0.0025 end) else 0.0035 end::double as Cost,
  case when etf then (case when Avg_Traded_Value_20D is null then 'ETF cost: missing traded value' when Avg_Traded_Value_20D < 2e7 then 'ETF low-liquidity cost' when Avg_Traded_Value_20D < 1e8 then 'ETF mid-liquidity cost' else 'ETF high-liquidity cost' end) else 'Stock cost' end as Note from scores""")
def cost_model(spark, sf_dir):
    df = all_signals(spark, sf_dir).join(panel.master(spark, sf_dir), "Symbol", "left")
    return df.select("Symbol", "Date", validation.cost_model().alias("c")).select("Symbol", "Date", F.col("c.cost").alias("Cost"), F.col("c.note").alias("Note"))


@register("signal_gap", f"with {sql.SPREADS}, g as (select Horizon_Days, date_diff('day', lag(Signal_Date) over (partition by Horizon_Days order by Signal_Date), Signal_Date) as g from spreads) select Horizon_Days, quantile_cont(g, 0.5) as Gap_Days from g group by 1")
def signal_gap(spark, sf_dir):
    from barlake.plans.queries import _spreads

    return validation.signal_gap(_spreads(spark, sf_dir))


_FEAR = "fear as (select date_trunc('week', o_orderdate)::date as Date, round(avg(o_totalprice), 4) as Value from orders group by 1)"


def fear(spark, sf_dir):
    """The weekly mean order price, as a stand-in for a volatility index."""
    o = panel.table(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("Date")).agg(F.round(F.avg("o_totalprice"), 4).alias("Value"))


_SHARE = "case when count(Value) over w >= {least} then list_count(list_filter(list(Value) over w, lambda x: x {op} Value)) / count(Value) over w::double * 100 end"


@register("vix_percentile", f"with {_FEAR}, p as (select 'F' as Symbol, Date, {_SHARE.format(least=20, op='<')} as Percentile from fear window w as (order by Date rows between 251 preceding and current row)) select Symbol, Date, {sql.r4('Percentile')}, case when Percentile is null then 'UNKNOWN' when Percentile < 30 then 'LOW' when Percentile <= 70 then 'MID' else 'HIGH' end as Regime from p")
def vix_percentile(spark, sf_dir):
    return signals.vix_percentile(fear(spark, sf_dir).withColumn("Symbol", F.lit("F"))).select("Symbol", "Date", *r4("Percentile"), "Regime")


@register("macro_tape", f"""with {sql.BARS}, {_FEAR}, p as (select Date, {_SHARE.format(least=60, op='<=')} as Fear_Pctile from fear window w as (order by Date rows between 251 preceding and current row)),
m as (select Date, case when count(*) over (order by Date) >= 55 then Benchmark_Close >= avg(Benchmark_Close) over (order by Date rows between 49 preceding and current row) end as Above_50, case when count(*) over (order by Date) >= 55 then (Benchmark_Close / lag(Benchmark_Close, 49) over (order by Date) - 1) * 100 end as Trend_50, Fear_Pctile from bench left join p using (Date)),
r as (select *, case when Fear_Pctile is null then 'neutral' when coalesce(Trend_50, 0) > 2 and Fear_Pctile < 40 then 'risk-on' when coalesce(Trend_50, 0) < -3 or Fear_Pctile > 70 then 'risk-off' else 'neutral' end as Regime from m)
select Date, Above_50, {sql.r4('Trend_50', 'Fear_Pctile')}, Regime, lag(Regime) over (order by Date) as Previous_Regime from r""")
def macro_tape(spark, sf_dir):
    tape = signals.macro_tape(panel.benchmark(panel.bars(spark, sf_dir)), fear(spark, sf_dir))
    return tape.select("Date", "Above_50", *r4("Trend_50", "Fear_Pctile"), "Regime", "Previous_Regime")


_W60 = "over (partition by Symbol order by Date rows between 59 preceding and current row)"
_W20 = "over (partition by Symbol order by Date rows between 19 preceding and current row)"


@register("microstructure", f"""with {sql.BARS}, {sql.MASTER}, m0 as (select bars.*, Close * Volume as tv, (High - Low) / Close as sp, Close / nullif(Open * (1 + NAV_Gap), 0) - 1 as pr from bars left join quality using (Symbol)),
m1 as (select Symbol, Date, quantile_cont(tv, 0.5) {_W20} as Traded_Median_20, quantile_cont(sp, 0.5) {_W20} as Spread_Median_20, case when count(pr) {_W60} >= 10 and stddev_pop(pr) {_W60} > 1e-12 then (pr - avg(pr) {_W60}) / stddev_pop(pr) {_W60} end as Premium_Z from m0),
m2 as (select *, concat_ws('; ', case when Traded_Median_20 is null or Traded_Median_20 < 200000 then 'LOW_LIQUIDITY' end, case when abs(Premium_Z) > 2.5 then 'PREMIUM_Z' end) as Fails from m1) select Symbol, Date, {sql.r4('Traded_Median_20', 'Spread_Median_20', 'Premium_Z')}, Fails = '' as Passes, Fails from m2""")
def microstructure(spark, sf_dir):
    df = signals.microstructure(panel.bars(spark, sf_dir), panel.etf_quality(spark, sf_dir).select("Symbol", "NAV_Gap"), 200_000)
    return df.select("Symbol", "Date", *r4("Traded_Median_20", "Spread_Median_20", "Premium_Z"), "Passes", "Fails")


_B = ("Excess_21", "Tracking_Error", "Information_Ratio", "Beta")


@register("benchmark_stats", f"""with {sql.BARS}, b0 as (select Symbol, Date, {sql.change('Close')} as r, {sql.change('Benchmark_Close')} as b from bars join bench using (Date)), b1 as (select *, row_number() over (partition by Symbol order by Date desc) as k from b0 where r is not null and b is not null),
s as (select Symbol, count(*) as N, exp(sum(case when k <= 21 then ln(1 + r) end)) - exp(sum(case when k <= 21 then ln(1 + b) end)) as Excess_21, stddev_pop(r - b) * sqrt(252.0) as Tracking_Error, avg(r - b) * 252 as m, covar_samp(r, b) / nullif(var_pop(b), 0) as Beta from b1 where k <= 63 group by 1)
select Symbol, N, {sql.r4('Excess_21', 'Tracking_Error')}, {sql.r4x('m / nullif(Tracking_Error, 0)')} as Information_Ratio, {sql.r4('Beta')} from s where N >= 20""")
def benchmark_stats(spark, sf_dir):
    b = panel.bars(spark, sf_dir)
    return signals.benchmark_stats(b, panel.benchmark(b)).select("Symbol", "N", *r4(*_B))


@register("sector_context", f"""with {sql.BARS}, {sql.MASTER}, c0 as (select Symbol, Date, Close, {sql.change('Close')} as r, {sql.change('Close', 21)} as Return_21, {sql.change('Close', 63)} as Return_63, row_number() over (partition by Symbol order by Date desc) as k from bars), bb as (select Date, Benchmark_Close / lag(Benchmark_Close, 21) over (order by Date) - 1 as b21 from bench),
picks as (select Symbol from (select Symbol, row_number() over (order by round(Return_63, 10) desc nulls last, Symbol) as p from c0 where k = 1) where p <= 5),
pc as (select a.Symbol, b.Symbol as Peer, corr(a.r, b.r) as c, count(*) as n from c0 a join c0 b on a.Date = b.Date and a.Symbol != b.Symbol where a.Symbol in (select Symbol from picks) and a.k <= 60 and a.r is not null and b.r is not null group by 1, 2),
pt as (select *, row_number() over (partition by Symbol order by round(c, 8) desc, Peer) as place from pc where n >= 20 and c is not null and not isnan(c)),
pf as (select pt.Symbol, string_agg(Peer, ',' order by place) as Peers, quantile_cont(l.Return_63, 0.5) as Peer_Median_63 from pt join c0 l on l.Symbol = Peer and l.k = 1 where place <= 3 group by 1)
select pf.Symbol, Sector, {sql.r4('Return_21', 'Return_63')}, {sql.r4x('Return_21 - b21')} as Relative_21, Peers, {sql.r4('Peer_Median_63')} from pf join c0 on c0.Symbol = pf.Symbol and k = 1 left join master on master.Symbol = pf.Symbol left join bb using (Date)""")
def sector_context(spark, sf_dir):
    """The five symbols with the highest 63-row return at their last bar."""
    b = panel.bars(spark, sf_dir)
    last = b.withColumns({"r": frames.change(F.col("Close"), 63), "k": F.row_number().over(frames.Window.partitionBy("Symbol").orderBy(F.col("Date").desc()))}).where("k = 1")
    picks = last.orderBy(F.round("r", 10).desc_nulls_last(), "Symbol").limit(5).select("Symbol")
    return signals.sector_context(b, panel.benchmark(b), panel.master(spark, sf_dir), picks).select("Symbol", "Sector", *r4("Return_21", "Return_63", "Relative_21"), "Peers", *r4("Peer_Median_63"))
