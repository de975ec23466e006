"""SQL for DuckDB over the same tables: what the registered queries are compared with."""

from __future__ import annotations


def _w(n: int, to: int = 0) -> str:
    end = "current row" if to == 0 else f"{-to} preceding"
    return f"over (partition by Symbol order by Date rows between {n - 1 - to} preceding and {end})"


def rolling(agg: str, x: str, n: int, least: int) -> str:
    return f"case when count({x}) {_w(n)} >= {least} then {agg} {_w(n)} end"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over (partition by Symbol order by Date)"


def change(x: str, n: int = 1) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def pr(x: str, *keys: str) -> str:
    k, v = ", ".join(keys), f"round({x}, 10)"
    return f"(case when {v} is not null then (rank() over (partition by {k} order by {v} asc nulls last) + (count({v}) over (partition by {k}, {v}) - 1) / 2.0::double) / count({v}) over (partition by {k}) end)"


def ps(x: str, up: bool, *keys: str) -> str:
    p = f"100 * {pr(x, *keys)}" if up else f"100 - 100 * {pr(x, *keys)}"
    return f"(case when count(round({x}, 10)) over (partition by {', '.join(keys)}) <= 1 or {x} is null then 50.0::double else least(greatest({p}, 0.0::double), 100.0::double) end)"


#: Added before rounding results to 4 decimals, so that values halfway between two steps round alike in both engines.
NUDGE = 1.37e-6


def r4(*cols: str) -> str:
    return ", ".join(f"{r4x(c)} as {c}" for c in cols)


def r4x(x: str) -> str:
    return f"round({x} + {NUDGE:.8f}::double, 4)"


def bars(grain: str = "week") -> str:
    return f"""
line as (select 'S' || l_suppkey as Symbol, cast(date_trunc('{grain}', l_shipdate) as date) as Date, l_extendedprice / l_quantity as unit, l_quantity as quantity from lineitem),
grouped as (select Symbol, Date, max(unit) as High, min(unit) as Low, round(avg(unit) + 0.0000000137::double, 6) as Close, sum(quantity) as Volume from line group by Symbol, Date),
bars as (select Symbol, Date, coalesce(lag(Close) over (partition by Symbol order by Date), Close) as Open, High, Low, Close, Close as Price, Volume from grouped),
bench as (select Date, round(avg(Close) + 0.0000000137::double, 6) as Benchmark_Close from bars group by Date)"""


BARS = bars()
MASTER = """
master as (select 'S' || s_suppkey as Symbol, s_name as Name, case when s_suppkey % 4 = 0 then 'ETF' else 'Stock' end as Universe, r_name as Universe_Group, n_name as Sector,
  case when s_suppkey % 11 = 0 then 'No' else 'Yes' end as Opportunity_Eligible
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
quality as (select 'S' || s_suppkey as Symbol, (s_suppkey % 7 - 3) / 100.0::double as NAV_Gap, case when s_suppkey % 5 != 0 then abs(s_acctbal) / 20.0::double end as AUM_Cr,
  case when s_suppkey % 3 != 0 then (s_suppkey % 13) / 1000.0::double end as TER, case when s_suppkey % 6 != 0 then (s_suppkey % 9) / 200.0::double end as Tracking_Error,
  case when s_suppkey % 8 != 0 then (s_suppkey % 10 - 5) / 200.0::double end as Tracking_Difference, ['Verified', 'Suggested', 'Review', 'Missing'][(s_suppkey // 4) % 4 + 1] as Mapping_Status
  from supplier where s_suppkey % 4 = 0)"""

_RET = ", ".join(f"{change('Price', n)} as Return_{n}D, {change('Benchmark_Close', n)} as Benchmark_Return_{n}D, {change('Price', n)} - {change('Benchmark_Close', n)} as Relative_Strength_{n}D" for n in (5, 10, 21, 63, 126, 252))
_MA = ", ".join(f"{rolling('avg(Price)', 'Price', n, max(5, n // 2))} as MA_{n}D" for n in (10, 20, 50, 100, 200))
_ABOVE = ", ".join(f"coalesce(Price > MA_{n}D, false) as Above_{n}DMA" for n in (10, 20, 50, 100, 200))
SIGNALS = f"""{BARS},
s0 as (select bars.*, Benchmark_Close from bars left join bench using (Date)),
s1 as (select *, {change('Price')} as Daily_Return, {change('Benchmark_Close')} as Benchmark_Return, {_RET}, {_MA}, Price - {lag('Price')} as d,
  Price / ({rolling('max(Price)', 'Price', 60, 10)}) - 1 as gap60, Price / ({rolling('max(Price)', 'Price', 252, 10)}) - 1 as gap252, Price * Volume as Traded_Value,
  greatest(High - Low, abs(High - {lag('Close')}), abs(Low - {lag('Close')})) as tr, row_number() over (partition by Symbol order by Date) as History_Days from s0),
s2 as (select *, {_ABOVE}, {rolling('stddev_samp(Daily_Return)', 'Daily_Return', 20, 10)} * sqrt(252.0) as Volatility_20D, {rolling('stddev_samp(Daily_Return)', 'Daily_Return', 60, 20)} * sqrt(252.0) as Volatility_60D,
  gap60 as Current_Drawdown_60D, {rolling('min(gap60)', 'gap60', 60, 10)} as Max_Drawdown_60D, {rolling('min(gap252)', 'gap252', 252, 10)} as Max_Drawdown_252D,
  coalesce(100 - 100 / (1 + ({rolling('avg(greatest(d, 0.0::double))', 'd', 14, 14)}) / nullif({rolling('avg(greatest(-d, 0.0::double))', 'd', 14, 14)}, 0)), 50.0) as RSI_14,
  {rolling('avg(Traded_Value)', 'Traded_Value', 20, 5)} as Avg_Traded_Value_20D, Volume / nullif({rolling('avg(Volume)', 'Volume', 20, 5)}, 0) as Volume_Ratio_20D,
  {rolling('sum(case when coalesce(Volume, 0) <= 0 then 1.0::double else 0.0::double end)', '1', 60, 10)} as Zero_Volume_Days_60D,
  case when count(case when Daily_Return is not null and Benchmark_Return is not null then 1 end) {_w(252)} >= 60 then covar_samp(Daily_Return, Benchmark_Return) {_w(252)} end
    / nullif({rolling('var_samp(Benchmark_Return)', 'Benchmark_Return', 252, 60)}, 0) as Beta_252D,
  {rolling('avg(tr)', 'tr', 14, 7)} as ATR_14 from s1),
signals as (select *, {', '.join(f'MA_{n}D / 100 as MA_{n}D_Hundreds' for n in (10, 20, 50, 100, 200))}, Traded_Value / 1e5 as Traded_Lakh, Avg_Traded_Value_20D / 1e5 as Avg_Traded_Lakh_20D, Price - 1.5 * ATR_14 as ATR_Stop_Level, Price + 1.5 * ATR_14 as ATR_Target_1, Price + 2.5 * ATR_14 as ATR_Target_2,
  (Price + 2.5 * ATR_14 - Price) / nullif(Price - (Price - 1.5 * ATR_14), 0) as Risk_Reward_Ratio_2 from s2)"""
_BW = "over (order by Date rows between {} preceding and current row)"
REGIME = f"""
r0 as (select Date, Benchmark_Close as c, case when count(*) {_BW.format(19)} >= 10 then avg(Benchmark_Close) {_BW.format(19)} end as m20, case when count(*) {_BW.format(49)} >= 20 then avg(Benchmark_Close) {_BW.format(49)} end as m50,
  Benchmark_Close / lag(Benchmark_Close, 21) over (order by Date) - 1 as r21 from bench),
regime as (select Date, case when m20 is null or m50 is null or r21 is null then 'Neutral' when c > m20 and m20 > m50 and r21 > 0 then 'Risk-On' when c < m20 and m20 < m50 and r21 < 0 then 'Risk-Off' else 'Neutral' end as Market_Regime,
  case when m20 is null or m50 is null or r21 is null then 50.0::double when c > m20 and m20 > m50 and r21 > 0 then 85.0 when c < m20 and m20 < m50 and r21 < 0 then 25.0 else 55.0 end as Market_Regime_Score from r0)"""


def _threshold(x: str, good: str, up: bool) -> str:
    s = ps(x, up, "Date")
    return f"case when {x} {'>=' if up else '<='} {good} then greatest({s}, 75.0::double) else {s} end"


_CLIP = "least(greatest({}, 0.0::double), 100.0::double)"


def _final(consistency: str) -> str:
    blend = f"""case when etf then 0.42 * Opportunity_Score + 0.25 * Safety_Score + 0.18 * ETF_Quality_Score + 0.05 * {consistency} + 0.10 * Market_Regime_Score
  else 0.50 * Opportunity_Score + 0.35 * Safety_Score + 0.05 * {consistency} + 0.10 * Market_Regime_Score end"""
    return _CLIP.format(f"case when Absolute_Momentum_Pass then {blend} else least({blend}, 64.9::double) end")


def _blend(consistency: str) -> str:
    return _CLIP.format(f"{_final(consistency)} * Confidence_Score / 10")


def _consistency(score: str) -> str:
    w = "over (partition by Symbol order by Date range between interval 28 day preceding and interval 1 day preceding)"
    return f"coalesce(least(greatest(avg({score}) {w} - 1.5 * coalesce(stddev_samp({score}) {w}, 0), 0.0::double), 100.0::double), 50.0)"


SCORES = f"""{SIGNALS}, {REGIME}, {MASTER},
c0 as (select s.*, m.Name, m.Universe, m.Universe_Group, m.Sector, m.Opportunity_Eligible, q.AUM_Cr, q.TER, q.Tracking_Error, q.Tracking_Difference, q.Mapping_Status, s.Price * (1 + q.NAV_Gap) as NAV,
  s.Price / nullif(s.Price * (1 + q.NAV_Gap), 0) - 1 as NAV_Premium_Discount, g.Market_Regime, g.Market_Regime_Score, lower(m.Universe) = 'etf' as etf
  from signals s left join master m using (Symbol) left join quality q using (Symbol) left join regime g using (Date)),
c1 as (select *, coalesce(Return_21D, -999) >= 0 and coalesce(Return_5D, -999) >= -0.02 and (Above_20DMA or Above_50DMA) as Absolute_Momentum_Pass,
  0.25 * coalesce(Return_5D, 0) + 0.45 * coalesce(Return_21D, 0) + 0.30 * coalesce(Return_63D, 0) as Momentum_Raw,
  20.0::double * Above_10DMA::int + 25.0 * Above_20DMA::int + 30.0 * Above_50DMA::int + 25.0 * coalesce(MA_20D > MA_50D, false)::int as Trend_Score,
  coalesce(Tracking_Error, abs(Tracking_Difference)) as trk, abs(NAV_Premium_Discount) as prem from c0),
c2 as (select *, {ps('Momentum_Raw', True, 'Date')} as Momentum_Score, {ps('Relative_Strength_21D', True, 'Date')} as Relative_Strength_Score, {ps('Volatility_20D', False, 'Date')} as pvol,
  {ps('Current_Drawdown_60D', True, 'Date')} as pdd, {ps('Max_Drawdown_60D', True, 'Date')} as pmdd, {ps('Zero_Volume_Days_60D', False, 'Date')} as pzero, {ps('Avg_Traded_Value_20D', True, 'Date')} as pliq,
  {_threshold('prem', '0.02', False)} as pnav, {_threshold('AUM_Cr', '100', True)} as paum, {_threshold('TER', '0.005', False)} as pter, {_threshold('trk', '0.02', False)} as pte from c1),
c3 as (select *, {_CLIP.format('0.40 * Momentum_Score + 0.35 * Trend_Score + 0.25 * Relative_Strength_Score')} as Opportunity_Score, {_CLIP.format('0.80 * pliq + 0.20 * pzero')} as Liquidity_Score,
  {_CLIP.format("0.50 * pvol + 0.35 * pdd + 0.15 * pmdd - (case when RSI_14 > 75 then 25.0 when RSI_14 < 30 then 10.0 else 0.0 end)")} as Risk_Score,
  case when etf then {_CLIP.format("(0.30 * pnav + 0.25 * paum + 0.25 * pter + 0.20 * (case when Tracking_Error is null and Tracking_Difference is not null then pte * 0.85 else pte end)) * (case Mapping_Status when 'Verified' then 1.0 when 'Suggested' then 0.75 else 0.5 end)")} else 100.0 end as ETF_Quality_Score,
  least(greatest(10.0::double - ((case when etf and NAV is null then 1.5 else 0 end) + (case when etf and AUM_Cr is null then 1.0 else 0 end) + (case when etf and TER is null then 1.0 else 0 end)
    + (case when etf and Tracking_Error is null and Tracking_Difference is null then 1.0 else 0 end) + (case when etf and Tracking_Error is null and Tracking_Difference is not null then 0.25 else 0 end)
    + (case when etf and coalesce(Mapping_Status, '') in ('Review', 'Missing', '') then 1.5 else 0 end) + (case when Market_Regime = 'Risk-Off' then 1.0 else 0 end) + (case when RSI_14 > 75 then 1.0 else 0 end)), 1.0::double), 10.0::double) as Confidence_Score from c2),
c4 as (select *, {_CLIP.format('0.70 * Risk_Score + 0.30 * Liquidity_Score')} as Safety_Score from c3),
c5 as (select *, {_blend('50.0::double')} as first_score from c4),
c6 as (select *, {_consistency('first_score')} as Score_Consistency_4W from c5),
c7 as (select *, {_final('Score_Consistency_4W')} as Final_Score, {_blend('Score_Consistency_4W')} as Confidence_Adjusted_Score from c6),
c8 as (select *, round(Confidence_Adjusted_Score, 10) as cas10, lower(trim(Opportunity_Eligible)) = 'yes' as elig from c7),
scores as (select *, row_number() over (partition by Date order by cas10 desc nulls last, Symbol) as Rank, row_number() over (partition by Date, Universe_Group order by cas10 desc nulls last, Symbol) as Group_Rank,
  case when elig then row_number() over (partition by Date, elig order by cas10 desc nulls last, Symbol) end as Opportunity_Rank, row_number() over (partition by Date order by round(Final_Score, 10) desc nulls last, Symbol) as Raw_Score_Rank from c8)"""

MATURED = f"""{SCORES},
px as (select Symbol, Date, Price, lead(Date, 5) over w as d5, lead(Price, 5) over w as p5, lead(Date, 10) over w as d10, lead(Price, 10) over w as p10, lead(Date, 21) over w as d21, lead(Price, 21) over w as p21 from bars window w as (partition by Symbol order by Date)),
sig as (select *, case when etf then (case when Avg_Traded_Value_20D is null then 0.005 when Avg_Traded_Value_20D < 2e7 then 0.01 when Avg_Traded_Value_20D < 1e8 then 0.005 else 0.0025 end) when lower(Universe) = 'stock' then 0.0035 else 0.003 end::double as cost from scores),
matured as (select sig.Symbol, sig.Date as Signal_Date, h.h as Horizon_Days, px.Date as Entry_Date, case h.h when 5 then d5 when 10 then d10 else d21 end as Exit_Date,
  (case h.h when 5 then p5 when 10 then p10 else p21 end) / nullif(px.Price, 0) - 1 as Gross_Forward_Return, cost as Round_Trip_Cost, (case h.h when 5 then p5 when 10 then p10 else p21 end) / nullif(px.Price, 0) - 1 - cost as Net_Forward_Return,
  Confidence_Adjusted_Score, Final_Score, Universe, Opportunity_Eligible, case when (case h.h when 5 then p5 when 10 then p10 else p21 end) is null then 'Forward bar not available yet' end as Reason
  from sig join px on sig.Symbol = px.Symbol and sig.Date = px.Date cross join (select unnest([5, 10, 21])::bigint as h) h)"""
DETAIL = f"""{MATURED},
b0 as (select *, count(*) over (partition by Signal_Date, Horizon_Days) as n, row_number() over (partition by Signal_Date, Horizon_Days order by round(Confidence_Adjusted_Score, 10) desc, Symbol) as r,
  row_number() over (partition by Signal_Date, Horizon_Days order by round(Confidence_Adjusted_Score, 10) asc, Symbol) as up from matured where Net_Forward_Return is not null and Confidence_Adjusted_Score is not null and lower(trim(Opportunity_Eligible)) = 'yes'),
detail as (select *, r as Score_Rank_On_Date, 1 - (r - 1) / (n - 1)::double as Score_Percentile_On_Date, case when r <= 5 then 'Top 5' when r <= 10 then 'Top 6-10' when r <= 25 then 'Top 11-25' else 'Other' end as Bucket_TopN,
  greatest(1, ceil((up - 1) * 10 / (n - 1)::double))::bigint as Score_Decile, greatest(1, ceil((up - 1) * 5 / (n - 1)::double))::bigint as Score_Quintile from b0 where n >= 10)"""
SPREADS = f"""{DETAIL},
sp0 as (select Signal_Date, Horizon_Days, avg(Net_Forward_Return) as All_Avg, avg(Net_Forward_Return) filter (Score_Quintile = 5) as Top_Quintile, avg(Net_Forward_Return) filter (Score_Quintile = 1) as Bottom_Quintile,
  avg(Net_Forward_Return) filter (r <= 10) as Top10, avg(Net_Forward_Return) filter (r <= 25) as Top25, count(*) as Obs_All, count(*) filter (Score_Quintile = 5) as Obs_Top, count(*) filter (Score_Quintile = 1) as Obs_Bottom from detail group by 1, 2),
spreads as (select *, Top_Quintile - Bottom_Quintile as TopMinusBottom, Top10 - All_Avg as Top10MinusAll, Top25 - All_Avg as Top25MinusAll from sp0)"""
BOOT = f"""{SPREADS},
vals as (select Horizon_Days, TopMinusBottom as v, row_number() over (partition by Horizon_Days order by Signal_Date) - 1 as i, count(*) over (partition by Horizon_Days) as n from spreads where TopMinusBottom is not null),
draws as (select Horizon_Days, b, ('0x' || substr(md5(b || '-' || i || '-' || (42 + Horizon_Days)), 1, 8))::bigint % n as j from vals cross join (select unnest(range(2000)) as b) where n >= 2),
means as (select d.Horizon_Days, d.b, avg(v.v) as m from draws d join vals v on d.Horizon_Days = v.Horizon_Days and d.j = v.i group by 1, 2),
boot as (select Horizon_Days, avg(m) as Boot_Mean, quantile_cont(m, 0.05) as Boot_P5, quantile_cont(m, 0.95) as Boot_P95, avg(case when m > 0 then 1.0::double else 0.0 end) as Boot_Prob_Positive from means group by 1)"""
SUMMARY = f"""{BOOT},
gaps as (select Horizon_Days, quantile_cont(g, 0.5) as Gap_Days from (select Horizon_Days, date_diff('day', lag(Signal_Date) over (partition by Horizon_Days order by Signal_Date), Signal_Date) as g from spreads) group by 1),
u0 as (select Horizon_Days, count(TopMinusBottom) as Validation_Dates, avg(TopMinusBottom) as Avg_Spread, quantile_cont(TopMinusBottom, 0.5) as Median_Spread, stddev_samp(TopMinusBottom) as Std_Spread,
  avg(case when TopMinusBottom > 0 then 1.0::double when TopMinusBottom is not null then 0.0 end) as Hit_Rate, avg(Top10MinusAll) as Avg_Top10MinusAll, avg(case when Top10MinusAll > 0 then 1.0::double else 0.0 end) as Hit_Top10,
  avg(Top25MinusAll) as Avg_Top25MinusAll, avg(case when Top25MinusAll > 0 then 1.0::double else 0.0 end) as Hit_Top25, avg(Obs_All) as Avg_Obs from spreads group by 1),
u1 as (select *, case when Gap_Days > 0 then greatest(1.0::double, Horizon_Days / Gap_Days) else 1.0 end as Overlap_Factor from u0 left join gaps using (Horizon_Days) left join boot using (Horizon_Days)),
u2 as (select *, Validation_Dates / Overlap_Factor as Effective_Dates from u1),
summary as (select *, case when Std_Spread > 0 then Avg_Spread / (Std_Spread / sqrt(Validation_Dates)) end as TStat, case when Effective_Dates > 1 and Std_Spread > 0 then Avg_Spread / (Std_Spread / sqrt(Effective_Dates)) end as Adjusted_TStat from u2),
shrunk as (select *, round((10 + Hit_Rate * floor(Effective_Dates)) / (20 + floor(Effective_Dates)), 6) as Shrunk_Hit, round(Adjusted_TStat * (floor(Effective_Dates) / (20 + floor(Effective_Dates))), 6) as Shrunk_T,
  round(Avg_Spread * (floor(Effective_Dates) / (20 + floor(Effective_Dates))), 6) as Shrunk_Spread from summary),
v0 as (select *, case when Validation_Dates < 10 then 'Insufficient History' when Effective_Dates < 6 then 'Insufficient Independent History' when Avg_Obs < 50 then 'Insufficient Breadth'
  when Shrunk_Spread is null or Shrunk_Hit is null or Shrunk_T is null or Boot_Prob_Positive is null then 'Insufficient Statistical Evidence'
  when Shrunk_Spread >= 0.005 and Shrunk_Hit >= 0.55 and Shrunk_T >= 1.5 and Boot_Prob_Positive >= 0.7 then 'Validation Positive' when Shrunk_Spread <= -0.005 and Shrunk_T <= 0 then 'Validation Negative' else 'No Proven Edge Yet' end as Verdict from shrunk),
verdicts as (select *, case when Verdict like 'Insufficient%' then 'Insufficient Evidence' when Verdict = 'Validation Positive' then (case when Effective_Dates >= 20 and Shrunk_T >= 2 then 'Strong Evidence' else 'Moderate Evidence' end) else 'Weak or Negative Evidence' end as Evidence_Grade from v0)"""


def over(n: int, agg: str, to: int = 0) -> str:
    return f"{agg} {_w(n, to)}"


ALPHA_BARS = f"""{BARS},
a0 as (select *, row_number() over w as n, Close / lag(Close) over w - 1 as ret, Open / lag(Close) over w - 1 as gap, sign(Close - lag(Close) over w) * Volume as signed,
  coalesce((2 * Close - High - Low) / nullif(High - Low, 0), 0) * Volume as flow from bars window w as (partition by Symbol order by Date)),
a as (select *, abs(ret) / nullif(Close * Volume, 0) as illiquid, sum(coalesce(signed, 0)) over (partition by Symbol order by Date rows between unbounded preceding and current row) as obv from a0)"""
_SLOPE20 = "case when isnan({0}) then null else {0} end"
ALPHAS = {
    "mom_12_1": (252, f"{lag('Close', 20)} / nullif({lag('Close', 251)}, 0) - 1"),
    "high_52w": (60, f"1 - ({over(252, 'max(Close)')} - Close) / nullif({over(252, 'max(Close)')}, 0)"),
    "amihud": (25, f"-{over(20, 'avg(illiquid)')}"),
    "obv_slope": (25, f"{_SLOPE20.format(over(20, 'regr_slope(obv, n)'))} / greatest(abs({over(20, 'avg(obv)')}), 1.0)"),
    "chaikin_mf": (21, f"{over(20, 'sum(flow)')} / nullif({over(20, 'sum(Volume)')}, 0)"),
    "mean_rev_z": (25, f"-(Close - {over(20, 'avg(Close)')}) / nullif({over(20, 'stddev_pop(Close)')}, 0)"),
    "breakout": (25, f"(Close - {over(20, 'max(Close)', -1)}) / nullif({over(20, 'avg(High - Low)')}, 0)"),
    "gap": (25, over(20, "median(gap)")),
    "vol_term": (65, f"-({over(20, 'stddev_pop(ret)')} / nullif({over(60, 'stddev_pop(ret)')}, 0))"),
    "low_vol": (60, f"-{over(60, 'stddev_pop(ret)')}"),
    "dd_recovery": (60, f"1 - ({over(60, 'max(Close)')} - Close) / nullif({over(60, 'max(Close)')}, 0)"),
    "up_ratio": (15, over(21, "avg(case when ret > 0 then 1.0::double when ret is not null then 0.0 end)")),
    "quiet_uptrend": (20, f"{_SLOPE20.format(over(20, 'regr_slope(Close, n)'))} / nullif({over(20, 'stddev_pop(Close)')}, 0)"),
    "volume_surge": (60, f"{over(5, 'avg(Volume)')} / nullif({over(60, 'avg(Volume)')}, 0)"),
    "over_ma50": (50, f"Close / nullif({over(50, 'avg(Close)')}, 0) - 1"),
}


def alpha(name: str) -> str:
    least, x = ALPHAS[name]
    return f"with {ALPHA_BARS} select Date, Symbol, {r4x('value')} as value from (select Date, Symbol, case when n >= {least} then {x} end as value from a) where value is not null"


PANEL = f"{ALPHA_BARS}, panel as (" + " union all ".join(f"select Date, Symbol, '{k}' as alpha, value from (select Date, Symbol, case when n >= {m} then {x} end as value from a) where value is not null" for k, (m, x) in ALPHAS.items()) + ")"
