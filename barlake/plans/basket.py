"""Registered queries of the backtest and of baskets: sizes, diversification, events, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.operators import backtest, portfolio, scoring, tradeplan, validation
from barlake.plans import sql, trade
from barlake.plans.books import PLAN, _CANON
from barlake.plans.more import _FLOWS, AS_OF
from barlake.plans.queries import all_scores, matured, r4, register, table

_STYLE = f"""t0 as (select *, {sql.change('Close', 21)} as r21, {sql.change('Close', 63)} as r63, {sql.change('Close')} as r1 from bars),
t1 as (select *, 1 / nullif({sql.rolling('stddev_pop(r1)', 'r1', 20, 20)}, 0) as iv from t0),
t2 as (select Date, Symbol, [({sql.pr('r21', 'Date')} - 0.5) * 2, ({sql.pr('r63', 'Date')} - 0.5) * 2, ({sql.pr('iv', 'Date')} - 0.5) * 2] as p from t1),
style as (select Date, Symbol, list_avg(list_filter(p, lambda x: x is not null)) as Style_Score from t2 where len(list_filter(p, lambda x: x is not null)) > 0)"""
EVENTS = f"""{sql.BARS}, {_STYLE}, cal as (select Date, row_number() over (order by Date) - 1 as i, count(*) over () as n from (select distinct Date from bars)),
reb as (select Date, i from cal where n >= 270 and i >= n - 250 and i < n - 10 and (i - n + 250) % 5 = 0),
pk as (select style.*, reb.i, row_number() over (partition by Date order by round(Style_Score, 10) desc, Symbol) as place from style join reb using (Date)),
dt as (select Symbol, i, Close from bars join cal using (Date)),
me as (select pk.Date, pk.Symbol, place, l.Close / nullif(d.Close, 0) - 1 as ret from pk join dt d on d.Symbol = pk.Symbol and d.i = pk.i left join dt l on l.Symbol = pk.Symbol and l.i = pk.i + 10 where place <= 5),
bn as (select Date, lead(Benchmark_Close, 10) over (order by Date) / nullif(Benchmark_Close, 0) - 1 as Benchmark from bench),
ev as (select Date, string_agg(Symbol, ',' order by place) as Picks, avg(ret) as Top5_EW, max(case when place = 1 then ret end) as Top1 from me group by 1), events_ as (select ev.*, Benchmark from ev left join bn using (Date))"""
_LONG = "lo as (select Date, Benchmark, unnest(['Top5_EW', 'Top1', 'Benchmark']) as Variant, unnest([Top5_EW, Top1, Benchmark]) as s from events_)"
CARD = f"""{EVENTS}, {_LONG}, e0 as (select *, exp(sum(ln(1 + s)) over (partition by Variant order by Date)) as e from lo where s is not null), e1 as (select *, e / max(e) over (partition by Variant order by Date) - 1 as d from e0),
card as (select Variant, count(*) as N_Rebalances, avg(case when s > 0 then 1.0::double else 0.0 end) as Hit_Rate, avg(case when s > 0 then s end) as Avg_Win, avg(case when s < 0 then s end) as Avg_Loss, avg(s) / nullif(stddev_pop(s), 0) * sqrt(25.2) as Sharpe,
  case when count(case when s < 0 then 1 end) > 1 then avg(s) / nullif(stddev_pop(case when s < 0 then s end), 0) * sqrt(25.2) end as Sortino, min(d) as Max_Drawdown, avg(s - Benchmark) * 25.2 as Annual_Excess, -avg(case when s > 0 then s end) / avg(case when s < 0 then s end) as Payoff from e1 group by 1)"""


def _events(spark, sf_dir):
    b = panel.bars(spark, sf_dir)
    return backtest.backtest_events(b, panel.benchmark(b))


@register("backtest_events", f"with {EVENTS} select Date, Picks, {sql.r4(*backtest.VARIANTS)} from events_")
def backtest_events(spark, sf_dir):
    return _events(spark, sf_dir).select("Date", "Picks", *r4(*backtest.VARIANTS))


_CARD = ("Hit_Rate", "Avg_Win", "Avg_Loss", "Sharpe", "Sortino", "Max_Drawdown", "Annual_Excess", "Payoff")


@register("backtest_scorecard", f"with {CARD} select Variant, N_Rebalances, {sql.r4(*_CARD)} from card")
def backtest_scorecard(spark, sf_dir):
    return backtest.backtest_scorecard(_events(spark, sf_dir)).select("Variant", "N_Rebalances", *r4(*_CARD))


@register("equity_curve", f"with {EVENTS}, {_LONG} select Variant, Date, {sql.r4x('exp(sum(ln(1 + coalesce(s, 0))) over (partition by Variant order by Date))')} as Equity from lo")
def equity_curve(spark, sf_dir):
    return backtest.equity_curve(_events(spark, sf_dir)).select("Variant", "Date", *r4("Equity"))


@register("expected_value", f"""with {sql.MATURED}, x as (select Net_Forward_Return as x from matured where Horizon_Days = 10 and upper(Universe) = 'STOCK'),
a as (select count(x) as N, avg(case when x > 0 then 1.0::double when x is not null then 0.0 end) as P_Win, coalesce(avg(case when x > 0 then x end), 0) as Avg_Win, coalesce(abs(avg(case when x <= 0 then x end)), 0) as Avg_Loss from x),
e as (select *, case when N >= 30 then P_Win * Avg_Win - (1 - P_Win) * Avg_Loss end as EV_Per_Trade from a)
select N, {sql.r4('P_Win', 'Avg_Win', 'Avg_Loss', 'EV_Per_Trade')}, round(EV_Per_Trade / 10 + 0.00000137::double, 4) as EV_Per_Day, case when N < 30 then 'EV unavailable - too few observations' else 'EV computed from validated filtered forward returns' end as Status from e""")
def expected_value(spark, sf_dir):
    """As if validation were positive: the statistic itself is compared."""
    ev = backtest.expected_value(matured(spark, sf_dir), "Validation Positive", filters={"Universe": "stock"})
    return ev.select("N", *r4("P_Win", "Avg_Win", "Avg_Loss", "EV_Per_Trade", "EV_Per_Day"), "Status")


_PICKS = "picks as (select Date, Symbol, Price, Sector, Confidence_Adjusted_Score as Score, Opportunity_Rank as Place from scores where Date = (select max(Date) from scores) and Opportunity_Rank <= {n})"
_SIGMA = f"""v0 as (select Symbol, Date, {sql.change('Close')} as r from bars), v1 as (select *, row_number() over (partition by Symbol order by Date desc) as k from v0 where r is not null and Symbol in (select Symbol from picks)), sigma as (select Symbol, stddev_pop(r) * sqrt(252.0) as Sigma from v1 where k <= 63 group by 1)"""
_SIZED = f"""{_SIGMA}, w0 as (select picks.*, 1 / nullif(Sigma, 0) as i from picks left join sigma using (Symbol)), w1 as (select *, least(i / sum(i) over (), 0.3::double) as c, sum(i) over () as si from w0),
w2 as (select *, coalesce(case when si is null then 1 / count(*) over ()::double else c / sum(c) over () end, 0) as Weight from w1), sized as (select *, Weight * 900000 as Capital, case when Price > 0 then floor(Weight * 900000 / Price + 0.5) end as Shares, Weight * 900000 * 0.05 as Max_Loss, Weight * 900000 * 0.05 / 1000000 * 100 as Max_Loss_Pct from w2)"""


def picks(spark, sf_dir, n: int = 5):
    """The first n of the last date."""
    scored = table(all_scores(spark, sf_dir, "Price", "Sector").select("Date", "Symbol", "Price", "Sector", F.col("Confidence_Adjusted_Score").alias("Score"), F.col("Opportunity_Rank").alias("Place")), "ranks")
    return on_last_date(scored, scored).where(F.col("Place") <= n)


def on_last_date(rows, dates):
    """The rows of the last of the dates."""
    last = dates.agg(F.max("Date").alias("_last"))
    return rows.join(F.broadcast(last), F.col("Date") == F.col("_last")).drop("_last")


def _sized(spark, sf_dir, some):
    return backtest.position_sizing(some, backtest.volatility_63(panel.bars(spark, sf_dir), some))


@register("position_sizing", f"with {sql.SCORES}, {_PICKS.format(n=5)}, {_SIZED} select Symbol, {sql.r4('Weight', 'Capital', 'Shares', 'Max_Loss', 'Max_Loss_Pct')} from sized")
def position_sizing(spark, sf_dir):
    return sizes(_sized(spark, sf_dir, table(picks(spark, sf_dir), "picks")))


def sizes(sized):
    return sized.select("Symbol", *r4("Weight", "Capital", "Shares", "Max_Loss", "Max_Loss_Pct"))


_CORR = """k0 as (select Symbol, Date, Close / nullif(lag(Close) over (partition by Symbol order by Date), 0) - 1 as ret, row_number() over (partition by Symbol order by Date desc) as k from bars), k1 as (select *, count(*) over (partition by Symbol) as n from k0 where k <= 60 and ret is not null and Symbol in (select Symbol from picks)), k2 as (select * from k1 where n >= 30),
corr0 as (select a.Symbol as Symbol_A, b.Symbol as Symbol_B, corr(a.ret, b.ret) as c from k2 a join k2 b on a.Date = b.Date and a.Symbol < b.Symbol group by 1, 2), corrs as (select Symbol_A, Symbol_B, case when c is null or isnan(c) then 0.0::double else c end as corr from corr0)"""


@register("pairwise_corr", f"with {sql.SCORES}, {_PICKS.format(n=25)}, {_CORR} select Symbol_A, Symbol_B, {sql.r4('corr')} from corrs")
def pairwise_corr(spark, sf_dir):
    """Of the first 25 of the last date."""
    return portfolio.pairwise_corr(panel.bars(spark, sf_dir), picks(spark, sf_dir, 25)).select("Symbol_A", "Symbol_B", *r4("corr"))


@register("avg_abs_offdiag", f"with {sql.SCORES}, {_PICKS.format(n=25)}, {_CORR} select count(*) as Pairs, {sql.r4x('avg(abs(corr))')} as Avg_Abs_Corr from corrs")
def avg_abs_offdiag(spark, sf_dir):
    return portfolio.avg_abs_offdiag(portfolio.pairwise_corr(panel.bars(spark, sf_dir), picks(spark, sf_dir, 25))).select("Pairs", *r4("Avg_Abs_Corr"))


_STEP = """near{k} as (select Symbol, max(c) as c from both_ where Other in (select Symbol from pick{j}) group by 1),
pick{k} as (select * from pick{j} union all select Symbol, {k} as Pick from (select p.Symbol, row_number() over (order by round(0.5 * Score / (select max(Score) from picks) - 0.5 * coalesce(c, 0), 10) desc, p.Symbol) as o from picks p left join near{k} using (Symbol) where p.Symbol not in (select Symbol from pick{j})) where o = 1)"""
_GREEDY = f"""both_ as (select Symbol_A as Symbol, Symbol_B as Other, abs(corr) as c from corrs union all select Symbol_B, Symbol_A, abs(corr) from corrs), pick1 as (select Symbol, 1 as Pick from (select Symbol, row_number() over (order by round(Score, 10) desc, Symbol) as o from picks where Score is not null) where o = 1), {', '.join(_STEP.format(k=k, j=k - 1) for k in range(2, 6))}"""


@register("diversified_top_n", f"with {sql.SCORES}, {_PICKS.format(n=25)}, {_CORR}, {_GREEDY} select Symbol, Pick::bigint as Pick from pick5")
def diversified_top_n(spark, sf_dir):
    some = table(picks(spark, sf_dir, 25), "picks")
    corr = table(portfolio.pairwise_corr(panel.bars(spark, sf_dir), some), "corr")
    return backtest.diversified_top_n(some, corr)


@register("risk_parity")
def risk_parity(spark, sf_dir):
    some = table(picks(spark, sf_dir), "picks")
    b = panel.bars(spark, sf_dir)
    return backtest.risk_parity(some, backtest.volatility_63(b, some), portfolio.pairwise_corr(b, some))


@register("ev_kelly", f"""with {sql.SCORES}, {_PICKS.format(n=5)}, {_SIZED}, {CARD.replace(sql.BARS + ',', '').strip()}, one as (select Hit_Rate as p, Avg_Win as w, abs(Avg_Loss) as l from card where Variant = 'Top5_EW'),
k as (select Symbol, Weight, p * w - (1 - p) * l as edge, greatest(0.0::double, (p * w - (1 - p) * l) / greatest(l * w, 1e-9)) as raw from sized left join one on true)
select Symbol, {sql.r4x('edge')} as EV, {sql.r4x('case when edge is not null then raw end')} as Kelly_Raw, {sql.r4x('case when edge is not null and Weight is not null then least(raw, 0.25 * Weight) end')} as Kelly_Capped, case when edge is null or Weight is null then '' when edge > 0 and Weight > 0 then 'Consistent' when Weight > 0 then 'Inconsistent - EV<=0 but sized' else 'Neutral' end as Agreement, 'Decision_Input' as Decision_Use from k""")
def ev_kelly(spark, sf_dir):
    """As if validation were positive: the fractions themselves are compared."""
    return fractions(spark, sf_dir, _sized(spark, sf_dir, table(picks(spark, sf_dir), "picks")))


def fractions(spark, sf_dir, sized):
    return backtest.ev_kelly(sized, backtest.backtest_scorecard(table(_events(spark, sf_dir), "events")), "Validation Positive").select("Symbol", *r4("EV", "Kelly_Raw", "Kelly_Capped"), "Agreement", "Decision_Use")


_EARN = "earn as (select 'S' || l_suppkey as Symbol, max(l_shipdate::date) - 45 + (l_suppkey % 97)::int as Next_Earnings from lineitem where l_suppkey % 8 != 0 group by l_suppkey)"


def earnings(spark, sf_dir):
    """The last ship date of a supplier, moved by its key; every eighth has none."""
    line = panel.table(spark, sf_dir, "lineitem").where("l_suppkey % 8 != 0")
    return line.groupBy("l_suppkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("d")).select(panel.symbol("l_suppkey").alias("Symbol"), F.date_add(F.date_sub("d", 45), (F.col("l_suppkey") % 97).cast("int")).alias("Next_Earnings"))


LAST = "2001-11-05"
_CAL = f"""cal_ as (select m.Symbol, Next_Earnings, date_diff('day', date '{LAST}', Next_Earnings) as Days from (select 'S' || s_suppkey as Symbol from supplier) m left join earn using (Symbol)),
evc as (select *, case when Days is null then 'Unknown' when Days between -2 and 12 and Days < 0 then 'Post_Earnings' when Days between -2 and 12 then 'In_Window' when Days > 0 and Days <= 30 then 'Pre_Earnings' when Days < 0 and Days >= -30 then 'Post_Earnings' else 'Clear' end as Event_Risk from cal_)"""


@register("event_calendar", f"with {_EARN}, {_CAL} select Symbol, Next_Earnings, Days, Event_Risk from evc")
def event_calendar(spark, sf_dir):
    return backtest.event_calendar(panel.master(spark, sf_dir), earnings(spark, sf_dir), LAST)


@register("event_ev_merge", f"with {_EARN}, {_CAL}, d as (select 'S' || user_id as Symbol, round(sum(value), 4) as EV from events where event_type = 'purchase' group by user_id) select Symbol, Event_Risk, {sql.r4('EV')} from (select Symbol, Event_Risk from evc where Event_Risk != 'Clear') e full join d using (Symbol)")
def event_ev_merge(spark, sf_dir):
    """Events that are not clear, with each user's purchases as values."""
    e = panel.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    value = e.groupBy(panel.symbol("user_id").alias("Symbol")).agg(F.round(F.sum("value"), 4).alias("EV"))
    risk = event_calendar(spark, sf_dir).where("Event_Risk != 'Clear'").select("Symbol", "Event_Risk")
    return backtest.event_ev_merge(risk, value).select("Symbol", "Event_Risk", *r4("EV"))


_DEALS = f"""d as (select 'S' || (user_id % 100) as Symbol, ts::date as Date, case when event_type = 'error' then 'S' else 'B' end as side, value / 10.0 as v from events where event_type in ('purchase', 'signup', 'error')),
g as (select Symbol, coalesce(sum(v) filter (side = 'B'), 0) - coalesce(sum(v) filter (side = 'S'), 0) as gap from d where Date >= date '{AS_OF}' - 20 group by 1)"""


@register("flow_confirmation", f"""with {_DEALS}, {_FLOWS}, r as (select case when FII_Net_5D > 500 then 'Net_Buying' when FII_Net_5D < -500 then 'Net_Selling' else 'Mixed' end as r from fr where Date = (select max(Date) from fr)),
m as (select 'S' || s_suppkey as Symbol, case when gap > 0.5 then 'Buy' when gap < -0.5 then 'Sell' when gap is not null then 'None' else 'Unknown' end as f, (select r from r) as r from supplier left join g on g.Symbol = 'S' || s_suppkey)
select Symbol, case when f = 'Buy' and r = 'Net_Buying' then 'Yes' when f = 'Sell' or r = 'Net_Selling' then 'No' when f = 'Unknown' and r = 'Unknown' then 'Unknown' else 'Mixed' end as Institutional_Confirmation from m""")
def flow_confirmation(spark, sf_dir):
    regime = portfolio.flow_regime(panel.flows(spark, sf_dir)).orderBy(F.col("Date").desc()).first()
    net = portfolio.bulk_deal_net(panel.deals(spark, sf_dir), AS_OF, 20, unit=10.0)
    return portfolio.flow_confirmation(panel.master(spark, sf_dir), net, regime.FII_Regime if regime else "Unknown")


@register("top5_alignment", f"""with {PLAN}, a as (select Date, row_number() over (partition by Date order by round(Confidence_Adjusted_Score, 10) desc, Symbol) as Place, Symbol from scores where elig), k as (select *, {_CANON} as Place from plan where Trade_Status not like 'Avoid%'),
la as (select Date, list(Symbol order by Place) as a from a where Place <= 5 group by 1), lb as (select Date, list(Symbol order by Place) as b from k where Place <= 5 group by 1)
select Date, coalesce(list_sort(a) = list_sort(b), false) as Aligned, coalesce(list_sort(a) = list_sort(b) and a = b, false) as Same_Order from la full join lb using (Date)""")
def top5_alignment(spark, sf_dir):
    scored = trade.scored(spark, sf_dir)
    p = trade.planned(scored, trade.verdicts(spark, sf_dir, scored))
    return backtest.top5_alignment(scoring.top_official(scored), tradeplan.official_top5(p)).select("Date", "Aligned", F.coalesce("Same_Order", F.lit(False)).alias("Same_Order"))


@register("portfolio_gate", f"""with {sql.SCORES}, {_PICKS.format(n=5)}, {_SIZED}, {_CORR}, {CARD.replace(sql.BARS + ',', '').strip()}, {_EARN}, {_CAL},
x as (select (select avg(abs(corr)) from corrs) as corr, (select sum(Max_Loss_Pct) from sized) as loss, (select count(*) from sized) as n, (select max(w) from (select Sector, sum(Weight) * 100 as w from sized where Sector is not null group by 1)) as sector, (select Hit_Rate from card where Variant = 'Top5_EW') as hit, (select count(*) from evc e join picks using (Symbol) where Event_Risk = 'In_Window') as inside),
g as (select concat_ws('; ', case when corr > 0.6 then 'average |corr| too high' end, case when loss > 3 then 'sum of losses too high' end, case when hit < 0.45 then 'backtest hit rate too low' end, case when n = 0 or corr is null or hit is null then 'missing evidence' end) as Reasons,
  concat_ws('; ', case when sector > 40 then 'sector concentration' end, 'few alpha survivors', case when inside >= 2 then 'earnings inside hold window' end) as Caveats from x)
select Reasons, Caveats, case when Reasons != '' then 'Downgrade_To_Watch' when Caveats != '' then 'Ship_With_Caveats' else 'Ship' end as Verdict from g""")
def portfolio_gate(spark, sf_dir):
    """The last date's basket, as if validation were positive, with no surviving factor and a neutral regime."""
    some = table(picks(spark, sf_dir), "picks")
    b = panel.bars(spark, sf_dir)
    sized = table(_sized(spark, sf_dir, some).drop("Sector"), "sized")
    card = backtest.backtest_scorecard(table(_events(spark, sf_dir), "events"))
    events = backtest.event_calendar(some, earnings(spark, sf_dir), LAST)
    return backtest.portfolio_gate(portfolio.pairwise_corr(b, some), sized, panel.master(spark, sf_dir), card, some.limit(0), "neutral", events, "Validation Positive")


@register("hold_horizon", f"""with {sql.BARS}, h0 as (select Symbol, Date, Price, row_number() over (partition by Symbol order by Date desc) as k from bars), h1 as (select * from h0 where k <= 320),
h2 as (select Symbol, {', '.join(f'Price / lag(Price, {h}) over w - 1 as r{h}' for h in (1, 3, 5, 10, 21, 42, 63))} from h1 window w as (partition by Symbol order by Date)),
h3 as (select Symbol, unnest([1, 3, 5, 10, 21, 42, 63]) as h, unnest([{', '.join(f'r{h}' for h in (1, 3, 5, 10, 21, 42, 63))}]) as r from h2),
h4 as (select Symbol, h, count(r) as N, quantile_cont(r, 0.5) as Median, quantile_cont(r, 0.25) as Q25, quantile_cont(r, 0.75) as Q75, stddev_pop(r) as sd, case when count(case when r < 0 then 1 end) > 3 then stddev_pop(case when r < 0 then r end) else stddev_pop(r) end as down, min(r) as Worst from h3 where r is not null group by 1, 2),
h5 as (select a.*, o.sd * sqrt(a.h) as Vol, o.down * sqrt(a.h) as Downside, a.Median / (abs(o.down * sqrt(a.h)) + 1e-6) as Sharpe_Like from h4 a join h4 o on o.Symbol = a.Symbol and o.h = 1 where a.h > 1)
select Symbol, h::bigint as Horizon, N, {sql.r4('Median', 'Q25', 'Q75', 'Vol', 'Downside', 'Worst', 'Sharpe_Like')}, row_number() over (partition by Symbol order by (Downside <= 0.06)::int desc, round(Sharpe_Like, 10) desc, h) = 1 as Best from h5""")
def hold_horizon(spark, sf_dir):
    from barlake.operators import signals

    return signals.hold_horizon(panel.bars(spark, sf_dir)).select("Symbol", "Horizon", "N", *r4("Median", "Q25", "Q75", "Vol", "Downside", "Worst", "Sharpe_Like"), "Best")


@register("asof_overlay", f"""with {sql.BARS}, o as (select 'S' || (user_id % 100) as Symbol, ts::date - 8000 as Date, max(value) as Deal_Price from events where event_type in ('purchase', 'signup', 'error') group by 1, 2)
select b.Symbol, b.Date, {sql.r4('Deal_Price')} from bars b asof left join o on o.Symbol = b.Symbol and o.Date <= b.Date""")
def asof_overlay(spark, sf_dir):
    from barlake.operators import alphas

    overlay = panel.deals(spark, sf_dir).groupBy("Symbol", F.date_sub("Date", 8000).alias("Date")).agg(F.max("Price").alias("Deal_Price"))
    return alphas.asof_overlay(panel.bars(spark, sf_dir), overlay, "Deal_Price").select("Symbol", "Date", *r4("Deal_Price"))
