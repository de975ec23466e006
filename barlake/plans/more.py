"""Registered queries of factor evaluation, portfolio, changes, news and incremental tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.operators import alphas, changes, evaluation, news, portfolio, signals
from barlake.plans import sql
from barlake.plans.queries import all_scores, r4, register, scores_table, table
from barlake.sources import tables

AS_OF = "2024-01-30"
#: Polarity of a few words of the headlines. Fixed values.
LEXICON = (("the", 1.0), ("and", -1.0), ("les", 0.5), ("und", -0.5), ("que", 0.8))

FORWARD = f"""{sql.PANEL},
cal as (select Date, row_number() over (order by Date) as idx from (select distinct Date from bars)),
dated as (select Symbol, Date, Close, idx from bars join cal using (Date)),
fwd as (select d.Date, d.Symbol, h.h as horizon, l.Close / nullif(d.Close, 0) - 1 as fwd from dated d cross join (select unnest([5, 10, 21])::bigint as h) h join dated l on l.Symbol = d.Symbol and l.idx = d.idx + h.h)"""
_KEYS = ("Date", "alpha", "horizon")
IC = f"""{FORWARD},
paired as (select Date, Symbol, alpha, value, horizon, fwd from panel join fwd using (Date, Symbol) where fwd is not null),
ranked as (select Date, alpha, horizon, {sql.pr('value', *_KEYS)} as ra, {sql.pr('fwd', *_KEYS)} as rf from paired),
ic0 as (select Date, alpha, horizon, corr(ra, rf) as ic, count(*) as n from ranked group by 1, 2, 3),
ic as (select * from ic0 where n >= 8 and ic is not null and not isnan(ic))"""
REPORT = f"""{IC},
rep0 as (select alpha, horizon, count(*) as n_dates, avg(ic) as m, stddev_samp(ic) as s, count(*) filter (round(ic, 10) > 0) as up, count(*) filter (round(ic, 10) < 0) as down from ic group by 1, 2),
report as (select alpha, horizon, n_dates, case when n_dates >= 3 then m end as mean_ic, case when n_dates >= 3 then s end as std_ic, case when n_dates >= 3 and s > 0 then m / (s / sqrt(n_dates)) end as t_stat,
  case when n_dates >= 3 then (case when round(m, 10) > 0 then up / n_dates::double when round(m, 10) < 0 then down / n_dates::double else 0.5 end) end as hit_rate from rep0)"""


def factors(spark, sf_dir, names=tuple(alphas.REGISTRY), horizons=(5, 10, 21)):
    """(Date, Symbol, a column a factor, fwd_h) of every bar."""
    b = table(panel.bars(spark, sf_dir), "bars")
    return alphas.alpha_columns(evaluation.forward_columns(b, horizons), names, tuple(f"fwd_{h}" for h in horizons))


def _ic(spark, sf_dir):
    return evaluation.spearman_ic(factors(spark, sf_dir), tuple(alphas.REGISTRY))


@register("forward_returns_panel", f"with {FORWARD} select Date, Symbol, horizon, {sql.r4('fwd')} from fwd")
def forward_returns_panel(spark, sf_dir):
    return evaluation.forward_returns_panel(panel.bars(spark, sf_dir)).select("Date", "Symbol", "horizon", *r4("fwd"))


@register("spearman_ic", f"with {IC} select Date, alpha, horizon, n, {sql.r4('ic')} from ic")
def spearman_ic(spark, sf_dir):
    return _ic(spark, sf_dir).select("Date", "alpha", "horizon", "n", *r4("ic"))


@register("ic_report", f"with {REPORT} select alpha, horizon, n_dates, {sql.r4('mean_ic', 'std_ic', 't_stat', 'hit_rate')} from report")
def ic_report(spark, sf_dir):
    return evaluation.ic_report(_ic(spark, sf_dir)).select("alpha", "horizon", "n_dates", *r4("mean_ic", "std_ic", "t_stat", "hit_rate"))


@register("promote_alphas", f"with {REPORT}, k as (select *, row_number() over (partition by alpha order by round(abs(mean_ic), 10) desc, round(abs(t_stat), 10) desc, horizon) as k from report where abs(mean_ic) >= 0.03 and abs(t_stat) >= 2) select alpha, horizon, {sql.r4('mean_ic', 't_stat')} from k where k = 1")
def promote_alphas(spark, sf_dir):
    return evaluation.promote_alphas(evaluation.ic_report(_ic(spark, sf_dir))).select("alpha", "horizon", *r4("mean_ic", "t_stat"))


_STYLE = f"""{sql.BARS}, t0 as (select *, {sql.change('Close', 21)} as r21, {sql.change('Close', 63)} as r63, {sql.change('Close')} as r1 from bars),
t1 as (select *, 1 / nullif({sql.rolling('stddev_pop(r1)', 'r1', 20, 20)}, 0) as iv from t0),
t2 as (select Date, Symbol, [({sql.pr('r21', 'Date')} - 0.5) * 2, ({sql.pr('r63', 'Date')} - 0.5) * 2, ({sql.pr('iv', 'Date')} - 0.5) * 2] as p from t1),
style as (select Date, Symbol, list_avg(list_filter(p, lambda x: x is not null)) as Style_Score from t2)"""


@register("style_score", f"with {_STYLE} select Date, Symbol, {sql.r4('Style_Score')} from style where Style_Score is not null")
def style_score(spark, sf_dir):
    return portfolio.style_score(panel.bars(spark, sf_dir)).select("Date", "Symbol", *r4("Style_Score"))


@register("pairwise_corr", f"""with {sql.BARS}, e0 as (select *, {sql.change('Close')} as ret, row_number() over (partition by Symbol order by Date desc) as k from bars),
e1 as (select *, count(*) over (partition by Symbol) as n from e0 where k <= 60 and ret is not null), e as (select * from e1 where n >= 30),
c as (select a.Symbol as Symbol_A, b.Symbol as Symbol_B, corr(a.ret, b.ret) as c from e a join e b on a.Date = b.Date and a.Symbol < b.Symbol group by 1, 2)
select Symbol_A, Symbol_B, {sql.r4x("case when c is null or isnan(c) then 0.0::double else c end")} as corr from c""")
def pairwise_corr(spark, sf_dir):
    b = panel.bars(spark, sf_dir)
    return portfolio.pairwise_corr(b, b).select("Symbol_A", "Symbol_B", *r4("corr"))


_FLOWS = """flows as (select ts::date as Date, round(sum(case event_type when 'purchase' then value when 'error' then -value else 0.0::double end), 6) as FII_Net, round(sum(case event_type when 'view' then value when 'click' then -value else 0.0::double end), 6) as DII_Net from events group by 1),
fr as (select Date, sum(FII_Net) over (order by Date rows between 4 preceding and current row) as FII_Net_5D, sum(DII_Net) over (order by Date rows between 4 preceding and current row) as DII_Net_5D from flows)"""


@register("flow_regime", f"with {_FLOWS} select Date, {sql.r4('FII_Net_5D', 'DII_Net_5D')}, case when FII_Net_5D > 500 then 'Net_Buying' when FII_Net_5D < -500 then 'Net_Selling' else 'Mixed' end as FII_Regime from fr")
def flow_regime(spark, sf_dir):
    return portfolio.flow_regime(panel.flows(spark, sf_dir)).select("Date", *r4("FII_Net_5D", "DII_Net_5D"), "FII_Regime")


@register("bulk_deal_net", f"""with d as (select 'S' || (user_id % 100) as Symbol, ts::date as Date, case when event_type = 'error' then 'S' else 'B' end as side, value / 10.0 as v from events where event_type in ('purchase', 'signup', 'error')),
g as (select Symbol, coalesce(sum(v) filter (side = 'B'), 0) as Buy_Value, coalesce(sum(v) filter (side = 'S'), 0) as Sell_Value, count(*) as N_Deals from d where Date >= date '{AS_OF}' - 20 group by 1)
select Symbol, {sql.r4('Buy_Value', 'Sell_Value')}, N_Deals, case when Buy_Value - Sell_Value > 0.5 then 'Buy' when Buy_Value - Sell_Value < -0.5 then 'Sell' else 'None' end as Net_Flag from g""")
def bulk_deal_net(spark, sf_dir):
    return portfolio.bulk_deal_net(panel.deals(spark, sf_dir), AS_OF, 20, unit=10.0).select("Symbol", *r4("Buy_Value", "Sell_Value"), "N_Deals", "Net_Flag")


_PREV = "prev as (select Date, lag(Date) over (order by Date) as pd from (select distinct Date from scores))"


@register("previous_snapshot", f"with {sql.BARS}, q as (select distinct Date from bars) select Date, lag(Date) over (order by Date) as Previous_Date from q")
def previous_snapshot(spark, sf_dir):
    return changes.previous_snapshot(panel.bars(spark, sf_dir))


@register("topn_entries_exits", f"""with {sql.SCORES}, {_PREV}, top as (select Date, Symbol from scores where Opportunity_Rank <= 20),
now as (select t.Date, t.Symbol from top t join prev using (Date) where pd is not null), bef as (select p.Date, t.Symbol from top t join prev p on t.Date = p.pd)
select Date, Symbol, 'entry' as Change from now where not exists (select 1 from bef where bef.Date = now.Date and bef.Symbol = now.Symbol)
union all select Date, Symbol, 'exit' from bef where not exists (select 1 from now where bef.Date = now.Date and bef.Symbol = now.Symbol)""")
def topn_entries_exits(spark, sf_dir):
    return changes.topn_entries_exits(scores_table(spark, sf_dir, "Opportunity_Rank"))


@register("rank_movers", f"""with {sql.SCORES}, {_PREV}, b as (select s.Date, s.Symbol, s.Rank, o.Rank as Previous_Rank, o.Rank - s.Rank as Move from scores s join prev using (Date) join scores o on o.Date = prev.pd and o.Symbol = s.Symbol),
k as (select *, row_number() over (partition by Date order by Move desc, Symbol) as u, row_number() over (partition by Date order by Move asc, Symbol) as d from b)
select Date, Symbol, Rank, Previous_Rank, Move, 'gainer' as Side from k where u <= 5 and Move > 0 union all select Date, Symbol, Rank, Previous_Rank, Move, 'loser' from k where d <= 5 and Move < 0""")
def rank_movers(spark, sf_dir):
    return changes.rank_movers(scores_table(spark, sf_dir, "Rank"))


@register("regime_change", f"with {sql.BARS}, {sql.REGIME}, q as (select Date, lag(Market_Regime) over (order by Date) as From_Regime, Market_Regime as To_Regime from regime) select * from q where From_Regime is not null and From_Regime != To_Regime")
def regime_change(spark, sf_dir):
    return changes.regime_change(signals.market_regime(panel.benchmark(panel.bars(spark, sf_dir))))


@register("symbol_history", f"""with {sql.SCORES}, k as (select *, row_number() over (partition by Symbol order by Date desc) as k from scores)
select Symbol, max(Rank) filter (k = 1) as Current_Rank, max(Rank) filter (k = 2) as Previous_Rank, min(Rank) as Best_Rank, count(*) filter (Rank <= 25) as Days_In_Top25, count(*) as Snapshots from k group by 1""")
def symbol_history(spark, sf_dir):
    return changes.symbol_history(all_scores(spark, sf_dir))


@register("trailing_streak", f"""with {sql.SCORES}, k as (select *, sum(case when Absolute_Momentum_Pass then 0 else 1 end) over (partition by Symbol order by Date desc) as m from scores) select Symbol, count(*) filter (m = 0) as Streak from k group by 1""")
def trailing_streak(spark, sf_dir):
    return changes.trailing_streak(all_scores(spark, sf_dir), F.col("Absolute_Momentum_Pass"))


_TITLE = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_REST = "regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
_SCHEME = "lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"
CANON = f"case when trim(url) = '' then '' else case when {_SCHEME} = '' then 'https' else {_SCHEME} end || '://' || regexp_replace(lower(regexp_extract({_REST}, '^([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '/+$', '') end"


@register("canonical_url", f"select page_id, {CANON} as canonical from pages")
def canonical_url(spark, sf_dir):
    return panel.table(spark, sf_dir, "pages").select("page_id", news.canonical_url(F.col("url")).alias("canonical"))


_HEAD = "heads as (select doc_id, text as title from documents)"


@register("normalize_title", f"with {_HEAD} select doc_id, {_TITLE.format('title')} as title from heads")
def normalize_title(spark, sf_dir):
    return panel.headlines(spark, sf_dir).select("doc_id", news.normalize_title(F.col("title")).alias("title"))


@register("lexicon_sentiment", f"""with {_HEAD}, lex(term, polarity) as (values {', '.join(f"('{t}', {p}::double)" for t, p in LEXICON)}), tok as (select doc_id, unnest(string_split({_TITLE.format('title')}, ' ')) as term from heads),
m as (select doc_id, count(*) as hits, sum(polarity) as total from tok join lex using (term) group by 1) select doc_id, hits, {sql.r4x('greatest(least(total / sqrt(hits) / 3, 1.0::double), -1.0::double)')} as polarity from m""")
def lexicon_sentiment(spark, sf_dir):
    lexicon = spark.createDataFrame(list(LEXICON), "term string, polarity double")
    return news.lexicon_sentiment(panel.headlines(spark, sf_dir), lexicon).select("doc_id", "hits", *r4("polarity"))


def _halves(spark, sf_dir):
    """The bars as an older table and an overlapping newer one with other prices."""
    b = panel.bars(spark, sf_dir).select("Date", "Symbol", "Price")
    return b.where("Date < date '1999-01-01'"), b.where("Date >= date '1998-10-01'").withColumn("Price", F.col("Price") + 1)


_HALVES = f"{sql.BARS}, old as (select Date, Symbol, Price from bars where Date < date '1999-01-01'), new as (select Date, Symbol, Price + 1 as Price from bars where Date >= date '1998-10-01')"
_ONLY = "not exists (select 1 from {b} x where x.Date = {a}.Date and x.Symbol = {a}.Symbol)"


@register("history_append", f"with {_HALVES} select Date, Symbol, {sql.r4('Price')} from new union all select Date, Symbol, {sql.r4('Price')} from old where {_ONLY.format(a='old', b='new')}")
def history_append(spark, sf_dir):
    return tables.history_append(*_halves(spark, sf_dir), ["Date", "Symbol"]).select("Date", "Symbol", *r4("Price"))


@register("price_cache_update", f"with {_HALVES} select Date, Symbol, {sql.r4('Price')} from old union all select Date, Symbol, {sql.r4('Price')} from new where {_ONLY.format(a='new', b='old')}")
def price_cache_update(spark, sf_dir):
    return tables.price_cache_update(*_halves(spark, sf_dir)).select("Date", "Symbol", *r4("Price"))


@register("forward_history_merge", f"with {_HALVES} select Date, Symbol, {sql.r4('Price')}, 'computed' as origin from new union all select Date, Symbol, {sql.r4('Price')}, 'retained' from old where {_ONLY.format(a='old', b='new')}")
def forward_history_merge(spark, sf_dir):
    return tables.forward_history_merge(*_halves(spark, sf_dir), ["Date", "Symbol"]).select("Date", "Symbol", *r4("Price"), "origin")


@register("stale_symbols", f"with {sql.BARS}, m as (select 'S' || s_suppkey as Symbol from supplier), l as (select Symbol, max(Date) as Last_Date from bars group by 1) select Symbol, Last_Date from m left join l using (Symbol) where Last_Date is null or date_diff('day', Last_Date, date '2001-11-05') > 10")
def stale_symbols(spark, sf_dir):
    return tables.stale_symbols(panel.bars(spark, sf_dir), panel.master(spark, sf_dir), "2001-11-05", 10)


@register("recent_window", f"with {sql.BARS} select Symbol, Date, {sql.r4('Price')} from bars where Date >= (select max(Date) from bars) - 90")
def recent_window(spark, sf_dir):
    return tables.recent_window(panel.bars(spark, sf_dir), 90).select("Symbol", "Date", *r4("Price"))


@register("business_day_gaps", """with d as (select distinct o_custkey as feed, o_orderdate::date as Date from orders), r as (select feed, min(Date) as a, max(Date) as b from d group by 1),
s as (select feed, unnest(generate_series(a, b, interval 1 day))::date as Date from r) select feed, Date from s where isodow(Date) < 6 and not exists (select 1 from d where d.feed = s.feed and d.Date = s.Date)""")
def business_day_gaps(spark, sf_dir):
    """Weekdays without an order between each customer's first and last."""
    o = panel.table(spark, sf_dir, "orders")
    return tables.business_day_gaps(o.select(F.col("o_custkey").alias("feed"), F.col("o_orderdate").cast("date").alias("Date")), "feed")


@register("feed_health", f"with g as (select 'S' || user_id as feed, count(*) as Rows, max(ts::date) as Last_Date from events group by 1) select feed, Rows, Last_Date, case when date_diff('day', Last_Date, date '{AS_OF}') <= 2 then 'green' when date_diff('day', Last_Date, date '{AS_OF}') <= 7 then 'amber' else 'red' end as Status from g")
def feed_health(spark, sf_dir):
    """Each user's events as a feed."""
    e = panel.table(spark, sf_dir, "events")
    return tables.feed_health(e.select(panel.symbol("user_id").alias("feed"), F.to_date("ts").alias("Date")), AS_OF)


@register("hold_horizon")
def hold_horizon(spark, sf_dir):
    return signals.hold_horizon(panel.bars(spark, sf_dir))


@register("asof_overlay")
def asof_overlay(spark, sf_dir):
    """Each bar with the symbol's last deal price on or before it; deals are moved onto the bars' calendar."""
    overlay = panel.deals(spark, sf_dir).groupBy("Symbol", F.date_sub("Date", 8000).alias("Date")).agg(F.max("Price").alias("Deal_Price"))
    return alphas.asof_overlay(panel.bars(spark, sf_dir), overlay, "Deal_Price")
