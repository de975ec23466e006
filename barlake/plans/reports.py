"""Registered queries that join several reports: ledgers, gates, cards, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.operators import changes, scoring
from barlake.plans import sql
from barlake.plans.basket import _CAL, _EARN, event_calendar
from barlake.plans.books import _COMPARE, _SHADOW, LABELS, shadow
from barlake.plans.more import _PREV, feed_health
from barlake.plans.queries import all_scores, oracle_sql, queries, r4, register, table
from barlake.sources import tables


@register("ledger_upsert", f"with {sql.SCORES}, {_SHADOW}, {_COMPARE} select Date, N + (Date >= date '1998-10-01')::int as N from cmp")
def ledger_upsert(spark, sf_dir):
    """One row a date: later runs of the comparison replace earlier ones of the same date."""
    c = table(changes.shadow_compare(shadow(spark, sf_dir)).select("Date", "N"), "compare")
    return tables.history_append(c.where("Date < date '1999-01-01'"), c.where("Date >= date '1998-10-01'").withColumn("N", F.col("N") + 1), ["Date"])


@register("shadow_gate", """with g as (select s_suppkey as k, case s_suppkey % 3 when 0 then 'Validation Positive' when 1 then 'Validation Negative' end as Verdict, s_suppkey % 12 as l, (s_suppkey // 2) % 12 as p, s_suppkey % 9 as o, s_suppkey % 2 as v from supplier),
f as (select *, concat_ws('; ', case when coalesce(Verdict, '') != 'Validation Positive' then 'official verdict is not Validation Positive' end, case when l < 8 then 'too few consecutive shadow leads' end, case when p < 8 then 'too few consecutive positive verdicts' end, case when o < 6 then 'too few matured observations' end, case when v > 0 then 'shadow list holds vetoed names' end) as Failed from g)
select k, case when Failed = '' then 'green' when Verdict = 'Validation Negative' then 'red' else 'amber' end as State, Failed from f""")
def shadow_gate(spark, sf_dir):
    """Suppliers as runs of the comparison."""
    k = F.col("s_suppkey")
    runs = panel.table(spark, sf_dir, "supplier").select(k.alias("k"), F.when(k % 3 == 0, "Validation Positive").when(k % 3 == 1, "Validation Negative").alias("Verdict"), (k % 12).alias("Leads"), (F.floor(k / 2) % 12).alias("Positives"), (k % 9).alias("Observations"), (k % 2).alias("Veto"))
    return changes.shadow_gate(runs).select("k", "State", "Failed")


@register("card_join", f"with {sql.SCORES}, e as ({oracle_sql()['hold_horizon']}) select s.Date, s.Symbol, Opportunity_Rank as Place, s.Sector, e.Horizon, round(s.Benchmark_Close + 0.00000137::double, 4) as Benchmark_Close from scores s left join e on e.Symbol = s.Symbol and e.Best where Opportunity_Rank <= 5")
def card_join(spark, sf_dir):
    return _cards(spark, sf_dir).select("Date", "Symbol", "Place", "Sector", "Horizon", *r4("Benchmark_Close"))


def _cards(spark, sf_dir):
    from barlake.operators import signals

    b = panel.bars(spark, sf_dir)
    top = all_scores(spark, sf_dir).where("Opportunity_Rank <= 5").select("Date", "Symbol", F.col("Opportunity_Rank").alias("Place"))
    best = signals.hold_horizon(b).where("Best").select("Symbol", "Horizon")
    return changes.card_join(top, panel.master(spark, sf_dir).select("Symbol", "Sector"), best, panel.benchmark(b))


@register("evidence_rows")
def evidence_rows(spark, sf_dir):
    """The cards of every date with what eight other queries say of their symbols. Scores, picks, sizes and horizons are computed once for all of them."""
    from barlake.operators import backtest, signals
    from barlake.plans import basket, books

    b = panel.bars(spark, sf_dir)
    bench = table(panel.benchmark(b), "benchmark")
    top = table(all_scores(spark, sf_dir, "Price", "Sector").where("Opportunity_Rank <= 5").select("Date", "Symbol", "Price", "Sector", F.col("Confidence_Adjusted_Score").alias("Score"), F.col("Opportunity_Rank").alias("Place")), "top")
    best = table(signals.hold_horizon(b).where("Best"), "horizons")
    cards = changes.card_join(top.select("Date", "Symbol", "Place"), panel.master(spark, sf_dir).select("Symbol", "Sector"), best.select("Symbol", "Horizon"), bench)
    last = table(basket.on_last_date(top, bench), "picks")
    sized = table(backtest.position_sizing(last, backtest.volatility_63(b, last)), "sized")
    said = {
        "horizon": best.select("Symbol", "Horizon", "N", *r4("Median", "Downside")), "benchmark_stats": signals.benchmark_stats(b, bench).select("Symbol", "N", *r4("Excess_21", "Beta")),
        "fundamentals": panel.fundamentals(spark, sf_dir).select("Symbol", "PE", "ROE"), "event_calendar": event_calendar(spark, sf_dir).select("Symbol", "Event_Risk"),
        "sizing": basket.sizes(sized), "sector_context": books.sector_context(spark, sf_dir), "expected_value": basket.fractions(spark, sf_dir, sized), "institutional_flow": queries()["bulk_deal_net"](spark, sf_dir),
    }
    return changes.evidence_rows(cards, said)


@register("review_queue", f"""with {sql.SCORES}, {LABELS}, {_EARN}, {_CAL}, p as (select *, lag(Rank) over (partition by Symbol order by Date) - Rank as ch from labels), l as (select * from p where Date = (select max(Date) from labels)), fh as ({oracle_sql()['feed_health']}),
q as (select 1 as k, 'event' as Kind, Symbol as Item from evc where Event_Risk = 'In_Window' union select 2, 'flag', Symbol from l where Opportunity_Rank <= 5 and Risk_Flag != 'Clean' union select 3, 'move', Symbol from l where abs(ch) >= 10 union select 4, 'feed', feed from fh where Status != 'green'),
o as (select *, row_number() over (order by k, Item) as Place from q) select Place, Kind, Item from o where Place <= 20""")
def review_queue(spark, sf_dir):
    scored = table(scoring.rank_changes(scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED))).select("Date", "Symbol", "Opportunity_Rank", "Risk_Flag", "Rank_Change"), "ranks")
    last = scored.join(F.broadcast(scored.agg(F.max("Date").alias("_l"))), F.col("Date") == F.col("_l"))
    return changes.review_queue(event_calendar(spark, sf_dir), last.where("Opportunity_Rank <= 5"), last, feed_health(spark, sf_dir))


@register("news_candidates", f"""with {sql.SCORES}, {LABELS}, {_PREV}, top as (select Date, Symbol from scores where Opportunity_Rank <= 20), ent as (select t.Date, t.Symbol from top t join prev using (Date) where pd is not null and not exists (select 1 from top b where b.Date = prev.pd and b.Symbol = t.Symbol)),
mv as (select s.Date, s.Symbol, o.Rank - s.Rank as Move from scores s join prev using (Date) join scores o on o.Date = prev.pd and o.Symbol = s.Symbol), mk as (select *, row_number() over (partition by Date order by Move desc, Symbol) as u from mv),
fl as (select Date, Symbol, Risk_Flag, lag(Risk_Flag) over (partition by Symbol order by Date) as pf from labels),
a as (select Date, Symbol, 1 as k, 'top-15' as Why from scores where Opportunity_Rank <= 15 union all select Date, Symbol, 2, 'new top-20' from ent union all select Date, Symbol, 3, 'gainer' from mk where u <= 5 and Move >= 5 union all select Date, Symbol, 5, 'user_pin' from scores where Symbol in (select 'S' || s_suppkey from supplier where s_acctbal < 0) union all select Date, Symbol, 4, 'new risk flag' from fl where pf = 'Clean' and Risk_Flag != 'Clean'),
m as (select Date, Symbol, min(k) as k, arg_min(Why, k) as Why from a group by 1, 2), p as (select *, row_number() over (partition by Date order by k, Symbol) as Place from m) select Date, Symbol, Why, Place from p where Place <= 30""")
def news_candidates(spark, sf_dir):
    scored = table(scoring.labels(all_scores(spark, sf_dir, *scoring.LABELLED)).select("Date", "Symbol", "Rank", "Opportunity_Rank", "Risk_Flag"), "labels")
    pins = panel.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(panel.symbol("s_suppkey").alias("Symbol"))
    return changes.news_candidates(scored, changes.topn_entries_exits(scored), changes.rank_movers(scored), changes.risk_flag_changes(scored), pins)
