"""Registered queries that run streams over the landed event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.plans import sql
from barlake.plans.queries import r4, register
from barlake.streaming import events as ev
from barlake.streaming import state


def _events(spark, sf_dir):
    return ev.read_events(spark, sf_dir, panel.table(spark, sf_dir, "events").schema)


@register("stream_flow_windows", f"select ts::date as Day, event_type, count(*) as n, {sql.r4x('sum(value)')} as value from events group by 1, 2")
def stream_flow_windows(spark, sf_dir):
    log = ev.landed(ev.flow_windows(_events(spark, sf_dir)), "flow_windows", "update")
    return ev.last_of_key(log, ["Day", "event_type"]).select("Day", "event_type", "n", *r4("value"))


@register("stream_first_of_key", "select count(distinct event_id) as n from events")
def stream_first_of_key(spark, sf_dir):
    log = ev.landed(ev.first_of_key(_events(spark, sf_dir), ["event_id"]), "first_events", "append")
    return log.selectExpr("count(*) as n")


def _landings(spark, df, name, order):
    """df as three landings, read as a stream, one landing a batch."""
    path = state.land(df, name, order)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _days(spark, sf_dir):
    e = panel.table(spark, sf_dir, "events").select(F.to_date("ts").alias("Date"), panel.symbol("user_id").alias("Symbol"), "event_type", "value", "event_id")
    return _landings(spark, e, "landed_events", F.pmod("event_id", F.lit(3)))


@register("stream_history", "with k as (select ts::date as Date, 'S' || user_id as Symbol, event_type, value, row_number() over (partition by ts::date, user_id order by event_id desc) as k from events) select Date, Symbol, event_type, round(value + 0.00000137::double, 4) as value from k where k = 1")
def stream_history(spark, sf_dir):
    """The last event of each user and day, in a bucketed table; events land in three turns, each with events older than those of the turn before."""
    got = state.upserted(_days(spark, sf_dir), "history", ["Date", "Symbol"], [F.col("event_id").desc()])
    return got.select("Date", "Symbol", "event_type", *r4("value"))


@register("stream_price_freeze", "with k as (select ts::date as Date, 'S' || user_id as Symbol, value, row_number() over (partition by ts::date, user_id order by event_id % 3, event_id) as k from events) select Date, Symbol, round(value + 0.00000137::double, 4) as value from k where k = 1")
def stream_price_freeze(spark, sf_dir):
    """The first event of each user and day that lands stays."""
    got = state.upserted(_days(spark, sf_dir), "prices", ["Date", "Symbol"], [F.col("_landed"), F.col("event_id")])
    return got.select("Date", "Symbol", *r4("value"))


_KEY = "concat_ws('::', 't', source, case when doc_id % 5 = 0 then 'f' else 'm' end, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')))"


@register("stream_news_dedup", f"select arg_min(doc_id, (doc_id % 700) * -1000000 + doc_id) as id, min(date '2024-06-01' - (doc_id % 700)::int) as First_Seen from documents where text is not null group by {_KEY}")
def stream_news_dedup(spark, sf_dir):
    """The first story of each cluster key by the day it was seen, of documents that land in three turns, the oldest of many clusters last."""
    from barlake.operators import news

    k = F.col("doc_id")
    key = news.cluster_key(F.col("source"), k % 5 == 0, F.lit(None).cast("string"), F.col("text"))
    seen = F.date_sub(F.lit("2024-06-01").cast("date"), (k % 700).cast("int")).cast("timestamp")
    d = panel.table(spark, sf_dir, "documents").where("text is not null").select(k.alias("id"), F.sha2(key, 256).alias("Cluster_Key"), seen.alias("First_Seen"))
    log = ev.landed(state.first_seen(_landings(spark, d, "landed_stories", 2 - F.pmod("id", F.lit(3))), late="1000 days", keep_days=2000), "clusters", "update")
    return ev.last_of_key(log, ["Cluster_Key"]).select("id", F.col("First_Seen").cast("date").alias("First_Seen"))


_RAW = "lb as (select 'S' || l_suppkey as Symbol, l_shipdate::date as Date, max(l_extendedprice) as Price from lineitem group by 1, 2)"


@register("stream_maturation", f"with {_RAW}, px as (select Symbol, Date, Price, lead(Price, 5) over w as p5, lead(Price, 21) over w as p21 from lb window w as (partition by Symbol order by Date)) select Symbol, Date as Signal_Date, h as Horizon_Days, round((case h when 5 then p5 else p21 end) / nullif(Price, 0) - 1 + 0.00000137::double, 4) as Gross_Forward_Return from px cross join (select unnest([5, 21])::bigint as h)")
def stream_maturation(spark, sf_dir):
    """A signal at every bar; bars land as daily best prices in three turns, each with bars between those of the turns before."""
    line = panel.table(spark, sf_dir, "lineitem").select(panel.symbol("l_suppkey").alias("Symbol"), F.col("l_shipdate").cast("date").alias("Date"), F.col("l_extendedprice").alias("Price"), "l_orderkey")
    log = ev.landed(state.matured(_landings(spark, line, "landed_bars", F.pmod("l_orderkey", F.lit(3)))), "maturation", "update")
    return ev.last_of_key(log, ["Symbol", "Signal_Date", "Horizon_Days"]).select("Symbol", "Signal_Date", "Horizon_Days", *r4("Gross_Forward_Return"))
