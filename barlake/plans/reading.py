"""Registered queries of the readers: each lands files derived from the tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from barlake import panel
from barlake.plans import sql
from barlake.plans.basket import _EARN, earnings
from barlake.plans.queries import r4, register, table
from barlake.sources import nested, readers
from barlake.sources.shared import shared_path

PRICE = StructType([StructField("Date", DateType()), StructField("Symbol", StringType()), StructField("Price", DoubleType())])


def landed(df, name: str, folder: str | None = None) -> str:
    """df as CSV with a header; the path."""
    path = folder or shared_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def _csv(spark, path):
    return spark.read.option("header", True).csv(path)


def _prices(spark, sf_dir):
    """Order lines as raw price rows under other headers, with thousands separators and dates of several forms."""
    line = panel.table(spark, sf_dir, "lineitem")
    d = F.col("l_shipdate").cast("date")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.date_format(d, "dd-MMM-yyyy")).when(F.col("l_linenumber") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyyMMdd"))
    price = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.format_number("l_extendedprice", 2))
    return line.select(panel.symbol("l_suppkey").alias(" Ticker "), text.alias("DATETIME"), price.alias("close"), F.col("l_quantity").alias("Volume"))


_RAW = "raw as (select 'S' || l_suppkey as Symbol, l_shipdate::date as Date, case when l_linenumber != 7 then round(l_extendedprice, 2) end as Price, l_quantity as Volume from lineitem)"


@register("scan_bars", f"with {_RAW} select Symbol, Date, count(*) as n, {sql.r4x('sum(Price)')} as Price, {sql.r4x('sum(Volume)')} as Volume from raw where Price is not null group by 1, 2")
def scan_bars(spark, sf_dir):
    bars, _ = readers.scan_bars(_csv(spark, landed(_prices(spark, sf_dir), "prices")))
    return bars.groupBy("Symbol", "Date").agg(F.count(F.lit(1)).alias("n"), F.sum("Price").alias("Price"), F.sum("Volume").alias("Volume")).select("Symbol", "Date", "n", *r4("Price", "Volume"))


@register("scan_bars_diagnostics", f"with {_RAW}, s as (select Symbol, count(*) as n, min(Date) as a, max(Date) as b from raw where Price is not null group by 1), m as (select 'S' || c_custkey as Symbol from customer) select m.Symbol, case when n is null then 'no data' else 'ok' end as Status, coalesce(n, 0) as Rows, a as First_Date, b as Last_Date from m left join s using (Symbol)")
def scan_bars_diagnostics(spark, sf_dir):
    asked = panel.table(spark, sf_dir, "customer").select(panel.symbol("c_custkey").alias("Symbol"))
    return readers.scan_bars(_csv(spark, landed(_prices(spark, sf_dir), "prices")), asked)[1]


@register("scan_tolerant", f"with {sql.BARS} select Date, Symbol, {sql.r4('Price')} from bars")
def scan_tolerant(spark, sf_dir):
    """Bars landed as CSV, with an absent table on top."""
    path = landed(panel.bars(spark, sf_dir).select("Price", F.col("Symbol").alias("SYMBOL"), "Date"), "bars")
    none = readers.scan_tolerant(spark, shared_path(spark, "absent"), PRICE)
    return readers.scan_tolerant(spark, path, PRICE, "the bars").unionByName(none).select("Date", "Symbol", *r4("Price"))


@register("scan_nav_text", "select p_partkey::varchar as Scheme_Code, 'INF' || p_partkey as ISIN, p_name as Scheme_Name, round(p_retailprice, 2) as NAV, date '2024-01-01' + (p_size % 28)::int as NAV_Date from part where p_partkey % 10 != 3")
def scan_nav_text(spark, sf_dir):
    """A text dump with a header, section lines, and rows without a value."""
    p = panel.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    nav = F.when(k % 10 == 3, "N.A.").otherwise(F.format_number("p_retailprice", 2))
    row = F.concat_ws(";", k, F.concat(F.lit("INF"), k), F.lit("-"), "p_name", nav, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") % 28).cast("int")), "dd-MMM-yyyy"))
    lines = p.select(F.explode(F.array(row, F.when(k % 50 == 0, "Open Ended Schemes"), F.when(k % 97 == 0, "Scheme Code;ISIN;ISIN2;Scheme Name;Net Asset Value;Date"))).alias("value")).where("value is not null")
    path = shared_path(spark, "nav")
    lines.write.text(path)
    return readers.scan_nav_text(spark, path)


@register("scan_delivery", f"with x as (select 'S' || l_suppkey as Symbol, l_shipdate::date as Date, case when l_linenumber % 2 = 0 then round(l_discount * 100, 2) else l_discount * l_quantity / nullif(l_quantity, 0) * 100 end as p from lineitem where l_returnflag != 'R') select Symbol, Date, count(*) as n, {sql.r4x('avg(p)')} as Delivery_Pct from x group by 1, 2")
def scan_delivery(spark, sf_dir):
    """Lines as delivery rows: the share given for half of them, quantities for the rest; returned lines are of another series."""
    line = panel.table(spark, sf_dir, "lineitem")
    given = F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_discount") * 100, 2).cast("string")).otherwise(" - ")
    series = F.when(F.col("l_returnflag") == "R", "GB").when(F.col("l_returnflag") == "A", " EQ").otherwise("BE ")
    raw = line.select(panel.symbol("l_suppkey").alias(" SYMBOL"), series.alias(" SERIES"), F.date_format("l_shipdate", "dd-MMM-yyyy").alias(" DATE1"), given.alias(" DELIV_PER"), (F.col("l_discount") * F.col("l_quantity")).alias(" DELIV_QTY"), F.col("l_quantity").alias(" TTL_TRD_QNTY"))
    out = readers.scan_delivery(_csv(spark, landed(raw, "delivery")))
    return out.groupBy("Symbol", "Date").agg(F.count(F.lit(1)).alias("n"), F.avg("Delivery_Pct").alias("Delivery_Pct")).select("Symbol", "Date", "n", *r4("Delivery_Pct"))


@register("fold_flows", f"select ts::date as Date, {sql.r4x('''sum(case when event_type in ('purchase', 'view') then round(value, 2) end)''')} as FII_Net, {sql.r4x('''sum(case when event_type = 'error' then -round(value, 2) end)''')} as DII_Net from events group by 1")
def fold_flows(spark, sf_dir):
    e = panel.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "FII/FPI *").when(F.col("event_type") == "view", "fpi").when(F.col("event_type") == "error", "DII **").otherwise("other")
    net = F.when(F.col("event_type") == "error", F.concat(F.lit("−"), F.format_number("value", 2))).otherwise(F.format_number("value", 2))
    raw = e.select(F.date_format("ts", "dd-MMM-yyyy").alias("date"), kind.alias("category"), net.alias("netValue"))
    return readers.fold_flows(_csv(spark, landed(raw, "flows"))).select("Date", *r4("FII_Net", "DII_Net"))


@register("scan_deals", f"select ts::date as Date, 'S' || user_id as Symbol, case when event_type = 'error' then 'SELL' else 'BUY' end as Buy_Sell, count(*) as n, {sql.r4x('sum(round(value, 2))')} as Price from events where event_type in ('purchase', 'signup', 'error') group by 1, 2, 3")
def scan_deals(spark, sf_dir):
    """Events as deals in two layouts."""
    e = panel.table(spark, sf_dir, "events")
    price = F.format_number("value", 2)
    a = e.where("event_type in ('purchase', 'signup')").select(F.date_format("ts", "dd-MMM-yyyy").alias("Date "), panel.symbol("user_id").alias("Symbol"), F.lit("c").alias("Client Name"), F.lit("BUY").alias("Buy/Sell"), F.lit("1,000").alias("Quantity Traded"), price.alias("Trade Price / Wght. Avg. Price"))
    b = e.where("event_type = 'error'").select(F.date_format("ts", "yyyy-MM-dd").alias("BD_DT_DATE"), F.lower(panel.symbol("user_id")).alias("BD_SYMBOL"), F.lit("c").alias("BD_CLIENT_NAME"), F.lit("s").alias("BD_BUY_SELL"), F.lit("1").alias("BD_QTY_TRD"), price.alias("BD_TP_WATP"))
    out = readers.scan_deals([_csv(spark, landed(x, "deals")) for x in (a, b)])
    return out.groupBy("Date", "Symbol", "Buy_Sell").agg(F.count(F.lit(1)).alias("n"), F.sum("Price").alias("Price")).select("Date", "Symbol", "Buy_Sell", "n", *r4("Price"))


@register("split_benchmark", f"with {sql.BARS} select 'candidate' as kind, Symbol, count(*) as n from bars where Symbol != 'S1' group by 2 union all select 'benchmark', Symbol, count(*) from bars where Symbol = 'S1' group by 2 union all select 'failed', 'S' || c_custkey, 0 from customer where 'S' || c_custkey not in (select Symbol from bars)")
def split_benchmark(spark, sf_dir):
    b = panel.bars(spark, sf_dir).select("Date", "Symbol", "Price")
    asked = panel.table(spark, sf_dir, "customer").select(panel.symbol("c_custkey").alias("Symbol"))
    some, bench, failed = readers.split_benchmark([b.where("Date < date '1999-01-01'"), b.where("Date >= date '1998-06-01'")], "S1", asked)
    count = lambda df, kind: df.groupBy("Symbol").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "Symbol", "n")
    return count(some, "candidate").unionByName(count(bench, "benchmark")).unionByName(failed.select(F.lit("failed").alias("kind"), "Symbol", F.lit(0).cast("long").alias("n")))


@register("read_inputs", f"select l_shipdate::date as Date, 'S' || l_suppkey as Symbol, {sql.r4x('max(l_extendedprice)')} as Price from lineitem group by 1, 2")
def read_inputs(spark, sf_dir):
    line = panel.table(spark, sf_dir, "lineitem").select(panel.symbol("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("DATE"), F.col("l_extendedprice").alias("price"))
    return readers.read_inputs(line.unionByName(line.limit(1).withColumn("symbol", F.lit(None).cast("string"))), PRICE, ["Date", "Symbol"]).select("Date", "Symbol", *r4("Price"))


@register("dated_merge", f"with {sql.BARS}, n as (select Date, Symbol, Price + 1 as Price from bars where Date >= date '1998-10-01'), o as (select Date, Symbol, Price from bars where Date < date '1999-01-01') select Date, Symbol, {sql.r4('Price')} from (select * from n union all select * from o where Date < date '1998-10-01') where Date >= date '2001-11-05' - 1000")
def dated_merge(spark, sf_dir):
    from barlake.plans.more import _halves

    return readers.dated_merge(*_halves(spark, sf_dir), ["Date", "Symbol"], "2001-11-05", 1000).select("Date", "Symbol", *r4("Price"))


@register("price_cache_overwrite", f"with {sql.BARS} select Date, Symbol, {sql.r4x('Price + (Date >= date ' + chr(39) + '1998-10-01' + chr(39) + ')::int')} as Price from bars")
def price_cache_overwrite(spark, sf_dir):
    from barlake.plans.more import _halves
    from barlake.sources import tables

    return tables.price_cache_update(*_halves(spark, sf_dir), freeze=False).select("Date", "Symbol", *r4("Price"))


@register("degraded_guard", "select o_orderkey from orders")
def degraded_guard(spark, sf_dir):
    """A table of a third of the rows does not replace the orders."""
    o = panel.table(spark, sf_dir, "orders").select("o_orderkey")
    return readers.degraded_guard(o, o.where("o_orderkey % 3 = 0"))


@register("table_sink", f"with {sql.BARS} select Date, Symbol, {sql.r4('Price')} from bars")
def table_sink(spark, sf_dir):
    """Bars written by date, and the last of them written again with the same rows."""
    path = shared_path(spark, "sink")
    b = panel.bars(spark, sf_dir).select("Date", "Symbol", "Price")
    b = b.withColumn("Year", F.year("Date").cast("long"))
    schema = StructType([*PRICE.fields, StructField("Year", LongType())])
    readers.table_sink(b, schema, path, "Year")
    readers.table_sink(b.where("Year = 2000"), schema, path, "Year")
    return spark.read.parquet(path).select("Date", "Symbol", *r4("Price"))


@register("load_rules", """with r as (select n_regionkey as Rule_Set, n_nationkey % 3 as p, n_nationkey as v from nation) select Rule_Set, coalesce(max(case when p = 0 and v % 2 = 0 then v / 10.0::double end), 65) as Risk_Score_Min, coalesce(max(case when p = 1 and v % 2 = 0 then v / 10.0::double end), 60) as Final_Score_Min from r group by 1""")
def load_rules(spark, sf_dir):
    """Nations as parameters of their regions' rule sets; odd ones cannot be parsed."""
    n = panel.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    rows = n.select(F.col("n_regionkey").alias("Rule_Set"), F.when(k % 3 == 0, "Risk_Score_Min").when(k % 3 == 1, "Final_Score_Min").otherwise("Other").alias("Parameter"), F.when(k % 2 == 0, (k / 10).cast("string")).otherwise("?").alias("Value"))
    return readers.load_rules(rows, {"Risk_Score_Min": 65, "Final_Score_Min": 60})


@register("schema_migration", "select o_orderkey::varchar as Symbol, o_orderdate::date as Date, case when o_orderkey % 2 = 0 then 2 else 1 end::bigint as Schema_Version, case when o_orderkey % 2 = 0 then 'Confidence_Adjusted_Score' else 'Final_Score' end as Ranking_Column from orders")
def schema_migration(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.when(F.col("o_orderkey") % 2 == 0, "2").alias("schema_version"))
    schema = StructType([StructField("Symbol", StringType()), StructField("Date", DateType()), StructField("Schema_Version", LongType())])
    return readers.schema_migration(old, schema).select("Symbol", "Date", "Schema_Version", "Ranking_Column")


@register("multi_file_union", "select 'aum_latest' as Source_File, count(*) as n from part where p_partkey % 2 = 0 union all select 'ter_20240102', count(*) from part where p_partkey % 5 = 0")
def multi_file_union(spark, sf_dir):
    """Two families of files: one with a latest mirror, one with two dates."""
    p, top = panel.table(spark, sf_dir, "part").select("p_partkey"), shared_path(spark, "imports")
    for name, every in (("aum_latest", 2), ("aum_20240101", 3), ("ter_20240101", 4), ("ter_20240102", 5)):
        landed(p.where(F.col("p_partkey") % every == 0), name, f"{top}/{name}.csv")
    return readers.multi_file_union(spark, top).groupBy("Source_File").agg(F.count(F.lit(1)).alias("n"))


def _chains(spark, sf_dir):
    """An order's lines as the strikes of an option chain in JSON: quantity as strike, discount and tax as volatilities, the mean quantity as underlying."""
    line = panel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("Date"), F.round(F.avg("l_quantity"), 3).alias("underlying"), F.collect_list(F.struct(F.col("l_quantity").alias("strike"), F.col("l_discount").alias("ce"), F.col("l_tax").alias("pe"))).alias("data"))
    return line.select(F.concat(F.lit("O"), F.col("l_orderkey") % 50).alias("Symbol"), "l_orderkey", "Date", F.to_json(F.struct("underlying", "data")).alias("json"))


_IV = """u as (select l_orderkey, min(l_shipdate::date) as Date, round(avg(l_quantity), 3) as under from lineitem group by 1),
n as (select l_orderkey, Date, greatest(l_discount, l_tax) as iv, rank() over (partition by l_orderkey order by abs(l_quantity - under), l_quantity) as k from lineitem join u using (l_orderkey))"""


@register("atm_iv", f"with {_IV} select l_orderkey::varchar as Symbol, Date, count(*) as Strikes, max(case when iv > 0 then iv end) as IV from n where k = 1 group by 1, 2")
def atm_iv(spark, sf_dir):
    return readers.atm_iv(_chains(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("Symbol"), "Date", "json"))


_DAY = "iv as (select 'S' || (l_suppkey % 50) as Symbol, l_shipdate::date as Date, round(avg(l_discount) + 0.0000000137::double, 6) as Value from lineitem group by 1, 2)"


@register("iv_rank_daily", f"with {_DAY}, w as (select Symbol, Date, Value, list(Value) over (partition by Symbol order by Date rows between 252 preceding and 1 preceding) as v from iv) select Symbol, Date, {sql.r4x('case when len(v) >= 1 then len(list_filter(v, lambda x: x < Value)) / len(v)::double * 100 end')} as IV_Rank from w")
def iv_rank_daily(spark, sf_dir):
    line = panel.table(spark, sf_dir, "lineitem")
    iv = line.groupBy(F.concat(F.lit("S"), F.col("l_suppkey") % 50).alias("Symbol"), F.col("l_shipdate").cast("date").alias("Date")).agg(F.round(F.avg("l_discount") + 1.37e-8, 6).alias("IV"))
    return readers.iv_rank_daily(iv).select("Symbol", "Date", *r4("IV_Rank"))


def _filings(spark, sf_dir):
    c = panel.table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    when = F.when(k % 4 == 0, None).otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")), "dd-MMM-yyyy"))
    raw = c.select(F.when(k % 7 != 0, F.concat(F.lit(" s"), k % 20)).alias("sm_name"), F.col("text").alias("desc"), when.alias("an_dt"), k.alias("id"))
    path = shared_path(spark, "filings")
    raw.write.json(path)
    return readers.scan_filings(spark.read.json(path), "2024-03-01", 30)


_FILED = "f0 as (select case when conv_id % 7 != 0 then 'S' || (conv_id % 20) end as Symbol, case when conv_id % 4 != 0 then date '2024-01-01' + (conv_id % 60)::int end as Published, trim(text, ' ') as Title from conversations where trim(text, ' ') != ''), f1 as (select * from f0 where Symbol is not null and (Published is null or Published >= date '2024-03-01' - 30))"


@register("scan_filings", f"with {_FILED} select Symbol, Published, sha256(Title) as Title_SHA256 from f1")
def scan_filings(spark, sf_dir):
    return _filings(spark, sf_dir).select("Symbol", "Published", F.sha2("Title", 256).alias("Title_SHA256"))


@register("filings_for_symbols", f"with {_FILED} select Symbol, Published, sha256(Title) as Title_SHA256 from f1 where Symbol in (select 'S' || s_suppkey from supplier)")
def filings_for_symbols(spark, sf_dir):
    wanted = readers.filings_for_symbols(_filings(spark, sf_dir), panel.master(spark, sf_dir))
    return wanted.select("Symbol", "Published", F.sha2("Title", 256).alias("Title_SHA256"))


@register("scan_rss", "with t as (select distinct p_type as Query, trim(p_name) as Title from part), k as (select *, row_number() over (partition by Query order by Title) as k from t), l as (select p_type as Query, trim(p_name) as Title, min('http://x/' || p_partkey) as Link from part group by 1, 2) select Query, Title, Link from k join l using (Query, Title) where k <= 10")
def scan_rss(spark, sf_dir):
    p = panel.table(spark, sf_dir, "part").select(F.col("p_type").alias("query"), F.col("p_name").alias("title"), F.concat(F.lit("http://x/"), "p_partkey").alias("link"), F.lit("").alias("pubDate"))
    path = shared_path(spark, "rss")
    p.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return readers.scan_rss(spark, path)


@register("earnings_horizon", f"with {_EARN} select Symbol, Next_Earnings from earn where Next_Earnings between date '2001-11-05' and date '2001-11-05' + 30")
def earnings_horizon(spark, sf_dir):
    return readers.earnings_horizon(earnings(spark, sf_dir), "2001-11-05", 30)


@register("shortlist", "select 'S' || s_suppkey as Symbol from supplier order by round(s_acctbal, 4) desc, Symbol limit 20")
def shortlist(spark, sf_dir):
    """The first 20 suppliers by balance."""
    from pyspark.sql import Window

    s = panel.table(spark, sf_dir, "supplier")
    top = s.withColumn("Place", F.row_number().over(Window.orderBy(F.round("s_acctbal", 4).desc(), panel.symbol("s_suppkey"))).cast("long")).where("Place <= 20")
    return readers.shortlist(top.select(panel.symbol("s_suppkey").alias("Symbol"), "Place"), panel.master(spark, sf_dir), 20)


_NESTED = """o as (select o_custkey as id, o_orderkey::varchar as k, o_orderstatus as s, o_orderpriority as p, o_custkey % 3 as shape from orders),
f as (select id, unnest(['name', 'Key', 'Value']) as Name, unnest([p, k, s]) as Value from o where shape = 0 union all select distinct id, 'name', p from o where shape = 0
union all select distinct id, 'cust', id::varchar from o where shape = 1 union all select id, unnest(['cust', 'code']), unnest([id::varchar, k]) from o where shape = 1 union all select id, unnest(['cust', 'code', 'status']), unnest([id::varchar, k, s]) from o where shape = 1
union all select id, unnest(['code', 'code_2', 'status']), unnest([k, p, s]) from o where shape = 2)"""


@register("flatten_nested", f"with {_NESTED} select * from f")
def flatten_nested(spark, sf_dir):
    """Orders as payloads of three shapes: tables under names, nested objects, and tables with a repeated name."""
    o = panel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    listed = lambda *c: F.collect_list(F.array(*c))
    headed = lambda names, rows: F.concat(F.array(F.array(*map(F.lit, names))), rows)
    of = lambda n: o.where(F.col("id") % 3 == n)
    named = of(0).groupBy("id", "p").agg(F.struct(F.col("p").alias("name"), headed(("Key", "Value"), listed("k", "s")).alias("rows")).alias("d")).groupBy("id").agg(F.to_json(F.struct(F.collect_list("d").alias("data"))).alias("json"))
    inner = of(1).groupBy("id").agg(F.collect_list(F.struct(F.col("k").alias("code"), F.struct(F.col("s").alias("status")).alias("more"))).alias("orders"))
    objects = inner.select("id", F.to_json(F.struct(F.col("id").alias("cust"), "orders")).alias("json"))
    tables = of(2).groupBy("id").agg(F.to_json(headed(("code", "code", "status"), listed("k", "p", "s"))).alias("json"))
    raw = named.unionByName(objects).unionByName(tables)
    return nested.flatten_nested(raw, "json", table).select("id", "Name", "Value")
