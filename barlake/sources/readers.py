"""Readers of landed files: tolerant of headers, layouts and gaps; what cannot be parsed is null."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlake.sources.tables import history_append, project_to_schema


def plain(name: str) -> str:
    """A header without case and punctuation."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def aliased(df: DataFrame, names: dict[str, tuple[str, ...]], contains: bool = False) -> DataFrame:
    """df with exactly the columns of `names`: each the first non-null of its candidates, matched without case and punctuation; null where none is there."""
    have = [(plain(c), c) for c in df.columns]

    def column(name: str, wanted: tuple[str, ...]) -> Column:
        found = [c for w in (name, *wanted) for p, c in have if p == plain(w) or (contains and plain(w) in p)]
        cols = [F.col(f"`{c}`") for c in dict.fromkeys(found)]
        return (F.coalesce(*cols) if cols else F.lit(None).cast("string")).alias(name)

    return df.select(*(column(n, w) for n, w in names.items()))


def number(x: Column) -> Column:
    """A number from text with thousands separators, blanks or a Unicode minus; null where there is none."""
    return F.regexp_replace(F.regexp_replace(F.trim(x.cast("string")), "[,\\s]", ""), "[−–]", "-").try_cast("double")


def date(x: Column) -> Column:
    """A date written as 2024-01-31, 31-Jan-2024, 31-01-2024 or 20240131."""
    t = F.substring(F.trim(x.cast("string")), 1, 11)
    return F.coalesce(*(F.try_to_timestamp(F.trim(t) if n is None else F.substring(t, 1, n), F.lit(f)).cast("date") for f, n in (("yyyy-MM-dd", 10), ("dd-MMM-yyyy", None), ("dd-MM-yyyy", 10), ("yyyyMMdd", 8))))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system knows the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_tolerant(spark: SparkSession, path: str, schema: StructType, required: str | None = None) -> DataFrame:
    """A CSV table with the schema's columns. An absent or empty one is an empty table, or an error that names its producer where it is `required`."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(f"{path} is missing; it is written by {required}")
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return project_to_schema(raw, schema)


def scan_bars(raw: DataFrame, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, diagnostics) of raw price rows under any headers: Price is the adjusted close, else the close; rows without symbol, date or price go.

    diagnostics: (Symbol, Status, Rows, First_Date, Last_Date) of every requested symbol.
    """
    df = aliased(raw, {"Symbol": ("ticker",), "Date": ("index", "datetime", "timestamp"), "Open": (), "High": (), "Low": (), "Close": (), "Adj_Close": ("adjusted close",), "Volume": ("ttl_trd_qnty",)})
    df = df.withColumns({c: number(F.col(c)) for c in ("Open", "High", "Low", "Close", "Adj_Close", "Volume")}).withColumns({"Symbol": F.trim("Symbol"), "Date": date(F.col("Date"))})
    bars = df.withColumn("Price", F.coalesce("Adj_Close", "Close")).where("Symbol is not null and Symbol != '' and Date is not null and Price is not null").drop("Adj_Close")
    seen = bars.groupBy("Symbol").agg(F.count(F.lit(1)).alias("Rows"), F.min("Date").alias("First_Date"), F.max("Date").alias("Last_Date"))
    asked = (requested if requested is not None else seen).select("Symbol").distinct()
    notes = asked.join(seen.hint("shuffle_hash"), "Symbol", "left").select("Symbol", F.when(F.col("Rows").isNull(), "no data").otherwise("ok").alias("Status"), F.coalesce("Rows", F.lit(0)).cast("long").alias("Rows"), "First_Date", "Last_Date")
    return bars, notes


def split_benchmark(frames: list[DataFrame], benchmark: str, requested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, benchmark rows, failed symbols): frames as one table, the last of each (Date, Symbol); later frames win."""
    every = frames[0]
    for f in frames[1:]:
        every = history_append(every, f, ["Date", "Symbol"])
    is_bench = F.col("Symbol") == benchmark
    failed = requested.select("Symbol").distinct().join(every.select("Symbol").distinct().hint("shuffle_hash"), "Symbol", "left_anti")
    return every.where(~is_bench), every.where(is_bench), failed


def read_inputs(df: DataFrame, schema: StructType, keys: list[str]) -> DataFrame:
    """df under the schema, without rows that lack a key, one row a key."""
    lacking = [k for k in keys if plain(k) not in {plain(c) for c in df.columns}]
    if lacking:
        raise ValueError(f"key columns are missing: {', '.join(lacking)}")
    rows = project_to_schema(df, schema).dropna(subset=keys)
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(c).desc_nulls_last() for c in rest] or [F.lit(1)]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def scan_nav_text(spark: SparkSession, path: str) -> DataFrame:
    """(Scheme_Code, ISIN, Scheme_Name, NAV, NAV_Date) of a text dump with six or more fields between semicolons; headers and section lines go."""
    f = F.split("value", ";", -1)
    rows = spark.read.text(path).where(F.size(f) >= 6).select(F.trim(f[0]).alias("Scheme_Code"), F.trim(f[1]).alias("ISIN"), F.trim(f[3]).alias("Scheme_Name"), number(f[4]).alias("NAV"), date(f[5]).alias("NAV_Date"))
    return rows.where("NAV is not null and Scheme_Code rlike '^[0-9]+$'")


def scan_delivery(raw: DataFrame) -> DataFrame:
    """(Symbol, Date, Delivery_Pct): the share delivered as given, else from the quantities; series EQ, BE or none."""
    df = aliased(raw, {"Symbol": (), "Series": (), "Date": ("date1", "timestamp"), "Delivery_Pct": ("deliv_per", "%dlyqttotradedqty"), "Delivered": ("deliv_qty",), "Traded": ("ttl_trd_qnty", "volume")})
    share = F.coalesce(number(F.col("Delivery_Pct")), number(F.col("Delivered")) / F.nullif(number(F.col("Traded")), F.lit(0.0)) * 100)
    kept = F.upper(F.trim(F.coalesce("Series", F.lit("")))).isin("EQ", "BE", "")
    return df.where(kept).select(F.trim("Symbol").alias("Symbol"), date(F.col("Date")).alias("Date"), share.alias("Delivery_Pct")).where("Symbol != '' and Date is not null")


def fold_flows(rows: DataFrame) -> DataFrame:
    """(Date, FII_Net, DII_Net) from a row a date and category; a date that only one side has keeps null for the other."""
    df = aliased(rows, {"Date": (), "Category": ("client type",), "Net": ("netvalue", "net value")})
    df = df.select(date(F.col("Date")).alias("Date"), F.upper("Category").alias("c"), number(F.col("Net")).alias("n")).where("Date is not null")
    foreign = F.col("c").rlike("FII|FPI")
    return df.groupBy("Date").agg(F.sum(F.when(foreign, F.col("n"))).alias("FII_Net"), F.sum(F.when(F.col("c").contains("DII") & ~foreign, F.col("n"))).alias("DII_Net"))


def scan_deals(layouts: list[DataFrame]) -> DataFrame:
    """(Date, Symbol, Client, Buy_Sell, Qty, Price) of deals landed in several layouts."""
    names = {"Date": ("deal date", "bd_dt_date"), "Symbol": ("bd_symbol", "security"), "Client": ("client name", "bd_client_name"), "Buy_Sell": ("buy/sell", "bd_buy_sell", "deal type"), "Qty": ("quantity traded", "bd_qty_trd", "quantity"), "Price": ("trade price / wght. avg. price", "bd_tp_watp", "price")}
    out = None
    for raw in layouts:
        df = aliased(raw, names)
        side = F.when(F.upper(F.trim("Buy_Sell")).startswith("B"), "BUY").when(F.upper(F.trim("Buy_Sell")).startswith("S"), "SELL")
        df = df.select(date(F.col("Date")).alias("Date"), F.upper(F.trim("Symbol")).alias("Symbol"), F.trim("Client").alias("Client"), side.alias("Buy_Sell"), number(F.col("Qty")).alias("Qty"), number(F.col("Price")).alias("Price"))
        out = df if out is None else out.unionByName(df)
    return out.where("Date is not null and Symbol is not null")


def dated_merge(old: DataFrame, new: DataFrame, keys: list[str], as_of: str, keep_days: int) -> DataFrame:
    """history_append, less rows dated more than keep_days before as_of."""
    return history_append(old, new, keys).where(F.col("Date") >= F.date_sub(F.lit(as_of).cast("date"), keep_days))


def degraded_guard(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """new, unless it has fewer than `least` times the rows of old: then old. Two counts decide."""
    return old if new.count() < least * old.count() else new


def table_sink(df: DataFrame, schema: StructType, path: str, by: str = "Date") -> None:
    """df under the schema as Parquet, a folder for each value of `by`; only those values' folders are replaced."""
    project_to_schema(df, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load_rules(rows: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """A row for each rule set (Rule_Set, Parameter, Value) with a column for each default; unparsable and missing values are the default."""
    value = lambda p: F.coalesce(F.max(F.when(F.col("Parameter") == p, F.col("Value").cast("string").try_cast("double"))), F.lit(float(defaults[p]))).alias(p)
    return rows.groupBy("Rule_Set").agg(*(value(p) for p in defaults))


def schema_migration(df: DataFrame, schema: StructType) -> DataFrame:
    """History under the schema; a missing version is 1, and Ranking_Column follows from it: before version 2 the final score ranked."""
    out = project_to_schema(df, schema)
    version = F.coalesce(F.col("Schema_Version"), F.lit(1))
    return out.withColumns({"Schema_Version": version, "Ranking_Column": F.when(version >= 2, "Confidence_Adjusted_Score").otherwise("Final_Score")})


def multi_file_union(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files below path as one table with Source_File; of a family (the name less its date) `*_latest` is taken, else the newest date."""
    files = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).select("*", F.col("_metadata.file_name").alias("Source_File"), F.col("_metadata.file_path").alias("_path"))
    folder = F.element_at(F.split("_path", "/"), -2)  # a landed file is a folder of parts
    stem = F.regexp_replace(folder, r"\.csv$", "")
    names = files.withColumn("Source_File", stem).withColumns({"_family": F.regexp_replace(stem, r"_(latest|\d{8})$", ""), "_rank": F.when(stem.endswith("_latest"), "99999999").otherwise(F.regexp_extract(stem, r"(\d{8})$", 1))})
    best = names.groupBy("_family").agg(F.max("_rank").alias("_best"))
    return names.join(best.hint("shuffle_hash"), "_family").where("_rank = _best").drop("_family", "_rank", "_best", "_path")


def atm_iv(chains: DataFrame) -> DataFrame:
    """(Symbol, Date, Strikes, IV) from option chains as JSON text (Symbol, Date, json): the largest volatility of calls and puts at the strike nearest to the underlying.

    Of strikes as near the lower one counts; Strikes says how many quotes it has. IV is null where none is positive. Text that is no chain gives no row.
    """
    schema = "underlying double, data array<struct<strike:double, ce:double, pe:double>>"
    c = chains.withColumn("c", F.from_json("json", schema)).select("Symbol", "Date", "c.underlying", F.explode("c.data").alias("d")).where("d.strike is not null and underlying is not null")
    near = F.struct(F.abs(F.col("d.strike") - F.col("underlying")), F.col("d.strike"))
    iv = F.greatest("d.ce", "d.pe")
    strikes = c.groupBy("Symbol", "Date", near.alias("near")).agg(F.count(F.lit(1)).alias("Strikes"), F.max(F.when(iv > 0, iv)).alias("IV"))
    return strikes.groupBy("Symbol", "Date").agg(F.min_by(F.struct("Strikes", "IV"), "near").alias("d")).select("Symbol", "Date", "d.Strikes", "d.IV")


def scan_filings(raw: DataFrame, as_of: str, days: int) -> DataFrame:
    """(Symbol, Title, Published) of announcements under alternate keys; blank symbols and titles go, unknown dates stay, others must lie within `days` of as_of."""
    df = aliased(raw, {"Symbol": ("sm_name", "scrip"), "Title": ("desc", "subject", "headline"), "Published": ("an_dt", "date", "sort_date")})
    df = df.select(F.upper(F.trim("Symbol")).alias("Symbol"), F.trim("Title").alias("Title"), date(F.col("Published")).alias("Published"))
    recent = F.col("Published").isNull() | (F.col("Published") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return df.where("Symbol != '' and Title != ''").where(recent)


def filings_for_symbols(filings: DataFrame, wanted: DataFrame) -> DataFrame:
    return filings.join(wanted.select("Symbol").distinct().hint("shuffle_hash"), "Symbol", "left_semi")


def scan_rss(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """(Query, Title, Link) of RSS items, one a title, the first `most` of each query by title."""
    items = spark.read.format("xml").option("rowTag", "item").schema("query string, title string, link string, pubDate string").load(path)
    one = items.where("title is not null").groupBy(F.col("query").alias("Query"), F.trim("title").alias("Title")).agg(F.min("link").alias("Link"))
    return one.withColumn("k", F.row_number().over(Window.partitionBy("Query").orderBy("Title"))).where(F.col("k") <= most).drop("k")


def earnings_horizon(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """(Symbol, Next_Earnings): the first event of each symbol from as_of to `days` later."""
    d = F.col("Next_Earnings")
    a = F.lit(as_of).cast("date")
    return events.where((d >= a) & (d <= F.date_add(a, days))).groupBy("Symbol").agg(F.min(d).alias("Next_Earnings"))


def shortlist(ranked: DataFrame, master: DataFrame, n: int) -> DataFrame:
    """(Symbol): the first n symbols of the ranked rows (Symbol, Place), else of the master by name. A top-n list."""
    first = ranked.select("Symbol", F.lit(0).alias("s"), F.col("Place").alias("p")).unionByName(master.select("Symbol", F.lit(1).alias("s"), F.lit(0).cast("long").alias("p")))
    source = first.agg(F.min("s").alias("_s"))
    return first.join(F.broadcast(source), F.col("s") == F.col("_s")).orderBy("p", "Symbol").limit(n).select("Symbol")


def iv_rank_daily(iv: DataFrame) -> DataFrame:
    """(Symbol, Date, IV_Rank): percentage of the symbol's 252 values before that lie below the current one; null for the first."""
    from barlake.operators.signals import share_below

    out = share_below(iv.select("Symbol", "Date", F.col("IV").alias("Value")), 252, 1, to=-1)
    return out.select("Symbol", "Date", F.col("Share").alias("IV_Rank"))
