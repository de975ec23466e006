"""Market tables derived from the order, supplier and event tables; FIXTURES.md describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(key: str):
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """(Symbol, Date, Open, High, Low, Close, Price, Volume): unit prices of a supplier's lines by week or day."""
    line = table(spark, sf_dir, "lineitem").select(
        symbol("l_suppkey").alias("Symbol"),
        F.date_trunc(grain, "l_shipdate").cast("date").alias("Date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        F.col("l_quantity").alias("quantity"),
    )
    # dealt by symbol, which serves the grouping and the window alike
    grouped = line.repartition("Symbol").groupBy("Symbol", "Date").agg(
        F.max("unit").alias("High"), F.min("unit").alias("Low"), F.round(F.avg("unit") + 1.37e-8, 6).alias("Close"), F.sum("quantity").alias("Volume")
    )
    last = F.lag("Close").over(Window.partitionBy("Symbol").orderBy("Date"))
    return grouped.select("Symbol", "Date", F.coalesce(last, F.col("Close")).alias("Open"), "High", "Low", "Close", F.col("Close").alias("Price"), "Volume")


def benchmark(bars: DataFrame) -> DataFrame:
    """(Date, Benchmark_Close): the mean close of all symbols; a row for each date."""
    return bars.groupBy("Date").agg(F.round(F.avg("Close") + 1.37e-8, 6).alias("Benchmark_Close"))


def sessions(bars: DataFrame) -> DataFrame:
    """benchmark with Symbols, the number of the date's bars; a row for each date."""
    return bars.groupBy("Date").agg(F.round(F.avg("Close") + 1.37e-8, 6).alias("Benchmark_Close"), F.count(F.lit(1)).alias("Symbols"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument master: sector from the nation, group from the region, universe and eligibility by the supplier's key."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.select(
        symbol("s_suppkey").alias("Symbol"),
        F.col("s_name").alias("Name"),
        F.when(F.col("s_suppkey") % 4 == 0, "ETF").otherwise("Stock").alias("Universe"),
        F.col("r_name").alias("Universe_Group"),
        F.col("n_name").alias("Sector"),
        F.when(F.col("s_suppkey") % 11 == 0, "No").otherwise("Yes").alias("Opportunity_Eligible"),
    )


def etf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fund data of the ETF suppliers, with gaps by the key's remainders."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier").where(k % 4 == 0)
    return s.select(
        symbol("s_suppkey").alias("Symbol"),
        ((k % 7 - 3) / F.lit(100.0)).alias("NAV_Gap"),
        F.when(k % 5 != 0, F.abs(bal) / 20.0).alias("AUM_Cr"),
        F.when(k % 3 != 0, (k % 13) / F.lit(1000.0)).alias("TER"),
        F.when(k % 6 != 0, (k % 9) / F.lit(200.0)).alias("Tracking_Error"),
        F.when(k % 8 != 0, (k % 10 - 5) / F.lit(200.0)).alias("Tracking_Difference"),
        F.element_at(F.array(*map(F.lit, ("Verified", "Suggested", "Review", "Missing"))), ((k / 4).cast("long") % 4 + 1).cast("int")).alias("Mapping_Status"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Date, FII_Net, DII_Net): purchases less errors and views less clicks of each day's events."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("Date"), "event_type", "value")
    net = lambda plus, minus: F.sum(F.when(F.col("event_type") == plus, F.col("value")).when(F.col("event_type") == minus, -F.col("value")).otherwise(0.0))
    return e.groupBy("Date").agg(F.round(net("purchase", "error"), 6).alias("FII_Net"), F.round(net("view", "click"), 6).alias("DII_Net"))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Symbol, Date, Buy_Sell, Qty, Price): purchases and signups as buys, errors as sells, by user."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    side = F.when(F.col("event_type") == "error", "Sell").otherwise("Buy")
    return e.select(F.concat(F.lit("S"), F.col("user_id") % 100).alias("Symbol"), F.to_date("ts").alias("Date"), side.alias("Buy_Sell"), F.lit(1.0).alias("Qty"), F.col("value").alias("Price"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, Symbol, title): every document's whole text as a headline, by its source."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("Symbol"), F.col("text").alias("title"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Symbol, Sector, Self_Median_PE and metrics): a supplier's metrics from its lines, with gaps by the key's remainders."""
    k = F.col("l_suppkey")
    r = lambda x: F.round(x + 1.37e-8, 6)
    line = table(spark, sf_dir, "lineitem").groupBy(k).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"), F.percentile("l_quantity", 0.5).alias("m")
    )
    some = line.select(
        symbol("l_suppkey").alias("Symbol"), F.when(k % 7 != 0, r(F.col("u") / 100)).alias("PE"), F.when(k % 5 != 0, r(F.col("d") * 4)).alias("ROE"), F.when(k % 6 != 0, r(F.col("t") * 10)).alias("DebtToEquity"),
        F.when(k % 9 != 0, r(F.col("q") / 50 - 0.5)).alias("EarningsGrowth"), F.when(k % 4 != 0, r(F.col("d") + F.col("t"))).alias("ProfitMargin"), r(F.col("m") * F.col("u") / 2550).alias("Self_Median_PE"),
    )
    return some.join(master(spark, sf_dir).select("Symbol", "Sector"), "Symbol", "left")
