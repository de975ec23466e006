"""Incremental tables: keyed appends, freezes, retention, and the health of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def project_to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones as typed nulls, others cast, unparsable values null."""
    have = {c.lower(): c for c in df.columns}
    col = lambda f: F.col(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
    return df.select(*(col(f).alias(f.name) for f in schema.fields))


def history_append(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, the last one of each key: new before old. Duplicates within the old table heal too."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_batch")]
    order = [F.col("_batch").desc(), *(F.col(c).desc_nulls_last() for c in rest)]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k", "_batch")


def price_cache_update(cache: DataFrame, fresh: DataFrame, freeze: bool = True) -> DataFrame:
    """Frozen: only (Date, Symbol) that the cache lacks are added. Else fresh rows win."""
    if not freeze:
        return history_append(cache, fresh, ["Date", "Symbol"])
    return cache.unionByName(fresh.join(cache.select("Date", "Symbol"), ["Date", "Symbol"], "left_anti"))


def stale_symbols(cache: DataFrame, universe: DataFrame, as_of: str, days: int) -> DataFrame:
    """(Symbol, Last_Date): symbols of the universe that the cache lacks or last saw more than `days` before as_of."""
    last = cache.groupBy("Symbol").agg(F.max("Date").alias("Last_Date"))
    met = universe.select("Symbol").distinct().join(last, "Symbol", "left")
    return met.where(F.col("Last_Date").isNull() | (F.datediff(F.lit(as_of).cast("date"), "Last_Date") > days))


def recent_window(bars: DataFrame, days: int) -> DataFrame:
    """Rows of the last `days` days of the table; the last date is one row, broadcast."""
    last = bars.agg(F.max("Date").alias("_last"))
    return bars.join(F.broadcast(last), F.col("Date") >= F.date_sub("_last", days)).drop("_last")


def business_day_gaps(dates: DataFrame, *keys: str) -> DataFrame:
    """(keys, Date): weekdays between the first and last date of each key that the table lacks. A null date counts for nothing."""
    span = dates.where("Date is not null").groupBy(*keys).agg(F.min("Date").alias("a"), F.max("Date").alias("b")).where("a is not null")
    every = span.select(*keys, F.explode(F.sequence("a", "b")).alias("Date")).where(F.weekday("Date") < 5)
    return every.join(dates.select(*keys, "Date").distinct().hint("shuffle_hash"), [*keys, "Date"], "left_anti")


def feed_health(feeds: DataFrame, as_of: str) -> DataFrame:
    """(feed, Rows, Last_Date, Status): green up to 2 days old, amber up to 7, else red."""
    age = F.datediff(F.lit(as_of).cast("date"), "Last_Date")
    agg = feeds.groupBy("feed").agg(F.count(F.lit(1)).alias("Rows"), F.max("Date").alias("Last_Date"))
    return agg.withColumn("Status", F.when(age <= 2, "green").when(age <= 7, "amber").otherwise("red"))


def forward_history_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones that could not be computed again; `origin` tells which."""
    kept = old.join(new.select(*keys), keys, "left_anti").withColumn("origin", F.lit("retained"))
    return new.withColumn("origin", F.lit("computed")).unionByName(kept, allowMissingColumns=True)
