"""Incremental tables that see late data: upserts that touch the buckets of their keys, and state by key.

A table is kept in buckets by the hash of its keys. A batch writes new versions of the buckets that its keys fall into and a list of
every bucket's version; it reads the old versions of these buckets alone. Lists and versions carry the batch's number, so a batch that
runs again writes the same. State by symbol or cluster lives in Spark's state store, so a batch sees its own rows and the state of its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlake.sources.shared import shared_path


class BucketTable:
    """A keyed table in `buckets` buckets; of rows with one key the first by `order` stays. keys: no nulls are told apart from other nulls."""

    def __init__(self, spark: SparkSession, name: str, keys: list[str], order: list[Column], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, shared_path(spark, name), keys, order, buckets

    def _versions(self, before: int) -> dict[int, int]:
        """Bucket -> batch that wrote it last, as of the batch before; at most `buckets` entries."""
        if before <= 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/versions/{before - 1}").collect()}

    def _read(self, versions: dict[int, int], like: DataFrame) -> DataFrame | None:
        paths = [f"{self.path}/data/{v}/_bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(like.schema).parquet(*paths) if paths else None

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Merges a batch. Of the rows of a key, old ones included, the first by order stays, so order may prefer old or new ones, or the least value."""
        rows = batch.withColumn("_landed", F.lit(number).cast("long"))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())
        versions = self._versions(number)
        old = self._read({b: versions[b] for b in touched if b in versions}, rows)
        both = rows if old is None else rows.unionByName(old)
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.order))
        kept = both.withColumn("_k", place).where("_k = 1").drop("_k").withColumn("_bucket", bucket)
        kept.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{number}")
        listed = list((versions | dict.fromkeys(touched, number)).items())
        self.spark.createDataFrame(listed, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{number}")

    def table(self, last: int, like: DataFrame) -> DataFrame:
        """The table after batch `last`; like: a table of the batches' columns."""
        rows = like.withColumn("_landed", F.lit(0).cast("long"))
        found = self._read(self._versions(last + 1), rows)
        return (rows.limit(0) if found is None else found).drop("_landed")


def upserted(stream: DataFrame, name: str, keys: list[str], order: list[Column], buckets: int = 64) -> DataFrame:
    """The stream's rows as a table with one row a key, kept bucket by bucket. order may name `_landed`, the number of the batch that brought a row."""
    spark, last = stream.sparkSession, [-1]
    table = BucketTable(spark, name, keys, order, buckets)

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)
        last[0] = number

    query = stream.writeStream.option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return table.table(last[0], spark.createDataFrame([], stream.schema))


def _earliest(keep_ms: int) -> Callable:
    """The state of a bucket: its clusters' keys in order, and each one's first story and time, and the time of its latest one (microseconds)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame(dict(zip(("Cluster_Key", "id", "seen", "latest"), state.get, strict=True)) if state.exists else {"Cluster_Key": [], "id": [], "seen": [], "latest": []})
        old = old.astype({"Cluster_Key": object, "id": "int64", "seen": "int64", "latest": "int64"})
        landed = [] if state.hasTimedOut else list(frames)
        new = pd.concat(landed) if landed else old.iloc[:0].rename(columns={"latest": "First_Seen"})[["Cluster_Key", "id", "First_Seen"]].astype({"First_Seen": "datetime64[us]"})
        new = new.assign(seen=new["First_Seen"].astype("datetime64[us]").astype("int64"))
        mark = state.getCurrentWatermarkMs()
        # clusters without a story in this batch are forgotten when their time is over
        old = old[(old["latest"] // 1000 + keep_ms > mark) | old["Cluster_Key"].isin(new["Cluster_Key"])]
        both = pd.concat([old, new.assign(latest=new["seen"])[["Cluster_Key", "id", "seen", "latest"]]])
        best = both.sort_values(["Cluster_Key", "seen", "id"]).drop_duplicates("Cluster_Key").drop(columns="latest")
        best = best.merge(both.groupby("Cluster_Key", as_index=False)["latest"].max(), on="Cluster_Key")
        if best.empty:
            state.remove()
            return
        state.update(tuple(best[c].tolist() for c in ("Cluster_Key", "id", "seen", "latest")))
        state.setTimeoutTimestamp(max(int(best["latest"].min() // 1000) + keep_ms, mark + 1))
        was = best.merge(old[["Cluster_Key", "id", "seen"]], on=["Cluster_Key", "id", "seen"], how="left", indicator=True)["_merge"] == "both"
        out = best[~was.to_numpy()]
        if len(out):
            yield pd.DataFrame({"Cluster_Key": out["Cluster_Key"].to_numpy(), "id": out["id"].to_numpy(), "First_Seen": out["seen"].to_numpy().astype("datetime64[us]")})

    return update


def first_seen(stories: DataFrame, late: str = "30 days", keep_days: int = 180, buckets: int = 512) -> DataFrame:
    """A stream of (Cluster_Key, id, First_Seen): the earliest story of each cluster, anew whenever an earlier one lands.

    stories: Cluster_Key, id, First_Seen (timestamp), a stream. By the stream's own time, the greatest First_Seen so far less `late`, older stories are left out, and a cluster is
    forgotten `keep_days` after its latest story; one that lands after that opens it anew. Of stories of one time the smaller id counts. Rows without a key or time go.
    The clusters of one of `buckets` buckets, by the key's hash, share a state and are looked at together: a batch reads and writes the states that its keys fall into.
    """
    some = stories.where("Cluster_Key is not null and First_Seen is not null").withWatermark("First_Seen", late).select(F.pmod(F.xxhash64("Cluster_Key"), F.lit(buckets)).alias("_bucket"), "Cluster_Key", "id", "First_Seen")
    return some.groupBy("_bucket").applyInPandasWithState(_earliest(keep_days * 86_400_000), "Cluster_Key string, id long, First_Seen timestamp", "keys array<string>, ids array<long>, seen array<long>, latest array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def _matured(horizons: tuple[int, ...]) -> Callable:
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, prices = (list(x) for x in state.get) if state.exists else ([], [])
        bars, new = dict(zip(days, prices, strict=True)), set()
        for f in frames:
            for day, price in zip((pd.to_datetime(f["Date"]) - pd.Timestamp(0)).dt.days.tolist(), f["Price"].tolist(), strict=True):
                if day not in bars or price > bars[day]:
                    bars[day] = price
                    new.add(day)
        days = sorted(bars)
        prices = [float(bars[d]) for d in days]
        state.update((days, prices))
        # a bar changes its own row and those that it stands within the farthest horizon of
        place = {d: i for i, d in enumerate(days)}
        touched = sorted({i for d in new for i in range(max(0, place[d] - max(horizons)), place[d] + 1)})
        out = []
        for i in touched:
            for h in horizons:
                later = prices[i + h] if i + h < len(days) else None
                out.append((key[0], pd.Timestamp(0) + pd.Timedelta(days=days[i]), h, None if later is None or prices[i] == 0 else later / prices[i] - 1))
        if out:
            frame = pd.DataFrame(out, columns=["Symbol", "Signal_Date", "Horizon_Days", "Gross_Forward_Return"])
            yield frame.assign(Signal_Date=frame["Signal_Date"].dt.date, Gross_Forward_Return=frame["Gross_Forward_Return"].astype("float64"))

    return update


def matured(bars: DataFrame, horizons: tuple[int, ...] = (5, 21)) -> DataFrame:
    """A stream of (Symbol, Signal_Date, Horizon_Days, Gross_Forward_Return) of a signal at every bar: rows as they mature, and anew where a late or better bar changes them.

    bars: Symbol, Date, Price, a stream; of a day's prices the highest counts, null ones go. Return: the price h bars later over the signal's, less 1; null while pending and for a price of 0.
    The state holds a symbol's bars, so that a bar however late repairs the rows before it; a batch reads its own bars and the state of their symbols.
    """
    some = bars.where("Symbol is not null and Date is not null and Price is not null and not isnan(Price)").select("Symbol", "Date", "Price")
    return some.groupBy("Symbol").applyInPandasWithState(_matured(horizons), "Symbol string, Signal_Date date, Horizon_Days long, Gross_Forward_Return double", "days array<int>, prices array<double>", "update", GroupStateTimeout.NoTimeout)


def land(df: DataFrame, name: str, order: Column, parts: int = 3, files: int = 2) -> str:
    """Writes df to a new folder in `parts` landings by `order` (0, 1, ...), of `files` files each, one after the other; its path."""
    path = shared_path(df.sparkSession, name)
    for k in range(parts):
        df.where(order == k).repartition(files).write.mode("append").parquet(path)
    return path
