"""Streaming twins: daily windows of the event stream, and keyed tables kept by batches of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlake.sources.shared import shared_path


def read_events(spark: SparkSession, folder: str, schema: StructType, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """The landed event files of a folder as a stream, `files` of them a batch; times without a zone are the session's."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def flow_windows(events: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(Day, event_type, n, value): sums by window and type; rows later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.to_date("w.start").alias("Day"), "event_type", "n", "value")


def first_of_key(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def landed(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs the stream over all that has landed; each batch's rows as a table with its number in `_batch`.

    A batch that runs again after a failure overwrites its own folder, so rows are there once.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/*")


def last_of_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest batch's row of each key: an upsert log read as a table."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_batch").desc()))
    return changes.withColumn("_k", newest).where("_k = 1").drop("_k", "_batch")
