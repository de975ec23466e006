"""Tables written between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.native import small

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one in local mode alone, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-barlake-")
    return _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no earlier step."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, *more: Column) -> tuple:
    """(table, rows, *more): df written, with its number of rows and further aggregates."""
    table = written(df, name)
    return table, *table.agg(F.count(F.lit(1)), *more).first()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_sample(df: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """At most `bound` rows of each label, chosen by the hash of `key`, so that reruns agree.

    A hash threshold from the label's count thins the rows first; the rank that enforces
    the bound then sees little more than `bound` rows of a label.
    """
    from pyspark.sql import Window

    modulus = 1 << 20
    counts = small(written(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "label_counts"))
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(modulus))
    # 1.3 times the bound, and a constant for small counts: the rank seldom finds too few rows
    share = F.least(F.lit(1.0), F.lit(1.3 * bound + 30) / F.col("_n"))
    thin = df.join(counts, label).where(h < share * modulus)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key)), F.col(key)))
    return thin.withColumn("_r", rank).where(F.col("_r") <= bound).drop("_r", "_n")
