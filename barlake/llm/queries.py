"""The operators' registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import bagminhash, decontaminate, langid, licenses, line_chunks, mixture, multi_index, negatives, quality, recompress, topk, urls, whitening
from barlake.llm.oracles import oracle_sql as oracle_sql
from barlake.llm.tables import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup_digests(documents(spark, sf_dir))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), digest.alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.rate(docs, quality.fit_labels(docs, _table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(multi_index.usable(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.labelled(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.usable(_table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_cover_tree, op2_bagminhash, op3_language_id, op4_decontamination, op5_substring_dedup, op6_line_chunks, op7_url_filter, op8_mixture, op9_quality, op10_license_scan, op11_multi_index, op12_hard_negatives, op13_whitening)
    return {f.__name__: f for f in found}
