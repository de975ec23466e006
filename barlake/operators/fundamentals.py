"""Fundamental scores of a universe, by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.frames import clip, percent_rank

#: Metric, weight and whether higher is better. Fixed values.
METRICS = (("ROE", 0.25, True), ("EarningsGrowth", 0.20, True), ("ProfitMargin", 0.20, True), ("PE", 0.20, False), ("DebtToEquity", 0.15, False))


def fundamental_quality(df: DataFrame, *keys: str) -> DataFrame:
    """Fundamental_Score: weighted mean of the metrics' percentiles, winsorised at 2 and 98 % where there are 5; Fundamental_Coverage: share of metrics there are."""
    w = Window.partitionBy(*keys)
    for name, _, _ in METRICS:
        x = F.col(name)
        ends = F.percentile(x, F.array(F.lit(0.02), F.lit(0.98))).over(w)
        df = df.withColumn("_e", ends).withColumn(f"_{name}", F.when(F.count(x).over(w) >= 5, F.least(F.greatest(x, F.col("_e")[0]), F.col("_e")[1])).otherwise(x))
    df = df.withColumns({f"_p{name}": percent_rank(F.col(f"_{name}"), *keys) * 100 if up else (1 - percent_rank(F.col(f"_{name}"), *keys)) * 100 for name, _, up in METRICS})
    have = [(F.col(f"_p{name}"), weight) for name, weight, _ in METRICS]
    total = sum((F.when(p.isNotNull(), F.lit(wt)).otherwise(0.0) for p, wt in have), F.lit(0.0))
    score = sum((F.coalesce(p, F.lit(0.0)) * wt for p, wt in have), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    some = sum((F.when(p.isNotNull(), 1).otherwise(0) for p, _ in have), F.lit(0))
    return df.withColumns({"Fundamental_Score": score, "Fundamental_Coverage": some / F.lit(float(len(METRICS)))}).drop(*(c for c in df.columns if c.startswith("_")))


def fundamental_zscore(df: DataFrame, *keys: str) -> DataFrame:
    """Fundamental_Z: mean z-score of at least 2 metrics, signs so that higher is better, within -3 and 3; and Z_Coverage."""
    w = Window.partitionBy(*keys)

    def z(name: str, up: bool) -> Column:
        x, sd = F.col(name), F.stddev_pop(name).over(w)
        raw = F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, F.when(x.isNotNull(), 0.0)).otherwise((x - F.avg(x).over(w)) / sd)
        return F.when(F.count(x).over(w) >= 3, raw if up else -raw)

    df = df.withColumn("_z", F.array_compact(F.array(*(z(name, up) for name, _, up in METRICS))))
    mean = F.aggregate("_z", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_z"), F.lit(0))
    return df.withColumns({"Fundamental_Z": F.when(F.size("_z") >= 2, clip(mean, -3, 3)), "Z_Coverage": F.size("_z") / F.lit(float(len(METRICS)))}).drop("_z")


def valuation_flag(df: DataFrame, *keys: str) -> DataFrame:
    """Valuation: Cheap, Expensive, Fair or Unknown, by votes of the PE against the symbol's own median and its sector's, each by 15 %."""
    df = df.withColumn("Sector_Median_PE", F.percentile("PE", 0.5).over(Window.partitionBy(*keys, "Sector")))
    pe = F.col("PE")

    def vote(ref: Column) -> Column:
        return F.when(ref > 0, F.when(pe < ref * 0.85, 1).when(pe > ref * 1.15, -1).otherwise(0))

    own, sector = vote(F.col("Self_Median_PE")), vote(F.col("Sector_Median_PE"))
    votes = F.coalesce(own, F.lit(0)) + F.coalesce(sector, F.lit(0))
    unknown = pe.isNull() | (pe <= 0) | (own.isNull() & sector.isNull())
    return df.withColumn("Valuation", F.when(unknown, "Unknown").when(votes >= 1, "Cheap").when(votes <= -1, "Expensive").otherwise("Fair"))


def fundamentals_table(raw: DataFrame, requested: DataFrame) -> DataFrame:
    """A row for each requested symbol with its metrics and Coverage_Status: complete, partial or missing."""
    have = sum((F.when(F.col(name).isNotNull(), 1).otherwise(0) for name, _, _ in METRICS), F.lit(0))
    met = requested.select("Symbol").distinct().join(raw.hint("shuffle_hash"), "Symbol", "left")
    return met.withColumn("Coverage_Status", F.when(have == len(METRICS), "complete").when(have > 0, "partial").otherwise("missing"))
