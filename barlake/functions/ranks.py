"""Ranks of cross-sections of any size: dates of moderate size are ranked whole, all components at once; larger ones are dealt over tasks by ranges, and ranks put together from offsets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barlake.functions.frames import clip

Keep = Callable[[DataFrame, str], DataFrame]
#: Values of one cross-section that a task sorts; rows of a table of bounds that is broadcast after it was counted.
BUCKET, SMALL = 100_000, 100_000
#: Rows of a date that with_ranks takes as one group of a task, with all their columns: some 500 bytes a row.
WHOLE = 500_000
#: Digits enough for any double at a few decimals.
_DIGITS = Context(prec=400)


def _sorted_ranks(long: DataFrame, keys: list[str]) -> DataFrame:
    """`_r`: the average rank of `_v` within keys, from one sort."""
    order = Window.partitionBy(*keys).orderBy("_v")
    ties = F.count("_v").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return long.withColumn("_r", F.rank().over(order) + (ties - 1) / F.lit(2.0))


def ranked(long: DataFrame, keys: list[str], value: str, keep: Keep, bucket: int = BUCKET, most: int | None = None) -> DataFrame:
    """long with `rank`, the average rank of `value` (at 10 decimals) within keys, and `n`, the number of values; rows without a value go.

    Where a cross-section has more than `bucket` values, all are cut into ranges at approximate quantiles. Each range is sorted in a task of its own, and the
    sizes of the ranges before it are added to its ranks. A value at several quantiles is a range of its own, which is not sorted:
    its rank follows from the sizes alone. Results do not depend on the cuts. `most` is a bound on the values of a
    cross-section; they are counted where it is not given. keep(df, name) writes a table and returns it.
    """
    long = long.where(F.col(value).isNotNull()).withColumn("_v", F.round(F.col(value), 10))
    if most is None or most > bucket:
        long = keep(long, "values")
        most = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= bucket:
        whole = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return _sorted_ranks(long, keys).withColumns({"rank": F.col("_r"), "n": F.count("_v").over(whole)}).drop("_v", "_r")
    parts = min(2 * -(-most // bucket), 10_000)
    quantiles = F.percentile_approx("_v", [i / parts for i in range(1, parts)], 10 * parts)
    cuts = keep(long.groupBy(*keys).agg(quantiles.alias("_q")).withColumns({"_cuts": F.array_distinct("_q"), "_heavy": F.array_distinct(F.filter("_q", lambda x, i: (i > 0) & (x == F.element_at("_q", i))))}).drop("_q"), "cuts")
    side = F.broadcast if cuts.count() * parts <= SMALL else (lambda df: df.hint("merge"))
    # values below the first cut are range 0, a heavy cut itself an odd range
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    dealt = keep(long.join(side(cuts), keys).withColumn("_b", 2 * below + F.array_contains("_heavy", F.col("_v")).cast("int")).drop("_cuts", "_heavy"), "ranges")
    at = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_size"))
    by = Window.partitionBy(*keys).orderBy("_b")
    offsets = keep(at.withColumns({"_offset": F.sum("_size").over(by) - F.col("_size"), "n": F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}), "offsets")
    met = lambda df: df.join(F.broadcast(offsets) if few else offsets.hint("merge"), [*keys, "_b"])
    few = offsets.count() <= SMALL
    sorted_ = met(_sorted_ranks(dealt.where("_b % 2 = 0"), [*keys, "_b"]))
    heavy = met(dealt.where("_b % 2 = 1")).withColumn("_r", (F.col("_size") + 1) / F.lit(2.0))
    both = sorted_.unionByName(heavy).withColumn("rank", F.col("_offset") + F.col("_r"))
    return both.drop("_v", "_b", "_r", "_size", "_offset")


def component_ranks(df: DataFrame, components: dict[str, Column], keep: Keep, bucket: int = BUCKET) -> DataFrame:
    """(Date, Symbol, one struct (rank, n) a component) of rows that have any of the components; a component without a value is null.

    The components are ranked in long form, by one sort for all of them. (Date, Symbol) is unique.
    """
    names = list(components)
    values = F.posexplode(F.array(*(c.cast("double") for c in components.values()))).alias("_c", "_x")
    most = largest(df)
    long = ranked(df.select("Date", "Symbol", values), ["Date", "_c"], "_x", keep, bucket, most)
    each = lambda i: [F.max(F.when(F.col("_c") == i, F.col(c))).alias(f"_{c}{i}") for c in ("rank", "n")]
    wide = long.groupBy("Date", "Symbol").agg(*(c for i in range(len(names)) for c in each(i)))
    return wide.select("Date", "Symbol", *(F.when(F.col(f"_n{i}").isNotNull(), F.struct(F.col(f"_rank{i}").alias("rank"), F.col(f"_n{i}").alias("n"))).alias(name) for i, name in enumerate(names)))


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Which values there are, and each one's place among the distinct ones in order; NaN counts as the largest."""
    there, x = column.is_valid().to_numpy(), column.to_numpy()
    out = np.zeros(len(x), np.int64)
    out[there] = np.unique(x[there], return_inverse=True)[1]
    return there, out


def rounded(column: pa.ChunkedArray, decimals: int = 10) -> pa.Array:
    """Doubles as Spark's round gives them, half up by their decimal digits; digits are written out for those alone that lie near a half or are too large for whole numbers."""
    x, there = column.to_numpy(), column.is_valid().to_numpy()
    some = there & (np.abs(x) < 1e290)  # larger ones have no decimals
    t = np.where(some, np.abs(x), 0.0) * 10.0**decimals
    whole = np.floor(t + 0.5)
    out = np.copysign(whole / 10.0**decimals, x)
    near = np.abs(t - np.floor(t) - 0.5) <= 1e-6 + t * 1e-15
    for i in np.flatnonzero(some & (near | (t >= 2.0**52))):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP, _DIGITS))
    return pa.array(np.where(some, out, x), mask=~there)


def average_ranks(places: np.ndarray) -> np.ndarray:
    """Average ranks of values by their codes."""
    counts = np.bincount(places)
    return (np.cumsum(counts) - (counts - 1) / 2)[places]


def _ranks_of_a_date(names: Sequence[str]):
    """The rows of one date with a struct (rank, n) in place of each component's value."""

    def run(table: pa.Table) -> pa.Table:
        out = {c: table.column(c) for c in table.column_names if c not in names}
        for c in names:
            there, places = codes(table.column(c))
            rank, n = np.zeros(len(there)), int(there.sum())
            if n:
                rank[there] = average_ranks(places[there])
            out[c] = pa.StructArray.from_arrays([pa.array(rank), pa.array(np.full(len(there), n))], ["rank", "n"], mask=pa.array(~there))
        return pa.table(out)

    return run


def largest(df: DataFrame) -> int:
    """The number of rows of the date that has most."""
    return df.groupBy("Date").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def with_ranks(df: DataFrame, components: dict[str, Column], keep: Keep, most: int | None = None, columns: Sequence[str] | None = None, whole: int = WHOLE) -> DataFrame:
    """df, or its columns named (with Date and Symbol), with a struct (rank, n) a component, null where it has no value: ranks as those of component_ranks. (Date, Symbol) is unique.

    Where no date has more than `whole` rows, the rows are shuffled once, by date, and a date is one group of a task; nothing is written. `most` is a bound on the rows of a date;
    where it is not given, or is beyond `whole`, df is written, and in the latter case its components are ranked in long form and joined.
    """
    columns = df.columns if columns is None else list(columns)
    if most is None:
        df = keep(df, "rows")
        most = largest(df)
    elif most > whole:
        df = keep(df, "rows")
    if most > whole:
        return df.select(*columns).join(component_ranks(df, components, keep).hint("merge"), ["Date", "Symbol"], "left")
    rows = df.select(*columns, *(F.round(c.cast("double"), 10).alias(k) for k, c in components.items()))
    place = StructType([StructField("rank", DoubleType()), StructField("n", LongType())])
    schema = StructType([*df.select(*columns).schema.fields, *(StructField(k, place) for k in components)])
    return rows.groupBy("Date").applyInArrow(_ranks_of_a_date(list(components)), schema)


def share(ranks: str) -> Column:
    """Rank as a share of the values."""
    return F.col(f"{ranks}.rank") / F.col(f"{ranks}.n")


def score(ranks: str, higher_is_better: bool) -> Column:
    """0 to 100 by rank: 100 * share, or 100 less that; 50 without a value and where there is at most one."""
    p = share(ranks) * 100
    p = p if higher_is_better else 100 - p
    return F.when(F.col(ranks).isNull() | (F.col(f"{ranks}.n") <= 1), 50.0).otherwise(clip(p, 0, 100))
