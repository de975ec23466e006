"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions alone.

Every document has a hash of 40 bits. A source's words are summed by the hash's first bits; the bucket in which the sum
passes the source's budget is refined by the next bits, and so on. What lies below the final threshold is taken, so
a larger budget takes all that a smaller one does. No rows are sorted but a source's buckets, of which there are
1,024 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.native import small
from barlake.llm.tables import written

#: Weights by the rank of the source, repeating; words taken as a share of all words; most times a document is taken.
WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2
BITS, STEP = 40, 10
#: What is left of a budget is filled from documents of at most this share of it.
FILL = 0.25


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def position() -> Column:
    """The document's hash, from its id and size; null ids differ by size alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """sources (source_key, source, source_size) with target: shares of `total` of all words by weight, none above `most` times its words.

    The excess of sources at their limit is shared by weight among the others: target = least(weight * level, limit), where
    the level is found from the sources in order of limit / weight. One row a source is all that is looked at.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    t = sources.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * most).withColumn("c", F.col("cap") / F.col("w"))
    by = Window.orderBy("c")
    to, beyond = by.rangeBetween(Window.unboundedPreceding, 0), by.rangeBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumns({"A": F.sum("cap").over(to), "own": F.sum("cap").over(Window.partitionBy("c")), "ww": F.sum("w").over(beyond), "own_w": F.sum("w").over(Window.partitionBy("c")), "T": F.sum("source_size").over(every) * F.lit(total)})
    reached = F.col("A") + F.col("c") * (F.col("ww") - F.col("own_w")) >= F.col("T")
    t = t.withColumn("level", F.when(reached, (F.col("T") - (F.col("A") - F.col("own"))) / F.col("ww")))
    level = F.min_by("level", F.when(reached, F.col("c"))).over(every)
    return t.select("source_key", "source", "source_size", F.least(F.col("w") * level, F.col("cap")).alias("target"))


def chosen(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source_key, limit, last): a source's documents with hash < limit are taken, those with hash = limit too if `last`.

    docs: source_key, size, h. budgets: source_key, budget. left: what remains of the budget then.
    """
    state = budgets.select("source_key", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for done in range(STEP, BITS + 1, STEP):
        state = written(state, "budgets")
        inside = docs.join(small(state), "source_key").where(F.shiftright("h", BITS - done + STEP) == F.col("prefix"))
        histogram = inside.groupBy("source_key", F.shiftright("h", BITS - done).alias("bucket"), "left").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        histogram = histogram.withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") > F.col("left"))
        over = histogram.groupBy("source_key").agg(F.min(F.struct("bucket", "sum", "n", "left")).alias("x"))
        state = over.select("source_key", F.col("x.bucket").alias("prefix"), (F.col("x.left") - (F.col("x.sum") - F.col("x.n"))).alias("left"), F.col("x.n").alias("n"))
        if done < BITS:
            state = state.drop("n")
    last = F.col("left") * 2 >= F.col("n")
    return written(state.select("source_key", F.col("prefix").alias("limit"), last.alias("last"), F.when(last, F.lit(0.0)).otherwise(F.col("left")).alias("left")), "limits")


def _is_taken(limits: str = "limit", last: str = "last") -> Column:
    """Sources without a limit take all that there is."""
    return F.col(limits).isNull() | (F.col("h") < F.col(limits)) | ((F.col("h") == F.col(limits)) & F.col(last))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and copies: docs, all columns, with how often the mix takes each.

    size: words of the text (null: 0). Every document of a source is taken floor(target / source_size) times; hash
    thresholds take some once more, so that the source's words come near its target. A null source is a source.
    Null ids are taken by size; repeated rows are taken alike. Reruns agree.
    Columns of docs that have an added name are replaced.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = docs.select("doc_id", key.alias("source_key"), "source", size().alias("size")).withColumn("h", position())
    sized = written(sized, "sized")
    sums = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goals = written(targets(sums).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)), "targets")
    budgets = goals.where("source_size > 0").select("source_key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    limits = chosen(sized.where("size > 0"), budgets)
    # the rest of the budget, from small documents that are not taken yet
    rest = sized.where("size > 0").join(small(limits.select("source_key", "limit", "last", F.col("left").alias("_left"))), "source_key")
    rest = rest.where(~_is_taken() & (F.col("size") <= F.col("_left") * FILL) & (F.col("h") > F.col("limit"))).select("source_key", "size", "h")
    fill = chosen(rest, limits.where("left > 0").select("source_key", F.col("left").alias("budget")))
    state = goals.select("source_key", "source_size", "target", "whole").join(small(limits).select("source_key", "limit", "last", "left"), "source_key", "left")
    state = state.join(small(fill).select("source_key", F.col("limit").alias("fill_limit"), F.col("last").alias("fill_last")), "source_key", "left")
    state = written(state, "mixture")
    keyed = docs.select("doc_id", key.alias("_key"), size().alias("size"), F.struct(*docs.columns).alias("_row")).withColumn("h", position())
    met = keyed.join(small(state), keyed["_key"] == state["source_key"])
    frac = F.col("target") - F.col("whole") * F.col("source_size")
    filled = (F.col("size") <= F.col("left") * FILL) & (F.col("h") > F.col("limit")) & (F.col("left") > 0) & _is_taken("fill_limit", "fill_last")
    more = F.when((frac > 0) & (_is_taken() | filled), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + more, F.lit(MOST))).otherwise(0).cast("long")
    added = ["size", "source_size", "target", "taken", "copies"]
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return met.withColumns({"copies": copies, "taken": F.col("size") * copies}).select(*kept, *added)
