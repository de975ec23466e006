"""Names matched by shared words and matching blocks.

The score is 0.6 of the shared words over the longer name's words, and 0.4 of the matching-block ratio: twice the length of the longest common block,
and recursively of those on both sides of it, over the length of both names. As no ratio exceeds 1, a pair that reaches
a score shares at least (score - 0.4) / 0.6 of the longer name's words. So names meet only on their rarest words, as many as a matching
name cannot all lack.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from barlake.operators.clusters import Keep

#: Words that tell no names apart: of the kind, and of the houses. Fixed values.
STOP = (
    "etf", "exchange", "traded", "fund", "funds", "scheme", "schemes", "regular", "direct", "growth", "dividend", "payout", "reinvestment", "plan", "index", "the", "and", "of",
    "mutual", "amc", "asset", "management", "company", "limited", "ltd", "india", "nse", "bse", "benchmark", "total", "return", "tri",
)
HOUSES = (
    "icici", "prudential", "icicipramc", "hdfc", "hdfcamc", "motilal", "oswal", "mirae", "axis", "sbi", "kotak", "nippon", "uti", "aditya", "birla", "sun", "life", "zerodha", "edelweiss", "bandhan",
    "invesco", "tata", "lic", "canara", "robeco", "dsp", "quantum", "mahindra", "manulife", "groww", "bajaj", "baroda", "bnp", "paribas",
)
WORDS, BLOCKS = 0.6, 0.4


def name_words(name: Column) -> Column:
    """Lower-case runs of letters and digits without those of STOP and HOUSES, in order; & counts as the word and."""
    text = F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(text), " "), lambda w: (w != "") & ~w.isin(*STOP, *HOUSES))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def block_ratio(a: str, b: str) -> Column:
    """The matching-block ratio of two text columns. Built on call, as functions need a session."""
    return F.pandas_udf(_ratios, DoubleType())(a, b)


def _prefixes(left: DataFrame, right: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Each side's (key, n, w): of n words of a name the rarest, so many that a name with `share` of the longer one's words has one of them."""
    each = lambda df: df.select("key", F.size("set").alias("n"), F.explode("set").alias("w"))
    a, b = each(left), each(right)
    often = a.select("w").unionByName(b.select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("df", "w"))
    cut = lambda df: df.join(often.hint("merge"), "w").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("key", "n", "w")
    return cut(a), cut(b)


def similar_names(left: DataFrame, right: DataFrame, least: float, keep: Keep) -> DataFrame:
    """(Symbol, Id, Score) of all pairs of left (Symbol, Name) and right (Id, Name) whose score, at 6 decimals, reaches `least`, which has to exceed 0.4.

    Symbols and ids are unique. Names without words match nothing.
    """
    share = (least - 5e-7 - BLOCKS) / WORDS
    if share <= 0:
        raise ValueError(f"names that share no word could score {least}: it has to exceed {BLOCKS}")
    side = lambda df, key: keep(df.select(F.col(key).alias("key"), name_words(F.col("Name")).alias("words")).where(F.size("words") > 0).select("key", F.array_join("words", " ").alias("text"), F.array_distinct("words").alias("set")), "names")
    a, b = side(left, "Symbol"), side(right, "Id")
    pa, pb = _prefixes(a, b, share)
    near = F.least("x.n", "y.n") >= share * F.greatest("x.n", "y.n") - 1e-9
    pairs = pa.alias("x").join(pb.alias("y").hint("merge"), F.col("x.w") == F.col("y.w")).where(near).select(F.col("x.key").alias("Symbol"), F.col("y.key").alias("Id")).distinct()
    named = lambda df, key, p: df.select(F.col("key").alias(key), F.col("text").alias(p + "text"), F.col("set").alias(p + "set")).hint("merge")
    met = pairs.join(named(a, "Symbol", "a_"), "Symbol").join(named(b, "Id", "b_"), "Id")
    met = met.withColumn("_w", F.size(F.array_intersect("a_set", "b_set")) / F.greatest(F.size("a_set"), F.size("b_set")))
    # the ratio is at most twice the shorter name's share of both
    most = 2 * F.least(F.length("a_text"), F.length("b_text")) / (F.length("a_text") + F.length("b_text"))
    open_ = met.where(WORDS * F.col("_w") + BLOCKS * most >= least - 5e-7)
    return open_.select("Symbol", "Id", F.round(WORDS * F.col("_w") + BLOCKS * block_ratio("a_text", "b_text"), 6).alias("Score")).where(F.col("Score") >= least)


def fuzzy_name_match(left: DataFrame, right: DataFrame, keep: Keep, least: float = 0.62) -> DataFrame:
    """(Symbol, Id, Score): for each name of left (Symbol, Name) the best of right (Id, Name) of a score of `least` or more; ties go to the smaller Id.

    Names of the same words in the same order are joined first; their score is 1, so that no other pair of theirs is looked at. Null names and names without telling words match
    nothing; an empty table gives no rows. keep(df, name) writes a table and returns it.
    """
    text = F.array_join(name_words(F.col("Name")), " ")
    same = right.select("Id", text.alias("t")).where("t != ''").groupBy("t").agg(F.min("Id").alias("Id"))
    exact = keep(left.select("Symbol", text.alias("t")).join(same.hint("merge"), "t").select("Symbol", "Id", F.lit(1.0).alias("Score")), "equal_names")
    rest = left.join(exact.select("Symbol").hint("merge"), "Symbol", "left_anti")
    found = similar_names(rest, right, least, keep)
    best = found.groupBy("Symbol").agg(F.min_by(F.struct("Id", "Score"), F.struct(-F.col("Score"), "Id")).alias("m"))
    return exact.unionByName(best.select("Symbol", "m.Id", "m.Score"))


def id_match_cascade(left: DataFrame, right: DataFrame, keep: Keep, fuzzy: float = 0.62) -> DataFrame:
    """(Symbol, Id, Method, Score): rows of left (Symbol, Code, ISIN, Name) meet right (Id, Symbol, Code, ISIN, Name) by symbol, then code, then ISIN; only what is left by name."""
    found = None
    for order, key in enumerate(("Symbol", "Code", "ISIN")):
        r = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("Id").alias("Id"))
        part = left.where(F.col(key).isNotNull()).select("Symbol", F.col(key).alias("_key")).join(r.hint("merge"), "_key").select("Symbol", "Id", F.lit(f"Exact {key}").alias("Method"), F.lit(1.0).alias("Score"), F.lit(order).alias("_o"))
        found = part if found is None else found.unionByName(part)
    exact = keep(found.groupBy("Symbol").agg(F.min(F.struct("_o", "Id", "Method", "Score")).alias("m")).select("Symbol", "m.Id", "m.Method", "m.Score"), "exact_matches")
    rest = left.join(exact.select("Symbol").hint("merge"), "Symbol", "left_anti")
    return exact.unionByName(fuzzy_name_match(rest, right, keep, fuzzy).select("Symbol", "Id", F.lit("Fuzzy").alias("Method"), "Score"))
