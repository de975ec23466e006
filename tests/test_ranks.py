"""Ranks of large cross-sections against windows, with ties, heavy values, nulls and NaN."""

import random

import pytest
from pyspark.sql import functions as F

from barlake.functions import ranks
from barlake.functions.frames import average_rank
from barlake.sources.shared import shared_path


def keep(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def panel(spark):
    rnd = random.Random(7)
    rows = []
    for d, n in ((1, 900), (2, 40), (3, 1)):
        for s in range(n):
            rows.append((d, f"S{s}", rnd.choice([None, 0.0, 0.0, 5.0, rnd.random()]), float(s // 7), None if s else 1.0, float("nan") if s % 5 == 0 else rnd.gauss(0, 1), 3.0))
    return spark.createDataFrame(rows, "Date int, Symbol string, a double, b double, c double, d double, e double")


@pytest.mark.parametrize("bucket", [ranks.BUCKET, 30, 1])
def test_ranks_do_not_depend_on_the_ranges(spark, bucket):
    """One sort; some thirty ranges; a range for almost each value."""
    df = panel(spark)
    names = list("abcde")
    got = {(r.Date, r.Symbol): r for r in ranks.component_ranks(df, {n: F.col(n) for n in names}, keep, bucket).collect()}
    want = df.select("Date", "Symbol", *(average_rank(F.col(n), "Date").alias(n) for n in names)).collect()
    n = {(r.Date, k): r[k] for r in df.groupBy("Date").agg(*(F.count(k).alias(k) for k in names)).collect() for k in names}
    for w in want:
        for k in names:
            r = got[w.Date, w.Symbol][k]
            assert (r is None) == (w[k] is None) and (r is None or (r.rank == w[k] and r.n == n[w.Date, k])), (k, w, r)


def test_a_heavy_value_is_not_sorted(spark):
    """A value that a third of a date holds is a range of its own, and no sorted range is larger than a few times the bucket."""
    df = panel(spark).where("Date = 1").withColumn("x", F.when(F.xxhash64("Symbol") % 3 == 0, 7.0).otherwise(F.xxhash64("Symbol").cast("double")))
    seen = {}

    def watch(frame, name):
        seen[name] = keep(frame, name)
        return seen[name]

    ranks.ranked(df.select("Date", "Symbol", "x"), ["Date"], "x", watch, 50).count()
    sizes = {r["_b"]: r["_size"] for r in seen["offsets"].collect()}
    assert any(b % 2 and n > 200 for b, n in sizes.items()) and max(n for b, n in sizes.items() if b % 2 == 0) <= 150


def test_scores_of_few_and_missing_values(spark):
    df = ranks.component_ranks(panel(spark), {"c": F.col("c"), "e": F.col("e")}, keep).select("Date", "Symbol", ranks.score("c", True).alias("c"), ranks.score("e", False).alias("e"))
    got = {(r.Date, r.Symbol): (r.c, r.e) for r in df.collect()}
    assert got[3, "S0"] == (50.0, 50.0) and got[1, "S0"][0] == 50.0 and got[1, "S5"] == (50.0, pytest.approx(100 - 100 * 901 / 2 / 900))
    assert ranks.component_ranks(panel(spark).limit(0), {"c": F.col("c")}, keep).count() == 0


@pytest.mark.parametrize("whole", [10_000, 899])
def test_whole_dates_rank_as_ranges_do(spark, whole):
    """A date is one group up to the bound, beyond it the long form is taken; both keep the rows, and whole dates write nothing but what was counted."""
    df = panel(spark)
    names, written = list("abcde"), []

    def watch(frame, name):
        written.append(name)
        return keep(frame, name)

    got = ranks.with_ranks(df.withColumn("more", F.col("b")), {f"_{n}": F.col(n) for n in names}, watch, 900, ("Date", "Symbol", "more"), whole).collect()
    assert (written == []) == (whole >= 900)
    want = {(r.Date, r.Symbol): r for r in ranks.component_ranks(df, {n: F.col(n) for n in names}, keep).collect()}
    assert len(got) == df.count() and all(g.more == float(int(g.Symbol[1:]) // 7) for g in got)
    for g in got:
        for n in names:
            w = want[g.Date, g.Symbol][n] if (g.Date, g.Symbol) in want else None
            assert g[f"_{n}"] == w, (n, g)


def test_shadow_ranks_come_from_the_pass_of_the_components(spark):
    """One group and one more exchange by date serve official and shadow ranks; the raw signals end before the latter."""
    from barlake.plans import books

    plan = books.shadow(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning(Date") == 2
