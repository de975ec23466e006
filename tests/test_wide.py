"""Wide forms of factor queries against their long forms, and distinct counts of the diagnosis against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barlake.operators import alphas, evaluation, validation
from barlake.sources.shared import shared_path


def keep(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(spark):
    """c is twice b, d is a plus noise, e is constant; gaps everywhere, and a date that is too small."""
    rnd = random.Random(3)
    some = lambda x: None if rnd.random() < 0.2 else x
    rows = []
    for d, n in ((1, 60), (2, 40), (3, 9), (4, 3)):
        for s in range(n):
            a, b = rnd.gauss(0, 1), rnd.choice([0.0, 1.0, rnd.gauss(0, 1)])
            rows.append((datetime.date(2024, 1, d), f"S{s}", some(a), some(b), some(2 * b), some(a + rnd.gauss(0, 0.3)), some(1.0), some(a + b + rnd.gauss(0, 1))))
    return spark.createDataFrame(rows, "Date date, Symbol string, a double, b double, c double, d double, e double, fwd_10 double")


@pytest.mark.parametrize("survivors", [[], ["b"], ["b", "c", "a", "e"]])
def test_residuals_of_columns(spark, survivors):
    names = list("abcde")
    df = wide(spark).cache()
    panel = df.unpivot(["Date", "Symbol"], names, "alpha", "value").where("value is not null")
    forward = df.select("Date", "Symbol", F.lit(10).cast("long").alias("horizon"), F.col("fwd_10").alias("fwd")).where("fwd is not null")
    want = {(r.Date, r.alpha): (r.ic, r.n) for r in evaluation.residual_ic(panel, forward, names, survivors, 10, keep).collect()}
    got = {(r.Date, r.alpha): (r.ic, r.n) for r in evaluation.residual_columns(df, names, survivors, 10).collect()}
    assert want and got.keys() == want.keys()
    for k, (ic, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(ic, abs=1e-9), (k, got[k], want[k])


def test_zoo_of_columns(spark):
    names, df = list("abcde"), wide(spark)
    panel = df.unpivot(["Date", "Symbol"], names, "alpha", "value").where("value is not null")
    want = {(r.Date, r.Symbol): (r.Zoo_Score, r.Zoo_Coverage) for r in alphas.alpha_zoo(panel, keep).collect()}
    got = {(r.Date, r.Symbol): (r.Zoo_Score, r.Zoo_Coverage) for r in alphas.zoo_columns(df, names, keep).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)


def test_diagnosis_counts_each_once_without_unfolding(spark):
    """Nulls count for nothing; rows are not multiplied by the number of distinct counts."""
    rnd = random.Random(5)
    day = lambda: rnd.choice([None, *(datetime.date(2024, 1, d) for d in range(1, 9))])
    rows = [(rnd.choice([5, 10]), day(), rnd.choice([None, "A", "B", "C", "D"]), rnd.choice([None, None, 0.1]), rnd.choice([None, "why"])) for _ in range(60)]
    df = spark.createDataFrame(rows, "Horizon_Days long, Signal_Date date, Symbol string, Net_Forward_Return double, Reason string")
    out = validation.validation_diagnosis(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Expand") <= 2
    for r in out.collect():
        mine = [x for x in rows if x[0] == r.Horizon_Days]
        dates, known = {x[1] for x in mine} - {None}, [x for x in mine if x[3] is not None]
        assert (r.Dates, r.Matured_Dates, r.First_Date, r.Last_Date) == (len(dates), len({x[1] for x in known} - {None}), min(dates), max(dates))
        assert r.Symbols_Lost == len({x[2] for x in mine} - {None}) - len({x[2] for x in known} - {None}) and r.Unmatured == sum(x[4] is not None for x in mine)
