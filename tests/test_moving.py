"""Factors from one pass over a symbol's rows against Spark's windows."""

import datetime
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from barlake.functions.ranks import rounded
from barlake.operators import alphas


def bars(spark):
    """A long symbol, short ones, one of a single bar, prices that stand still, and gaps."""
    rnd = random.Random(7)
    rows = []
    for s, n in (("A", 330), ("B", 70), ("C", 30), ("D", 1), ("E", 90), ("F", 5)):
        close = 100.0
        for d in range(n):
            close = close if s == "E" and d < 80 else round(close * (1 + rnd.gauss(0, 0.02)), 2)
            gone = s == "B" and rnd.random() < 0.2
            rows.append((s, datetime.date(2024, 1, 1) + datetime.timedelta(days=d), close, None if gone else close + 1, close - 1 if s != "E" else close + 1, None if gone else close, None if rnd.random() < 0.1 and s == "A" else float(rnd.randrange(0, 50))))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "Symbol string, Date date, Open double, High double, Low double, Close double, Volume double").repartition(3)


def test_factors_of_one_pass_equal_windows(spark):
    df = bars(spark).cache()
    out = alphas.alpha_columns(df)
    assert "rowframe, -251" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r.Date, r.Symbol): r for r in out.collect()}
    assert len(got) == df.count()
    for name in alphas.REGISTRY:
        want = {(r.Date, r.Symbol): r.value for r in alphas.alpha(df, name).collect()}
        mine = {k: r[name] for k, r in got.items() if r[name] is not None}
        assert want.keys() == mine.keys(), name
        assert all(mine[k] == v or math.isnan(v) and math.isnan(mine[k]) for k, v in want.items()), name


def test_a_factor_without_frames(spark):
    df = bars(spark)
    alphas.REGISTRY["own"] = ("own", 1, lambda over: F.col("Close") * 2)
    try:
        assert alphas.alpha_columns(df, ("own",)).where("own is not null").count() == df.where("Close is not null").count()
    finally:
        del alphas.REGISTRY["own"]


def test_long_symbols_over_many_batches(spark):
    """Batches that end inside symbols, and symbols longer than a batch."""
    df = bars(spark).cache()
    want = sorted(alphas.alpha_columns(df).collect())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert str(sorted(alphas.alpha_columns(df).collect())) == str(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_rounding_is_that_of_spark(spark):
    rnd = random.Random(9)
    values = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 1e300, 5e-11, -5e-11, 1.00000000005, 2.67500000005, 123456.12345678905, 9e5 + 0.12345678901, 1e15 + 0.3, *(rnd.gauss(0, 1) * 10 ** rnd.randrange(-12, 9) for _ in range(3000)), *(round(rnd.gauss(0, 3), 11) for _ in range(3000))]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 10)).collect()]
    got = rounded(pa.chunked_array([pa.array(values, pa.float64())])).to_pylist()
    assert all(a == b or a is not None and math.isnan(a) and math.isnan(b) for a, b in zip(got, want, strict=True))
