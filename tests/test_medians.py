"""Medians of large groups against sorting, and means that lie halfway between two steps."""

import datetime as dt
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest

from barlake.operators import validation
from barlake.plans import queries, reading  # noqa: F401  reading registers its queries


@pytest.mark.parametrize("margin", [0.001, 0.1])
def test_medians(spark, margin):
    """Groups above and below the size from which bounds are used, heavy values at the middle, odd and even counts, a null key."""
    rnd = random.Random(3)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(1501)], "b": [rnd.choice([0.0, 0.0, rnd.random(), -1.0]) for _ in range(1000)], "c": [1.0, 4.0], "d": [2.0], None: [5.0] * 300 + [7.0] * 300}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    got = {r.k: r.median for r in validation.medians(df, ["k"], "v", margin).collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in groups.items()}


def test_volatility_of_the_same_strikes_is_the_same(spark, tmp_path):
    """Two days with the same 32 values in other orders, whose means are halfway between two steps: neither lies below the other."""
    rnd = random.Random(1)
    seen = {}
    while len(seen) < 2:
        seen, v = {}, [rnd.randint(0, 10) / 100 for _ in range(32)]
        if sum(round(x * 100) for x in v) % 2:
            for _ in range(20):
                rnd.shuffle(v)
                total = 0.0
                for x in v:
                    total += x
                seen[total / 32] = list(v)
        seen = seen if len({Decimal(repr(m)).quantize(Decimal("0.000001"), ROUND_HALF_UP) for m in seen}) > 1 else {}
    low, high = seen[min(seen)], seen[max(seen)]
    rows = [(1, dt.datetime(2024, 1, day), x) for day, values in ((1, low), (2, high)) for x in values]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.Date.day: r.IV_Rank for r in queries.queries()["iv_rank_daily"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: 0.0}
