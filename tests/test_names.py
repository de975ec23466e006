"""Name matching against all pairs, scored in plain Python."""

import difflib
import random
import re

import pytest

from barlake.operators import names
from barlake.sources.shared import shared_path


def keep(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(name):
    return [w for w in re.sub("[^a-z0-9]+", " ", (name or "").lower().replace("&", " and ")).split() if w not in names.STOP + names.HOUSES]


def score(a, b):
    x, y = words(a), words(b)
    if not x or not y:
        return 0.0
    shared = len(set(x) & set(y)) / max(len(set(x)), len(set(y)))
    return round(0.6 * shared + 0.4 * difflib.SequenceMatcher(None, " ".join(x), " ".join(y)).ratio(), 6)


def tables(spark):
    rnd = random.Random(2)
    some = ["nifty", "bank", "gold", "silver", "next", "50", "100", "midcap", "alpha", "quality", "low", "vol", "it", "pharma", "value", "banks", "bank2"]
    name = lambda: " ".join(["common"] * rnd.randrange(2) + [rnd.choice(some) for _ in range(rnd.randrange(1, 6))] + rnd.choice([["ETF"], ["Fund"], []]))
    left = [(f"S{i}", name()) for i in range(120)] + [("N", None), ("E", ""), ("F", "the ETF fund"), ("A", "Alpha & Low"), ("B", "Bank  Nifty!"), ("D", "gold gold gold")]
    right = [(i, name()) for i in range(120)] + [(500, None), (501, "fund"), (502, "alpha and low"), (503, "BANK-NIFTY"), (504, "bank nifty"), (505, "gold"), (506, "x" * 300 + " gold")]
    return left, right, spark.createDataFrame(left, "Symbol string, Name string"), spark.createDataFrame(right, "Id long, Name string")


@pytest.mark.parametrize("least", [0.48, 0.62, 0.82, 1.0])
def test_all_pairs_that_reach_the_score_are_found(spark, least):
    left, right, a, b = tables(spark)
    got = {(r.Symbol, r.Id): r.Score for r in names.similar_names(a, b, least, keep).collect()}
    want = {(s, i): score(x, y) for s, x in left for i, y in right if score(x, y) >= least}
    assert got == pytest.approx(want) and len(want) > 3


def test_the_best_match_and_ties(spark):
    left, right, a, b = tables(spark)
    got = {r.Symbol: (r.Id, r.Score) for r in names.fuzzy_name_match(a, b, keep).collect()}
    want = {s: max((score(x, y), -i) for i, y in right) for s, x in left}
    assert got == {s: (-i, pytest.approx(v)) for s, (v, i) in want.items() if v >= 0.62} and got["B"] == (503, 1.0)
    with pytest.raises(ValueError):
        names.similar_names(a, b, 0.4, keep)
    assert names.fuzzy_name_match(a.limit(0), b, keep).count() == 0


def test_a_word_that_half_share_joins_no_names(spark):
    """Names of three words of which one stands in all: no pair meets on it."""
    a = spark.createDataFrame([(f"S{i}", f"common left{i} one{i}") for i in range(300)], "Symbol string, Name string")
    b = spark.createDataFrame([(i, f"common right{i} two{i}") for i in range(300)], "Id long, Name string")
    pa, pb = names._prefixes(*(df.selectExpr(f"{k} as key", "split(lower(Name), ' ') as set") for df, k in ((a, "Symbol"), (b, "cast(Id as string)"))), 0.3666)
    assert pa.where("w = 'common'").isEmpty() and pb.where("w = 'common'").isEmpty() and pa.count() == 600


def test_exact_keys_come_before_names(spark):
    left = spark.createDataFrame([("A", "1", None, "gold"), ("B", "2", None, "silver"), ("C", None, "I9", "quality"), ("D", None, None, "midcap 50"), ("E", None, None, "none")], "Symbol string, Code string, ISIN string, Name string")
    right = spark.createDataFrame([(1, "A", None, None, "x"), (2, "Z", "1", None, "gold"), (3, None, "2", None, "x"), (4, None, None, "I9", "x"), (5, None, None, None, "midcap 50 fund"), (0, None, "2", None, "y")], "Id long, Symbol string, Code string, ISIN string, Name string")
    got = {r.Symbol: (r.Id, r.Method, r.Score) for r in names.id_match_cascade(left, right, keep).collect()}
    assert got == {"A": (1, "Exact Symbol", 1.0), "B": (0, "Exact Code", 1.0), "C": (4, "Exact ISIN", 1.0), "D": (5, "Fuzzy", 1.0)}
