"""Coverage of validation: spans, overlap, breadth and lost symbols by hand, and empty tables."""

from datetime import date

from barlake.operators import validation

H = "Symbol string, Date date, Schema_Version int, Confidence_Adjusted_Score double"
M = "Symbol string, Signal_Date date, Horizon_Days int, Net_Forward_Return double, Opportunity_Eligible string"
D = [date(2024, 1, k) for k in range(1, 8)]


def frames(spark, h, m, x, b):
    return spark.createDataFrame(h, H), spark.createDataFrame(m, M), spark.createDataFrame(x, "Reason string"), spark.createDataFrame(b, "Symbol string, Date date")


def test_coverage_by_hand(spark):
    h = [("A", D[0], None, 1.0), ("A", D[1], 2, 1.0), ("B", D[1], 2, 2.0), ("B", D[2], 2, None), ("C", D[3], 2, 3.0)]
    m = [("A", D[0], 10, 0.1, "Yes"), ("A", D[1], 10, 0.1, " yes"), ("B", D[1], 10, 0.2, "YES"), ("B", D[2], 10, 0.3, "Yes"), ("C", D[3], 10, 0.1, "Yes"), ("C", D[3], 5, 0.1, "Yes"), ("A", D[4], 10, None, "Yes")]
    out = validation.validation_coverage(*frames(spark, h, m, [("x",), ("x",), (None,)], [("A", D[0]), ("B", D[5])]), least=2)
    assert {(r[0], r[1]): tuple(r)[2:] for r in out.collect()} == {
        ("schema", "v1"): (1, 1, D[0], D[0]), ("schema", "v2"): (4, 3, D[1], D[3]), ("schema", "v2 without score"): (1, 1, D[2], D[2]),
        ("matured", "rows"): (6, 5, D[0], D[4]), ("overlap", "rows"): (4, 3, D[1], D[3]),
        ("breadth", "usable dates"): (1, 1, D[1], D[1]), ("breadth", "thin dates"): (1, 1, D[3], D[3]),
        ("reason", "x"): (2, 0, None, None), ("prices", "bars"): (2, 2, D[0], D[5]), ("lost", "symbols"): (1, 0, None, None),
    }


def test_coverage_of_empty_tables(spark):
    out = validation.validation_coverage(*frames(spark, [], [], [], [])).collect()
    assert len(out) == 9 and all(r["Rows"] == 0 and r["First_Date"] is None for r in out)
