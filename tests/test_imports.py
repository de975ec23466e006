"""Import tables: base columns under any headers, the last mapping of a symbol, import rows with blanks, ties and missing sides."""

from barlake.operators import imports

BASE = ("Scheme_Code", "ISIN", "Scheme_Name", "Benchmark_Index")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_base_columns_by_header_and_by_value(spark):
    named = spark.createDataFrame([(" 7 ", None, "A", "x", "Nifty 50")], "`Scheme Code` string, ISIN string, `Scheme Name` string, `Scheme Category` string, `Underlying Index` string")
    assert rows(imports.standard_base_columns(named), *BASE) == [("7", "", "A", "Nifty 50")]
    odd = spark.createDataFrame([("1", "Gold ETF", "Nifty TRI"), ("2", None, "Sensex"), (None, "Bank ETF fund plan", "BSE 500 index")], "`a.b` string, `c``d` string, e string")
    assert rows(imports.standard_base_columns(odd), *BASE) == [("", "", "", "Sensex"), ("", "", "Bank ETF fund plan", "BSE 500 index"), ("", "", "Gold ETF", "Nifty TRI")]
    assert imports.standard_base_columns(odd.limit(0)).collect() == []


def test_last_mapping_of_a_symbol(spark):
    a = spark.createDataFrame([("A", 1, "x"), ("A", 3, "y"), ("A", 3, "z"), ("B", 1, None), (None, 9, "n")], "Symbol string, k int, Code string")
    b = spark.createDataFrame([("B", 0, "i")], "Symbol string, k int, ISIN string")
    assert imports.mapping_context([a, b], "k").orderBy("Symbol").collect() == [("A", "z", None), ("B", None, "i")]


def test_price_file_mappings(spark):
    nav = spark.createDataFrame([(1, " 5", "old", "in1", "-"), (2, "5", " ", "IN1 ", None), (3, "6", "new", "nan", "IN1"), (4, "", "lost", "IN9", "IN8")], "k int, Scheme_Code string, Scheme_Name string, i string, j string")
    codes, names = imports.nav_mappings(nav, ["i", "j"], "k")
    assert rows(codes, "ISIN", "Scheme_Code") == [("IN1", "6")]
    assert rows(names, "Scheme_Code", "Scheme_Name") == [("5", "old"), ("6", "new")]


def test_import_rows(spark):
    etfs = spark.createDataFrame([("A.NS", " ", "Fund A"), ("B", "OWN", "Fund B"), ("C", None, None)], "Symbol string, ISIN string, Name string")
    context = spark.createDataFrame([("a.ns", "11", "", "CTX"), ("D", "1", "d", "e")], "Symbol string, AMFI_Scheme_Code string, AMFI_Scheme_Name string, ISIN string")
    schema = "Symbol string, Match_Method string, Match_Score double, Source string, Scheme_Code string, Scheme_Name string, ISIN string, Benchmark_Index string, TER double, Tracking_Error double, Tracking_Difference double"
    matched = spark.createDataFrame([("A.NS", "isin", 1.0, "s", "99", "Other", "SRC", " ", 0.1, None, None), ("b", "name", 0.8, "t", "98", "Named", "SRC", "Nifty", None, 0.0, 0.2)], schema)
    out = rows(imports.import_output(etfs, context, matched), "Symbol", "NSE_Symbol", "ISIN", "AMFI_Scheme_Code", "Scheme_Name", "Match_Method", "Match_Score", "TER_Filled", "Tracking_Error_Filled", "Benchmark_Filled")
    assert out == [
        ("A.NS", "A", "CTX", "11", "Fund A", "isin", 1.0, True, False, False),
        ("B", "B", "OWN", "98", "Named", "name", 0.8, False, True, True),
        ("C", "C", "", "", "", "unmatched", 0.0, False, False, False),
    ]
