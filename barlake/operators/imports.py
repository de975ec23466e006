"""Import tables under any headers: their base columns, the mappings known of each fund, and the import rows that follow from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header words of each base column, best first, and words that rule a header out.
HEADERS = {
    "Scheme_Code": (("scheme code", "amfi code", "code", "schemecode"), ("category", "type")),
    "ISIN": (("isin",), ()),
    "Scheme_Name": (("scheme name", "fund name", "name of scheme", "scheme", "fund"), ("code", "isin")),
    "Benchmark_Index": (("benchmark index", "benchmark", "underlying index", "index"), ("tracking", "scheme")),
}
#: Words that tell a column of names or benchmarks by its header or values, and header words that rule it out.
TEXTS = {
    "Scheme_Name": (("scheme", "fund", "etf", "index"), ("benchmark", "amc", "mutual fund")),
    "Benchmark_Index": (("benchmark", "nifty", "sensex", "bse", "crisil", "tri", "index"), ("scheme name", "fund name")),
}
VALUES = ("TER", "Tracking_Error", "Tracking_Difference")


def _clean(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).strip()


def _named(columns: list[str], field: str) -> str | None:
    words, without = HEADERS[field]
    fit = [(k, c) for c in columns for k, w in enumerate(words) if w in _clean(c) and not any(x in _clean(c) for x in without)]
    return min(fit, key=lambda x: (x[0], columns.index(x[1])))[1] if fit else None


def _quoted(c: str):
    return F.col("`" + c.replace("`", "``") + "`")


def standard_base_columns(df: DataFrame) -> DataFrame:
    """(Scheme_Code, ISIN, Scheme_Name, Benchmark_Index) of a table under any headers, trimmed; what is not found or null is empty.

    A column is chosen by its header; names and benchmarks without a telling header by their values: of the columns whose
    values mostly hold letters the one with most telling words in header or values, then the longest values, then the last
    header. All rows are profiled in one pass, of which the driver sees a few numbers a column.
    """
    chosen = {f: _named(df.columns, f) for f in HEADERS}
    open_fields = [f for f in TEXTS if not chosen[f]]
    words = sorted({w for f in open_fields for w in TEXTS[f][0]})
    profile = {}
    if open_fields and df.columns:
        value = lambda c: F.lower(_quoted(c).cast("string"))
        seen = lambda c: F.array(*(F.coalesce(F.max(F.contains(value(c), F.lit(w))), F.lit(False)) for w in words))
        each = [F.struct(F.avg(F.length(value(c))).alias("n"), F.avg(value(c).rlike("[a-z]").cast("int")).alias("a"), seen(c).alias("w")).alias(f"c{i}") for i, c in enumerate(df.columns)]
        row = df.agg(*each).first()
        profile = {c: row[i] for i, c in enumerate(df.columns) if row[i]["a"] is not None and row[i]["a"] >= 0.5}
    for f in open_fields:
        tell, without = TEXTS[f]
        score = lambda c: (sum(w in _clean(c) or profile[c]["w"][words.index(w)] for w in tell), profile[c]["n"], c)  # noqa: E731,B023
        fit = [c for c in profile if not any(x in _clean(c) for x in without)]
        chosen[f] = max(fit, key=score) if fit else None
    text = lambda c: F.coalesce(F.trim(_quoted(c).cast("string")), F.lit("")) if c else F.lit("")
    return df.select(*(text(c).alias(f) for f, c in chosen.items()))


def mapping_context(frames: list[DataFrame], order: str) -> DataFrame:
    """The last row of each Symbol: of the last frame that has it, and there of the greatest `order`; columns that a frame lacks are null.

    Rows that tie are told apart by all their columns. Rows without a symbol go.
    """
    numbered = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    both = numbered[0]
    for f in numbered[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("Symbol", "_frame", order)]
    last = F.max(F.struct("_frame", order, *rest)).alias("_last")
    return both.where("Symbol is not null").groupBy("Symbol").agg(last).select("Symbol", *(F.col("_last")[c].alias(c) for c in rest))


def nav_mappings(nav: DataFrame, isins: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(ISIN, Scheme_Code) and (Scheme_Code, Scheme_Name) of a price file (Scheme_Code, Scheme_Name, `isins`): the last by `order` that is not blank."""
    nav = nav.withColumn("Scheme_Code", F.trim(F.col("Scheme_Code").cast("string"))).where("Scheme_Code != ''")
    each = nav.select(F.explode(F.array(*(F.upper(F.trim(c)) for c in isins))).alias("ISIN"), "Scheme_Code", order)
    each = each.where(F.col("ISIN").isNotNull() & ~F.col("ISIN").isin("", "NAN", "NONE", "-"))
    codes = each.groupBy("ISIN").agg(F.max_by("Scheme_Code", F.struct(order, "Scheme_Code")).alias("Scheme_Code"))
    name = nav.withColumn("Scheme_Name", F.trim("Scheme_Name")).where("Scheme_Name != ''")
    return codes, name.groupBy("Scheme_Code").agg(F.max_by("Scheme_Name", F.struct(order, "Scheme_Name")).alias("Scheme_Name"))


def import_output(etfs: DataFrame, context: DataFrame, matched: DataFrame) -> DataFrame:
    """A row a fund (Symbol, ISIN, Name) with what is to be imported, how it was matched, and which values were filled.

    context: a row a symbol (Symbol, AMFI_Scheme_Code, AMFI_Scheme_Name, ISIN); its code and name go before those of the source row,
    the fund's own ISIN before both. matched: a row a symbol (Symbol, Match_Method, Match_Score, Source, Scheme_Code, Scheme_Name,
    ISIN, Benchmark_Index and VALUES). Blank texts count as missing; symbols meet without regard to case.
    """
    key = F.upper(F.trim("Symbol")).alias("_key")
    side = lambda df, p: df.select(key, F.lit(True).alias(f"{p}_there"), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "Symbol")).hint("shuffle_merge")
    df = etfs.select("Symbol", "ISIN", "Name", key).join(side(context, "c"), "_key", "left").join(side(matched, "m"), "_key", "left")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    first = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c), F.lit(""))
    known = lambda a, b: F.when(F.col("c_there"), text(a)).otherwise(text(b))
    return df.select(
        "Symbol",
        F.regexp_replace(F.trim("Symbol"), r"\.NS$", "").alias("NSE_Symbol"),
        first(text("ISIN"), known("c_ISIN", "m_ISIN")).alias("ISIN"),
        known("c_AMFI_Scheme_Code", "m_Scheme_Code").alias("AMFI_Scheme_Code"),
        first(known("c_AMFI_Scheme_Name", "m_Scheme_Name"), text("Name")).alias("Scheme_Name"),
        *(F.col(f"m_{c}").alias(c) for c in VALUES),
        text("m_Benchmark_Index").alias("Benchmark_Index"),
        F.coalesce("m_Match_Method", F.lit("unmatched")).alias("Match_Method"),
        F.coalesce("m_Match_Score", F.lit(0.0)).alias("Match_Score"),
        text("m_Source").alias("Source"),
        *(F.col(f"m_{c}").isNotNull().alias(f"{c}_Filled") for c in VALUES),
        (text("m_Benchmark_Index") != "").alias("Benchmark_Filled"),
    )
