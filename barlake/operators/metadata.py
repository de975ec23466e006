"""Universe, master data and fund metadata: cleaning, classification, matching, validation and its quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of names that mark a parking fund. Fixed values.
PARKING = ("LIQUID", "LIQ", "CASH", "MONEY", "OVERNIGHT", "TREPS", "1D", "1D RATE", "GILT", "GSEC", "G-SEC", "SDL", "BOND", "DEBT", "T-BILL", "TBILL", "COLLATERAL", "LOW DURATION", "ULTRA SHORT", "MONEY MARKET")
#: (category, words), the first that a name holds. Fixed values.
CATEGORIES = (
    ("Parking/Debt ETF", PARKING), ("Gold ETF", ("GOLD",)), ("Silver ETF", ("SILVER",)), ("International ETF", ("NASDAQ", "S&P", "FANG", "HANG", "GLOBAL", "NYSE", "US ", "USA")),
    ("Bank/Financial ETF", ("BANK", "FINANCIAL", "PSU BANK")), ("IT ETF", ("IT", "TECH")), ("Pharma/Healthcare ETF", ("PHARMA", "HEALTH")), ("Auto ETF", ("AUTO",)), ("Consumption/FMCG ETF", ("CONSUM", "FMCG")),
    ("PSU/CPSE ETF", ("PSU", "CPSE")), ("Factor ETF", ("MOMENTUM", "QUALITY", "VALUE", "LOW VOL", "ALPHA")), ("Broad Market ETF", ("MIDCAP", "SMALLCAP", "NEXT 50", "NIFTY", "SENSEX")),
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def classify_etf(df: DataFrame, universe: str = "Universe", name: str = "Name") -> DataFrame:
    """ETF_Category, Opportunity_Type and Opportunity_Eligible by the first rule whose words the name holds."""
    text, etf = F.upper(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(universe, F.lit(""))) == "ETF"
    category = F.lit("ETF")
    for label, words in reversed(CATEGORIES):
        category = F.when(_any(text, words), label).otherwise(category)
    kind = F.when(~etf, "Stock").when(category == "Parking/Debt ETF", "Parking/Debt ETF").when(category.isin("Gold ETF", "Silver ETF"), "Commodity ETF").when(category == "International ETF", "International ETF").otherwise("Equity ETF")
    return df.withColumns({"ETF_Category": F.when(etf, category), "Opportunity_Type": kind, "Opportunity_Eligible": F.when(etf & _any(text, PARKING), "No").otherwise("Yes")})


def clean_symbol(symbol: Column, suffix: str = ".NS") -> Column:
    """Upper case without blanks at the ends, with the exchange's suffix; blank ones are null."""
    s = F.upper(F.trim(symbol))
    return F.when(s.isNull() | (s == ""), None).when(s.endswith(suffix), s).otherwise(F.concat(s, F.lit(suffix)))


def bad_symbol(symbol: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    return (s == "") | s.startswith("DUMMY") | s.startswith("TEST")


def load_master(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows that are included (yes, y, true, 1), texts trimmed, one row a symbol: the first by `order`. A missing Include counts as yes."""
    inc = F.lower(F.trim(F.coalesce("Include", F.lit("yes"))))
    rows = df.where(inc.isin("yes", "y", "true", "1")).withColumns({c: F.trim(c) for c, t in df.dtypes if t == "string"}).where("Symbol is not null and Symbol != ''")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("Symbol").orderBy(*order))).where("_k = 1").drop("_k", "Include")


def universe_union_priority(lists: list[DataFrame]) -> DataFrame:
    """(Symbol, Universe_Group, Priority) of lists (Symbol, Universe_Group), the first list that has a symbol; bad symbols go, others are cleaned."""
    out = None
    for k, df in enumerate(lists):
        part = df.where(~bad_symbol(F.col("Symbol"))).select(clean_symbol(F.col("Symbol")).alias("Symbol"), "Universe_Group", F.lit(k + 1).cast("long").alias("Priority"))
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("Priority", "Universe_Group")).alias("b")
    return out.groupBy("Symbol").agg(best).select("Symbol", "b.Universe_Group", "b.Priority")


def parse_amount(text: Column) -> Column:
    """Crores from text: a number with an optional currency, in lakh, crore or million where it says so."""
    low = F.lower(text)
    n = F.nullif(F.regexp_extract(F.regexp_replace(low, ",", ""), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(low.rlike("lakh|lac"), n / 100).when(low.rlike(r"million|\bmn\b"), n / 10).otherwise(n)


def parse_percent(text: Column) -> Column:
    """A share from text: with a percent sign, or above 0.05 in size, it is divided by 100."""
    n = F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(F.contains(text, F.lit("%")) | (F.abs(n) > 0.05), n / 100).otherwise(n)


def validate_metadata(df: DataFrame) -> DataFrame:
    """(ok, value, reason) structs of AUM_Cr, TER, Tracking_Error and Tracking_Difference; a code in place of assets is told by equality with Scheme_Code."""
    def judged(x: Column, *rules) -> Column:
        say = F.when(x.isNull(), "missing")
        for cond, text in rules:
            say = say.when(cond, text)
        reason = say.otherwise("ok")
        return F.struct((reason == "ok").alias("ok"), F.when(reason == "ok", x).alias("value"), reason.alias("reason"))

    aum, ter, te, td = (F.col(c) for c in ("AUM_Cr", "TER", "Tracking_Error", "Tracking_Difference"))
    return df.withColumns(
        {
            "AUM_Check": judged(aum, (aum <= 0, "blank_or_non_positive"), (aum == F.col("Scheme_Code").try_cast("double"), "scheme_code_like"), (aum > 100_000, "too_large")),
            "TER_Check": judged(ter, (ter <= 0, "blank_or_non_positive"), (ter > 0.05, "too_large")),
            "TE_Check": judged(te, (te < 0, "negative"), (te > 0.2, "too_large")),
            "TD_Check": judged(td, (F.abs(td) > 0.2, "too_large")),
        }
    )


def metadata_confidence(df: DataFrame) -> DataFrame:
    """Metadata_Confidence: the weights of the fields that are there and valid; and Metadata_Flags. df: validated rows with NAV and Benchmark_Index."""
    have = lambda c: F.col(f"{c}_Check.ok")
    bench, nav = F.trim(F.coalesce("Benchmark_Index", F.lit(""))) != "", F.col("NAV").isNotNull()
    w = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = w(nav, 0.30) + w(have("AUM"), 0.25) + w(have("TER"), 0.15) + F.when(have("TE"), 0.15).when(have("TD"), 0.10).otherwise(0.0) + w(bench, 0.15)
    limited = ~have("TE") & ~have("TD") & nav & have("AUM") & have("TER") & bench
    flags = F.concat_ws("; ", F.when(~nav, "NAV missing"), F.when(~have("AUM"), "AUM invalid"), F.when(~have("TER"), "TER invalid"), F.when(~have("TE") & ~have("TD") & ~limited, "Tracking quality metric missing"), F.when(~bench, "Benchmark missing"))
    return df.withColumns({"Metadata_Confidence": F.round(score, 4), "Metadata_Flags": F.when(flags == "", "Complete").otherwise(flags)})


def business_days(start: Column, end: Column) -> Column:
    """Weekdays after `start` up to `end`, without listing them."""
    n = F.datediff(end, start)
    whole, rest, first = F.floor(n / 7) * 5, n % 7, F.weekday(start)
    more = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(0), lambda a, i: a + F.when((i <= rest) & ((first + i) % 7 < 5), 1).otherwise(0))
    return F.when(n >= 0, whole + more)


def dq_flags(df: DataFrame, as_of: str, stale: int = 5, least: float = 25.0) -> DataFrame:
    """Quality_Flags of fund rows, joined by |; OK where none applies."""
    late = F.col("NAV_Date").isNull() | F.coalesce(business_days(F.col("NAV_Date"), F.lit(as_of).cast("date")) > stale, F.lit(False))
    flags = F.concat_ws(
        "|", F.when(~F.lower(F.coalesce("Mapping_Status", F.lit(""))).isin("verified", "manual", "matched"), "UNRESOLVED_MAPPING"), F.when(F.col("TER").isNull(), "MISSING_TER"),
        F.when(F.col("Tracking_Error").isNull() & F.col("Tracking_Difference").isNull(), "MISSING_TRACKING"), F.when(late, "STALE_NAV"), F.when(F.col("AUM_Cr") < least, "LOW_AUM"),
    )
    return df.withColumn("Quality_Flags", F.when(flags == "", "OK").otherwise(flags))


#: Weights of the health score. Fixed values.
HEALTH = {"NAV": 1.5, "TER": 1.3, "AUM_Cr": 1.3, "Benchmark_Index": 0.7}


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(Field, Fill_Rate): the share of rows that have each column; one pass."""
    rate = [F.avg(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1.0).otherwise(0.0)).alias(c) for c in columns]
    return df.agg(*rate).unpivot([], columns, "Field", "Fill_Rate")


def dq_health_score(df: DataFrame) -> DataFrame:
    """(Rows, Health_Score): fill rates by weight, of 100."""
    there = lambda c: F.avg(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1.0).otherwise(0.0))
    return df.agg(F.count(F.lit(1)).alias("Rows"), F.round(100 * sum((there(c) * w for c, w in HEALTH.items()), F.lit(0.0)) / sum(HEALTH.values()), 1).alias("Health_Score"))


def coalesce_metadata(sources: DataFrame, manual: DataFrame, fields: list[str]) -> DataFrame:
    """A row a symbol: each field's value of the best source (Symbol, Source, Priority, fields) that has it, manual ones (Symbol, fields) first; Sources names all sources that gave any."""
    pick = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("Priority", "Source"))).alias(f"_{c}") for c in fields]
    some = F.when(F.greatest(*(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in fields), F.lit(0)) == 1, F.col("Source"))
    auto = sources.groupBy("Symbol").agg(*pick, F.array_join(F.sort_array(F.collect_set(some)), "+").alias("Sources"))
    both = auto.join(manual.select("Symbol", *(F.col(c).alias(f"_m_{c}") for c in fields)).hint("shuffle_hash"), "Symbol", "full")
    return both.select("Symbol", *(F.coalesce(f"_m_{c}", f"_{c}").alias(c) for c in fields), F.coalesce("Sources", F.lit("")).alias("Sources"))


def source_cascade(sources: DataFrame) -> DataFrame:
    """(Symbol, Metric, Value, Source, Tried): the first source by Priority with a value; Tried counts those asked for it."""
    ok = F.col("Value").isNotNull()
    best = F.min(F.when(ok, F.struct("Priority", "Source", "Value"))).alias("b")
    return sources.groupBy("Symbol", "Metric").agg(best, F.count(F.lit(1)).alias("Tried")).select("Symbol", "Metric", "b.Value", "b.Source", "Tried")


def etf_quality_build(etfs: DataFrame, mapping: DataFrame, data: DataFrame) -> DataFrame:
    """Fund rows of the trusted mappings (Verified or Suggested) with ETF_Quality_Data_Flag: what is missing, or Complete."""
    trusted = mapping.where(F.col("Mapping_Status").isin("Verified", "Suggested")).select("Symbol", "Id", "Mapping_Status")
    df = etfs.select("Symbol").join(trusted.hint("shuffle_hash"), "Symbol", "left").join(data.hint("shuffle_hash"), "Id", "left")
    te, td = F.col("Tracking_Error").isNull(), F.col("Tracking_Difference").isNull()
    flag = F.concat_ws("; ", F.when(F.col("NAV").isNull(), "NAV missing"), F.when(F.col("AUM_Cr").isNull(), "AUM missing"), F.when(F.col("TER").isNull(), "TER missing"), F.when(te & td, "Tracking quality metric missing").when(te, "Tracking error unavailable; tracking difference available"))
    return df.withColumn("ETF_Quality_Data_Flag", F.when(flag == "", "Complete").otherwise(flag))


def pick_value_column(df: DataFrame, named: str, code: str) -> str | None:
    """The column of a badly labelled table that most plausibly holds amounts: 1000 if its header holds `named`, 1 for each number, 100 for each share of numbers between 1 and 100,000, less 500 for each share equal to `code`.

    All columns are profiled in one pass; the driver sees four numbers a column.
    """
    cols = [c for c in df.columns if c != code]
    n = lambda c: F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double")
    real = lambda c: F.count_if(n(c).between(1, 100_000))
    row = df.agg(*(F.struct(F.count(n(c)).alias("n"), real(c).alias("real"), F.count_if(n(c) == F.col(code).try_cast("double")).alias("code")).alias(c) for c in cols)).first()
    score = {c: (1000 * (named.lower() in c.lower()) + row[c]["n"] + 100 * row[c]["real"] / max(row[c]["n"], 1) - 500 * row[c]["code"] / max(row[c]["n"], 1)) for c in cols if row[c]["n"]}
    return min(score, key=lambda c: (-score[c], c)) if score else None


def standardize_imports(raw: DataFrame, name: str) -> DataFrame:
    """(Import_Code, Import_AUM_Cr, Import_TER, Import_Reason, Import_Source) of an import table under any headers, validated."""
    from barlake.sources.readers import aliased

    df = aliased(raw, {"Scheme_Code": ("amfi code", "code"), "AUM_Cr": ("aum", "average aum", "net assets"), "TER": ("total expense ratio", "expense ratio")})
    df = df.select(F.trim("Scheme_Code").alias("Scheme_Code"), parse_amount(F.col("AUM_Cr")).alias("AUM_Cr"), parse_percent(F.col("TER")).alias("TER"), F.lit(None).cast("double").alias("Tracking_Error"), F.lit(None).cast("double").alias("Tracking_Difference"))
    v = validate_metadata(df)
    return v.select(F.col("Scheme_Code").alias("Import_Code"), F.col("AUM_Check.value").alias("Import_AUM_Cr"), F.col("TER_Check.value").alias("Import_TER"), F.concat_ws("; ", F.concat(F.lit("aum:"), "AUM_Check.reason"), F.concat(F.lit("ter:"), "TER_Check.reason")).alias("Import_Reason"), F.lit(name).alias("Import_Source"))


def combine_sources(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Standardised tables as one: blank texts are null, equal rows stand once, rows without all of `keys` go."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out = out.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes))
    return out.dropna(subset=keys).dropDuplicates()


def manual_template(etfs: DataFrame, suggestions: DataFrame, blanks: tuple[str, ...] = ("Manual_AUM_Cr", "Manual_TER", "Notes")) -> DataFrame:
    """A row a fund with its suggested match and empty columns to fill in."""
    return etfs.select("Symbol", "Name").join(suggestions.hint("shuffle_hash"), "Symbol", "left").withColumns({c: F.lit(None).cast("string") for c in blanks})


def etf_subset(master: DataFrame) -> DataFrame:
    """(Symbol, Name, Sector) of the funds."""
    return master.where(F.upper(F.trim("Universe")) == "ETF").select("Symbol", F.coalesce("Name", "Symbol").alias("Name"), "Sector")
