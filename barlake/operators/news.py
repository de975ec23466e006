"""Text of headlines: keys, tone and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_url(url: Column) -> Column:
    """Scheme (https where there is none), host in lower case without www., and the path without a slash at its end; query and fragment go, an empty URL stays empty."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(F.trim(url) == "", "").otherwise(F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path))


def normalize_title(title: Column) -> Column:
    """Lower-case ASCII letters, digits and spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "), " +", " "))


def tokens_of(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) > 2))


def title_tokens(title: Column) -> Column:
    return tokens_of(normalize_title(title))


def lexicon_sentiment(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, hits, polarity): summed polarity of a text's words by the root of their number, by 3, within -1 and 1.

    Words meet the lexicon by an equi-join; the lexicon is broadcast, a table of fixed size.
    """
    tokens = docs.select("doc_id", F.explode(F.split(normalize_title(F.col("title")), " ")).alias("term"))
    met = tokens.join(F.broadcast(lexicon), "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("polarity").alias("total"))
    return met.select("doc_id", "hits", F.greatest(F.least(F.col("total") / F.sqrt("hits") / 3, F.lit(1.0)), F.lit(-1.0)).alias("polarity"))


def recency(days: Column) -> Column:
    return F.when(days.isNull(), "Unknown_Date").when(days <= 7, "0-7d").when(days <= 30, "8-30d").when(days <= 90, "31-90d").otherwise("90d+")


#: (event, pattern over lower-case text), the first that fits; else OTHER. Fixed values.
EVENTS = (
    ("Results/Earnings", r"\b(q[1-4]|quarter(ly)?|earnings|results|profit|revenue|ebitda|topline|bottomline|net profit)\b"),
    ("Corporate Action", r"\b(dividend|bonus|split|record date|buyback|buy-back|rights issue|ex-dividend)\b"),
    ("Fundraising", r"\b(qip|preferential|fund ?rais(e|ing)|ncd|debentures?|bond issue|ipo|fpo|placement)\b"),
    ("Credit Rating", r"\b(credit rating|rating(s)? (upgrade|downgrade|revision|affirm|assign)|crisil|icra|care ratings|india ratings|moody's|s&p|fitch)\b"),
    ("Regulatory/Legal", r"\b(sebi|rbi|cci|nclt|court|tribunal|lawsuit|litigation|probe|investigation|penalty|show cause|notice)\b"),
    ("M&A", r"\b(merger|acquisition|acquires?|acquired|takeover|demerger|scheme of arrangement|amalgamation|stake sale|divest)\b"),
    ("Management", r"\b(ceo|cfo|md|chairman|managing director|resign|resignation|appoint(ed|ment)?|steps? down)\b"),
    ("Order/Contract", r"\b(order (win|book|received)|contract (award|win)|bags? order|loi|letter of intent|awarded)\b"),
    ("Product/Operational", r"\b(launch|unveils|commission(ed|ing)?|plant|capacity expansion|new facility|production)\b"),
    ("Analyst/Broker Opinion", r"\b(target price|price target|upgrade|downgrade|initiate coverage|analyst|brokerage|jefferies|morgan stanley|citi|nomura|kotak|motilal|hsbc|goldman)\b"),
)
OTHER = "General Company News"


def classify_event(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(OTHER)
    for label, pattern in reversed(EVENTS):
        out = F.when(low.rlike(pattern), label).otherwise(out)
    return out


def cluster_key(symbol: Column, filing: Column, url: Column, title: Column) -> Column:
    """u::symbol::f or m::url where there is a URL, else t:: with the normalised title."""
    kind = F.when(filing, "f").otherwise("m")
    address = canonical_url(url)
    return F.when(F.coalesce(address, F.lit("")) != "", F.concat_ws("::", F.lit("u"), symbol, kind, address)).otherwise(F.concat_ws("::", F.lit("t"), symbol, kind, normalize_title(title)))


def news_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (Cluster_Key, First_Seen, other columns): new non-null values over old ones, the oldest First_Seen."""
    rest = [c for c in old.columns if c not in ("Cluster_Key", "First_Seen")]
    both = old.alias("o").join(new.alias("n").hint("shuffle_hash"), "Cluster_Key", "full")
    return both.select("Cluster_Key", F.least("o.First_Seen", "n.First_Seen").alias("First_Seen"), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest))


def news_prune(news: DataFrame, as_of: str, media: int = 180, filings: int = 540) -> DataFrame:
    """Rows younger than 180 days, filings 540; unknown dates stay."""
    age = F.datediff(F.lit(as_of).cast("date"), "Published")
    return news.where(age.isNull() | (age <= F.when(F.col("filing"), filings).otherwise(media)))


def news_feed(news: DataFrame, ranks: DataFrame, cap: int = 15) -> DataFrame:
    """(Symbol, id, Place): by the symbol's rank, filings first, newest first; `cap` of each symbol."""
    df = news.join(ranks.select("Symbol", "Rank").hint("shuffle_hash"), "Symbol", "left")
    order = (F.col("filing").desc(), F.col("Published").desc_nulls_last(), F.col("id"))
    kept = df.withColumn("Place", F.row_number().over(Window.partitionBy("Symbol").orderBy(*order)).cast("long")).where(F.col("Place") <= cap)
    return kept.select("Symbol", "Rank", "id", "Place")


def news_summary(news: DataFrame, as_of: str) -> DataFrame:
    """(Symbol, Stories, Filings, First_Event, Min_Age)."""
    age = F.datediff(F.lit(as_of).cast("date"), "Published")
    return news.groupBy("Symbol").agg(F.count(F.lit(1)).alias("Stories"), F.count_if("filing").alias("Filings"), F.min_by("Event", "id").alias("First_Event"), F.min(age).cast("long").alias("Min_Age"))


def news_filter(news: DataFrame, as_of: str, event: str | None = None, recency_bin: str | None = None, filing: bool | None = None) -> DataFrame:
    """Rows of the event, recency and kind asked for; what is not asked for is not looked at."""
    if event:
        news = news.where(F.col("Event") == event)
    if recency_bin:
        news = news.where(recency(F.datediff(F.lit(as_of).cast("date"), "Published")) == recency_bin)
    return news if filing is None else news.where(F.col("filing") == filing)


def source_status(runs: DataFrame) -> DataFrame:
    """(Source, Runs, OK, Status, Last_Success) of fetch runs (Source, Run, ok): success, partial or failed; the last success outlives failures."""
    agg = runs.groupBy("Source").agg(F.count(F.lit(1)).alias("Runs"), F.count_if("ok").alias("OK"), F.max(F.when(F.col("ok"), F.col("Run"))).alias("Last_Success"))
    return agg.withColumn("Status", F.when(F.col("OK") == F.col("Runs"), "success").when(F.col("OK") > 0, "partial").otherwise("failed"))


def sentiment_veto(scored: DataFrame, least: int = 3, share: float = 0.60) -> DataFrame:
    """(Symbol, Headlines, Neg_Share) of symbols with at least 3 scored headlines (Symbol, polarity) of which 60 % lie below -0.05."""
    agg = scored.groupBy("Symbol").agg(F.count(F.lit(1)).alias("Headlines"), F.avg(F.when(F.col("polarity") < -0.05, 1.0).otherwise(0.0)).alias("Neg_Share"))
    return agg.where((F.col("Headlines") >= least) & (F.round("Neg_Share", 10) >= share))


def sentiment_by_symbol(scored: DataFrame) -> DataFrame:
    """(Symbol, Day, Headlines, Pos_Share, Neg_Share, Mean) over the 7 days up to each day of scored headlines (Symbol, Day, polarity)."""
    day = scored.groupBy("Symbol", "Day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("polarity") > 0.05).alias("p"), F.count_if(F.col("polarity") < -0.05).alias("m"), F.sum("polarity").alias("s"))
    w = Window.partitionBy("Symbol").orderBy(F.unix_date("Day")).rangeBetween(-6, 0)
    n = F.sum("n").over(w)
    return day.select("Symbol", "Day", n.alias("Headlines"), (F.sum("p").over(w) / n).alias("Pos_Share"), (F.sum("m").over(w) / n).alias("Neg_Share"), (F.sum("s").over(w) / n).alias("Mean"))
