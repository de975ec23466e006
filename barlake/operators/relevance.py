"""Which symbols a story is about: exchange identifiers, symbols, aliases as phrases, and distinctive words.

Words keep their places, so that a phrase is found by a join on the alias's rarest word and a check of its other words' places. Words that most
aliases and stories share are never joined on: two hits of an alias hold one besides its commonest word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.clusters import Keep

#: Words of a company's name that do not tell it apart; words that are no alias alone. Fixed values.
LEGAL = r"\b(ltd|limited|inc|corp|corporation|company|co|plc|pvt|private|industries|holdings|group|the)\b\.?"
GENERIC = (
    "bank", "power", "steel", "india", "indian", "energy", "finance", "financial", "motors", "motor", "industries", "industry", "company", "corporation", "holdings", "holding", "ltd", "limited",
    "group", "the", "and", "of", "for", "auto", "cement", "oil", "gas", "life", "health", "care", "tech", "technologies", "solutions", "services",
)
#: What stands between two words that are not parted by space alone.
_BREAK = "\u0001"
OFFICIAL, SYMBOL, PHRASE, TOKENS = "Official filing mapping", "Symbol match", "Exact alias match", "Token alias match"


def name_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def distinctive(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC))


def build_aliases(master: DataFrame, overrides: DataFrame) -> DataFrame:
    """(Symbol, Aliases) of master (Symbol, Name) and overrides (Symbol, Alias): symbol, name, the name without legal words, overrides; each once whatever its case.

    The shortened name is taken where it differs from the name and has two distinctive words or is one word that is not generic. Overrides come in alphabetical order.
    """
    name = F.trim(F.coalesce("Name", F.lit("")))
    short = F.trim(F.regexp_replace(F.regexp_replace(name, "(?i)" + LEGAL, " "), "[^A-Za-z0-9]+", " "))
    lone = (F.size(F.split(short, " ")) == 1) & ~F.lower(short).isin(*GENERIC)
    own = F.when((short != "") & (F.lower(short) != F.lower(name)) & ((F.size(distinctive(name_words(short))) >= 2) | lone), short)
    extra = overrides.select(F.upper(F.trim("Symbol")).alias("_s"), F.trim("Alias").alias("_a")).where("_s != '' and _a != ''").groupBy("_s").agg(F.sort_array(F.collect_set("_a")).alias("_x"))
    symbol = F.upper(F.trim("Symbol"))
    met = master.select("Symbol", symbol.alias("_s"), F.array(symbol, name, own).alias("_own")).join(extra.hint("merge"), "_s", "left")
    every = F.filter(F.concat("_own", F.coalesce("_x", F.array().cast("array<string>"))), lambda a: a.isNotNull() & (a != ""))
    first = F.filter(every, lambda a, i: ~F.array_contains(F.transform(F.slice(every, 1, i), F.lower), F.lower(a)))
    return met.select("Symbol", first.alias("Aliases"))


def places(stories: DataFrame) -> DataFrame:
    """(id, place, w): words of titles, letters and digits of any script and underscores, in lower case; words have adjacent places if space alone parts them."""
    spaced = F.regexp_replace(F.lower("title"), r"(?U)[^\p{L}\p{N}_\s]+", f" {_BREAK} ")
    words = stories.select("id", F.posexplode(F.split(F.trim(spaced), r"(?U)\s+")).alias("place", "w"))
    return words.where((F.col("w") != _BREAK) & (F.col("w") != ""))


def _phrases(aliases: DataFrame, at: DataFrame) -> DataFrame:
    """(id, Symbol, rank) where all words of an alias stand in a row. aliases: Symbol, rank, words."""
    df = at.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    each = aliases.select("Symbol", "rank", F.size("words").alias("k"), F.posexplode("words").alias("off", "w"))
    known = each.join(df.hint("merge"), "w")
    rare = known.groupBy("Symbol", "rank").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("off", "w"), F.struct("df", "off")).alias("x")).where("n = k")
    start = rare.select("Symbol", "rank", "k", "x.off", "x.w").join(at.hint("merge"), "w").select("id", "Symbol", "rank", "k", (F.col("place") - F.col("off")).alias("start"))
    alone, long = start.where("k = 1"), start.where("k > 1")
    rest = long.join(each.select("Symbol", "rank", "off", "w").hint("merge"), ["Symbol", "rank"]).withColumn("place", F.col("start") + F.col("off"))
    whole = rest.join(at.hint("merge"), ["id", "place", "w"]).groupBy("id", "Symbol", "rank", "start").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("n")).where("n = k")
    return alone.select("id", "Symbol", "rank").unionByName(whole.select("id", "Symbol", "rank")).distinct()


def _tokens(aliases: DataFrame, at: DataFrame, least: int) -> DataFrame:
    """(id, Symbol, rank) where `least` distinctive words of an alias stand anywhere; a word that an alias has twice counts twice."""
    each = aliases.select("Symbol", "rank", F.explode(distinctive(F.col("words"))).alias("w")).groupBy("Symbol", "rank", "w").agg(F.count(F.lit(1)).alias("m"))
    words = at.select("id", "w").distinct()
    shared = each.groupBy("w").agg(F.count(F.lit(1)).alias("aliases")).join(words.groupBy("w").agg(F.count(F.lit(1)).alias("stories")).hint("merge"), "w")
    cost = each.join(shared.select("w", (F.col("aliases") * F.col("stories")).alias("cost")).hint("merge"), "w")
    most = cost.groupBy("Symbol", "rank").agg(F.max_by("w", F.struct("cost", "w")).alias("common"), F.sum("m").alias("all")).where(F.col("all") >= least)
    keys = cost.join(most.hint("merge"), ["Symbol", "rank"]).where((F.col("w") != F.col("common")) | (F.col("m") >= least))
    pairs = keys.select("Symbol", "rank", "w").join(words.hint("merge"), "w").select("id", "Symbol", "rank").distinct()
    hits = pairs.join(each.hint("merge"), ["Symbol", "rank"]).join(words.hint("merge"), ["id", "w"]).groupBy("id", "Symbol", "rank").agg(F.sum("m").alias("hits"))
    return hits.where(F.col("hits") >= least).select("id", "Symbol", "rank")


def _symbols(stories: DataFrame, symbols: DataFrame, at: DataFrame) -> DataFrame:
    """(id, Symbol) where the symbol stands between word ends; symbols of several runs are looked up by the first and then held against the title."""
    runs = F.filter(F.split(F.lower(F.trim("Symbol")), r"(?U)[^\p{L}\p{N}_]+"), lambda w: w != "")
    found = symbols.select("Symbol", F.lower(F.trim("Symbol")).alias("s"), runs.alias("r")).where(F.size("r") > 0).withColumn("w", F.element_at("r", 1))
    met = at.select("id", "w").distinct().join(found.hint("merge"), "w").select("id", "Symbol", (F.col("w") != F.col("s")).alias("mixed"))
    mixed = met.where("mixed").join(stories.select("id", "title").hint("merge"), "id")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.trim("Symbol"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return met.where("not mixed").select("id", "Symbol").unionByName(mixed.where(F.regexp_like("title", pattern)).select("id", "Symbol"))


def relevance(stories: DataFrame, aliases: DataFrame, keep: Keep, least: int = 2) -> DataFrame:
    """(id, Symbol, Reason) of stories (id, title, filing, filing_symbol) and aliases (Symbol, Aliases), for each symbol that a story is about.

    Filings are about the symbol that the exchange names, whatever their title. Other stories are about a symbol that stands in the title as a word, else by the first alias
    in order that stands there as a phrase (words parted by space alone; one word only if it has 4 letters and is not generic) or, of several words, with
    `least` distinctive words. Symbols compare without case and outer space. Ids and symbols are unique; null titles and empty
    lists give no rows. keep(df, name) writes a table and returns it.
    """
    filed = F.coalesce(F.col("filing"), F.lit(False))
    same = lambda c: F.upper(F.trim(c))
    symbols = aliases.select("Symbol").where("trim(Symbol) != ''")
    official = stories.where(filed).select("id", same("filing_symbol").alias("s")).join(symbols.withColumn("s", same("Symbol")).hint("merge"), "s").select("id", "Symbol", F.lit(-2).alias("rank"), F.lit(OFFICIAL).alias("Reason"))
    media = stories.where(~filed).select("id", "title")
    at = keep(places(media), "places")
    listed = aliases.select("Symbol", F.posexplode("Aliases").alias("rank", "alias")).where(same("alias") != same("Symbol"))
    listed = keep(listed.select("Symbol", "rank", name_words(F.col("alias")).alias("words")), "aliases")
    lone = F.size(distinctive(F.col("words"))) == 1
    phrases = _phrases(listed.where((F.size("words") > 1) | ((F.size("words") == 1) & lone)), at)
    tokens = _tokens(listed.where(F.size("words") > 1), at, least)
    by_symbol = _symbols(media, symbols, at)
    found = [by_symbol.select("id", "Symbol", F.lit(-1).alias("rank"), F.lit(SYMBOL).alias("Reason")), phrases.withColumn("Reason", F.lit(PHRASE)), tokens.withColumn("Reason", F.lit(TOKENS))]
    every = official
    for f in found:
        every = every.unionByName(f)
    # of one alias the phrase, whose reason comes first in the alphabet
    return every.groupBy("id", "Symbol").agg(F.min(F.struct("rank", "Reason")).alias("x")).select("id", "Symbol", "x.Reason")
