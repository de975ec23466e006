"""URL filtering by rules of host and path, with DataFrame functions alone.

Each URL is expanded into its host's suffixes, at label boundaries, and its path's prefixes, of the lengths that rules
have. The expressions' hashes meet the rules' on a short prefix; a full digest and the expression confirm, and of the
rules that fit the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.native import bind, small
from barlake.llm.tables import written

#: (verdict, rule): the rules of the contract. Fixed values.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEFAULT = "allow"
#: Hexadecimal digits of the hash on which expressions and rules are joined.
SHORT = 8
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def _suffixes(name: Column, counts: list[int]) -> Column:
    """The host's last labels, as many as some rule has: work by the rules' lengths, not by the host's."""
    some = lambda x: F.filter(F.array(*map(F.lit, counts)), lambda n: n <= F.size(x))
    return bind(F.split(name, "\\.", -1), lambda x: F.transform(some(x), lambda n: F.array_join(F.slice(x, F.size(x) - n + 1, n), ".")))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url).

    rules: (verdict, rule), rule = host and path in one, the path beginning at the first slash. A rule fits its host and
    all subdomains where the path begins with the rule's. The longest rule wins, and block before allow among
    equals. Where none fits, rule is null and verdict is `default`. Null URLs and those without :// have an empty
    host and path. Null ids and repeated rows are kept; equal URLs are judged once. Other columns are ignored.
    """
    rules = rules.where("rule is not null and verdict is not null").select("rule", "verdict", F.length(F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1)).alias("path_length"), F.size(F.split(F.regexp_extract("rule", "^[^/]*", 0), "\\.", -1)).alias("labels"))
    rules = written(rules.withColumns({"digest": F.sha2("rule", 256), "short": F.substring(F.sha2("rule", 256), 1, SHORT)}), "rules")
    lengths, counts = (sorted(r[0] for r in rules.select(c).distinct().collect()) for c in ("path_length", "labels"))
    pages = pages.select("page_id", "url")
    urls = pages.where("url is not null").select("url").distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    expressions = F.flatten(F.transform(_suffixes(F.col("host"), counts), lambda h: F.transform(F.col("path_prefixes"), lambda p: F.concat(h, p))))
    each = urls.where(F.col("host") != "" if counts else F.lit(False)).withColumn("path_prefixes", prefixes).select("url", F.explode(F.array_distinct(expressions)).alias("expression"))
    each = each.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    met = each.join(small(rules).withColumnRenamed("digest", "rule_digest"), "short").where("digest = rule_digest and expression = rule")
    best = met.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    best = written(best.select("url", "best.rule", "best.verdict"), "judged")
    out = pages.where("url is not null").join(best.hint("shuffle_hash"), "url", "left")
    none = pages.where("url is null").select("url", "page_id", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))  # they would all meet in one task of the join
    return out.unionByName(none).select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
