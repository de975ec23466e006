"""License scans by ordered signature rules, with DataFrame functions alone.

Texts are normalised to lower-case words with one space between and around. A rule's keyword is looked for before the
rule itself; license_rules has the rules, from tags and sentences of license texts down to bare names.
Detections are intervals of characters. One that lies within another of at least its priority is suppressed (of equal
intervals and priorities the first label stays); the labels of the others are the text's licenses.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.license_rules import RULES
from barlake.llm.native import bind

#: Phrases of the contract and their labels. Fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words, A-Z in lower case, with one space between; null counts as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL)
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _count(part: Column, of: str) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(of), F.lit("")))


def _edge(pattern: str) -> str:
    return f"(?<= ){pattern}(?= )"


def rules() -> list[tuple[str, list[tuple[str, str, int]]]]:
    """(keyword, [(label, regular expression, priority)]), in the order of RULES."""
    found: dict[str, list[tuple[str, str, int]]] = {}
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ")
        found.setdefault(f" {keyword} " if len(keyword) < 5 else keyword, []).append((label, _edge(f"(?:{pattern})"), int(priority)))
    return list(found.items())


#: All priorities, in order.
LEVELS = sorted({int(line.split(" | ")[1]) for line in RULES.strip().splitlines()})


def _places(norm: Column, m: int):
    """(places, first, last) of a phrase of m words by the parts of the text between its places."""

    def places(parts: Column) -> Column:
        some = F.size(parts) > 1
        return F.struct(
            (F.size(parts) - 1).alias("n"),
            F.when(some, _count(F.get(parts, F.lit(0)), " ") - 1).alias("first"),
            F.when(some, _count(norm, " ") - _count(F.element_at(parts, -1), " ") - m).alias("last"),
        )

    return places


#: Places of a rule that are added up together.
CHUNK = 256


def _base(norm: Column) -> list[Column]:
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return [F.when(F.contains(norm, F.lit(f" {p} ")), bind(F.split(norm, _edge(p), -1), _places(norm, len(p.split())))).otherwise(none) for p, _ in BASE]


def _detections(norm: Column) -> Column:
    """(s, e, priority, label) of all rules' places, ordered by start, then from long to short, then by priority."""
    rule = lambda r: F.struct(F.lit(r[0]).alias("label"), F.lit(r[1]).alias("regex"), F.lit(r[2]).alias("priority"))
    table = F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*map(rule, rs)).alias("rules")) for k, rs in rules()))

    def places(r: Column) -> Column:
        def chunk(each: Column, at: Column) -> Column:
            start = F.struct(at.alias("at"), F.array().cast("array<struct<s:int,e:int,priority:int,label:string>>").alias("out"))
            step = lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["n"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["n"]).alias("e"), r["priority"].alias("priority"), r["label"].alias("label")))).alias("out"),
            )
            return F.aggregate(each, start, step, lambda a: a["out"])

        def walk(parts: Column, found: Column) -> Column:
            # an array that grows by one is copied each time, so places are added up in chunks and these put together
            each = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("gap"), F.length(f).alias("n")))
            cut = lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / CHUNK).cast("int")), lambda k: F.slice(e, k * CHUNK + 1, F.lit(CHUNK)))
            long = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["n"])
            starts = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + long(c))))
            return bind(each, lambda e: bind(cut(e), lambda cs: F.flatten(F.zip_with(cs, F.slice(starts(cs), 1, F.size(cs)), chunk))))

        some = F.regexp_extract_all(norm, r["regex"], F.lit(0))
        none = F.array().cast("array<struct<s:int,e:int,priority:int,label:string>>")
        return bind(some, lambda f: F.when(F.size(f) > 0, bind(F.split(norm, r["regex"], -1), lambda p: walk(p, f))).otherwise(none))

    asked = F.filter(table, lambda k: F.contains(norm, k["keyword"]))
    every = F.flatten(F.transform(asked, lambda k: F.flatten(F.transform(k["rules"], places))))
    ordered = F.array_sort(F.transform(every, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("minus_e"), (-d["priority"]).alias("minus_p"), d["label"].alias("label"))))
    return ordered


def _resolved(ordered: Column) -> Column:
    """(labels, score): what is left after suppression.

    Detections come by start, then from long to short, so one is within an earlier one if that ends no sooner. For each level the
    furthest end of the detections of at least that priority is carried along; that is all that a later one needs.
    """
    start = F.struct(F.array(*(F.lit(-1) for _ in LEVELS)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))
    levels = F.array(*map(F.lit, LEVELS))

    def step(a: Column, d: Column) -> Column:
        e, p = -d["minus_e"], -d["minus_p"]
        hidden = F.element_at(a["ends"], F.array_position(levels, p).cast("int")) >= e
        ends = F.zip_with(a["ends"], levels, lambda end, level: F.when(level <= p, F.greatest(end, e)).otherwise(end))
        return F.when(hidden, a).otherwise(F.struct(ends.alias("ends"), F.array_union(a["labels"], F.array(d["label"])).alias("labels"), F.greatest(a["best"], p).alias("best")))

    return F.aggregate(ordered, start, step, lambda a: F.struct(a["labels"].alias("labels"), (a["best"] / 100.0).cast("double").alias("score")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row of docs.

    Words are ASCII letters and digits, without case, and anything beyond ASCII; null texts have none. n_base counts all
    places of the base phrases; first_word and last_word are the smallest and largest word, from 0, at which one
    starts, else null. labels are the base labels and those of the rules; both are distinct, sorted, joined by
    commas, and empty where there are none. score is the highest priority left, by 100; at least 0.5 with a base label.
    detections are (start word's character, end, priority, label) before suppression. Null ids and repeated rows stay;
    other columns are ignored.
    """
    trimmed = words(F.col("text"))
    norm = docs.select("doc_id", trimmed.alias("trimmed")).select("doc_id", "trimmed", F.concat(F.lit(" "), "trimmed", F.lit(" ")).alias("norm"))
    n_words = F.when(F.col("trimmed") == "", 0).otherwise(_count(F.col("trimmed"), " ") + 1)
    gate = reduce(or_, (F.contains(F.col("norm"), F.lit(k)) for k, _ in rules()))  # plain search, which is faster than one expression of all keywords
    base = F.array(*_base(F.col("norm")))
    hits = norm.select("doc_id", n_words.cast("long").alias("n_words"), base.alias("base"), F.when(gate, _detections(F.col("norm"))).alias("found"))
    names = F.array(*(F.lit(label) for _, label in BASE))
    base_labels = F.transform(F.filter(F.arrays_zip(F.col("base").alias("b"), names.alias("name")), lambda x: x["b"]["n"] > 0), lambda x: x["name"])
    counted = hits.select(
        "doc_id", "n_words", "found", base_labels.alias("base_labels"),
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).cast("long").alias("last_word"),
        F.when(F.size("found") > 0, _resolved(F.col("found"))).alias("method"),
    )
    both = F.array_union("base_labels", F.coalesce("method.labels", F.array().cast("array<string>")))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.coalesce("method.score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return counted.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(both).alias("labels"), score.alias("score"), F.col("found").alias("detections"))
