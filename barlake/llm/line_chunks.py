"""Line dedup by content-defined chunks of lines, with DataFrame functions alone.

A rolling hash over the hashes of two neighbouring lines says where a chunk ends, so a line put in or taken out moves the
cuts near it only. Chunks of two lines or more that stand elsewhere too are removed but for their first place, by
doc_id and line, after their bytes were compared with those of the first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.native import bind
from barlake.llm.tables import written

#: A cut follows a pair of lines with a chance of one in SPREAD.
SPREAD = 4
LEAST_LINES = 2


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _chunks(lines: Column) -> Column:
    """(s, n, k1, k2) of the chunks of LEAST_LINES lines or more: first line, lines, two hashes of the chunk's bytes."""

    def cut(h: Column) -> Column:
        n = F.size(h)
        ends = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(ends, lambda i: (F.coalesce(F.get(h, i - 2), F.lit(0)) * 31 + F.get(h, i - 1)) % SPREAD == 0)

    def pieces(cuts: Column, n: Column) -> Column:
        each = F.zip_with(F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(n)), lambda s, e: F.struct(s.alias("s"), (e - s).alias("n")))
        return F.filter(each, lambda c: c["n"] >= LEAST_LINES)

    def named(own: Column) -> Column:
        cuts = bind(F.transform(own, line_hash), cut)
        found = bind(cuts, lambda c: pieces(c, F.size(own)))
        text = lambda c: F.array_join(F.slice(own, c["s"] + 1, c["n"]), "\n")
        return F.transform(
            found,
            lambda c: bind(text(c), lambda t: F.struct(c["s"].alias("s"), c["n"].alias("n"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("chunk"), t).alias("k2"))),
        )

    return bind(lines, named)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): line ranges (s, n) of each text that go. docs: doc_id, text, th (hash of the text)."""
    docs = docs.select("doc_id", "text", "th")
    live = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # rows that repeat both id and text are one text here
    each = live.select("doc_id", "th", F.explode(_chunks(F.split("text", "\n", -1))).alias("c")).select("doc_id", "th", "c.*")
    chunks = written(each, "chunks")
    place = F.struct("doc_id", "th", "s")
    firsts = chunks.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("k1", "k2", "first")
    places = chunks.join(firsts.hint("shuffle_hash"), ["k1", "k2"]).withColumn("is_first", place == F.col("first")).drop("first")
    places = written(places, "places")
    asked = places.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "n", "k1", "k2", "is_first")).alias("asked"))
    texts = docs.join(asked.hint("shuffle_hash"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    cut = lambda lines: F.transform(F.col("asked"), lambda c: F.struct(c["s"].alias("s"), c["n"].alias("n"), c["k1"].alias("k1"), c["k2"].alias("k2"), c["is_first"].alias("is_first"), F.array_join(F.slice(lines, c["s"] + 1, c["n"]), "\n").alias("bytes")))
    found = texts.select("doc_id", "th", F.explode(bind(F.split("text", "\n", -1), cut)).alias("c")).select("doc_id", "th", "c.*")
    found = written(found, "chunk_texts")
    first = found.where("is_first").select("k1", "k2", F.col("bytes").alias("first_bytes"))
    later = found.where("not is_first").join(first.hint("shuffle_merge"), ["k1", "k2"]).where("bytes = first_bytes")
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "n")).alias("gone"))


def _kept(lines: Column) -> Column:
    gone = F.flatten(F.transform("gone", lambda c: F.sequence(c["s"], c["s"] + c["n"] - 1)))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(rest, lambda i: F.get(lines, i))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with `text` less its repeated chunks of lines, and `_lines` and `_removed` counts.

    Lines are what a line feed separates. Of a repeated chunk the place with the least doc_id (then hash of the text,
    then line) stays. Rows that repeat both doc_id and text count as one, so none of them makes another one's lines
    repeated. Null texts stay null with 0 lines; a null doc_id loses nothing and makes nothing repeated. Columns of docs
    that have an added name are replaced.
    """
    th = F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), th.alias("_th"), "text", F.struct(*docs.columns).alias("_row"))
    gone = repeated_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", th.alias("th")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "gone")
    met = keyed.join(gone.hint("shuffle_hash"), ["_id", "_th"], "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(bind(F.split("text", "\n", -1), _kept), "\n"))
    n = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, c: a + c["n"]), F.lit(0)).cast("long")
    kept = [text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("_lines", "_removed")]
    return met.select(*kept, n.alias("_lines"), removed.alias("_removed"))
