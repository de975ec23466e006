"""Substring dedup by recompression.

A text's words are renamed in rounds: equal neighbours (runs) and then neighbouring pairs become one
symbol. A symbol's name is a hash of its parts' names, so every task gives equal parts the same name
without any exchange: the naming is global. Whether two symbols merge depends on the two alone, and
merges are bounded in words; so wherever a sequence of WINDOW words stands, its inside is cut alike,
but for MARGIN words at either end. Each window is assigned to the inner cut whose surrounding high-level
context has the least name. Neighbouring windows assigned to one cut form a stretch.

Only stretches whose cut is shared by two documents go on. A stretch that a smaller document holds
whole is removed at once; where stretches around one cut differ, their windows are compared one by
one. Names compared across documents have 128 bits from two independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.tables import written
from barlake.llm.textops import Poly, U, mix, signed, split_words, text_slices, word_slices

WINDOW = 50
#: (what is merged, most words of a merged symbol), in order.
ROUNDS = (("runs", 2), ("pairs", 4), ("pairs", 8))
#: Words at either end of a window whose symbols may depend on what stands outside: each round adds its widest merge's reach.
MARGIN = 2 + 2 + 4

_poly: dict[int, Poly] = {}
_NONE = np.iinfo(np.int64).max


def _hash(seed: int) -> Poly:
    if seed not in _poly:
        _poly[seed] = Poly(seed)
    return _poly[seed]


def merge_runs(start, name, doc, end, cap: int):
    """Maximal runs of one symbol, of at most `cap` words, become one symbol."""
    if not len(start):
        return start, name, doc, end
    head = np.ones(len(name), dtype=bool)
    head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(name)))
    last = first + count - 1
    merged = (count > 1) & (end[last] - start[first] <= cap)
    run = np.cumsum(head) - 1
    keep = head | ~merged[run]
    new_name, new_end = name.copy(), end.copy()
    f = first[merged]
    new_name[f] = mix(name[f] * U(0x9E3779B97F4A7C15) + count[merged].astype(np.uint64))
    new_end[f] = end[last[merged]]
    return start[keep], new_name[keep], doc[keep], new_end[keep]


def merge_pairs(start, name, doc, end, cap: int, seed: int):
    """A symbol of the left class and one of the right class after it become one symbol, of at most `cap` words."""
    if len(start) < 2:
        return start, name, doc, end
    right = (mix(name + U(seed)) >> U(63)).astype(bool)
    left = np.flatnonzero(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]) & (end[1:] - start[:-1] <= cap))
    keep = np.ones(len(name), dtype=bool)
    keep[left + 1] = False
    new_name, new_end = name.copy(), end.copy()
    new_name[left] = mix(mix(name[left]) * U(0xD6E8FEB86659FD93) + name[left + 1])
    new_end[left] = end[left + 1]
    return start[keep], new_name[keep], doc[keep], new_end[keep]


def cuts(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions where symbols of the last round begin."""
    start = np.arange(len(name))
    parts = (start, name, doc, start + 1)
    for k, (what, cap) in enumerate(ROUNDS):
        parts = merge_runs(*parts, cap) if what == "runs" else merge_pairs(*parts, cap, 7919 * (k + 1))
    return parts[0]


def stretches(words, window: int = WINDOW):
    """(row, first window, last window, two hashes of the words covered, name of the cut) of the stretches of a slice."""
    n = len(words.start)
    h1, h2 = (_hash(s).words(words.buf, words.start, words.end) for s in (1, 2))
    s1, s2 = _hash(3).sums(h1), _hash(4).sums(h2)
    reach = window - 2 * MARGIN  # cuts from MARGIN to MARGIN + reach words after a window's start
    value = np.full(n + reach + MARGIN + 1, _NONE)  # of each word that is a cut its place in the order of all cuts' names, then positions
    at = cuts(h1, words.doc)
    lo, hi = words.first[words.doc[at]], words.first[words.doc[at] + 1]
    at = at[(at - lo >= MARGIN) & (hi - at >= MARGIN)]
    key = mix(_hash(3).span(s1, at - MARGIN, at + MARGIN))
    ordered = at[np.lexsort((at, key))]
    value[ordered] = np.arange(len(at))
    width, low = 1, value
    while 2 * width <= reach + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = reach + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    s = np.flatnonzero(np.arange(n) + window <= words.first[words.doc + 1]) if n else np.zeros(0, np.int64)
    best = low[s + MARGIN]
    if (best == _NONE).any():
        raise AssertionError("a window without a cut: symbols are wider than the bound")
    head = np.ones(len(s), dtype=bool)
    head[1:] = (best[1:] != best[:-1]) | (s[1:] != s[:-1] + 1)
    a = s[head]
    b = s[np.append(np.flatnonzero(head)[1:], len(s)) - 1] if len(s) else a
    doc = words.doc[a]
    cut = ordered[best[head]]
    u1 = mix(_hash(3).span(s1, a, b + window)) + (b - a).astype(np.uint64)
    u2 = mix(_hash(4).span(s2, a, b + window))
    name = mix(_hash(3).span(s1, cut - MARGIN, cut + MARGIN))
    return doc, a - words.first[doc], b - words.first[doc], u1, u2, name


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, th = batch.column("doc_id"), batch.column("th")
        for w in word_slices(batch.column("text")):
            doc, a, b, u1, u2, name = stretches(w)
            rows = pa.array(doc + w.row)
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), th.take(rows), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(signed(u1)), pa.array(signed(u2)), pa.array(signed(name))],
                names=["doc_id", "th", "a", "b", "u1", "u2", "cut"],
            )


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of single windows, for the stretches listed with each text."""
    for batch in batches:
        ids, th, spans = batch.column("doc_id"), batch.column("th"), batch.column("spans").to_pylist()
        for row, rows, buf, offsets in text_slices(batch.column("text")):
            w = split_words(row, rows, buf, offsets)
            s1 = _hash(3).sums(_hash(1).words(buf, w.start, w.end))
            s2 = _hash(4).sums(_hash(2).words(buf, w.start, w.end))
            doc, at = [], []
            for r in range(rows):
                one = np.unique(np.concatenate([np.arange(x["a"], x["b"] + 1) for x in spans[row + r]]))
                at.append(one + w.first[r])
                doc.append(np.full(len(one), r))
            doc, at = np.concatenate(doc), np.concatenate(at)
            take = pa.array(doc + row)
            w1 = mix(_hash(3).span(s1, at, at + WINDOW))
            w2 = mix(_hash(4).span(s2, at, at + WINDOW))
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), th.take(take), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(signed(w1)), pa.array(signed(w2))],
                names=["doc_id", "th", "s", "w1", "w2"],
            )


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans): for each text the ranges [a, b] of window starts that also start in a smaller doc_id.

    docs: doc_id, text, th (a hash of the text, which tells rows of one doc_id apart), key (doc_id, or 0). Rows whose
    doc_id or text is null take no part.
    """
    live = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "th", "text")
    schema = "doc_id long, th long, a int, b int, u1 long, u2 long, cut long"
    every = written(live.mapInArrow(_stretch_batches, schema), "stretches")
    # written, so that the join deals both sides out itself and can split a cut that very many stretches have
    shared = written(every.groupBy("cut").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("cut"), "cuts")
    some = written(every.join(shared.hint("shuffle_hash"), "cut", "left_semi"), "shared")
    owner = some.groupBy("u1", "u2").agg(F.min("doc_id").alias("owner"), F.min("cut").alias("owner_cut"))
    # Shuffled by a written table: each stretch meets its owner, and cuts with several different stretches are told apart.
    owner = written(owner, "owners")
    met = some.join(owner.select("u1", "u2", "owner").hint("shuffle_hash"), ["u1", "u2"])
    whole = met.where("owner < doc_id").select("doc_id", "th", "a", "b")
    mixed = owner.groupBy(F.col("owner_cut").alias("cut")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cut")
    single = met.where("owner = doc_id").join(mixed.hint("shuffle_hash"), "cut", "left_semi")
    spans = single.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    # not written: the texts are dealt out by (key, th) for this join and for the caller's, so Spark deals them out once
    spans = spans.withColumnRenamed("doc_id", "key")
    open_docs = docs.join(spans.hint("shuffle_hash"), ["key", "th"])
    windows = open_docs.mapInArrow(_window_batches, "doc_id long, th long, s int, w1 long, w2 long")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    part = windows.join(least.hint("shuffle_hash"), ["w1", "w2"]).where("least < doc_id").select("doc_id", "th", F.col("s").alias("a"), F.col("s").alias("b"))
    return whole.unionByName(part).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def kept_bytes(w, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of a slice, each after one space, as bytes; and where each row's bytes begin."""
    s, e, doc = w.start[keep], w.end[keep], w.doc[keep]
    length = e - s + 1
    to = np.cumsum(length)
    index = np.repeat(s - 1 - (to - length), length) + np.arange(to[-1] if len(to) else 0)
    out = w.buf[index] if len(index) else np.zeros(0, np.uint8)
    if len(out):
        out[to - length] = 0x20
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=length, minlength=w.rows))]).astype(np.int64)
    return out, bounds


def _keep_mask(w, spans) -> np.ndarray:
    n = len(w.start)
    change = np.zeros(n + 1, dtype=np.int64)
    for r in range(w.rows):
        for x in spans[w.row + r] or ():
            change[w.first[r] + x["a"]] += 1
            change[w.first[r] + x["b"] + WINDOW] -= 1
    return np.cumsum(change[:n]) == 0


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        for w in word_slices(batch.column("text")):
            keep = _keep_mask(w, spans)
            out, bounds = kept_bytes(w, keep)
            raw = out.tobytes()
            sha = [hashlib.sha256(raw[bounds[r] + 1 : bounds[r + 1]]).hexdigest() for r in range(w.rows)]
            total = np.diff(w.first)
            gone = total - np.bincount(w.doc[keep], minlength=w.rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(w.row, w.rows), pa.array(total), pa.array(gone), pa.array(sha)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        for w in word_slices(batch.column("text")):
            keep = _keep_mask(w, spans)
            out, bounds = kept_bytes(w, keep)
            raw = out.tobytes()
            texts = [raw[bounds[r] + 1 : bounds[r + 1]].decode() for r in range(w.rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.row, w.rows), pa.array(texts)], names=["doc_id", "kept"])


def _with_spans(docs: DataFrame) -> DataFrame:
    """Each text with its ranges. The join's keys are never null, so both joins with the texts see the same rows."""
    doc_id = F.col("doc_id").cast("long")
    th = F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())
    docs = docs.select(doc_id.alias("doc_id"), "text", th.alias("th"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("key"))
    spans = removed_windows(docs).withColumnRenamed("doc_id", "key")
    return docs.join(spans.hint("shuffle_hash"), ["key", "th"], "left").select("doc_id", "text", "spans")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): every text's words without those covered by a window that starts in a smaller doc_id too.

    Words are runs of anything but space and the control characters 9 to 13; kept words are joined by one
    space. Null or empty texts: kept is empty. Null doc_id: nothing is removed, and no window counts for others.
    Rows of one doc_id are judged one by one, and none of them is smaller than another. Other columns are ignored.
    """
    return _with_spans(docs).mapInArrow(_text_batches, "doc_id long, kept string")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """As dedup_substrings, but with counts and the SHA-256 of the kept words in place of the texts."""
    return _with_spans(docs).mapInArrow(_digest_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")
