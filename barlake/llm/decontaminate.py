"""Benchmark decontamination: passages of the corpus against an inverted index of test items, by block-max WAND.

Every passage (PASSAGE words, a new one every half passage) is a query of its distinct words. An item's BM25 score
against itself gives its threshold; impacts are divided by it, so that every item counts from a score of 1 on. Items are
numbered, and a term's postings are cut into blocks of BLOCK item numbers, each with its greatest impact.

All passages of a slice are evaluated together, a step at a time. Pivot: a passage's terms are put in order of their greatest
impact; those whose greatest impacts add up to less than PIVOT lie before the pivot (at 1 they could not make a result
alone; a lower pivot opens a few more blocks and leaves far fewer items to score), and only the others open blocks. Block maxima: a passage and block go on only if the opened block maxima and what lies before the pivot can
reach 1; the other blocks are skipped with all their postings. The postings of what is left are added up by item under the
same bound, and items that can still reach 1 are scored in full. All above the threshold are then verified by word
n-grams shared with the item's question and with its answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.tables import written
from barlake.llm.textops import ALNUM, LOWER, Poly, split_words, text_slices

PASSAGE = 128
#: Share of an item's score against itself that a passage must reach.
THRESHOLD = 0.5
#: Share of the n-grams of the question, and of the answer, that must stand around the passage.
OVERLAP = 0.5
NGRAM = 3
K1, B = 1.2, 0.75
#: What the greatest impacts before a passage's pivot add up to at most.
PIVOT = 0.4
#: Item numbers of a block of postings.
BLOCK = 32
#: Words of items that an index has, about: 8 bytes a word and 16 a posting are broadcast. More items are searched for in further passes.
INDEX_WORDS = 2_000_000

_poly = Poly(31)


def _words(row, rows, buf, offsets):
    low = LOWER[buf]
    w = split_words(row, rows, low, offsets, ALNUM)
    return w, _poly.words(low, w.start, w.end)


def answer_start(text: str) -> int:
    """Characters before an item's answer: after an answer mark, else after the last question mark, else its last sentence."""
    if m := re.search(r"(?i)\banswer\s*:", text):
        return m.start()
    if "?" in text.rstrip(" ?\n"):
        return text.rstrip(" ?\n").rindex("?") + 1
    body = text.rstrip(" .!\n")
    ends = [m.end() for m in re.finditer(r"[.!]\s+", body)]
    return ends[-1] if ends else 0


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each item as hashes, and how many of them belong to the question."""
    for batch in batches:
        for row, rows, buf, offsets in text_slices(batch.column("text")):
            w, h = _words(row, rows, buf, offsets)
            texts = batch.column("text").slice(row, rows).to_pylist()
            for r in range(rows):
                mine = h[w.first[r] : w.first[r + 1]]
                at = len((texts[r] or "")[: answer_start(texts[r] or "")].encode())
                question = int((w.start[w.first[r] : w.first[r + 1]] - offsets[r] < at).sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(row + r, 1), pa.array([mine.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([question], pa.int32())],
                    names=["item_id", "words", "question"],
                )


@dataclass
class Index:
    """Arrays by item number, by term (in order of its hash), by block of postings (by term, then block), and by posting."""

    ids: np.ndarray
    question: np.ndarray
    words: np.ndarray
    word_head: np.ndarray
    threshold: np.ndarray
    terms: np.ndarray
    seen: np.ndarray
    most: np.ndarray
    block_head: np.ndarray
    block: np.ndarray
    block_most: np.ndarray
    posting_head: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    item_head: np.ndarray
    term_of: np.ndarray
    weight: np.ndarray


def _low_bits(terms: np.ndarray) -> np.ndarray:
    """Marks the low 16 bits that any of the terms has, so that most other words are passed over."""
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    return seen


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def build_index(ids, question, words, word_head, frequency: np.ndarray, n_items: int, mean: float) -> Index:
    """Items as arrays: ids, words of the question, and all words as hashes, those of item k from word_head[k] on.

    frequency: for each word, the items among all n_items, of `mean` words, that hold it.
    """
    size = np.diff(word_head)
    number = np.repeat(np.arange(len(ids)), size)
    order = np.lexsort((words, number))
    term, item, df = words[order], number[order], frequency[order]
    head = _heads(item, term)
    tf = np.diff(np.append(head, len(term)))
    term, item, df = term[head], item[head], df[head]
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
    reach = np.minimum(1.0, (PASSAGE // 2) / np.maximum(size, 1))  # a passage holds at least so much of a long item
    threshold = THRESHOLD * np.bincount(item, weights=impact, minlength=len(ids)) * reach
    weight = impact / threshold[item]
    terms, term_of = np.unique(term, return_inverse=True)
    by_term = np.lexsort((item, term_of))
    slot, posted, impact = term_of[by_term], item[by_term], weight[by_term]
    start = _heads(slot, posted // BLOCK)
    block_most = np.maximum.reduceat(impact, start) if len(start) else np.zeros(0)
    block_head = np.searchsorted(slot[start], np.arange(len(terms) + 1))
    most = np.maximum.reduceat(block_most, block_head[:-1]) if len(terms) else np.zeros(0)
    item_head = np.searchsorted(item, np.arange(len(ids) + 1))
    return Index(
        ids, question, words, word_head, threshold, terms, _low_bits(terms), most,
        block_head, posted[start] // BLOCK, block_most, np.append(start, len(posted)), posted, impact, item_head, term_of, weight,
    )


def _ngrams(h: np.ndarray, n: int) -> np.ndarray:
    sums = _poly.sums(h)
    i = np.arange(max(0, len(h) - n + 1))
    return _poly.span(sums, i, i + n)


def _share(part: np.ndarray, around: np.ndarray) -> float:
    """Share of a part's n-grams that stand in the words around; shorter parts are one n-gram, empty ones stand anywhere."""
    if not len(part):
        return 1.0
    n = min(NGRAM, len(part))
    return float(np.isin(_ngrams(part, n), _ngrams(around, n)).mean())


def _spread(head: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of `at`, place): all places from head[x] to head[x + 1] for each x of `at`."""
    n = head[at + 1] - head[at]
    return np.repeat(np.arange(len(at)), n), np.repeat(head[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _summed(value: np.ndarray, key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `size`, in order, and the sums of their values: counted into an array where that is small, else sorted."""
    if size <= 4 * len(key) + 1024:
        total = np.bincount(key, weights=value, minlength=size)
        some = np.flatnonzero(total)
        return some, total[some]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = _heads(key)
    return key[head], np.add.reduceat(value[order], head) if len(head) else value[:0]


#: What sums of floating-point numbers may be off by.
_EPS = 1e-9


def candidates(index: Index, p: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) pairs that may score 1 or more; p, slot: the distinct terms of passages that the index has."""
    most = index.most[slot]
    order = np.lexsort((most, p))
    p, slot, most = p[order], slot[order], most[order]
    head = _heads(p)
    if not len(head):
        return p, p
    upto = np.cumsum(most)
    size = np.diff(np.append(head, len(p)))
    upto -= np.repeat(upto[head] - most[head], size)
    enough = np.repeat(upto[head + size - 1] >= 1 - _EPS, size)  # all terms of the passage together
    opens = enough & (upto >= PIVOT)
    first = np.flatnonzero(opens & np.append(True, (p[1:] != p[:-1]) | ~opens[:-1]))
    low = int(p[0])
    before = np.zeros(int(p[-1]) - low + 1)  # what lies before each passage's pivot
    before[p[first] - low] = upto[first] - most[first]
    p, slot = p[opens] - low, slot[opens]
    which, entry = _spread(index.block_head, slot)
    blocks = len(index.ids) // BLOCK + 1
    key = p[which] * blocks + index.block[entry]
    found, bound = _summed(index.block_most[entry], key, len(before) * blocks)
    live = np.zeros(len(before) * blocks, dtype=bool)
    live[found[bound + before[found // blocks] >= 1 - _EPS]] = True
    kept = live[key]
    which, entry = which[kept], entry[kept]
    mine, posting = _spread(index.posting_head, entry)
    n = len(index.ids)
    found, bound = _summed(index.impact[posting], p[which][mine] * n + index.item[posting], len(before) * n)
    found = found[bound + before[found // n] >= 1 - _EPS]
    return found // n + low, found % n


def scored(index: Index, p: np.ndarray, item: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """Full scores of (passage, item) pairs; stands: sorted passage * terms + term of all terms that stand in passages."""
    which, place = _spread(index.item_head, item)
    asked = p[which] * len(index.terms) + index.term_of[place]
    at = np.minimum(np.searchsorted(stands, asked), len(stands) - 1)
    return np.bincount(which, weights=np.where(stands[at] == asked, index.weight[place], 0.0), minlength=len(p))


def search(index: Index, first: np.ndarray, doc: np.ndarray, h: np.ndarray, overlap: float = OVERLAP) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, item, passage's first word, score, question share, answer share) of every verified passage of a slice."""
    half = PASSAGE // 2
    at = np.flatnonzero(index.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
    if not len(index.terms) or not len(at):
        return
    slot = np.minimum(np.searchsorted(index.terms, h[at]), len(index.terms) - 1)
    hit = index.terms[slot] == h[at]
    at, slot = at[hit], slot[hit]
    # each word lies in the passage that begins in its half and in the one before
    base = (first[:-1] // half + np.arange(len(first) - 1) * 2).astype(np.int64)  # no two rows share a passage number
    place = at - first[doc[at]]
    here = (base[doc[at]] + place // half) * len(index.terms) + slot
    stands = np.unique(np.concatenate([here, here[place >= half] - len(index.terms)]))
    p, item = candidates(index, stands // len(index.terms), stands % len(index.terms))
    if not len(p):
        return
    scores = scored(index, p, item, stands)
    row_of = np.searchsorted(base, p, "right") - 1
    for c in np.flatnonzero(scores >= 1 - _EPS):
        r, k = int(row_of[c]), int(item[c])
        lo = int(first[r] + (p[c] - base[r]) * half)
        hi = int(min(lo + PASSAGE, first[r + 1]))
        words = index.words[index.word_head[k] : index.word_head[k + 1]]
        around = h[max(int(first[r]), lo - len(words)) : min(hi + len(words), int(first[r + 1]))]
        q = _share(words[: index.question[k]], around)
        a = _share(words[index.question[k] :], around)
        if q >= overlap and a >= overlap:
            yield r, k, lo - int(first[r]), float(scores[c] * index.threshold[k]), q, a


def _search_batches(shared, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for part in text_slices(batch.column("text")):
                w, h = _words(*part)
                best = {}
                for r, k, lo, score, q, a in search(index, w.first, w.doc, h, overlap):
                    if (old := best.get((r, k))) is None or (score, -lo) > (old[1], -old[0]):
                        best[r, k] = (lo, score, q, a)
                if best:
                    rows = sorted(best)
                    ids = batch.column("doc_id").slice(w.row, w.rows).take(pa.array([r for r, _ in rows]))
                    cols = list(zip(*(best[x] for x in rows), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(index.ids[[k for _, k in rows]], pa.int64()), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])],
                        names=["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"],
                    )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, passage_start, score, question_overlap, answer_overlap): every item found in every document.

    One row for each row of docs and item (rows that repeat an item count once) with a passage above the item's threshold whose surroundings hold the item's
    question and answer; the best passage is named. Null texts, and items without words, match nothing; null
    doc_ids are kept. Words are ASCII letters, digits and anything beyond ASCII, without case. Other columns are ignored.

    The items' words, document frequencies and mean length are counted by Spark. An index holds about `index_words` words of items,
    however many there are; with more, documents are read once for each index.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = items.mapInArrow(_item_batches, "item_id long, words array<long>, question int").where(F.size("words") > 0)
    items = items.withColumns({"size": F.size("words"), "key": F.xxhash64("item_id", "words")}).dropDuplicates(["item_id", "key"])
    items = written(items, "items")
    total, mean, words = items.agg(F.count(F.lit(1)), F.avg("size"), F.sum("size")).first()
    passes = max(1, -(-(words or 0) // index_words))
    part = F.pmod("key", F.lit(passes)).alias("part")
    # each item's words in order, each with the number of items that hold it
    placed = items.select(part, "key", "item_id", F.posexplode("words").alias("place", "term"))
    frequency = items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = written(placed.join(written(frequency, "frequencies").hint("shuffle_hash"), "term"), "terms")
    found = None
    for k in range(passes):
        mine = items.select(part, "item_id", "key", "question", "size").where(F.col("part") == k).orderBy("item_id", "key").toArrow()
        terms = counted.where(F.col("part") == k).orderBy("item_id", "key", "place").select("term", "df").toArrow()
        flat = lambda t, c: t.column(c).to_numpy()
        head = np.append(0, np.cumsum(flat(mine, "size"))).astype(np.int64)
        index = build_index(flat(mine, "item_id"), flat(mine, "question"), flat(terms, "term").astype(np.int64).view(np.uint64), head, flat(terms, "df"), total, mean or 1.0)
        schema = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"
        passed = docs.mapInArrow(_search_batches(spark.sparkContext.broadcast(index), overlap), schema)
        found = passed if found is None else found.unionByName(passed)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which an item was found; null doc_ids stay."""
    gone = written(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.alias("d").join(gone.alias("g").hint("shuffle_hash"), F.col("d.doc_id").cast("long") == F.col("g.doc_id"), "left_anti")
