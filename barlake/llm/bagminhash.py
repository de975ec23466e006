"""Near-duplicate documents by BagMinHash signatures of their multisets of five-word shingles.

A shingle that stands c times has weight c. Its weight axis is cut into (0, 1], (1, 2], (2, 4], (4, 8], ...;
each piece carries a Poisson process in time, seeded by shingle and piece, whose rate is the piece's width. With each
point a piece wider than one is split: the half that holds the point and the other half go on as
processes of their own, from the time of the point, and so on down to pieces of width one. Halves beyond c are
dropped as soon as they arise. A point of a piece of width one falls on one signature component, and a component keeps
its earliest point; two bags agree on it with a probability equal to their weighted Jaccard similarity. Points
are made in order of time only until every component has an earlier one.

Bags that agree on all components of a band meet in a bucket. Every member is compared, multiset against multiset, with
one other first: the least document of all its buckets. Buckets whose members are then of several classes are open.
In turns, a member of each open bucket is drawn, and each member of another class meets one of the drawn members of
its buckets. In the end, documents that open buckets connect form groups, whose classes are compared in full: a group is
dealt into blocks, and the intersections of two blocks' multisets are products of their indicator matrices. So no
two similar bags that met in a bucket stay apart, and of the pairs only those that join classes are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.components import components, grown
from barlake.llm.native import sided
from barlake.llm.tables import counted, written
from barlake.llm.textops import Poly, U, mix, signed, word_slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Least share of equal components for a comparison of bags: over five standard deviations below SIMILARITY.
ESTIMATE = 0.6
#: Turns with drawn members at most, and the least share of the members outside that a turn must bring in for another one.
TURNS, PROGRESS = 6, 0.1
#: Documents and shingles of a block, about: a task holds two blocks.
BLOCK, SHINGLES = 1024, 1 << 19
#: Shingles that at least so many documents of two blocks have are counted by a matrix product, others pair by pair.
DENSE = 16

_poly = Poly(11)
_over = Poly(13)
_GOLD = U(0x9E3779B97F4A7C15)


def shingles(w) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit shingle) of a slice's words; a text of fewer than SHINGLE words is one shingle."""
    sums = _over.sums(_poly.words(w.buf, w.start, w.end))
    counts = np.diff(w.first)
    at = np.arange(len(w.start))
    full = at[at + SHINGLE <= w.first[w.doc + 1]] if len(at) else at
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    i = np.concatenate([full, w.first[short]])
    j = np.concatenate([full + SHINGLE, w.first[short + 1]])
    return np.concatenate([w.doc[full], short]), mix(_over.span(sums, i, j) + (j - i).astype(np.uint64))


def bags(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle, count), sorted: the multisets of a slice, whose rows are fewer than 65,536."""
    doc, name = shingles(w)
    key = np.sort((doc.astype(np.uint64) << U(48)) | (name >> U(16)))
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> U(48)).astype(np.int64), key & U(0xFFFFFFFFFFFF), count


def _split_pieces(grid: np.ndarray, seed, doc, low, width, top):
    """Splits pieces wider than one down to width one: (seed, doc, time) of those with a first point that can count.

    A process is its piece [low, low + width), the time it starts from, and whether it has a point at that time. Both
    halves of a split piece are seeded by the piece's own seed, so they do not depend on what a bag has of it.
    """
    size = grid.shape[1]
    time, has = np.zeros(len(seed), np.int64), np.zeros(len(seed), bool)
    out = []
    while len(seed):
        gap = -np.log(((mix(seed) >> U(11)).astype(np.float64) + 0.5) / 2**53) / (width * size)
        time = np.where(has, time, time + (gap * 2.0**44).astype(np.int64) + 1)
        alive = time < grid.max(axis=1)[doc]
        seed, doc, low, width, top, time = (x[alive] for x in (seed, doc, low, width, top, time))
        one = width == 1
        if one.any():
            out.append((seed[one], doc[one], time[one]))
            component = (mix(seed[one] + U(0x632BE59BD9B4E019)) % U(size)).astype(np.int64)
            np.minimum.at(grid.reshape(-1), doc[one] * size + component, time[one])
            seed, doc, low, width, top, time = (x[~one] for x in (seed, doc, low, width, top, time))
        half = width // 2
        upper = (mix(seed + _GOLD) >> U(63)).astype(bool)  # which half holds the point
        left, right = mix(seed * _GOLD + U(1)), mix(seed * _GOLD + U(2))
        seed, has = np.concatenate([left, right]), np.concatenate([~upper, upper])
        doc, width, top, time = (np.concatenate([x, x]) for x in (doc, half, top, time))
        low = np.concatenate([low, low + half])
        near = low < top
        seed, doc, low, width, top, time, has = (x[near] for x in (seed, doc, low, width, top, time, has))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def signatures(rows: int, doc: np.ndarray, name: np.ndarray, count: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Earliest times in units of 2**-44, rows x size; rows without shingles keep the largest number.

    Times are whole numbers, so sums do not depend on how the points of a process are blocked.
    """
    grid = np.full((rows, size), np.iinfo(np.int64).max)
    least = grid.reshape(-1)
    # pieces of width one have all their points made in blocks
    seed, own, time = mix(name * _GOLD + U(1)), doc, np.zeros(len(name), np.int64)
    wide, lo, piece = np.flatnonzero(count > 1), 1, 1
    parts = []
    while len(wide):
        n = len(wide)
        parts.append((mix(name[wide] * _GOLD + U(2 * piece + 1)), doc[wide], np.full(n, lo), np.full(n, lo), count[wide]))
        lo, piece = 2 * lo, piece + 1
        wide = wide[count[wide] > lo]
    fill = _fill(least, grid, seed, own, time)
    if parts:
        split = _split_pieces(grid, *(np.concatenate([p[k] for p in parts]) for k in range(5)))
        _fill(least, grid, *split)
    return fill


def _fill(least: np.ndarray, grid: np.ndarray, seed: np.ndarray, doc: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Further points of pieces of width one, until every component of their row has an earlier point."""
    size = grid.shape[1]
    made = 0
    while len(seed):
        block = 1 if len(seed) > 20_000 else 4 if len(seed) > 4_000 else 32
        step = np.arange(made + 1, made + block + 1, dtype=np.uint64)
        r1 = mix(seed[:, None] + step * _GOLD)
        gap = -np.log(((r1 >> U(11)).astype(np.float64) + 0.5) / 2**53) / size
        at = time[:, None] + np.cumsum((gap * 2.0**44).astype(np.int64) + 1, axis=1)
        component = (mix(r1 + U(0x632BE59BD9B4E019)) % U(size)).astype(np.int64)
        np.minimum.at(least, (doc[:, None] * size + component).reshape(-1), at.reshape(-1))
        time = at[:, -1]
        made += block
        alive = time < grid.max(axis=1)[doc]
        seed, doc, time = seed[alive], doc[alive], time[alive]
    return grid


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in word_slices(batch.column("text")):
            doc, name, count = bags(w)
            grid = signatures(w.rows, doc, name, count)
            bits = mix(grid.view(np.uint64) + np.arange(SIZE, dtype=np.uint64))
            band = mix((bits.reshape(w.rows, BANDS, ROWS) * (U(2) * np.arange(ROWS, dtype=np.uint64) + U(1))).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            total = np.bincount(doc, weights=count, minlength=w.rows).astype(np.int64)
            b = [np.zeros(w.rows, np.uint64), np.zeros(w.rows, np.uint64)]
            for k, seed in enumerate((U(17), U(29))):
                np.add.at(b[k], doc, mix(mix(name + seed) * count.astype(np.uint64)))
            some = total > 0
            flat = lambda x, n, kind: pa.ListArray.from_arrays(pa.array((np.arange(w.rows + 1) * n).astype(np.int32)), pa.array(x.reshape(-1), kind))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(w.row, w.rows),
                    pa.array(total),
                    pa.array(signed(b[0])),
                    pa.array(signed(b[1])),
                    flat((bits >> U(56)).astype(np.uint8).view(np.int8), SIZE, pa.int8()),
                    flat(signed(band), BANDS, pa.int64()),
                ],
                names=["doc_id", "n_shingles", "b1", "b2", "signature", "bands"],
            )
            yield out.filter(pa.array(some))


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of signatures, row by row, can be those of similar bags."""
    return (a == b).sum(axis=1) >= ESTIMATE * SIZE


def _signatures(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), SIZE)


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the two texts of each row whose signatures allow it, of which those of SIMILARITY or more stay."""
    for batch in batches:
        batch = batch.filter(pa.array(_similar(_signatures(batch.column("sig_u")), _signatures(batch.column("sig_v")))))
        n = batch.num_rows
        both = pa.concat_arrays([batch.column("text_u").cast(pa.large_string()), batch.column("text_v").cast(pa.large_string())])
        part = {}
        step = 200
        for i in range(0, n, step):  # each text and its partner in one slice
            m = min(step, n - i)
            pair = pa.concat_arrays([both.slice(i, m), both.slice(n + i, m)])
            found = [(w.row, *bags(w)) for w in word_slices(pair)]
            doc = np.concatenate([row + d for row, d, _, _ in found])
            name = np.concatenate([x for _, _, x, _ in found])
            count = np.concatenate([x for _, _, _, x in found])
            total = np.bincount(doc, weights=count, minlength=2 * m)
            key = ((doc % m).astype(np.uint64) << U(48)) | name
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            same = np.flatnonzero(key[1:] == key[:-1])
            shared = np.bincount((key[same] >> U(48)).astype(np.int64), weights=np.minimum(count[same], count[same + 1]), minlength=m)
            part[i] = shared / np.maximum(total[:m] + total[m:] - shared, 1)
        similarity = np.concatenate([part[i] for i in sorted(part)]) if part else np.zeros(0)
        keep = similarity >= SIMILARITY - 1e-12
        out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(similarity)], names=["u", "v", "similarity"])
        yield out.filter(pa.array(keep))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v, similarity) among candidate pairs (u, v). texts: doc_id, text, signature."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"), F.col("signature").alias(f"sig_{c}")).hint("shuffle_merge")
    rows = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v", "sig_u", "sig_v")
    return rows.mapInArrow(_compare_batches, "u long, v long, similarity double")


def _open_members(met: DataFrame, roots: DataFrame, n: int, turn: int) -> tuple:
    """(table, its rows, rows outside the drawn member's class) of the buckets whose members are of several classes.

    The table: bucket, doc_id, root, drawn, drawn_root, least (the bucket's least doc_id). Classes only grow together, so what is left out here
    need not be looked at again.
    """
    label = sided(roots.select(F.col("node").alias("doc_id"), "root"), n)
    own = met.select("bucket", "doc_id").join(label, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    drawn = F.min_by(F.struct(F.col("doc_id").alias("drawn"), F.col("root").alias("drawn_root")), F.xxhash64("doc_id", "bucket", F.lit(turn))).alias("d")
    several = own.groupBy("bucket").agg(drawn, F.min("root").alias("_a"), F.max("root").alias("_b"), F.min("doc_id").alias("least")).where("_a < _b")
    several, k = counted(several.select("bucket", "d.*", "least"), "open_buckets")
    return counted(own.join(sided(several, k), "bucket"), "open_members", F.count_if(F.col("root") != F.col("drawn_root")))


def _drawn_pairs(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v): each member that is of another class than its bucket's drawn member, with the drawn member of one of its buckets."""
    outside = rest.where("root != drawn_root")
    return outside.groupBy(F.col("doc_id").alias("u")).agg(F.min_by("drawn", F.xxhash64("drawn", F.lit(turn))).alias("v"))


def _intersections(n: int, doc: np.ndarray, name: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sizes of the multiset intersections of n bags, n x n (the diagonal is of no use).

    A shingle that stands c times is c different elements, so that multisets are sets.
    """
    which = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    element, doc = mix(name[which] + _GOLD * place.astype(np.uint64)), doc[which]
    order = np.argsort(element, kind="stable")
    element, doc = element[order], doc[order]
    head = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(element)))
    out = np.zeros((n, n), np.float32)
    for d in np.unique(size[(size > 1) & (size < DENSE)]):
        docs = doc[head[size == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        step = max(1, max(n * n // 16, 1 << 14) // len(i))  # indices stay small beside the counts of all pairs
        for k in range(0, len(docs), step):
            out += np.bincount((docs[k : k + step, i] * n + docs[k : k + step, j]).ravel(), minlength=n * n).reshape(n, n)
    out += out.T
    dense = np.flatnonzero(size >= DENSE)
    for k in range(0, len(dense), 1024):
        some = dense[k : k + 1024]
        at = np.repeat(head[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
        x = np.zeros((n, len(some)), np.float32)
        x[doc[at], np.repeat(np.arange(len(some)), size[some])] = 1
        out += x @ x.T
    return out


def _compare_block(table: pa.Table) -> pa.Table:
    """Links between classes among the documents of two blocks (or of several small groups): one for each two classes that it joins."""
    table = table.combine_chunks()
    column = table.column("text").combine_chunks()
    found = [(w.row, *bags(w)) for w in word_slices(column)]
    doc = np.concatenate([row + d for row, d, _, _ in found])
    name, count = np.concatenate([x for _, _, x, _ in found]), np.concatenate([x for _, _, _, x in found])
    n = table.num_rows
    total = np.bincount(doc, weights=count, minlength=n)
    shared = _intersections(n, doc, name, count)
    similar = np.empty((n, n), bool)
    for k in range(0, n, 256):  # rows at a time: the sizes of all unions at once would take several times the intersections
        similar[k : k + 256] = shared[k : k + 256] >= (SIMILARITY - 1e-12) * (total[k : k + 256, None] + total[None, :] - shared[k : k + 256])
    ids, group, side = (table.column(c).to_numpy() for c in ("doc_id", "group", "block"))
    similar &= (group[:, None] == group[None, :]) & ((side[:, None] != side[None, :]) | (side.min() == side.max()))
    label = table.column("root").to_numpy().copy()
    u, v, s = [], [], []
    for i in range(n):
        near = np.flatnonzero(similar[i] & (label != label[i]))
        for other, j in zip(*np.unique(label[near], return_index=True), strict=True):
            j = near[j]
            u.append(ids[i]), v.append(ids[j]), s.append(float(shared[i, j] / (total[i] + total[j] - shared[i, j])))
            label[label == other] = label[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "similarity": pa.array(s, pa.float64())})


def _across(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v, similarity) that join the classes of open buckets' members.

    Documents that buckets connect form a group. In a group, all but those of its largest class are compared with all;
    a group of more than BLOCK documents or SHINGLES shingles is dealt into blocks by hash, the largest class apart, and each two
    blocks of which one is not of that class meet in a task. Only a single text can make a block of many more shingles.
    """
    groups, n = components(rest.select(F.col("doc_id").alias("u"), F.col("least").alias("v")))
    lengths = texts.groupBy("doc_id").agg(F.sum("n_shingles").alias("length"))
    docs = rest.select("doc_id", "root").distinct().join(sided(groups.select(F.col("node").alias("doc_id"), F.col("root").alias("group")), n), "doc_id", "left")
    docs = docs.withColumn("group", F.coalesce("group", "doc_id")).join(lengths.hint("shuffle_hash"), "doc_id")
    docs = written(docs, "open_documents")
    classes = docs.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    main = lambda c: F.max_by(c, F.struct("n", "root"))
    sizes = classes.groupBy("group").agg(
        F.sum("n").alias("all"), F.sum("length").alias("all_length"), F.max("n").alias("main"), main("length").alias("main_length"), main("root").alias("main_root")
    ).where("all > main")
    blocks = lambda c, length: F.greatest(F.ceil(c / F.lit(BLOCK)), F.ceil(length / F.lit(SHINGLES)))
    sizes = sizes.select(
        "group",
        "main_root",
        blocks(F.col("all"), F.col("all_length")).alias("blocks"),
        blocks(F.col("all") - F.col("main"), F.col("all_length") - F.col("main_length")).cast("int").alias("odd_blocks"),
        blocks(F.col("main"), F.col("main_length")).cast("int").alias("main_blocks"),
        F.greatest(F.col("all") / F.lit(BLOCK), F.col("all_length") / F.lit(SHINGLES)).alias("share"),
    )
    sizes, n, small = counted(sizes, "groups", F.ceil(F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("share"))), F.lit(0))))
    dealt = docs.join(sided(sizes, n), "group")
    alone, h = F.col("blocks") == 1, F.xxhash64("doc_id")
    block = F.when(F.col("root") == F.col("main_root"), F.col("odd_blocks") + F.pmod(h, "main_blocks")).otherwise(F.pmod(h, F.greatest("odd_blocks", F.lit(1)))).cast("int")
    with_text = dealt.withColumn("block", F.when(alone, 0).otherwise(block)).join(texts.select("doc_id", "text").hint("shuffle_merge"), "doc_id")
    last = F.when(alone, 0).when(F.col("root") == F.col("main_root"), F.col("odd_blocks") - 1).otherwise(F.col("odd_blocks") + F.col("main_blocks") - 1)
    each = with_text.withColumn("partner", F.explode(F.sequence(F.lit(0), last)))
    bundle = F.pmod(F.xxhash64("group"), F.lit(max(1, int(small))))
    key = F.when(alone, F.struct(bundle.alias("a"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(
        F.struct(F.col("group").alias("a"), F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"))
    )
    return each.select(key.alias("key"), "doc_id", "group", "root", "block", "text").groupBy("key").applyInArrow(_compare_block, "u long, v long, similarity double")


def _linked(met: DataFrame, representatives: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(links, roots, number of roots) of the members of all buckets (bucket, doc_id, hub), one candidate a member and turn."""
    first = met.where("doc_id != hub").groupBy(F.col("doc_id").alias("u")).agg(F.min("hub").alias("v"))
    some = met.select("doc_id").distinct()
    texts = live.join(representatives.select("doc_id", "n_shingles", "signature").join(some.hint("shuffle_hash"), "doc_id", "left_semi").hint("shuffle_merge"), "doc_id")
    texts = written(texts, "texts")
    links = written(_verified(written(first, "pairs"), texts), "links")
    roots, n = components(links.select("u", "v"))
    rest, _, outside = _open_members(met, roots, n, 0)
    before = None
    for turn in range(1, TURNS + 1):
        if not outside or (before and outside > (1 - PROGRESS) * before):
            break
        found, new = counted(_verified(written(_drawn_pairs(rest, turn), "pairs"), texts), "links")
        links, before = links.unionByName(found), outside
        if new:
            roots, n = grown(roots, n, found.select("u", "v"))
            rest, _, outside = _open_members(rest, roots, n, turn)
    if outside:
        found, new = counted(_across(rest, texts), "links")
        links = links.unionByName(found)
        if new:
            roots, n = grown(roots, n, found.select("u", "v"))
    return links, roots, n


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: class_id is the least doc_id of its class of near duplicates.

    Two documents are linked if the weighted Jaccard similarity of their multisets of five-word shingles is 0.8 or
    more; classes are what links connect. n_links counts the verified links of the document's bag that were needed, each with
    a different text. Words are runs of anything but space and the control characters 9 to 13. Copies of one bag share a
    class without links. Texts that are null or have no word are a class of their own, as are null doc_ids
    (class_id null). Rows that repeat a doc_id share its class. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    live = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    schema = "doc_id long, n_shingles long, b1 long, b2 long, signature array<tinyint>, bands array<long>"
    signed_docs = written(live.mapInArrow(_signature_batches, schema), "signatures")
    least = signed_docs.groupBy("b1", "b2").agg(F.min("doc_id").alias("rep"))
    members = signed_docs.join(least.hint("shuffle_hash"), ["b1", "b2"])
    own = lambda c: F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c)
    members = written(members.select("doc_id", "rep", "n_shingles", "b1", "b2", own("signature"), own("bands")), "members")
    representatives = members.where("doc_id = rep").dropDuplicates(["doc_id", "b1", "b2"]).select("doc_id", "n_shingles", "signature", "bands")
    representatives = written(representatives, "representatives")

    buckets = representatives.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("_most")).where("hub < _most").select("bucket", "hub")
    met = written(buckets.join(hubs.hint("shuffle_hash"), "bucket"), "buckets")
    links, roots, n = _linked(met, representatives, live)

    links = links.select("u", "v").distinct()
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    state = sided(roots.select(F.col("node").alias("rep"), "root"), n)
    classes = members.select("doc_id", "rep").join(state, "rep", "left").join(degree.hint("shuffle_hash"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "rep")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links")
    )
    out = docs.select("doc_id").join(classes.hint("shuffle_hash"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those whose class of near duplicates has a smaller doc_id; null doc_ids stay."""
    gone = near_duplicates(docs).where("class_id < doc_id").select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g").hint("shuffle_hash"), F.col("d.doc_id").cast("long") == F.col("g.doc_id"), "left_anti")
