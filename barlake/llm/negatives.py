"""Hard negatives by exact inner products of Kronecker-packed integers.

A block of candidates is packed for each pair of blocks: the components of several candidates, biased to be non-negative, lie in separated fields of one
64-bit integer, so that one multiplication by an anchor's component serves all of them. Fields are as wide as the largest score of
the two blocks asks for (by Cauchy and Schwarz); carries between fields cancel modulo 2**64 once the bias is taken off, and
each field then holds its exact score.

Rows are dealt into blocks by label, large labels over several. Anchors meet the blocks of their own label for their positives, then all
blocks for the negatives between the bounds that each positive's score sets. Each task gives the few best of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.native import sided
from barlake.llm.tables import counted, written

POSITIVES, NEGATIVES, SCALE = 5, 3, 256.0
#: Rows of a data block and of an anchor block; the largest squared norm, so that every score fits into a long.
BLOCK, ANCHORS, NORM = 4096, 256, 2.0**62
_U = np.uint64
_KINDS = ("int8", "int16", "int32", "int64")


def labelled(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): v = floor(SCALE * x) of every component, the label raised by one modulo 10 where vec_id is divisible by 7.

    Null ids, labels, vectors or components and non-finite components take a row out, and so does a squared norm of NORM or more.
    """
    x = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * SCALE))
    bad = F.exists(F.col("embedding"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    wide = F.aggregate(F.transform(F.col("embedding"), lambda c: (F.abs(c.cast("double")) * SCALE + 1) ** 2), F.lit(0.0), lambda s, c: s + c) >= NORM
    live = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad | wide, F.lit(True)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return live.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda c: c.cast("long")).alias("v"))


def pack(y: np.ndarray, bits: int) -> tuple[np.ndarray, int, int]:
    """(wide, fields, bias): wide[d, g] holds component d of the candidates g, g + G, ... in fields of `bits` bits."""
    fields = 64 // bits
    groups = -(-len(y) // fields)
    bias = int(-y.min(initial=0))
    padded = np.zeros((fields * groups, y.shape[1]), dtype=np.uint64)
    padded[: len(y)] = (y + bias).astype(np.uint64)
    wide = np.zeros((y.shape[1], groups), dtype=np.uint64)
    for f in range(fields):
        wide += padded[f * groups : (f + 1) * groups].T << _U(f * bits)
    return wide, fields, bias


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers, exactly, for |x_i| |y_j| < 2**62."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    norm = lambda z: float(np.sqrt((z.astype(np.float64) ** 2).sum(axis=1).max()))
    bits = min(64, int(norm(x) * norm(y) * (1 + 1e-9) + 1).bit_length() + 1)
    wide, fields, bias = pack(y, bits)
    anchor = x.astype(np.uint64)
    total = np.zeros((len(x), wide.shape[1]), dtype=np.uint64)
    for d in range(x.shape[1]):  # one multiplication for each anchor component and wide integer
        total += anchor[:, d, None] * wide[d][None, :]
    half = _U(1 << (bits - 1))
    ones = _U(sum(1 << (f * bits) for f in range(fields)))
    total += ((half - anchor.sum(axis=1) * _U(bias & (2**64 - 1))) * ones)[:, None]
    mask = _U((1 << bits) - 1)
    fields_of = [((total >> _U(f * bits)) & mask) - half for f in range(fields)]
    return np.concatenate(fields_of, axis=1)[:, : len(y)].view(np.int64)


def _packed(table: pa.Table) -> pa.Table:
    """A block as one row, components in the narrowest type."""
    table = table.combine_chunks()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    kind = next(t for t in _KINDS if np.abs(flat).max(initial=0) <= np.iinfo(t).max)
    one = {c: table.column(c).slice(0, 1) for c in ("dim", "home", "part")}
    as_bytes = lambda c: pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
    return pa.table(one | {"ids": as_bytes("vec_id"), "labels": as_bytes("label"), "kind": [kind], "rows": pa.array([flat.astype(kind).tobytes()], pa.binary())})


_BLOCK = "dim int, home long, part int, ids binary, labels binary, kind string, rows binary"


def _homes(rows: DataFrame) -> tuple[DataFrame, int]:
    """(dim, label, home), and their number: a label of BLOCK rows or more has a home of its own, an even number; small labels share odd ones."""
    counts, n, small = counted(rows.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")), "labels", F.coalesce(F.sum(F.when(F.col("n") < BLOCK, F.col("n"))), F.lit(0)))
    shared = F.pmod(F.xxhash64("dim", "label"), F.lit(max(1, -(-small // BLOCK)))) * 2 + 1
    return counts.select("dim", "label", F.when(F.col("n") >= BLOCK, F.col("label") * 2).otherwise(shared).alias("home")), n


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, (dim, home, parts), number of blocks): each home's rows dealt over parts of about `size`."""
    parts, homes = counted(rows.groupBy("dim", "home").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")), "parts")
    # the place in the table deals rows that are alike; blocks are written at once
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    dealt = rows.join(sided(parts, homes), ["dim", "home"]).withColumn("part", part)
    blocks, n = counted(dealt.groupBy("dim", "home", "part").applyInArrow(_packed, _BLOCK), name)
    return blocks, parts, n


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first entries of each row by score and id."""
    order = np.lexsort((ids, -score, row))
    return order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(pair, anchors, candidates, scores, same label, other id) of each anchor block with a data block."""
    for batch in batches:
        for r in batch.to_pylist():
            a, d = _array(r["a_ids"]), _array(r["ids"])
            x, y = (np.frombuffer(r[p + "rows"], r[p + "kind"]).astype(np.int64).reshape(len(ids), r["dim"]) for p, ids in (("a_", a), ("", d)))
            yield r, a, d, products(x, y), _array(r["a_labels"])[:, None] == _array(r["labels"])[None, :], a[:, None] != d[None, :]


def _positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, a, d, score, same, other in _pairs(batches):
        i, j = np.nonzero(same & other)
        s = score[i, j]
        some = _best(i, s, d[j], POSITIVES)
        yield pa.RecordBatch.from_arrays([pa.array(a[i[some]]), pa.array(d[j[some]]), pa.array(s[some])], names=["anchor_id", "positive_id", "score"])


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r, a, d, score, same, other in _pairs(batches):
        least, most = (_array(r[c]).reshape(len(a), POSITIVES) for c in ("least", "most"))
        i, j = np.nonzero(~same & other & (score >= least.min(axis=1)[:, None]) & (score <= most.max(axis=1)[:, None]))
        s, found = score[i, j], []
        for slot in range(POSITIVES):
            ok = np.flatnonzero((s >= least[i, slot]) & (s <= most[i, slot]))
            some = ok[_best(i[ok], s[ok], d[j[ok]], NEGATIVES)]
            found.append((a[i[some]], np.full(len(some), slot + 1, np.int32), d[j[some]], s[some]))
        columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "slot", "negative_id", "negative_score"])


def _bounds(table: pa.Table) -> pa.Table:
    """What a negative may score beside each positive of an anchor block; a missing positive allows nothing."""
    ids = np.unique(table.column("anchor_id").to_numpy())
    slot, s = table.column("slot").to_numpy() - 1, table.column("score").to_numpy()
    at = np.searchsorted(ids, table.column("anchor_id").to_numpy())
    least, most = np.full((len(ids), POSITIVES), np.iinfo(np.int64).max), np.full((len(ids), POSITIVES), np.iinfo(np.int64).min)
    # 50 p <= 100 n and 100 n <= 95 p in whole numbers, without products that could run over
    least[at, slot] = s // 2 + s % 2
    most[at, slot] = s // 20 * 19 + s % 20 * 19 // 20
    one = {c: table.column(c).slice(0, 1) for c in ("dim", "home", "part")}
    return pa.table(one | {"b_ids": pa.array([ids.tobytes()], pa.binary()), "b_least": pa.array([least.tobytes()], pa.binary()), "b_most": pa.array([most.tobytes()], pa.binary())})


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor blocks of anchors that have a positive, with their bounds in the order of their ids."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            a, b = _array(r["a_ids"]), _array(r["b_ids"])
            mine = np.flatnonzero(np.isin(a, b))
            at = np.searchsorted(b, a[mine])
            rows = np.frombuffer(r["a_rows"], r["a_kind"]).reshape(len(a), r["dim"])[mine]
            least, most = (_array(r[c]).reshape(len(b), POSITIVES)[at].tobytes() for c in ("b_least", "b_most"))
            out.append({"dim": r["dim"], "a_home": r["a_home"], "a_ids": a[mine].tobytes(), "a_labels": _array(r["a_labels"])[mine].tobytes(), "a_kind": r["a_kind"], "a_rows": rows.tobytes(), "least": least, "most": most})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("dim", pa.int32()), ("a_home", pa.int64()), *((c, pa.string() if c == "a_kind" else pa.binary()) for c in ("a_ids", "a_labels", "a_kind", "a_rows", "least", "most"))]))


_ALIGNED = "dim int, a_home long, a_ids binary, a_labels binary, a_kind string, a_rows binary, least binary, most binary"


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first NEGATIVES negatives of each anchor and positive.

    rows: vec_id, label, v (array of long), as from labelled. is_anchor tells the anchors among them. An anchor's positives are the POSITIVES highest inner
    products among other ids of its label; its negatives, of other labels, score between a half and 95 % of the positive's. Ties go to the smaller vec_id.
    A row that stands twice counts twice, as a positive and as a negative; an anchor id that stands several times
    is asked once, with the least of its (label, v). Vectors of different lengths do not meet. An empty table gives no rows.
    """
    rows, n = counted(rows.select("vec_id", "label", "v", F.size("v").alias("dim")), "labelled")
    homes, labels = _homes(rows)
    placed = rows.join(sided(homes, labels), ["dim", "label"])
    anchors = placed.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim", "home")).alias("x")).select("vec_id", "x.*")
    data, parts, blocks = _blocks(placed, BLOCK, "data_blocks")
    asked, _, _ = _blocks(anchors, ANCHORS, "anchor_blocks")
    payload = [F.col(c).alias("a_" + c) for c in ("ids", "labels", "kind", "rows")]

    own = asked.select("dim", "home", F.col("part").alias("a_part"), *payload).join(sided(parts, blocks), ["dim", "home"])
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = data.join(own.hint("shuffle_merge"), ["dim", "home", "part"]).mapInArrow(_positives, "anchor_id long, positive_id long, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    positives = written(met.withColumn("slot", F.row_number().over(first)).where(F.col("slot") <= POSITIVES), "positives")

    members = asked.select("dim", "home", "part", "ids").mapInArrow(_members, "dim int, home long, part int, anchor_id long")
    bounds = positives.join(written(members, "anchors").hint("shuffle_merge"), "anchor_id").groupBy("dim", "home", "part").applyInArrow(_bounds, "dim int, home long, part int, b_ids binary, b_least binary, b_most binary")
    bounded = written(asked.select("dim", "home", "part", F.col("home").alias("a_home"), *payload).join(bounds.hint("shuffle_merge"), ["dim", "home", "part"]).mapInArrow(_aligned, _ALIGNED), "bounded")
    shards = F.lit(max(1, blocks))
    everywhere = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    dealt = data.withColumn("shard", F.pmod(F.xxhash64("dim", "home", "part"), shards).cast("int"))
    pairs = dealt.join(everywhere.hint("shuffle_merge"), ["dim", "shard"]).where((F.col("home") != F.col("a_home")) | (F.col("home") % 2 != 0))
    found = pairs.mapInArrow(_negatives, "anchor_id long, slot int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES), "negatives")
    out = ranked.join(positives.withColumnRenamed("score", "positive_score").hint("shuffle_merge"), ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = _array(r["ids"])
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["dim"], np.int32)), pa.array(np.full(n, r["home"], np.int64)), pa.array(np.full(n, r["part"], np.int32)), pa.array(ids)], names=["dim", "home", "part", "anchor_id"])
