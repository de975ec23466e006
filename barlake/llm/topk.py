"""Exact top-k by inner product with a dual-tree search over one cover tree of queries and data.

The tree is grown on a bounded sample. A node's children are taken farthest first until every sampled row of the node lies
within half the node's radius of one of them, so covering radii halve from level to level; a node ends where about
LEAF rows of the table lie below it. Every row descends to the nearest child, level by level. Each node then gets its
true covering radius about its centre and its number of rows, for queries and data apart. Rows below one end are packed into leaves;
where an end holds many rows, as with one vector that stands very often, into several by the hash of id and vector.

Query leaves first meet the few data ends whose centres promise the highest products, which gives each query a kth score that
only rises and each query leaf its worst kth score. Then query and data nodes are paired from the root down, both sides going to
their children together; a pair goes on only if the two centres and covering radii allow an inner product
that reaches the worst kth score of the query node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.native import small
from barlake.llm.tables import written

K = 20
#: Rows of a leaf, about; rows that the tree is grown on; most children of a node; levels.
LEAF, SAMPLE, FAN, LEVELS = 256, 4096, 16, 12
#: Data rows that a query leaf meets first, as a multiple of k.
FIRST = 8
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def quantised(rows: DataFrame, column: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component. Null vectors or components, non-finite ones and null ids are left out."""
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    live = rows.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return live.select(F.col("vec_id").cast("long"), x.alias("v"))


@dataclass
class Tree:
    """Nodes in order of their levels, parents before children: dimension, parent (-1: a root), level, centre; `ends` have no children."""

    dim: list[int]
    parent: list[int]
    level: list[int]
    centre: list[np.ndarray]
    children: list[list[int]]

    def add(self, dim: int, parent: int, level: int, centre: np.ndarray) -> int:
        for column, value in ((self.dim, dim), (self.parent, parent), (self.level, level), (self.centre, centre), (self.children, [])):
            column.append(value)
        if parent >= 0:
            self.children[parent].append(len(self.dim) - 1)
        return len(self.dim) - 1

    def roots(self) -> dict[int, int]:
        return {d: k for k, (d, p) in enumerate(zip(self.dim, self.parent, strict=True)) if p < 0}


def _farthest_first(x: np.ndarray, n: int, within: float) -> np.ndarray:
    """Up to n rows of x, each the farthest from those before, until all rows lie within a distance of one."""
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > within**2:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def grow(sample: list, rows: int) -> Tree:
    """A tree for each dimension, grown until an end has about LEAF of `rows` rows, or its sampled rows are all one vector."""
    tree = Tree([], [], [], [], [])
    share = rows / max(len(sample), 1)
    for dim in sorted({len(v) for v in sample}):
        x = np.array([v for v in sample if len(v) == dim], dtype=np.float64)
        x = x.reshape(len(x), dim)
        front = [(tree.add(dim, -1, 0, x.mean(axis=0)), x)]
        while front:
            below = []
            for node, mine in front:
                radius = float(np.sqrt(((mine - tree.centre[node]) ** 2).sum(axis=1).max()))
                if len(mine) * share <= LEAF or tree.level[node] + 1 == LEVELS or len(mine) < 2 or radius == 0:
                    continue
                centres = _farthest_first(mine, FAN, radius / 2)
                if len(centres) < 2:
                    continue
                near = _nearest(mine, centres)
                for k in range(len(centres)):
                    if (near == k).any():
                        below.append((tree.add(dim, node, tree.level[node] + 1, centres[k]), mine[near == k]))
            front = below
    return tree


def _rows_by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, rows) of a batch's vectors `v`."""
    lists = batch.column("v")
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield int(dim), at, flat[start[at][:, None] + np.arange(dim)].astype(np.float64)


def _descend(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = tree.roots()
        for batch in batches:
            end, size = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows, np.int32)
            above = np.array([_above(tree, k) for k in range(len(tree.dim))], dtype=np.int32)
            for dim, at, x in _rows_by_dim(batch):
                size[at] = dim
                front = [(roots[dim], np.arange(len(at)))] if dim in roots else []
                while front:
                    node, mine = front.pop()
                    kids = tree.children[node]
                    if not kids:
                        end[at[mine]] = node
                        continue
                    near = _nearest(x[mine], np.stack([tree.centre[k] for k in kids]))
                    front += [(k, mine[near == i]) for i, k in enumerate(kids) if (near == i).any()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(size), pa.array(end), pa.array(above[end])], names=["vec_id", "v", "dim", "end", "top"])

    return run


def _covers(tree: Tree):
    """(node, radius, n) of a task's rows, for every node above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, n = np.zeros(len(tree.dim)), np.zeros(len(tree.dim), np.int64)
        for batch in batches:
            ends = batch.column("end").to_numpy()
            for _, at, x in _rows_by_dim(batch):
                for end in np.unique(ends[at]):
                    mine, node = x[ends[at] == end], int(end)
                    while node >= 0:
                        radius[node] = max(radius[node], np.sqrt(((mine - tree.centre[node]) ** 2).sum(axis=1)).max())
                        n[node] += len(mine)
                        node = tree.parent[node]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(radius[some]), pa.array(n[some])], names=["node", "radius", "n"])

    return run


def covers(tree: Tree, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Covering radius and number of rows of every node; nodes are no more than the sample's rows and their ancestors."""
    found = rows.select("v", "end").mapInArrow(_covers(tree), "node int, radius double, n long").groupBy("node").agg(F.max("radius"), F.sum("n")).collect()
    radius, n = np.zeros(len(tree.dim)), np.zeros(len(tree.dim), np.int64)
    for node, r, k in found:
        radius[node], n[node] = r, k
    return radius, n


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """A group of rows as one leaf: ids and components in the narrowest type, centre and radius."""
    frame = frame.sort_values("vec_id")
    dim = int(frame["dim"].iloc[0])
    x = np.stack([np.asarray(v, dtype=np.int64) for v in frame["v"]]) if dim else np.zeros((len(frame), 0), np.int64)
    most = int(np.abs(x).max()) if x.size else 0
    kind = next(k for k, t in enumerate(_KINDS) if most <= np.iinfo(t).max)
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) if x.size else 0.0
    one = {"dim": dim, "end": frame["end"].iloc[0], "top": frame["top"].iloc[0], "leaf": frame["leaf"].iloc[0], "ids": frame["vec_id"].to_numpy(np.int64).tobytes(), "kind": kind, "most": most, "rows": x.astype(_KINDS[kind]).tobytes()}
    return pd.DataFrame({k: [v] for k, v in (one | {"centre": centre.tolist(), "radius": radius}).items()})


_LEAF_SCHEMA = "dim int, end int, top int, leaf string, ids binary, kind int, most long, rows binary, centre array<double>, radius double"


def _leaves(rows: DataFrame, name: str) -> DataFrame:
    """One row a leaf. An end's rows are dealt by the hash of id and vector over as many leaves as its count asks for."""
    counts = small(written(rows.groupBy("end").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("parts")), "counts"))
    dealt = rows.join(counts, "end").withColumn("leaf", F.concat_ws("-", "end", F.pmod(F.xxhash64("vec_id", "v"), "parts")))
    return written(dealt.groupBy("leaf").applyInPandas(_pack, _LEAF_SCHEMA), name)


def _matrix(rows: bytes, kind: int, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(rows, dtype=_KINDS[kind]).reshape(n, dim)


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a data leaf for each query of a query leaf, without those below the query's kth score so far.

        Rows of the same id and score take one place.
        """
        for batch in batches:
            for r in batch.to_pylist():
                q, d = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["d_ids"], np.int64)
                x, y = _matrix(r["q_rows"], r["q_kind"], r["dim"], len(q)), _matrix(r["d_rows"], r["d_kind"], r["dim"], len(d))
                kind = np.float64 if r["q_most"] * r["d_most"] * max(r["dim"], 1) < 2**53 else np.int64
                score = (x.astype(kind) @ y.astype(kind).T).astype(np.int64)
                low = np.frombuffer(r["low"], np.int64) if r["low"] else np.full(len(q), np.iinfo(np.int64).min)
                ok = (score >= low[:, None]) & (q[:, None] != d[None, :])
                i, j = np.nonzero(ok)
                s = score[i, j]
                order = np.lexsort((d[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                new = np.append(True, (i[1:] != i[:-1]) | (s[1:] != s[:-1]) | (d[j[1:]] != d[j[:-1]]))[: len(i)]
                i, j, s = i[new], j[new], s[new]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, s = i[place < k], j[place < k], s[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["leaf"], dtype=object), pa.string()), pa.array(q[i]), pa.array(d[j]), pa.array(s)], names=["leaf", "query_id", "vec_id", "score"])

    return run


def _scores(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """pairs: leaf (of queries), d_leaf, low."""
    q = queries.select("leaf", "dim", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("most").alias("q_most"), F.col("rows").alias("q_rows"))
    d = data.select(F.col("leaf").alias("d_leaf"), F.col("ids").alias("d_ids"), F.col("kind").alias("d_kind"), F.col("most").alias("d_most"), F.col("rows").alias("d_rows"))
    met = pairs.join(q.hint("shuffle_merge"), "leaf").join(d.hint("shuffle_merge"), "d_leaf")
    return met.mapInArrow(_meet(k), "leaf string, query_id long, vec_id long, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scores.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def _can_reach(centre_d: str, radius_d: str) -> Column:
    """Whether rows within the radii about two centres can have an inner product of `worst` or more."""
    most = _dot(F.col("centre"), F.col(centre_d)) + F.col("radius") * _norm(F.col(centre_d)) + F.col(radius_d) * _norm(F.col("centre")) + F.col("radius") * F.col(radius_d)
    return F.col("worst").isNull() | (most * (1 + 1e-9) + 1e-6 >= F.col("worst"))


def _first_ends(tree: Tree, n: np.ndarray, least: int):
    """The data ends with the highest products of centres, until they have `least` rows, for each query leaf."""
    ends = {d: np.array([k for k in range(len(tree.dim)) if tree.dim[k] == d and not tree.children[k] and n[k]], dtype=np.int64) for d in set(tree.dim)}
    centres = {d: np.stack([tree.centre[k] for k in e]) if len(e) else np.zeros((0, d)) for d, e in ends.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, dim, centre in zip(*(batch.column(c).to_pylist() for c in ("leaf", "dim", "centre")), strict=True):
                order = ends[dim][np.argsort(-(centres[dim] @ np.asarray(centre)), kind="stable")]
                some = order[: int(np.searchsorted(np.cumsum(n[order]), least)) + 1]
                yield pa.RecordBatch.from_arrays([pa.array([leaf] * len(some), pa.string()), pa.array(some.astype(np.int32))], names=["leaf", "end"])

    return run


def _dual(tree: Tree, q_radius: np.ndarray, d_radius: np.ndarray, d_n: np.ndarray):
    """Pairs (end, d_end) that can reach the query end's worst kth score, for the query ends below one node of the first level."""
    centre, norm = tree.centre, np.array([float(np.sqrt((c**2).sum())) for c in tree.centre])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        worst = {}  # of query nodes: the least of the ends below
        for end, w in zip(frame["end"], frame["worst"], strict=True):
            node = int(end)
            while node >= 0:
                worst[node] = min(worst.get(node, np.inf), -np.inf if pd.isna(w) else float(w))
                node = tree.parent[node]
        root = tree.roots()[int(frame["dim"].iloc[0])]
        pairs, out = [(root, root)], []
        while pairs:
            q, d = (np.array(x) for x in zip(*pairs, strict=True))
            cq, cd = np.stack([centre[k] for k in q]), np.stack([centre[k] for k in d])
            most = (cq * cd).sum(axis=1) + q_radius[q] * norm[d] + d_radius[d] * norm[q] + q_radius[q] * d_radius[d]
            live = most + np.abs(most) * 1e-9 + 1e-6 >= np.array([worst[int(k)] for k in q])
            pairs = []
            for a, b in zip(q[live].tolist(), d[live].tolist(), strict=True):
                if not tree.children[a] and not tree.children[b]:
                    out.append((a, b))
                else:
                    pairs += [(x, y) for x in (tree.children[a] or [a]) if x in worst for y in (tree.children[b] or [b]) if d_n[y]]
        return pd.DataFrame(out, columns=["end", "d_end"], dtype="int32")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the other rows, ties to the smaller vec_id.

    vectors: vec_id, v (array of long). is_query tells the queries among them. Rows with a query's own vec_id are no
    candidates of it; rows that repeat a vec_id with the same score count once. Vectors of different
    lengths do not meet. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    vectors = written(vectors.select("vec_id", "v").distinct(), "vectors")
    n = vectors.count()
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    # a dimension that the sample lacks has a root of its own
    lengths = {len(v) for v in sample}
    sample += [[0] * r[0] for r in vectors.select(F.size("v")).distinct().collect() if r[0] not in lengths]
    tree = grow(sample, n)
    rows = written(vectors.mapInArrow(_descend(tree), "vec_id long, v array<long>, dim int, end int, top int"), "assigned")
    asked = rows.where(is_query)
    (d_radius, d_n), (q_radius, _) = covers(tree, rows), covers(tree, asked)
    data, queries = _leaves(rows, "data_leaves"), _leaves(asked, "query_leaves")
    d = data.select("end", F.col("leaf").alias("d_leaf"), F.col("centre").alias("d_centre"), F.col("radius").alias("d_radius"))

    # of an end with many leaves, a few that have rows enough
    few = d.where(F.element_at(F.split("d_leaf", "-"), 2).cast("int") <= FIRST * k // LEAF + 1).select("end", "d_leaf")
    own = queries.select("leaf", "dim", "centre").mapInArrow(_first_ends(tree, d_n, FIRST * k), "leaf string, end int")
    own = written(written(own, "first_ends").join(few.hint("shuffle_hash"), "end").select("leaf", "d_leaf"), "first_pairs")
    first = written(_best(_scores(own.withColumn("low", F.lit(None).cast("binary")), queries, data, k), k), "first_scores")

    # each query's kth score so far, in the order of its leaf's ids; the leaf's worst where all have k
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    asked = queries.select("leaf", "ids").mapInArrow(_unpack, "leaf string, place int, query_id long").join(kth.hint("shuffle_hash"), "query_id", "left")
    low = asked.groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("kth", F.lit(np.iinfo(np.int64).min).cast("long")).alias("kth")))).alias("kths"),
        F.when(F.count("kth") == F.count(F.lit(1)), F.min("kth")).alias("worst"),
    )
    low = written(low.mapInArrow(_lows, "leaf string, low binary, worst long"), "kth_scores")
    at = queries.select("leaf", "dim", "end", "top", "centre", "radius").join(low.hint("shuffle_hash"), "leaf")
    worst = F.when(F.count("worst") == F.count(F.lit(1)), F.min("worst")).alias("worst")
    ends = at.groupBy("dim", "top", "end").agg(worst).groupBy("dim", "top").applyInPandas(_dual(tree, q_radius, d_radius, d_n), "end int, d_end int")
    near = written(ends, "end_pairs").join(at.hint("shuffle_hash"), "end").drop("end").join(d.withColumnRenamed("end", "d_end").hint("shuffle_hash"), "d_end")
    pairs = near.where(_can_reach("d_centre", "d_radius")).select("leaf", "d_leaf", "low").join(own.hint("shuffle_hash"), ["leaf", "d_leaf"], "left_anti")
    rest = _scores(written(pairs, "pairs"), queries, data, k)
    scores = first.select("query_id", "vec_id", "score").unionByName(rest.select("query_id", "vec_id", "score"))
    return _best(scores, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _above(tree: Tree, node: int) -> int:
    """The node of the first level above a node, or the root itself."""
    while tree.level[node] > 1:
        node = tree.parent[node]
    return node


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for leaf, ids in zip(batch.column("leaf").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            q = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([leaf] * len(q), pa.string()), pa.array(np.arange(len(q), dtype=np.int32)), pa.array(q)], names=["leaf", "place", "query_id"])


def _lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lows = [np.array([x["kth"] for x in kths], dtype=np.int64).tobytes() for kths in batch.column("kths").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), pa.array(lows, pa.binary()), batch.column("worst")], names=["leaf", "low", "worst"])
