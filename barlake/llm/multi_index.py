"""Approximate nearest neighbours by inner product: multi-index hashing of learned binary codes.

Each vector, scaled to length one, gets a code of BITS bits: signs beside rotations that are learned (iterative quantisation of the principal
components) on a bounded sample. A code is cut into M substrings, and an index for each substring holds every row's code under
the substring's cell (its first bits). By the pigeonhole principle a code within radius r of a query's has a substring
within r // M, or one less for the later ones, of the query's; so probing the cells within those radii retrieves
every code within r. A pair is retrieved at the first substring that qualifies, so once only. Its inner product is then taken from the vectors.

A first round probes a small radius and gives each query a kth score. Rows are grouped by the binary logarithm of their lengths, so that a score
bounds the cosine in each group; the second round's radius for a query and a group is the one within which, on the sample, all but
MISSED of the pairs of such a cosine lie. A query that found fewer than k rows meets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.native import sided
from barlake.llm.tables import counted, written

K = 20
#: Bits of a code, substrings of it, and bits of a substring that name its cell.
BITS, M, CELL_BITS = 128, 8, 6
WIDTH = BITS // M
#: Rows that the rotation is learned on, of which some are the sample's queries; turns of learning; share of near pairs that the radius may miss.
SAMPLE, ASKED, TURNS, MISSED = 4096, 256, 30, 0.01
#: Rows of a block of vectors, of a block of queries; blocks of vectors that an index block covers; rows that the first round should find, times k.
HOME, QUERIES, SPAN, FIRST = 2048, 256, 32, 8
#: Steps of the cosine in which radii are held.
STEPS = 40
#: Entries of an index block, and pairs, that are compared at a time.
CHUNK = 8192


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): components as double. Null ids, null or zero vectors and null or non-finite components are left out."""
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    some = F.exists(F.col(column), lambda c: c != 0)
    live = rows.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return live.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda c: c.cast("double")).alias("v"))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also of very small and very large components."""
    most = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


@dataclass
class Coder:
    """Hyperplanes of one dimension; `radius[i]` holds for cosines from -1 + 2 i / STEPS on; `first` is the first round's radius."""

    centre: np.ndarray
    planes: np.ndarray
    radius: np.ndarray
    first: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """M substrings of WIDTH bits a row."""
        unit = x / lengths(x)[:, None]
        return np.packbits((unit - self.centre) @ self.planes > 0, axis=1).view(np.uint16).reshape(len(x), M)

    def radii(self, cosine: np.ndarray) -> np.ndarray:
        """Radius for pairs of at least this cosine; -1 where no pair can have it."""
        step = np.clip(np.floor((np.clip(cosine, -1, 1) + 1) * STEPS / 2), 0, STEPS - 1).astype(int)
        return np.where(cosine > 1 + 1e-9, -1, self.radius[step])


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all codes of a to all codes of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(np.ascontiguousarray(a).view(np.uint64).T, np.ascontiguousarray(b).view(np.uint64).T, strict=True):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


def learn(x: np.ndarray, rows: int, k: int = K) -> Coder:
    """The coder of a sample x of `rows` rows of one dimension, deterministic for one sample."""
    d = x.shape[1]
    unit = x / lengths(x)[:, None] if len(x) else x
    centre = unit.mean(axis=0) if len(x) else np.zeros(d)
    axes = np.linalg.eigh((unit - centre).T @ (unit - centre))[1][:, ::-1][:, : min(d, BITS)] if len(x) else np.eye(d)[:, : min(d, BITS)]
    v, rnd, planes = (unit - centre) @ axes, np.random.default_rng(d), []
    while sum(p.shape[1] for p in planes) < BITS:
        turn = np.linalg.qr(rnd.normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(TURNS if len(x) else 0):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        planes.append(axes @ turn)
    coder = Coder(centre, np.hstack(planes)[:, :BITS], np.full(STEPS, BITS), BITS)
    if len(x) < 2:
        return coder
    # what the sample's pairs say of cosine and distance
    asked = unit[:ASKED]
    near, cosine = hamming(coder.codes(asked), coder.codes(unit)), asked @ unit.T
    own = np.arange(len(asked))
    others = np.ones(near.shape, bool)
    others[own, own] = False
    step = np.clip(np.floor((np.clip(cosine, -1, 1) + 1) * STEPS / 2), 0, STEPS - 1).astype(int)
    last = BITS
    for i in range(STEPS):
        mine = near[others & (step == i)]
        last = int(np.quantile(mine, 1 - MISSED, method="higher")) if len(mine) >= 50 else last
        coder.radius[i] = last
    coder.radius = np.maximum.accumulate(coder.radius[::-1])[::-1]
    want, each = FIRST * k / rows, len(x) - 1
    if want * each >= 4:
        mine = np.sort(np.where(others, near, BITS), axis=1)[:, min(each - 1, int(np.ceil(want * each)))]
    else:  # too rare for the sample: by the normal distribution of its distances
        spread = NormalDist().inv_cdf(want)
        mine = np.floor([row[o].mean() + spread * row[o].std() for row, o in zip(near, others, strict=True)])
    coder.first = int(max(0, np.quantile(mine, 0.9, method="higher")))
    return coder


def _rows_by_dim(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield int(dim), at, flat[start[at][:, None] + np.arange(dim)]


def _coded(coders: dict[int, Coder]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dim, g, norm, code = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros((n, M), np.uint16)
            for d, at, x in _rows_by_dim(batch.column("v")):
                dim[at], norm[at], code[at] = d, lengths(x), coders[d].codes(x)
            g = np.rint(np.log2(norm)).astype(np.int32)
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(dim), pa.array(g), pa.array(norm), codes], names=["vec_id", "v", "dim", "g", "norm", "code"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    """A block of vectors as one row."""
    table = table.combine_chunks()
    flat = table.column("v").combine_chunks().flatten().to_numpy()
    one = {c: table.column(c).slice(0, 1) for c in ("dim", "g", "part")}
    binary = lambda x: pa.array([x], pa.binary())
    more = {"ids": binary(table.column("vec_id").to_numpy().tobytes()), "norms": binary(table.column("norm").to_numpy().tobytes()), "codes": binary(b"".join(table.column("code").to_pylist())), "rows": binary(flat.tobytes())}
    return pa.table(one | more)


_BLOCK = "dim int, g int, part int, ids binary, norms binary, codes binary, rows binary"


def _blocks(coded: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of one dimension and group dealt over blocks of about `size`, whatever is alike in them."""
    parts, n = counted(coded.groupBy("dim", "g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    dealt = coded.join(sided(parts, n), ["dim", "g"]).withColumn("part", part)
    return written(dealt.groupBy("dim", "g", "part").applyInArrow(_packed, _BLOCK), name)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index entries of a block of vectors, one row for each substring and cell that has some."""
    for batch in batches:
        for r in batch.to_pylist():
            codes = np.frombuffer(r["codes"], np.uint16).reshape(-1, M)
            out = []
            for j in range(M):
                cell = codes[:, j] >> (WIDTH - CELL_BITS)
                order = np.argsort(cell, kind="stable")
                for c, at in zip(*_runs(cell[order], order), strict=True):
                    out.append({"dim": r["dim"], "g": r["g"], "j": j, "cell": int(c), "span": r["part"] // SPAN, "part": r["part"], "places": at.astype(np.uint16).tobytes(), "codes": codes[at].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=_ENTRY)


_ENTRY = pa.schema([*((c, pa.int32()) for c in ("dim", "g", "j", "cell", "span", "part")), ("places", pa.binary()), ("codes", pa.binary())])


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each key of a sorted array, with its values."""
    some, start = np.unique(keys, return_index=True)
    return some, np.split(values, start[1:])


def _index_block(table: pa.Table) -> pa.Table:
    places, codes = table.column("places").to_pylist(), table.column("codes").to_pylist()
    parts = np.repeat(table.column("part").to_numpy(), [len(p) // 2 for p in places]).astype(np.int32)
    one = {c: table.column(c).slice(0, 1) for c in ("dim", "g", "j", "cell")}
    return pa.table(one | {"parts": pa.array([parts.tobytes()], pa.binary()), "places": pa.array([b"".join(places)], pa.binary()), "codes": pa.array([b"".join(codes)], pa.binary())})


def index(blocks: DataFrame) -> DataFrame:
    """Index blocks by dimension, group, substring and cell; one covers SPAN blocks of vectors, so it is bounded where all codes are alike."""
    entries = blocks.select("dim", "g", "part", "codes").mapInArrow(_entries, "dim int, g int, j int, cell int, span int, part int, places binary, codes binary")
    merged = entries.groupBy("dim", "g", "j", "cell", "span").applyInArrow(_index_block, "dim int, g int, j int, cell int, parts binary, places binary, codes binary")
    return written(merged, "index")


def reach(radius: np.ndarray, j: int) -> np.ndarray:
    """How near substring j has to be: of r = a M + c, a for the first c + 1 substrings and a - 1 for the others."""
    return np.where(radius < 0, -1, radius // M - (j > radius % M))


def _probe(coders: dict[int, Coder], groups: dict[int, dict[int, float]], again: bool):
    """The cells that a block of queries probes, each with the queries' places, codes and radii; in the second round also the first one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.arange(1 << CELL_BITS, dtype=np.uint16)
        for batch in batches:
            for r in batch.to_pylist():
                codes, norms, coder = np.frombuffer(r["codes"], np.uint16).reshape(-1, M), np.frombuffer(r["norms"], np.float64), coders[r["dim"]]
                low = np.frombuffer(r["low"], np.float64) if again and r["low"] else np.full(len(codes), -np.inf)
                for g, most in groups[r["dim"]].items():
                    radius = np.full(len(codes), coder.first)
                    if again:
                        radius = np.where(np.isneginf(low), BITS, coder.radii(np.where(np.isneginf(low), -1, low) / norms / most))
                    out = []
                    for j in range(M):
                        near = np.bitwise_count(cells[:, None] ^ (codes[:, j] >> (WIDTH - CELL_BITS))[None, :]) <= reach(radius, j)[None, :]
                        for c in np.flatnonzero(near.any(axis=1)):
                            at = np.flatnonzero(near[c])
                            out.append({"dim": r["dim"], "g": g, "j": j, "cell": int(c), "q_part": r["part"], "q_places": at.astype(np.uint16).tobytes(), "q_codes": codes[at].tobytes(), "radii": radius[at].astype(np.int16).tobytes(), "seen": coder.first if again else -1})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=_PROBES)

    return run


_PROBES = pa.schema([*((c, pa.int32()) for c in ("dim", "g", "j", "cell", "q_part")), ("q_places", pa.binary()), ("q_codes", pa.binary()), ("radii", pa.binary()), ("seen", pa.int32())])
_PROBE = "dim int, g int, j int, cell int, q_part int, q_places binary, q_codes binary, radii binary, seen int"


def _retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of places of an index block's codes within the queries' radii, by block of vectors; not those of an earlier substring or round."""
    for batch in batches:
        for r in batch.to_pylist():
            j, q_places = r["j"], np.frombuffer(r["q_places"], np.uint16).astype(np.uint32)
            asked, radius = np.frombuffer(r["q_codes"], np.uint16).reshape(-1, M), np.frombuffer(r["radii"], np.int16)
            codes, places = np.frombuffer(r["codes"], np.uint16).reshape(-1, M), np.frombuffer(r["places"], np.uint16).astype(np.uint32)
            parts, found = np.frombuffer(r["parts"], np.int32), []
            for lo in range(0, len(codes), CHUNK):
                some = codes[lo : lo + CHUNK]
                ok = np.bitwise_count(asked[:, j, None] ^ some[None, :, j]) <= reach(radius, j)[:, None]
                for i in range(j):
                    ok &= np.bitwise_count(asked[:, i, None] ^ some[None, :, i]) > reach(radius, i)[:, None]
                q, d = np.nonzero(ok)
                if len(q):
                    far = sum(np.bitwise_count(x[q] ^ y[d]).astype(np.int16) for x, y in zip(np.ascontiguousarray(asked).view(np.uint64).T, np.ascontiguousarray(some).view(np.uint64).T, strict=True))
                    near = (far <= radius[q]) & (far > r["seen"])
                    found.append((parts[lo + d[near]], q_places[q[near]] << np.uint32(16) | places[lo + d[near]]))
            if found:
                part, pair = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(part, kind="stable")
                some, pairs = _runs(part[order], pair[order])
                if len(some):
                    rows = [{"dim": r["dim"], "g": r["g"], "part": int(p), "q_part": r["q_part"], "pairs": x.tobytes()} for p, x in zip(some, pairs, strict=True)]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*((c, pa.int32()) for c in ("dim", "g", "part", "q_part")), ("pairs", pa.binary())]))


def _rerank(k: int):
    """The k best of a block of vectors for each query of a block, of the retrieved pairs; in the second round those that reach the first's kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                x, y = (np.frombuffer(r[c]).reshape(-1, r["dim"]) for c in ("q_rows", "rows"))
                pairs = np.frombuffer(b"".join(r["pairs"]), np.uint32)
                q, d = (pairs >> np.uint32(16)).astype(np.int64), (pairs & np.uint32(0xFFFF)).astype(np.int64)
                other = asked[q] != ids[d]
                q, d = q[other], d[other]
                score = np.concatenate([np.zeros(0), *((x[q[i : i + CHUNK]] * y[d[i : i + CHUNK]]).sum(axis=1) for i in range(0, len(q), CHUNK))])
                if r["low"]:
                    high = score >= np.frombuffer(r["low"], np.float64)[q]
                    q, d, score = q[high], d[high], score[high]
                order = np.lexsort((ids[d], -score, q))
                some = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["dim"], np.int32)), pa.array(np.full(n, r["q_part"], np.int32)), pa.array(q[some].astype(np.int32)), pa.array(asked[q[some]]), pa.array(ids[d[some]]), pa.array(score[some])], names=["dim", "q_part", "place", "query_id", "vec_id", "score"])

    return run


_SCORES = "dim int, q_part int, place int, query_id long, vec_id long, score double"


def _searched(asked: DataFrame, blocks: DataFrame, codes: DataFrame, probe, k: int) -> DataFrame:
    """Scores of what the probes of blocks of queries retrieve; asked has `low`, the scores to reach."""
    probes = written(asked.mapInArrow(probe, _PROBE), "probes")
    met = codes.join(probes.hint("shuffle_merge"), ["dim", "g", "j", "cell"]).mapInArrow(_retrieve, "dim int, g int, part int, q_part int, pairs binary")
    # pairs of two blocks are at most HOME * QUERIES, each retrieved once
    pairs = written(met.groupBy("dim", "g", "part", "q_part").agg(F.collect_list("pairs").alias("pairs")), "retrieved")
    q = asked.select("dim", F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), "low")
    both = pairs.join(q.hint("shuffle_merge"), ["dim", "q_part"]).join(blocks.select("dim", "g", "part", "ids", "rows").hint("shuffle_merge"), ["dim", "g", "part"])
    return both.mapInArrow(_rerank(k), _SCORES)


def _best(scores: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, part, low): kth scores in the order of a block's queries, -inf where fewer were found."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            low = np.full(len(r["ids"]) // 8, -np.inf)
            for x in r["found"] or []:
                low[x["place"]] = x["score"]
            out.append({"dim": r["dim"], "part": r["part"], "low": low.tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("low", pa.binary())]))


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query up to k of the rows with the highest inner products, ties to the smaller vec_id.

    vectors: vec_id, v (array of double), as from usable; is_query tells the queries among them. Rows with a query's own vec_id are no candidates
    of it; a row that stands twice counts twice, and a query id that stands several times is asked once, with the least of its vectors.
    Vectors of different lengths do not meet. Scores are exact; a neighbour may be missed where its code lies beyond the
    radius (about MISSED of those at the kth score). With fewer than k candidates all are returned; an empty table gives no rows.
    """
    vectors = written(vectors.select("vec_id", "v"), "vectors")
    counts = {r["d"]: r["n"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [np.array(r["v"]) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()]
    coders = {d: learn(np.array([v for v in sample if len(v) == d]).reshape(-1, d), n, k) for d, n in counts.items()}
    coded = written(vectors.mapInArrow(_coded(coders), "vec_id long, v array<double>, dim int, g int, norm double, code binary"), "coded")
    groups: dict[int, dict[int, float]] = {}
    for r in coded.groupBy("dim", "g").agg(F.max("norm").alias("most")).collect():  # a row for each binary logarithm of a length
        groups.setdefault(r["dim"], {})[r["g"]] = r["most"]
    blocks = _blocks(coded, HOME, "vector_blocks")
    codes = index(blocks)
    once = coded.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm", "code")).alias("x")).select("vec_id", "x.*", F.lit(0).alias("g"))
    asked = _blocks(once, QUERIES, "query_blocks").drop("g")
    first = _searched(asked.withColumn("low", F.lit(None).cast("binary")), blocks, codes, _probe(coders, groups, False), k)
    first = written(_best(first, k), "first")
    kth = first.where(F.col("rank") == k).groupBy("dim", F.col("q_part").alias("part")).agg(F.collect_list(F.struct("place", "score")).alias("found"))
    low = asked.select("dim", "part", "ids").join(kth.hint("shuffle_merge"), ["dim", "part"], "left").mapInArrow(_lows, "dim int, part int, low binary")
    asked = asked.join(written(low, "lows").hint("shuffle_merge"), ["dim", "part"])
    rest = _searched(asked, blocks, codes, _probe(coders, groups, True), k)
    found = first.select("query_id", "vec_id", "score").unionByName(rest.select("query_id", "vec_id", "score"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
