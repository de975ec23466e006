"""Whitening of vectors by a singular value decomposition that never forms the covariance.

Blocks of centred rows are reduced to triangles by QR, in each task over its batches and then over tasks in rounds of FAN
triangles. The last triangle R, one row a dimension, has R'R = the sum of squares and products of all centred rows. It is brought to upper
bidiagonal form by Householder reflections; dqds finds its squared singular values one by one, each deflated at the bottom of the
qd array; twisted factorisations of the bidiagonal's LDL' give each wanted one's direction. Vectors of one cluster are
orthogonalised, by inverse iteration where a twisted vector has nothing new.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.tables import counted, written

#: Components, scale and offset of the contract; an entry of 2**52 or more after scaling takes its row out.
COMPONENTS, SCALE, OFFSET, LARGEST = 8, 1024, 100_000, 2**52
#: Bytes of triangles that one task reduces to one; rows that are reduced at a time.
FAN_BYTES, ROWS = 1 << 25, 4096
EPS = float(np.finfo(np.float64).eps)
_LONG = 2**63 - 1


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(SCALE * c) + OFFSET of every entry. Rows with a null vector or with null, non-finite or too large entries are left out."""
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * SCALE))
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE >= LARGEST))
    live = rows.where(F.col(column).isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return live.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _sums(d: int):
    """(i, high, low) of a task: the sum of x_i is high * 2**26 + low; neither part can run over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            high += (x >> 26).sum(axis=0)
            low += (x & (2**26 - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: int64 where it fits, else Python's integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if most < 2**62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where a sum does not fit into a long."""
    if dev.dtype != object and int(np.abs(dev).max(initial=0)) ** 2 * max(dev.shape[1], 1) <= _LONG:
        return (dev * dev).sum(axis=1).tolist()
    wide = dev.astype(object)
    return [s if s <= _LONG else None for s in (wide * wide).sum(axis=1)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(x, n, sums).astype(np.float64) / n


def _triangle(block: np.ndarray, d: int) -> np.ndarray:
    r = np.linalg.qr(block, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _reduced(n: int, sums: list[int]):
    """One triangle of all rows of a task."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for k in range(0, len(x), ROWS):
                block = _centred(x[k : k + ROWS], n, sums)
                r = _triangle(block if r is None else np.vstack([r, block]), d)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return run


def _merged(d: int):
    def run(table: pa.Table) -> pa.Table:
        stack = np.vstack([np.frombuffer(r, np.float64).reshape(d, d) for r in table.column("r").to_pylist()])
        return pa.table({"part": table.column("part").slice(0, 1), "r": pa.array([_triangle(stack, d).tobytes()], pa.binary())})

    return run


def triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows: d x d numbers, whatever the number of rows."""
    d = len(sums)
    fan = max(2, min(64, FAN_BYTES // (8 * d * d)))
    parts, left = counted(rows.select("x").mapInArrow(_reduced(n, sums), "part long, r binary"), "triangles")
    while left > 1:
        few = parts.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
        parts, left = counted(few.groupBy("part").applyInArrow(_merged(d), "part long, r binary"), "triangles")
    return np.frombuffer(parts.first()["r"], np.float64).reshape(d, d)


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, a): the reflection I - 2vv' turns x to (a, 0, ...); v is nil where x is so already."""
    size = float(np.abs(x).max(initial=0.0))
    v = np.zeros_like(x)
    if size == 0 or not x[1:].any():
        return v, float(x[0]) if len(x) else 0.0
    v = x / size
    norm = float(np.sqrt(v @ v))
    a = -norm if v[0] >= 0 else norm
    v[0] -= a
    return v / np.sqrt(v @ v), a * size


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of a square matrix; reflector k acts on the columns after k."""
    a, d = r.copy(), len(r)
    right = []
    for k in range(d):
        v, _ = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 1 < d:
            w, _ = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One dqds sweep: the qd array of the matrix less `shift`, and the quantities d; None if the shift was too large."""
    n = len(q)
    out, off, aux = np.empty(n), np.empty(n - 1), np.empty(n)
    d = float(q[0]) - shift
    for i in range(n - 1):
        if d < 0:
            return None
        aux[i] = d
        out[i] = d + e[i]
        if out[i] == 0:
            return None
        t = q[i + 1] / out[i]
        off[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    aux[-1] = out[-1] = d
    return out, off, aux


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of L'L for the qd array of squared diagonals q > 0 and squared off-diagonals e.

    Each step is a sweep without shift, whose d give a safe shift, 1 / sum(1 / d), and a sweep with it. An off-diagonal
    that no longer counts beside the shifts so far splits the array; one at the bottom leaves an eigenvalue.
    """
    found, todo = [], [(np.asarray(q, float), np.asarray(e, float), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while len(q):
            if len(q) == 1:
                found.append(moved + q[0])
                break
            small = e <= EPS**2 * (moved + np.minimum(q[:-1], q[1:]))
            if small[-1]:
                found.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            if small.any():
                k = int(np.flatnonzero(small)[-1])
                todo.append((q[: k + 1], e[:k], moved))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            step = _sweep(q, e, 0.0)
            if step is None:  # a pivot fell below the least number: what is left is nil beside the rest
                q = np.maximum(q, np.finfo(float).tiny / EPS)
                step = _sweep(q, e, 0.0)
            q, e, aux = step
            if aux.min() <= 0:
                q = np.maximum(q, np.finfo(float).tiny / EPS)
                continue
            shift = (1 - 8 * len(q) * EPS) / float((aux.min() / aux).sum()) * float(aux.min())
            if shift > EPS * moved and (step := _sweep(q, e, shift)) is not None:
                q, e, _ = step
                moved += shift
    return np.sort(np.array(found))[::-1]


def _factors(q: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(L+, U-, gamma) of the twisted factorisations of LDL' - value, D = q and L with `low` below its diagonal."""
    n, tiny = len(q), np.finfo(float).tiny / EPS
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0], p[-1] = -value, q[-1] - value
    for i in range(n - 1):
        pivot = s[i] + q[i] or -tiny
        down[i] = q[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        t = q[i] / (q[i] * low[i] * low[i] + p[i + 1] or -tiny)
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    return down, up, s + p + value


def _twisted(q: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """The eigenvector of LDL' at `value`, from the twist with the least gamma."""
    down, up, gamma = _factors(q, low, value)
    r = int(np.abs(gamma).argmin())
    z = np.zeros(len(q))
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, len(q) - 1):
        z[i + 1] = -up[i] * z[i]
    size = np.abs(z).max()
    z /= size
    return z / np.sqrt(z @ z)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def _iterated(q: np.ndarray, low: np.ndarray, value: float, others: list[np.ndarray], seed: int) -> np.ndarray:
    """A further eigenvector at `value`, orthogonal to the others: inverse iteration from a random start."""
    n = len(q)
    t = np.diag(q + np.append(0.0, q[:-1] * low * low)) + np.diag(q[:-1] * low, 1) + np.diag(q[:-1] * low, -1)
    z = _apart(np.random.default_rng(seed).normal(size=n), others)
    t[np.diag_indices(n)] -= value * (1 + 4 * EPS)
    for _ in range(4):
        z = np.linalg.lstsq(t, z / np.sqrt(z @ z), rcond=1e-18)[0]
        z = _apart(z / np.sqrt(z @ z), others)
    return z / np.sqrt(z @ z)


def directions(r: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as rows) of r, the k largest, without those that are nil beside the largest."""
    d = len(r)
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((0, d))
    diagonal, above, right = bidiagonalised(r / scale)
    most = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    diagonal = np.where(np.abs(diagonal) < 1e-30 * most, 1e-30 * most, diagonal)
    cut = [0, *(np.flatnonzero(np.abs(above) <= EPS * most) + 1).tolist(), d]
    all_values = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi > lo:
            q, low = diagonal[lo:hi] ** 2, above[lo : hi - 1] / diagonal[lo : hi - 1]
            all_values += [(float(v), lo, hi, q, low) for v in dqds(q, above[lo : hi - 1] ** 2)]
    all_values.sort(key=lambda x: (-x[0], x[1]))
    values, vectors, in_block = [], [], {}
    for value, lo, hi, q, low in all_values[:k]:
        if value <= (d * EPS) ** 2 * all_values[0][0]:
            break
        others = [z for v, z in in_block.get(lo, []) if abs(v - value) <= 1e-3 * v]
        z = _twisted(q, low, value)
        if others:
            rest = _apart(z, others)
            size = np.sqrt(rest @ rest)
            z = rest / size if size > 0.1 else _iterated(q, low, value, others, len(values))
        in_block.setdefault(lo, []).append((value, z))
        full = np.zeros(d)
        full[lo:hi] = z
        for j in range(len(right) - 1, -1, -1):
            full[j + 1 :] -= 2 * right[j] * (right[j] @ full[j + 1 :])
        full /= np.sqrt(full @ full)
        values.append(value * scale**2)
        vectors.append(full if full[np.abs(full).argmax()] > 0 else -full)
    return np.array(values), np.array(vectors).reshape(len(values), d)


@dataclass
class Model:
    """Rows, sums of x, eigenvalues of the covariance with their unit vectors as rows, and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.vectors.T / np.sqrt(self.values)


def fit(rows: DataFrame, n: int, d: int, k: int = COMPONENTS) -> Model:
    """rows: x, of d entries each, n of them."""
    parts = rows.select("x").mapInArrow(_sums(d), "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    by = {r["i"]: r["high"] * 2**26 + r["low"] for r in parts.collect()}  # one row a dimension
    sums = [by[i] for i in range(d)]
    r = triangle(rows, n, sums)
    values, vectors = directions(r, k)
    return Model(n, sums, values / n, vectors, float((r * r).sum()) / n)


def _moments(model: Model):
    """(i, j, product, one) of a task: sums of products of whitened components i and j, and of component i where j is 0."""
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.project(_matrix(batch.column("x"), d))
            total += w.T @ w
            one += w.sum(axis=0)
        i, j = np.indices((k, k)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel()), pa.array(np.where(j == 0, one[i], 0.0))], names=["i", "j", "product", "one"])

    return run


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k, n = len(model.values), model.n
    parts = rows.select("x").mapInArrow(_moments(model), "i int, j int, product double, one double").groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("one").alias("one"))
    product, mean = np.zeros((k, k)), np.zeros(k)
    for r in parts.collect():  # one row for each two components
        product[r["i"], r["j"]] = r["product"] / n
        mean[r["i"]] += r["one"] / n
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(model: Model, error: float):
    k, d = len(model.values), len(model.sums)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                m, x = part.num_rows, _matrix(part.column("x"), d)
                square = pa.array(_squares(_deviations(x, model.n, model.sums)), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(each), pa.array(number), pa.array(np.full(m * k, model.n)), square.take(each), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component up to k.

    vectors: vec_id, x (array of long), as from usable. Every row counts, repeated ones each time, also with a null vec_id. Vectors have the
    length that most rows have (of lengths as frequent, the least); others are left out. Components whose eigenvalue is nil beside the
    largest (relative to double precision) are not returned, so equal rows, a single row and an empty table give no rows. A deviation beyond a long is null.
    """
    rows = written(vectors.select("vec_id", "x"), "vectors")
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    if not top or top[0]["d"] == 0:
        return rows.sparkSession.createDataFrame([], _OUT)
    d, n = top[0]["d"], top[0]["n"]
    rows = rows.where(F.size("x") == d)
    model = fit(rows, n, d, k)
    return rows.mapInArrow(_whitened(model, identity_error(rows, model) if len(model.values) else 0.0), _OUT)
