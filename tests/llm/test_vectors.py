"""Neighbours by multi-index hashing, hard negatives and whitening against brute force, with odd rows among them."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import multi_index, negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, v string, x int"
ODD = [(7001, None, 1), (7002, [1.0, None, 0.5], 1), (7003, [float("nan")] * 3, 2), (7004, [float("inf"), 0.0, 0.0], 2), (None, [1.0, 2.0, 3.0], 1), (7005, [1.0, 2.0], 1), (7006, [], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "v", 8) for r in rows], SCHEMA)


def vectors(n, dim, seed, labels=3):
    rnd = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rnd.normal(size=dim) / 3], int(rnd.integers(labels))) for i in range(n)]


def live(rows):
    return [(i, tuple(e), label) for i, e, label in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]


# --- neighbours


def brute_neighbours(rows, k=20):
    rows = [(i, np.array(e)) for i, e, _ in live(rows) if any(e)]
    out = {}
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        x = np.array(min(tuple(e) for i, e in rows if i == q))
        out[q] = sorted(((-float((x * e).sum()), i) for i, e in rows if i != q and len(e) == len(x)))[:k]
    return out


def recall(got, want):
    """Share of the wanted places whose score is reached."""
    hit = all_ = 0
    for q, best in want.items():
        scores = [r.score for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        hit += sum(k < len(scores) and scores[k] >= -s - 1e-9 for k, (s, _) in enumerate(best))
        all_ += len(best)
    return hit / max(all_, 1)


@pytest.mark.parametrize("rows", [vectors(3000, 24, 1), vectors(1200, 200, 2), vectors(30, 3, 3) + ODD], ids=["plain", "long", "few"])
def test_neighbours_are_found(spark, rows):
    got = multi_index.nearest(multi_index.usable(frame(spark, rows)), F.col("vec_id") % 20 == 0).collect()
    want = brute_neighbours(rows)
    assert recall(got, want) >= 0.95 and {q: sum(r.query_id == q for r in got) for q in want} == {q: len(b) for q, b in want.items()}
    at = {i: np.array(e) for i, e, _ in live(rows)}
    assert all(r.score == pytest.approx(float(at[r.query_id] @ at[r.vec_id]), rel=1e-12, abs=1e-12) and r.query_id != r.vec_id for r in got)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_neighbours_of_copies_and_uneven_lengths(spark):
    """A third is one vector, another third near copies of it, one row stands three times, and lengths differ by powers of ten."""
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base], 0) for i in range(500)]
    rows += [(500 + i, [float(np.float32(x)) for x in base + rnd.normal(size=16) / 50], 0) for i in range(500)]
    rows += [(1000 + i, [float(np.float32(x)) for x in rnd.normal(size=16) * 10.0 ** rnd.integers(-3, 4)], 0) for i in range(500)]
    rows += [rows[1203]] * 2 + [(1020, [0.0] * 16, 0), (1040, [float(2**40)] * 16, 0)]
    got = multi_index.nearest(multi_index.usable(frame(spark, rows)), F.col("vec_id") % 20 == 0).collect()
    want = brute_neighbours(rows)
    assert recall(got, want) >= 0.95
    of_copy = sorted((r.rank, r.vec_id) for r in got if r.query_id == 20)
    best = [i for _, i in want[20]]
    assert [v for _, v in of_copy] == best  # ties among copies go to the smaller ids


def test_every_code_within_the_radius_is_retrieved_once():
    """The pigeonhole's reach, against all distances, for radii of all kinds."""
    rnd = np.random.default_rng(8)
    asked, codes = (rnd.integers(0, 1 << 16, size=(n, multi_index.M), dtype=np.uint16) for n in (40, 300))
    codes[:150] = asked[rnd.integers(40, size=150)] ^ (np.uint16(1) << rnd.integers(16, size=(150, multi_index.M), dtype=np.uint16)) * (rnd.random((150, multi_index.M)) < 0.5)
    far = multi_index.hamming(asked, codes)
    for r in (-1, 0, 1, 3, 7, 8, 9, 40, 61, 128):
        radius = np.full(40, r)
        times = np.zeros(far.shape, int)
        for j in range(multi_index.M):
            ok = np.bitwise_count(asked[:, j, None] ^ codes[None, :, j]) <= multi_index.reach(radius, j)[:, None]
            for i in range(j):
                ok &= np.bitwise_count(asked[:, i, None] ^ codes[None, :, i]) > multi_index.reach(radius, i)[:, None]
            times += ok
        assert times.max() <= 1 and (times[far <= r] == 1).all()


def test_neighbours_of_an_empty_table(spark):
    assert multi_index.nearest(multi_index.usable(frame(spark, [])), F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.nearest(multi_index.usable(frame(spark, ODD[:3])), F.col("vec_id") % 20 == 0).count() == 0


# --- hard negatives


def brute_negatives(rows):
    rows = [(i, [int(np.floor(256 * x)) for x in e], (label + 1) % 10 if i % 7 == 0 else label) for i, e, label in live(rows) if label is not None]
    out = []
    for q in sorted({i for i, _, _ in rows if i % 50 == 0}):
        own, x = min((label, e) for i, e, label in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(x, e)), i, label) for i, e, label in rows if i != q and len(e) == len(x))
        for s, p, _ in [t for t in scored if t[2] == own][:5]:
            ok = [(n, i) for n, i, label in scored if label != own and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(q, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize("block", [negatives.BLOCK, 40])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block):
    """One label holds most rows; ids and rows repeat; in small blocks labels lie in several, and blocks hold several labels."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = [(i, e, 5 if label < 2 else i % 9) for i, e, label in vectors(700, 6, 4)]
    rows += rows[10:13] * 3 + [(50, [0.25] * 6, 5), (50, [-0.25] * 6, 1), (100, [0.5] * 6, None), (3, [1e30] * 6, 1), (9000, [2.0**20] * 6, 3), (9050, [2.0**20] * 6, 4)] + ODD
    got = sorted(map(tuple, negatives.hard_negatives(negatives.labelled(frame(spark, rows)), F.col("vec_id") % 50 == 0).collect()))
    want = brute_negatives([r for r in rows if r[0] != 3 or r[1][0] < 1e20])
    assert got == want and len(want) > 50


def test_hard_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(negatives.labelled(frame(spark, [])), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(negatives.labelled(frame(spark, [(50, [1.0], 1)])), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("most", [1, 3, 120, 1000, 2**20, 2**27])
def test_packed_products_are_exact(most):
    rnd = np.random.default_rng(most)
    for n, m, d in ((1, 1, 1), (5, 7, 3), (40, 33, 64), (3, 1, 8), (0, 2, 4), (2, 2, 0)):
        x, y = rnd.integers(-most, most + 1, size=(n, d)), rnd.integers(-most, most + 1, size=(m, d))
        assert (negatives.products(x, y) == x @ y.T).all()
    edge = np.array(list(itertools.product((-most, most), repeat=3)))
    assert (negatives.products(edge, edge) == edge @ edge.T).all()


# --- whitening


def whitened(spark, rows):
    got = whitening.whiten(whitening.usable(frame(spark, rows))).collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in e] for _, e, _ in rows])
    return got, x


def test_whitening_matches_the_eigenvectors(spark):
    rnd = np.random.default_rng(3)
    turn = np.linalg.qr(rnd.normal(size=(12, 12)))[0]
    rows = [(i, [float(np.float32(c)) for c in (rnd.normal(size=12) * np.array([9, 5, 5, 3, 2, 1, 1, 1, 0.5, 0.2, 0.1, 0.1])) @ turn], 0) for i in range(800)]
    rows += [rows[5]] * 300
    got, x = whitened(spark, rows)
    n, c = len(x), x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    w = c @ axes / np.sqrt(values)
    assert len(got) == 8 * n and all(r.n == n and 0 <= r.identity_error < 1e-9 for r in got)
    by = {(r.vec_id, r.component): r for r in got}
    sign = {k: np.sign(by[0, k].whitened * w[0, k - 1]) for k in range(1, 9)}
    total = x.astype(object).sum(axis=0)
    for i, (vec_id, _, _) in enumerate(rows):
        for k in range(1, 9):
            r = by[vec_id, k]
            assert r.whitened == pytest.approx(sign[k] * w[i, k - 1], abs=1e-8) and r.explained == pytest.approx(values[k - 1] / np.trace(c.T @ c / n), rel=1e-9)
            assert r.deviation == ((n * x[i].astype(object) - total) ** 2).sum()


def test_whitening_of_odd_tables(spark):
    rows = vectors(60, 3, 9)
    got = whitening.whiten(whitening.usable(frame(spark, rows + ODD))).collect()
    assert {r.n for r in got} == {61} and sum(r.vec_id is None for r in got) == 3 and max(r.component for r in got) == 3
    assert whitening.whiten(whitening.usable(frame(spark, []))).count() == 0
    assert whitening.whiten(whitening.usable(frame(spark, [(1, [1.0, 2.0], 0)] * 5))).count() == 0
    assert whitening.whiten(whitening.usable(frame(spark, [(1, [], 0)]))).count() == 0
    line = whitening.whiten(whitening.usable(frame(spark, [(1, [0.0, 0.0], 0), (2, [3.0, 4.0], 0)]))).collect()
    assert sorted((r.component, abs(round(r.whitened, 9))) for r in line) == [(1, 1.0), (1, 1.0)]
    wide = whitening.whiten(whitening.usable(frame(spark, [(1, [float(2**41), 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.0], 0), (4, [float(2**45)] * 2, 0)]))).collect()
    assert {r.n for r in wide} == {3} and all(r.deviation is None for r in wide if r.vec_id == 1)


def decomposed(x):
    c = x - x.mean(axis=0)
    r = np.linalg.qr(np.vstack([c, np.zeros((x.shape[1], x.shape[1]))]), mode="r")
    return c, *whitening.directions(r, x.shape[1])


def special():
    rnd = np.random.default_rng(1)
    turn = np.linalg.qr(rnd.normal(size=(20, 20)))[0]
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 0.5) + np.diag(np.ones(20), 1)
    yield "equal values", np.vstack([turn, -turn])
    yield "clusters", np.vstack([m := np.linalg.qr(rnd.normal(size=(60, 20)))[0] * np.repeat([5, 4, 4, 3, 1.0], 4) @ turn, -m])
    yield "near clusters", np.vstack([m := np.linalg.qr(rnd.normal(size=(60, 20)))[0] * (np.repeat([5, 4, 4, 3, 1.0], 4) + 1e-10 * rnd.normal(size=20)) @ turn, -m])
    yield "pairs of near values", np.vstack([wilkinson, -wilkinson])
    yield "graded", rnd.normal(size=(90, 20)) * 10.0 ** -np.arange(20)
    yield "rank 3", rnd.normal(size=(90, 3)) @ rnd.normal(size=(3, 20))
    yield "constant columns", np.hstack([rnd.normal(size=(90, 6)), np.ones((90, 4))])
    for k in range(40):
        yield f"small {k}", rnd.integers(-2, 3, size=(rnd.integers(2, 30), rnd.integers(1, 12))).astype(float)


@pytest.mark.parametrize("name, x", list(special()), ids=lambda v: v if isinstance(v, str) else "")
def test_singular_values_and_directions(name, x):
    c, values, z = decomposed(x)
    want = np.append(np.linalg.svd(c, compute_uv=False) ** 2, np.zeros(x.shape[1]))
    top = max(float(want[0]), 1e-300)
    assert np.abs(values - want[: len(values)]).max(initial=0) <= 1e-12 * top and (want[len(values) :] <= 1e-12 * top).all()
    assert np.abs(z @ z.T - np.eye(len(z))).max(initial=0) < 1e-9
    assert all(np.abs(c.T @ (c @ v) - s * v).max() <= 1e-11 * top for s, v in zip(values, z, strict=True))


def test_qd_values_have_high_relative_accuracy():
    """A graded bidiagonal whose smallest value is far below the largest times the machine's precision."""
    d, f = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(1, 23, 2.0) * 1e-3
    got = whitening.dqds(d**2, f**2)
    from fractions import Fraction

    det = Fraction(1)
    for x in d:
        det *= Fraction(x) ** 2
    product = Fraction(1)
    for v in got:
        product *= Fraction(float(v))
    assert abs(float(product / det) - 1) < 1e-12 and list(got) == sorted(got, reverse=True)
