"""Quality by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= k) = logistic(threshold_k - score), with one score for all grades, the sum of the
weights of a text's hashed features, and thresholds in order. Features are words without case, runs of punctuation,
and shapes of words, each counted once a text. A bounded sample of rated rows is dealt into parts; in each round
every part improves the common weights on its own rows, and the parts' weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.tables import bounded_sample, written
from barlake.llm.textops import LOWER, PLAIN, Poly, mix, split_words, text_slices

BITS = 20
DIM = 1 << BITS
#: Most rated rows of each grade that the model is fitted on.
SAMPLE = 4000
PARTS, ROUNDS, EPOCHS, RATE, DECAY = 6, 4, 6, 0.5, 1e-4
#: A feature counts only if so many sampled rows have it and grades and feature depend on each other (chi-squared).
LEAST_ROWS, LEAST_CHI2 = 5, 25.0
#: Grade a text must reach to be selected, with a probability of at least TAIL.
GOOD, TAIL = 2, 0.5

_poly = Poly(41)
_ALPHA = np.array([(chr(c).isalnum() if c < 128 else True) for c in range(256)])
_SIGN = PLAIN & ~_ALPHA
_UPPER = np.array([65 <= c <= 90 for c in range(256)])


def _shapes(rows: int, doc: np.ndarray, key: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coarse sizes and shares of each text as features: tokens, distinct tokens, capitals, signs."""
    n = np.bincount(doc, minlength=rows)
    pairs = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16)))
    distinct = np.bincount((pairs[np.append(True, pairs[1:] != pairs[:-1])] >> np.uint64(48)).astype(np.int64), minlength=rows) if len(pairs) else n
    share = lambda table: np.diff(np.append(0, np.cumsum(table[buf]))[offsets]) / np.maximum(np.diff(offsets), 1)
    level = np.log2(n + 1).astype(np.int64)
    marks = [level, level * 16 + (distinct / np.maximum(n, 1) * 12).astype(np.int64), (share(_UPPER) * 20).astype(np.int64), (share(_SIGN) * 40).astype(np.int64)]
    each = [mix(m.astype(np.uint64) + np.uint64(1000 * (k + 1))) for k, m in enumerate(marks)]
    return np.tile(np.arange(rows), len(each)), np.concatenate(each)


def features(row: int, rows: int, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), distinct and sorted, of a slice of texts."""
    low = LOWER[buf]
    out_doc, out_key = [], []
    for table, tag in ((_ALPHA, 1), (_SIGN, 2)):
        w = split_words(row, rows, low, offsets, table)
        h = _poly.words(low, w.start, w.end)
        out_doc.append(w.doc)
        out_key.append(mix(h + np.uint64(tag)))
        if tag == 1 and len(w.start):
            upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
            shouted = (upper[w.end] - upper[w.start] == w.end - w.start) & (w.end - w.start > 2)
            out_doc.append(w.doc[shouted])
            out_key.append(np.full(int(shouted.sum()), 3, dtype=np.uint64))
    doc, key = np.concatenate(out_doc), np.concatenate(out_key)
    shape_doc, shape = _shapes(rows, doc, key, buf, offsets)
    doc, key = np.concatenate([doc, shape_doc]), np.concatenate([key, shape])
    both = np.sort(doc * DIM + (mix(key) >> np.uint64(64 - BITS)).astype(np.int64))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both // DIM, both % DIM


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def tails(model: Model, score: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 ..., rows x thresholds."""
    return _logistic(score[:, None] - model.thresholds[None, :])


def _scores(weights: np.ndarray, rows: int, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.bincount(doc, weights=weights[key], minlength=rows)


def improve(model: Model, grade: np.ndarray, doc: np.ndarray, key: np.ndarray, size: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Gradient steps scaled by each weight's past gradients, over batches of rows in a fixed order."""
    w, theta = model.weights.copy(), model.thresholds.copy()
    past, past_t = np.full(len(w), 1e-2), np.full(len(theta), 1e-2)
    n, batch = len(grade), 64
    ends = np.append(0, np.cumsum(size))
    order = np.argsort(mix(np.arange(n, dtype=np.uint64)))
    for _ in range(epochs):
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            at = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
            k, d = key[at], np.repeat(np.arange(len(rows)), size[rows])
            s, y = _scores(w, len(rows), d, k), grade[rows]
            up = np.append(theta, np.inf)[y] - s
            down = np.append(-np.inf, theta)[y] - s
            pu, pd_ = _logistic(up), _logistic(down)
            gu, gd = pu * (1 - pu), pd_ * (1 - pd_)
            gu[y == len(theta)] = 0
            gd[y == 0] = 0
            pu[y == len(theta)], pd_[y == 0] = 1, 0
            p = np.maximum(pu - pd_, 1e-9)
            ds = (gu - gd) / p / len(rows)  # of the loss by the score
            touched, k = np.unique(k, return_inverse=True)
            g = np.bincount(k, weights=ds[d], minlength=len(touched)) + DECAY * w[touched]
            past[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(past[touched])
            gt = np.zeros(len(theta))
            np.add.at(gt, y[y < len(theta)], -(gu / p)[y < len(theta)] / len(rows))
            np.add.at(gt, y[y > 0] - 1, (gd / p)[y > 0] / len(rows))
            past_t += gt * gt
            theta = np.sort(theta - RATE * gt / np.sqrt(past_t))
    return Model(w, theta)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch.column("text")):
            doc, key = features(*part)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part[1]))]).astype(np.int32)
            rest = [batch.column(c).slice(part[0], part[1]) for c in ("doc_id", "grade")]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(at), pa.array(key.astype(np.int32)))], names=["doc_id", "grade", "keys"])


def _arrays(frame: pd.DataFrame, allowed: np.ndarray):
    """Grades, and the numbers that the chosen features have among themselves, in the order of doc_id."""
    frame = frame.sort_values("doc_id")
    number = np.cumsum(allowed) - 1
    keys = [number[k[allowed[k]]] for k in map(np.asarray, frame["keys"])]
    size = np.array([len(k) for k in keys])
    return frame["grade"].to_numpy().astype(np.int64), np.repeat(np.arange(len(keys)), size), np.concatenate(keys).astype(np.int64), size


def _improve_part(model: Model, allowed: np.ndarray):
    def improve_part(frame: pd.DataFrame) -> pd.DataFrame:
        better = improve(Model(model.weights[allowed], model.thresholds), *_arrays(frame, allowed))
        weights = np.zeros(DIM)
        weights[allowed] = better.weights
        return pd.DataFrame({"n": [len(frame)], "weights": [weights.astype(np.float32).tobytes()], "thresholds": [better.thresholds.tolist()]})

    return improve_part


def fit(rated: DataFrame, grades: int = 3, sample: int = SAMPLE, counts: dict[int, int] | None = None) -> Model:
    """Fit on (doc_id, text, grade 0 ... grades-1) rows, at most `sample` of each grade.

    counts: how often each grade was given, where `rated` is a sample of the ratings; else `rated` is counted. The driver holds the weights alone: DIM numbers for each part and round. Without rated rows every score is 0.
    """
    rated = rated.select(F.col("doc_id").cast("long"), "text", F.col("grade").cast("int").alias("grade")).where("doc_id is not null and text is not null and grade is not null")
    keys = bounded_sample(rated.select("doc_id", "grade"), "grade", "doc_id", sample)
    rows = rated.join(F.broadcast(keys), ["doc_id", "grade"], "left_semi")
    rows = written(rows.mapInArrow(_feature_batches, "doc_id long, grade int, keys array<int>"), "features")
    size = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(size.values())
    seen = [F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(grades)]
    table = rows.select("grade", F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), *seen).where(F.col("n") >= LEAST_ROWS)
    chi2 = F.lit(0.0)
    for g, n in size.items():
        mean = F.col("n") * n / total
        chi2 += (F.col(f"n{g}") - mean) ** 2 / mean
    chosen = table.where(chi2 / F.greatest(1 - F.col("n") / max(total, 1), F.lit(1e-3)) >= LEAST_CHI2).select("k").collect()
    allowed = np.zeros(DIM, dtype=bool)
    allowed[[r["k"] for r in chosen]] = True
    model = Model(np.zeros(DIM), np.arange(grades - 1) - (grades - 2) / 2.0)
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for _ in range(ROUNDS):
        found = parts.groupBy("part").applyInPandas(_improve_part(model, allowed), "n long, weights binary, thresholds array<double>").collect()
        if not found:
            break
        found.sort(key=lambda r: (r["n"], r["weights"]))
        share = np.array([r["n"] for r in found]) / sum(r["n"] for r in found)
        model = Model(sum(s * np.frombuffer(r["weights"], np.float32).astype(np.float64) for s, r in zip(share, found, strict=True)), sum(s * np.array(r["thresholds"]) for s, r in zip(share, found, strict=True)))
    return _calibrated(model, rows, allowed, _counts(rated) if counts is None else counts, size)


def _counts(rated: DataFrame) -> dict[int, int]:
    return {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [float(model.weights[np.asarray(k, dtype=np.int64)].sum()) for k in batch.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(np.round(score, 1))], names=["grade", "score"])

    return run


def _calibrated(model: Model, rows: DataFrame, allowed: np.ndarray, counts: dict, size: dict) -> Model:
    """Thresholds set anew on the sample's scores, each grade weighed by its share of all rated rows."""
    found = rows.mapInArrow(_score_batches(model), "grade int, score double").groupBy("grade", "score").agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return model
    share = {g: n / max(size.get(g, 0), 1) for g, n in counts.items()}
    found.sort()
    y, s = np.array([r["grade"] for r in found]), np.array([r["score"] for r in found])
    w = np.array([r["n"] * share[r["grade"]] for r in found])
    theta = model.thresholds.copy()
    for k in range(len(theta)):
        for _ in range(50):  # Newton's method on a convex loss, kept from flying off by a weak pull to the start
            p = _logistic(theta[k] - s)
            gap = (w * (p - (y <= k))).sum() + (theta[k] - model.thresholds[k])
            theta[k] -= np.clip(gap / ((w * p * (1 - p)).sum() + 1.0), -1, 1)
    return Model(model.weights, np.sort(theta))


def _rate_batches(model: Model, good: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                doc, key = features(*part)
                tail = tails(model, _scores(model.weights, part[1], doc, key))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part[0], part[1]), pa.array(tail.sum(axis=1)), pa.array(tail[:, good - 1]), pa.array(tail[:, good - 1] >= TAIL)],
                    names=["doc_id", "expected_grade", "p_good", "selected"],
                )

    return run


def rate(docs: DataFrame, model: Model, good: int = GOOD) -> DataFrame:
    """(doc_id, expected_grade, p_good, selected) for every row: the mean grade, P(grade >= good), and whether that is TAIL or more.

    Every whole text is read; a null text counts as empty and gets the grade of no features. Other columns are ignored.
    """
    schema = "doc_id long, expected_grade double, p_good double, selected boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rate_batches(model, good), schema)


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, grade); of labels that differ for one doc_id the lowest grade holds."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def graded(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of the labelled documents: 0 toxic, 1 of low quality, 2 neither; labels with a null are left out, and of several
    labels of one doc_id the lowest grade holds.

    Of the labels a bounded sample is kept before they meet the texts, so they can be broadcast.
    """
    return docs.select("doc_id", "text").join(F.broadcast(bounded_sample(_marks(labels), "grade", "doc_id", sample)), "doc_id")


def fit_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a sample of the labelled documents, with each grade's share of all labels."""
    return fit(graded(docs, labels, sample), sample=sample, counts=_counts(_marks(labels)))
