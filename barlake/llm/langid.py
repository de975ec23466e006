"""Language identification by nearest centroid.

A text's letters are lower-cased and read as hashed byte n-grams (two and three bytes; anything but letters counts
as one space). Log counts weighted by inverse document frequency give a unit vector; each language has a few
centroids, found by spherical k-means over a bounded sample of its labelled rows. The language of the centroid with
the largest cosine wins; a text farther from it than its language's own rows ever are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.native import small
from barlake.llm.tables import bounded_sample, written
from barlake.llm.textops import ALNUM, text_slices

TRIGRAMS, BIGRAMS = 4096, 1024
DIM = TRIGRAMS + BIGRAMS
#: Most labelled rows a language is learned from, and its centroids.
SAMPLE, CENTROIDS = 256, 4
#: A text is rejected below this share of the smallest cosine among its language's own sampled rows.
REJECT = 0.3
UNKNOWN = "und"
#: Rows whose counts are held at once: 512 rows of 5,120 numbers are 20 MB.
ROWS = 512

_LETTERS = np.array([c if (ALNUM[c] and not 48 <= c <= 57) else 32 for c in range(256)], dtype=np.uint32)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray


def grams(rows: int, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, rows x DIM."""
    b = _LETTERS[buf]
    if not len(b):
        return np.zeros((rows, DIM), dtype=np.float32)
    pad = np.full(2, 32, dtype=np.uint32)
    one = np.concatenate([b, pad])
    edge = np.zeros(len(b) + 2, dtype=bool)
    edge[offsets] = True  # a text's n-grams don't reach into the next text
    second = np.where(edge[1 : len(b) + 1], 32, one[1 : len(b) + 1])
    third = np.where(edge[1 : len(b) + 1] | edge[2 : len(b) + 2], 32, one[2 : len(b) + 2])
    two = (b << 8) | second
    h3 = ((((two << 8) | third) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    h2 = ((two * np.uint32(2246822519)) >> np.uint32(22)).astype(np.int64) + TRIGRAMS
    doc = np.repeat(np.arange(rows) * DIM, np.diff(offsets))
    counts = np.bincount((doc + h3)[~((b == 32) & (second == 32))], minlength=rows * DIM)
    counts += np.bincount((doc + h2)[~((b == 32) & (second == 32))], minlength=rows * DIM)
    return counts.reshape(rows, DIM).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, rows, buf, offsets in text_slices(batch.column("text"), most=ROWS):
            x = grams(rows, buf, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(row, rows), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "counts"]
            )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, DIM)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        x = _matrix(batch.column("counts").to_pylist())
        total += (x > 0).sum(axis=0)
        seen += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(total, seen))], names=["i", "n"])


def _fit_language(idf: np.ndarray, centroids: int):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means, started from the first row and then the row farthest from those chosen."""
        x = unit(np.log1p(_matrix(frame.sort_values("counts")["counts"])) * idf)
        x = x[np.linalg.norm(x, axis=1) > 0.5]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        c = x.mean(axis=0, keepdims=True)
        while len(c) < min(centroids, len(x)):
            c = np.concatenate([c, x[[np.argmin((x @ unit(c).T).max(axis=1))]]])
        for _ in range(10):
            near = (x @ unit(c).T).argmax(axis=1)
            c = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        c = unit(c)
        least = float((x @ c.T).max(axis=1).min())
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centroid": [r.astype(np.float32).tobytes() for r in c], "least": least})

    return fit


def fit(rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from (text, lang, doc_id) rows, of which at most `sample` a language are used; nulls are left out.

    What reaches the driver is a few centroids a language.
    """
    known = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    keys = small(written(bounded_sample(known.select("doc_id", "lang"), "lang", "doc_id", sample), "sample"))
    chosen = known.select("doc_id", "lang", F.lower("text").alias("text")).join(keys, ["doc_id", "lang"], "left_semi")
    counts = written(chosen.mapInArrow(_count_batches, "lang string, counts binary"), "grams")
    df = {r["i"]: r["n"] for r in counts.mapInArrow(_frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    seen = np.array([df.get(i, 0) for i in range(DIM)])
    idf = (np.log((df.get(DIM, 0) + 1) / (seen + 1)) + 0.1).astype(np.float32)
    found = counts.groupBy("lang").applyInPandas(_fit_language(idf, centroids), "lang string, centroid binary, least double").orderBy("lang").collect()
    matrix = _matrix([r["centroid"] for r in found]) if found else np.zeros((0, DIM), dtype=np.float32)
    return Model(idf, matrix, [r["lang"] for r in found], np.array([r["least"] for r in found]))


def _predict(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            wordy = np.array(batch.column("_letters").fill_null(False).to_pylist(), dtype=bool)
            for row, rows, buf, offsets in text_slices(batch.column("text"), most=ROWS):
                best, score = np.full(rows, len(model.languages)), np.zeros(rows)
                if len(model.languages):
                    cosine = unit(np.log1p(grams(rows, buf, offsets)) * model.idf) @ model.centroids.T
                    best, score = cosine.argmax(axis=1), cosine.max(axis=1).astype(np.float64)
                ok = wordy[row : row + rows]
                best[~ok] = len(model.languages)
                score = np.clip(np.where(ok, score, 0.0), 0.0, 1.0)
                out = score < np.append(model.least * REJECT, 2.0)[best]
                kept = [batch.column(k).slice(row, rows) for k in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(score), pa.array(out)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return predict


def held_out() -> F.Column:
    """Rows that predictions are measured on and that nothing is learned from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs (doc_id, text, and lang to learn from).

    lang_pred is a learned language, or `und` where the text is null or has no letter, or nothing could be learned.
    score is the cosine, 0 to 1. rejected: `und`, or farther from every centroid than REJECT allows. Every whole
    text is read. Null doc_ids are kept and not learned from; other columns are ignored.
    """
    model = model or fit(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").rlike(r"\p{L}").alias("_letters"), F.lower("text").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def _keep(model: Model, names: list[str]):
    predict = _predict(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = pa.RecordBatch.from_arrays(
                [pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.bool_()), *(batch.column(n) for n in names)], names=["doc_id", "held_out", "_letters", "text"]
            )
            gone = pa.concat_arrays([x.column("rejected") for x in predict(iter([few]))]) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select([i for i, n in enumerate(batch.schema.names) if n not in names]).filter(pa.compute.invert(gone))

    return keep


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    model = model or fit(docs.where(~held_out()))
    tail = "_" * (1 + max(len(c) for c in docs.columns))  # no column of docs has these names
    names = ["letters" + tail, "lower" + tail]
    rows = docs.withColumns({names[0]: F.col("text").rlike(r"\p{L}"), names[1]: F.lower("text")})
    return rows.mapInArrow(_keep(model, names), docs.schema)
