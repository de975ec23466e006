"""Top-k search, language ID, decontamination and quality on small fixtures."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import decontaminate, langid, quality, topk

SYLLABLES = {"aa": ["the", "ing", "ion", "ent", "and"], "bb": ["sch", "ung", "eit", "aß", "ein"], "cc": ["que", "eau", "oi", "é", "aux"]}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 15, 700])
def test_top_k_matches_brute_force(spark, n):
    rnd = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rnd.normal(size=8).round(1)]) for i in range(n)]
    rows += [(1000 + i, [1.0] * 8) for i in range(600 if n == 700 else 0)]  # one vector, very often
    if n == 700:
        rows += [(20_000, None), (20_020, [1.0, None] * 4), (20_040, [float("nan")] * 8), (None, [1.0] * 8), (20_060, [1e9] * 3), (20_080, [])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, rank int")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(topk.quantised(frame), F.col("vec_id") % 20 == 0).collect()}
    v = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[j])), j) for j in v if j != q and len(v[j]) == len(v[q]))
        want.update((q, k + 1, j, -s) for k, (s, j) in enumerate(scored[:20]))
    assert got == want


def languages(spark, n=240):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.randrange(20, 80)), lang) for i in range(n)]
    rows += [(9000, None, "aa"), (9001, "", "aa"), (9002, "123 !?", "bb"), (None, rows[0][1], rows[0][2]), (9003, rows[1][1], None), (9004, prose(rnd, "aa", 4000), "aa")]
    return rows, spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")


def test_languages_are_told_apart(spark):
    rows, docs = languages(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert all(got[i].lang_pred == truth[i] for i in range(240)) and got[9003].lang_pred == rows[1][2]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (9000, 9001, 9002))
    assert all(0 <= r.score <= 1 for r in got.values()) and any(r.held_out for r in got.values())
    assert len(got) == len(rows)


def test_rejected_languages_go_and_columns_stay(spark):
    _, docs = languages(spark)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9000, 9001, 9002}
    assert langid.identify(docs.limit(0)).count() == 0


def test_benchmark_items_are_found_and_clean_texts_left(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(8, 30))) + ". Then " + " ".join(word() for _ in range(6)) + ".") for k in range(40)]
    items += [(40, "What is " + " ".join(word() for _ in range(90)) + "? " + " ".join(word() for _ in range(70))), (41, None), (42, ""), (None, "no id")]
    rows, want = [], set()
    for d in range(80):
        words = [word() for _ in range(rnd.randrange(0, 300))]
        for k in rnd.sample(range(41), rnd.randrange(3)):
            words.insert(rnd.randrange(len(words) + 1), items[k][1].upper() if d % 2 else items[k][1])
            want.add((d, k))
        rows.append((d, " ".join(words)))
    # an inserted item may be torn by the next one; only whole ones count
    flat = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    whole = {(d, k) for d, k in want if flat(items[k][1]) in flat(rows[d][1])}
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, (500, None), (501, "")]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (decontaminate.INDEX_WORDS, 150):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, words).collect()}
        assert whole <= got <= want
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert kept == {d for d in [*range(80), 500, 501] if d not in {x for x, _ in got}}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def exhaustive(items, docs):
    """(doc, item) -> best score, by BM25 of every passage against every item, without an index."""
    flat = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    words = {k: flat(t) for k, t in items}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(t for w in words.values() for t in set(w))
    found = {}
    for k, w in words.items():
        impact = {t: math.log1p((len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in collections.Counter(w).items()}
        least = 0.5 * sum(impact.values()) * min(1.0, 64 / len(w))
        for d, text in docs:
            h = flat(text)
            for lo in range(0, len(h), 64):
                passage = set(h[lo : lo + 128])
                score = sum(x for t, x in impact.items() if t in passage)
                if score >= least - 1e-9 and score > found.get((d, k), 0):
                    found[d, k] = score
    return found


def test_block_max_wand_matches_exhaustive_bm25(spark):
    """Long documents of many passages, words that repeat, items of one word and of a thousand, repeated rows; no verification."""
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghijklmnopqrst") * min(rnd.choice((1, 1, 2, 3, 5)), 9)
    items = [(k, " ".join(word() for _ in range(rnd.randrange(3, 40)))) for k in range(150)] + [(500, "solo"), (501, " ".join(word() + str(rnd.randrange(40)) for _ in range(1000))), (502, "a a a a b")]
    docs = [(d, " ".join(word() for _ in range(rnd.choice((0, 5, 64, 65, 128, 700))))) for d in range(25)]
    docs += [(100, "solo " * 3), (101, " ".join(word() for _ in range(300)) + " " + items[-2][1]), (102, " ".join(word() for _ in range(5000)))]
    want = exhaustive(items, docs)
    bench = spark.createDataFrame([*items, items[3], items[4]], "item_id long, text string")
    frame = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    for words in (decontaminate.INDEX_WORDS, 900):
        got = decontaminate.contaminated(frame, bench, words, overlap=0.0).collect()
        assert len(want) > 50 and {(r.doc_id, r.item_id) for r in got} == set(want)
        assert all(abs(r.score - want[r.doc_id, r.item_id]) < 1e-6 for r in got)


def test_quality_orders_grades(spark):
    rnd = random.Random(6)
    rows = []
    for d in range(900):
        words = [rnd.choice("abcdefghij") * rnd.randrange(1, 9) for _ in range(rnd.randrange(10, 60))]
        g = rnd.choice([0, 1, 2, 2, 2])
        if g == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["vile", "nasty"])
        if g == 1:
            words = [w + "!!" for w in words]
        rows.append((d, " ".join(words), g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    labels = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "int(grade != 1) as quality", "int(grade = 0) as toxic")
    model = quality.fit(quality.graded(docs, labels))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in quality.rate(docs.unionByName(spark.createDataFrame([(5000, None, 0), (None, "x", 0)], docs.schema)), model).collect()}
    held = [r for r in rows if r[0] % 2]
    right = [got[d].selected == (g == 2) for d, _, g in held]
    assert sum(right) / len(right) > 0.95 and len(got) == 902
    mean = [sum(got[d].expected_grade for d, _, g in held if g == k) / sum(g == k for _, _, g in held) for k in range(3)]
    assert mean == sorted(mean)
    assert quality.rate(docs.limit(0), quality.fit(docs.limit(0))).count() == 0


def test_quality_keeps_the_priors_of_all_labels(spark):
    """Texts tell nothing here, so each grade's probability is its share of the labels, however few are sampled."""
    docs = spark.range(1000).selectExpr("id as doc_id", "'some words' as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 != 1) as quality", "int(doc_id % 10 = 0) as toxic")
    model = quality.fit_labels(docs, labels, sample=50)
    got = quality.rate(docs.limit(1), model).first()
    assert abs(got.p_good - 0.8) < 0.02 and abs(got.expected_grade - 1.7) < 0.03 and got.selected


def test_conflicting_and_repeated_labels(spark):
    """Of several labels of one document the lowest grade holds, however rows are ordered; extra columns clash with added names."""
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "y"), (1, 1, 0, "x"), (2, 0, 0, ""), (2, 1, 0, ""), (3, 1, 0, ""), (4, None, 1, ""), (None, 1, 0, "")], "doc_id long, quality int, toxic int, grade string")
    assert sorted((r.doc_id, r.grade) for r in quality._marks(labels).collect()) == [(1, 0), (2, 1), (3, 2)]
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (3, "long " * 40_000, 9), (3, None, 1)], "doc_id long, text string, selected int")
    got = quality.rate(docs, quality.fit_labels(docs, labels)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 3, 3] and all(0 <= r.p_good <= 1 for r in got)


def test_ratings_match_the_model_written_out(spark):
    """Scores of the distributed pass against sums of weights and the logistic function, text by text."""
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    model = quality.Model(rnd.normal(size=quality.DIM), np.array([-1.0, 0.5]))
    texts = ["", "one", "A WORD, a word!!", "é ß 12", "x " * 3000, "?!"]
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        part = next(quality.text_slices(pa.array([t])))
        score = sum(model.weights[k] for k in set(quality.features(*part)[1].tolist()))
        tail = [1 / (1 + math.exp(c - score)) if abs(c - score) < 35 else float(score > c) for c in model.thresholds]
        assert abs(got[i].p_good - tail[1]) < 1e-9 and abs(got[i].expected_grade - sum(tail)) < 1e-9 and got[i].selected == (tail[1] >= 0.5)


def test_languages_match_centroids_written_out(spark):
    """Predictions against cosines of n-gram counts kept in dictionaries; many short texts in one batch, and a very long one."""
    rows, docs = languages(spark, 120)
    model = langid.fit(docs.where("doc_id < 120"))
    texts = [r[1] for r in rows if r[1]] + ["a", "?", "Ab1c", "é " * 5000, *(f"ing {i} sch" for i in range(1500))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        b = [c if (c >= 128 or chr(c).isalpha()) else 32 for c in t.lower().encode()] + [32, 32]
        n = collections.Counter()
        for a, c, d in zip(b, b[1:], b[2:]):
            if not (a == 32 and c == 32):
                n[((((a << 8 | c) << 8 | d) * 2654435761) & 0xFFFFFFFF) >> 20] += 1
                n[langid.TRIGRAMS + (((a << 8 | c) * 2246822519 & 0xFFFFFFFF) >> 22)] += 1
        if not any(c.isalpha() for c in t):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        v = {k: math.log1p(x) * float(model.idf[k]) for k, x in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[k]) for k, x in v.items()) / size for c in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert abs(got[i].score - min(max(cosine[best], 0), 1)) < 1e-4
        assert got[i].lang_pred == model.languages[best] or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-4


def test_top_k_counts_repeated_rows_once(spark):
    """Every row twice, one row 30 times, and one id with 30 vectors of two scores."""
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.integers(-50, 50, size=4).tolist()) for i in range(60)]
    odd = [(61, [90, 90, 90, k % 2]) for k in range(30)] + [(62, [80, 80, k, -k]) for k in range(30)]
    rows += [(20, [60, 60, 60, 60]), (0, [1, 1, 1, 0]), (40, [1, 1, 1, 1])]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows * 2 + rows[7:8] * 30 + odd, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0).collect()}
    want = set()
    for q in (0, 20, 40):
        scored = {(-sum(a * b for a, b in zip(x, y)), j) for i, x in rows if i == q for j, y in rows + odd if j != q}
        want.update((q, k + 1, j, -s) for k, (s, j) in enumerate(sorted(scored)[:20]))
    assert got == want
