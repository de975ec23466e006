"""Near-duplicates, substrings and lines against brute force on small fixtures, with odd rows among them."""

import collections
import functools
import hashlib
import itertools
import random
import re

import pytest

from barlake.llm import bagminhash, line_chunks, recompress

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, th string, size int"


def texts():
    rnd = random.Random(5)
    pool = [[rnd.choice(["a", "b", "é"]) for _ in range(120)] for _ in range(3)] + [["x"] * 130, ["p", "q"] * 60, ["p", "q", "r"] * 40]
    pool += [[str(rnd.randrange(50)) for _ in range(rnd.randrange(40, 150))] for _ in range(12)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            p = rnd.choice(pool)
            i = rnd.randrange(len(p))
            parts += p[i : i + rnd.randrange(1, 120)] + [str(rnd.randrange(1000)) for _ in range(rnd.randrange(0, 30))]
        rows.append((d, " \n".join(parts)))
    base = [str(rnd.randrange(10**6)) for _ in range(200)]
    for d in range(120, 150):  # near copies
        near = base[:]
        for _ in range(rnd.randrange(0, 6)):
            near[rnd.randrange(200)] = str(rnd.randrange(10**6))
        rows.append((d, " ".join(near)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "one"), (204, "  \t"), (205, " ".join(base * 40)), (206, " ".join(base))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "z", 1) for d, t in rows], SCHEMA)


def brute_windows(rows):
    first, words = {}, {}
    for d, t in rows:
        w = words[d] = WORD.findall(t or "")
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_match_brute_force(spark):
    rows = texts()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.dedup_digests(frame(spark, rows)).collect()}
    assert got == brute_windows(rows)


def test_substrings_with_null_and_repeated_ids(spark):
    w = " ".join(map(str, range(60)))
    got = recompress.dedup_digests(frame(spark, [(None, w), (3, w), (3, w), (5, w), (5, "a b")])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in got) == [(-1, 60, 0), (3, 60, 0), (3, 60, 0), (5, 2, 0), (5, 60, 60)]


def test_substrings_of_an_empty_table(spark):
    assert recompress.dedup_digests(frame(spark, [])).count() == 0


@functools.cache
def brute_classes(rows):
    bags = {}
    for d, t in rows:
        if w := WORD.findall(t or ""):
            bags[d] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        both = sum((bags[a] & bags[b]).values())
        if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize(
    "turns, block, shingles", [(bagminhash.TURNS, bagminhash.BLOCK, bagminhash.SHINGLES), (0, 4, bagminhash.SHINGLES), (1, 9, bagminhash.SHINGLES), (0, bagminhash.BLOCK, 900)]
)
def test_near_duplicates_match_brute_force(spark, monkeypatch, turns, block, shingles):
    """Groups in one block, and in many small ones without or after a turn with drawn members."""
    monkeypatch.setattr(bagminhash, "TURNS", turns)
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    monkeypatch.setattr(bagminhash, "SHINGLES", shingles)
    rows = texts()
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(tuple(rows))


def test_near_duplicates_of_odd_rows(spark):
    got = bagminhash.near_duplicates(frame(spark, [(None, "a b"), (7, "a b"), (7, "a b"), (9, "a b"), (11, None)])).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in got) == [(-1, -1), (7, 7), (7, 7), (9, 7), (11, 11)]
    assert bagminhash.near_duplicates(frame(spark, [])).count() == 0
    kept = bagminhash.keep_one(frame(spark, [(None, "a b"), (7, "a b"), (9, "a b")]))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 7] and kept.columns == ["doc_id", "text", "th", "size"]


def test_signatures_estimate_weighted_jaccard_and_do_not_depend_on_slices():
    import numpy as np
    import pyarrow as pa

    from barlake.llm.textops import word_slices

    a = " ".join(str(i % 97) for i in range(400))
    b = " ".join(str(i % 97) for i in range(330)) + " z" * 70
    column = pa.array([a, b])
    grid = bagminhash.signatures(2, *bagminhash.bags(next(word_slices(column))), size=4096)
    ca, cb = (collections.Counter(tuple(x.split()[i : i + 5]) for i in range(396)) for x in (a, b))
    assert abs((grid[0] == grid[1]).mean() - sum((ca & cb).values()) / sum((ca | cb).values())) < 0.03
    alone = np.concatenate([bagminhash.signatures(w.rows, *bagminhash.bags(w), size=4096) for w in word_slices(column, limit=10)])
    assert (alone == grid).all()


@pytest.mark.parametrize("dense", [2, 5, 1000])
def test_intersections_of_multisets(monkeypatch, dense):
    import numpy as np

    monkeypatch.setattr(bagminhash, "DENSE", dense)
    rnd = np.random.default_rng(dense)
    table = rnd.integers(0, 4, size=(30, 50)) * (rnd.random((30, 50)) < 0.3)
    doc, name = np.nonzero(table)
    got = bagminhash._intersections(30, doc, name.astype(np.uint64), table[doc, name])
    want = np.minimum(table[:, None, :], table[None, :, :]).sum(axis=2)
    np.fill_diagonal(got, 0), np.fill_diagonal(want, 0)
    assert (got == want).all()


def brute_lines(rows):
    cuts, first = {}, {}
    h = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
    for d, t in rows:
        lines = t.split("\n")
        v = [h(x) for x in lines]
        ends = [i for i in range(1, len(lines)) if ((v[i - 2] if i >= 2 else 0) * 31 + v[i - 1]) % 4 == 0]
        cuts[d] = [(s, "\n".join(lines[s:e])) for s, e in zip([0, *ends], [*ends, len(lines)]) if e - s >= 2]
        for s, c in cuts[d]:
            first[c] = min(first.get(c, (d, s)), (d, s))
    out = {}
    for d, t in rows:
        lines, gone = t.split("\n"), set()
        for s, c in cuts[d]:
            if first[c] != (d, s):
                gone.update(range(s, s + c.count("\n") + 1))
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_lines_match_brute_force(spark):
    rnd = random.Random(2)
    passage = [f"shared {i}" for i in range(12)]
    rows = []
    for d in range(60):
        lines = [f"own {d} {i}" for i in range(rnd.randrange(0, 6))]
        if rnd.random() < 0.6:
            lines += passage[rnd.randrange(3) : 12 - rnd.randrange(3)]
        rows.append((d, "\n".join(lines + ["same"] * rnd.randrange(3))))
    got = {r.doc_id: (r.text, r._lines, r._removed) for r in line_chunks.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert sum(v[2] for v in got.values()) > 50


def test_lines_of_odd_rows(spark):
    t = "a\nb\nc\nd\ne\nf\ng\nh"
    got = line_chunks.dedup_lines(frame(spark, [(None, t), (1, t), (1, t), (2, t), (3, None), (4, "")])).collect()
    lost = sorted((r.doc_id or -1, r._removed) for r in got)
    assert lost[:3] == [(-1, 0), (1, 0), (1, 0)] and lost[3][1] > 0 and lost[4:] == [(3, 0), (4, 0)]
    assert line_chunks.dedup_lines(frame(spark, [])).count() == 0


def test_cuts_do_not_depend_on_where_a_passage_stands():
    """A passage at the end of a long text is cut as it is alone; positions have no bound in bits."""
    import numpy as np
    import pyarrow as pa

    from barlake.llm.textops import word_slices

    rnd = random.Random(4)
    passage = [f"p{rnd.randrange(10**6)}" for _ in range(80)]
    names = []
    for before in (["a", "b", "c"], [f"w{i % 977}" for i in range(400_000)]):
        w = next(word_slices(pa.array([" ".join(before + passage)]), limit=1 << 40))
        _, a, b, u1, _, name = recompress.stretches(w)
        inside = a >= len(before)
        assert (b - a >= 0).all() and len(np.unique(u1[inside])) == inside.sum()
        names.append(set(name[inside].tolist()))
    assert names[0] and names[0] <= names[1]
