"""URL rules, mixing and license scans against plain Python."""

import random
import re

from barlake.llm import licenses, mixture, urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_urls_match_plain_python(spark):
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (4, "http://NET/"), (5, "http://net"), (6, "x://a.example.NET/en/?q=/de/"), (7, "http://example.net:80/en/"), (None, "http://a.org/fr/x"), (8, "http://a.net/#/en/"), (9, "http://..net/"), (10, "a://b://c.net/"), (11, "http://x.org" + "/fr/" * 3000), (12, "http://" + "a." * 50_000 + "example.net/en/"), (13, "http://...net/"), *[(14, None)] * 20]
    rows += [(100 + i, f"http://{rnd.choice(['a.', 'b.c.', ''])}{rnd.choice(['example', 'other'])}.{rnd.choice(['net', 'com', 'org'])}{rnd.choice(['', '/', '/en', '/en/', '/de/x', '/fr/y/z'])}{rnd.choice(['', '?q', '#f'])}") for i in range(200)]
    rows += [rows[-1]] * 50
    pages = spark.createDataFrame([(*r, "h", "clash") for r in rows], "page_id long, url string, rule string, digest string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(((i, *judged(u)) for i, u in rows), key=key)
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge(pages, urls.rule_table(spark, [("block", "zzz/")])).collect()} == {"allow"}


def filled(sizes):
    """Targets by sharing what is over again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_mixture_meets_its_targets(spark):
    rnd = random.Random(8)
    rows = [(d, " ".join("w" for _ in range(rnd.randrange(0, 60))), rnd.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot"])) for d in range(4000)]
    rows += [(9000, None, "a"), (9001, "", "empty"), (None, "x y", "a"), (7, rows[7][1], rows[7][2]), (9002, "w " * 5000, "hot")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, h int")
    got = mixture.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = filled(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= max(60, 0.01 * want[s]) for s in sizes)
    again = mixture.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)
    assert mixture.mix(docs.limit(0)).count() == 0


def scanned(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_match_plain_python(spark):
    rnd = random.Random(5)
    bits = ["under the MIT License", "Apache License, Version 2.0", "CC-BY-NC", "cc by", "nc", "the", "under", "license", "é", "--", "\n", "mit", "version 2"]
    rows = [(d, rnd.choice([" ", ", "]).join(rnd.choice(bits) for _ in range(rnd.randrange(0, 25)))) for d in range(300)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "under the mit license " * 2000), (None, "cc by nc"), (903, "x"), (904, "K under the mit license"), (905, "ΑΒΓ license")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((d, *scanned(t)) for d, t in rows), key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


def detected(text):
    """All places of all rules, found with re, and what is left of them by comparing every pair."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) + " "
    every = [(m.start(), m.end(), p, label) for keyword, rs in licenses.rules() if keyword in norm for label, regex, p in rs for m in re.finditer(regex, norm)]
    every = sorted(set(every), key=lambda d: (d[0], -d[1], -d[2], d[3]))
    left = [d for i, d in enumerate(every) if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] for o in every[:i])]
    return {d[3] for d in left}, max((d[2] for d in left), default=0) / 100


def test_detections_match_brute_force(spark):
    """Texts put together from the rules' own words, so that detections overlap, nest and repeat in all ways."""
    rnd = random.Random(11)
    plain = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\[(.).?\]|\?|\\S\+|\{.*?\}", lambda m: (m[1] or m[2] or ""), line.split(" | ")[3]) for line in licenses.RULES.strip().splitlines()]
    bits = [p for p in plain if re.fullmatch("[a-z0-9 ]+", p)] + ["the", "license", "mit", "x"]
    texts = [rnd.choice([" ", ", "]).join(rnd.choice(bits) for _ in range(rnd.randrange(1, 9))) for _ in range(250)]
    texts += ["MIT licensed under the MIT License apache license version 2 0", "cc by nc sa 4 0 cc by nc", "public domain " * 3000]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        labels, score = detected(t)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == labels | base, t
        assert abs(got[i].score - max(score, 0.5 if base else 0.0)) < 1e-9, t


def test_contained_detections_are_suppressed(spark):
    cases = {
        "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc,cc-by-nc-sa",  # the base phrase stays
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3",
        "SPDX-License-Identifier: MIT": "mit",
        "er geht mit uns": "",
        "BSD 3-Clause License and Apache License": "apache,bsd-3",
        "Neither the name of the Foo Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    rules = [r for _, rs in licenses.rules() for r in rs]
    assert len(rules) == len(set(rules)) >= 200


def test_a_rule_with_very_many_places(spark):
    """40,000 places of one phrase in one text, counted and found in time that grows with their number."""
    import time

    from barlake.llm import licenses

    n = 40_000
    began = time.time()
    got = licenses.scan(spark.createDataFrame([(1, "public domain x " * n)], "doc_id long, text string")).selectExpr("n_words", "labels", "size(detections) as n", "element_at(detections, -1).s as last").first()
    assert got.n_words == 3 * n and got.n >= n and got.labels and got["last"] == 1 + 16 * (n - 1)
    assert time.time() - began < 60
