"""Story clusters against a scan in order, relevance against a loop over aliases, and merged rows."""

import datetime as dt
import random
import re

import pytest

from barlake.operators import clusters, news, relevance
from barlake.sources.shared import shared_path

STORY = "id long, Symbol string, filing boolean, url string, title string"


def keep(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def url_key(url):
    if not (url or "").strip():
        return ""
    scheme, _, rest = url.partition("://") if "://" in url else ("https", "", url)
    host, slash, path = re.split("[?#]", rest)[0].partition("/")
    return f"{scheme.lower()}://{host.lower().removeprefix('www.')}{(slash + path).rstrip('/')}"


def scan(rows):
    """id -> leader, deciding story by story; the scan that the operator equals."""
    flat = lambda t: " ".join(re.sub("[^a-z0-9]+", " ", (t or "").lower()).split())
    words = {r[0]: {w for w in flat(r[4]).split() if len(w) > 2} for r in rows}
    leaders, out = [], {}
    for r in sorted(rows):
        for b in leaders:
            if ((r[1] or "").upper(), bool(r[2])) != ((b[1] or "").upper(), bool(b[2])):
                continue
            x, y = words[r[0]], words[b[0]]
            close = x and y and len(x & y) / len(x | y) >= 0.9
            if (url_key(r[3]) and url_key(r[3]) == url_key(b[3])) or (flat(r[4]) and flat(r[4]) == flat(b[4])) or close:
                out[r[0]] = b[0]
                break
        else:
            leaders.append(r)
            out[r[0]] = r[0]
    return out


def mixed(seed):
    """Few URLs and titles, shared crosswise; near copies of a few texts; short titles without tokens, nulls and empty texts."""
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(400)}x" for _ in range(30)] for _ in range(5)]
    rows = []
    for i in range(220):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 1, 1, 1, 2, 2, 3, 6))):
            words[rnd.randrange(30)] = f"n{rnd.randrange(40)}y"
        title = rnd.choice([" ".join(words)] * 6 + ["A-b", "a B!", "...", "", None, f"unique story number{rnd.randrange(60)}"])
        url = rnd.choice([None, None, "", f"http://www.x.com/{rnd.randrange(40)}/?q=1", f"HTTP://X.com/{rnd.randrange(40)}", f"x.com/{rnd.randrange(9)}"])
        rows.append((i * 3, rnd.choice(["A", "a", "B", None]), rnd.choice([True, False, None]), url, title))
    return rows


def chain(n):
    """Each story shares words with the next alone: every other one leads."""
    return [(i, "A", False, None, " ".join(f"word{k}" for k in range(i, i + 20))) for i in range(n)]


def ladder(n):
    """Each story matches the next two."""
    return [(i, "A", False, None, " ".join(f"word{k}" for k in range(i, i + 40))) for i in range(n)]


CASES = {
    "mixed 1": mixed(1), "mixed 2": mixed(2), "chain of 200": chain(200), "ladder": ladder(30), "empty": [],
    "crossed": [(1, "A", False, "http://a/1", "one two three"), (2, "A", False, "http://a/2", "one two three"), (3, "A", False, "http://a/2", "four five six"), (4, "A", False, "http://a/2", "seven eight nine")],
    "near copies": [(i, "A", False, None, " ".join([f"common{k}" for k in range(40)] + [f"own{i}"])) for i in range(120)],
    "alternating links": [(i, "A", False, f"http://u/{(i + 1) // 2}", f"title number{i // 2} words") for i in range(60)],
}


@pytest.mark.parametrize("large", [clusters.LARGE, 3])
@pytest.mark.parametrize("name", CASES)
def test_clusters_equal_a_scan_in_order(spark, monkeypatch, name, large):
    if large == 3 and name not in ("mixed 1", "near copies", "crossed"):
        pytest.skip("large blocks do not matter here")
    monkeypatch.setattr(clusters, "LARGE", large)
    rows = CASES[name]
    got = {r.id: r.leader for r in clusters.news_dedup(spark.createDataFrame(rows, STORY), keep).collect()}
    assert got == scan(rows)


def test_clusters_do_not_depend_on_what_tasks_hold(spark, monkeypatch):
    """Few known frequencies, and tokens picked by a join in place of a broadcast."""
    monkeypatch.setattr(clusters, "HEAVY", 5)
    monkeypatch.setattr(clusters, "FEW", 0)
    rows = CASES["mixed 2"]
    got = {r.id: r.leader for r in clusters.news_dedup(spark.createDataFrame(rows, STORY), keep).collect()}
    assert got == scan(rows)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_tokens(spark):
    rnd = random.Random(4)
    rows = [(i, "A", False, None, " ".join(f"word{rnd.randrange(300)}" for _ in range(rnd.choice([0, 1, 40, 200])))) for i in range(40)]
    keyed = clusters._keyed(spark.createDataFrame(rows, STORY)).cache()
    sets = {r.id: set(r.tokens or ()) for r in keyed.collect()}
    marked = {r.id: r for r in clusters._marked(keyed).collect()}
    assert "tokens" not in clusters._marked(keyed).columns and all(r.n == len(sets[i]) and len(r.prefix or ()) <= r.n // 10 + 1 for i, r in marked.items())
    for i in sets:
        for j in sets:
            assert sum(((marked[i][c] ^ marked[j][c]) & (1 << 64) - 1).bit_count() for c in clusters.BITS) <= len(sets[i] ^ sets[j])


def test_merged_rows_name_the_first_seen_story_and_all_sources(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [(1, "A", "x", None, d(3)), (2, "A", "y", d(5), d(1)), (3, "A", "x", d(4), d(9)), (4, "A", "", d(4), d(8)), (5, "B", None, None, None)]
    s = spark.createDataFrame(rows, "id long, Symbol string, Source string, First_Seen date, Published date")
    led = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)], "id long, leader long")
    got = {r.leader: r for r in clusters.merged(s, led).collect()}
    assert (got[1].id, got[1].All_Sources, got[1].Duplicate_Count) == (4, "x | y", 4)
    assert (got[5].id, got[5].All_Sources, got[5].Duplicate_Count) == (5, "", 1)


def test_cluster_and_event_of_odd_rows(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("http://WWW.a.com/x//?q#f",), ("",), (None,), ("b.com",)], "u string").select(news.canonical_url(F.col("u")).alias("c")).collect()
    assert [r.c for r in got] == ["http://a.com/x", "", None, "https://b.com"]
    assert spark.range(1).select(news.classify_event(F.lit("nothing")).alias("e")).first().e == "General Company News"


# --- relevance


def about(title, symbol, aliases, filing, filed):
    """The reason that a plain loop over a symbol's aliases gives, or None."""
    plain = lambda t: re.sub("[^A-Za-z0-9]+", " ", t).lower().split()
    telling = lambda w: len(w) >= 4 and w not in relevance.GENERIC
    stands = lambda w: re.search(rf"\b{re.escape(w)}\b", title or "", re.I)
    if filing:
        return relevance.OFFICIAL if filed and filed.strip().upper() == symbol.strip().upper() else None
    if title and stands(symbol):
        return relevance.SYMBOL
    for a in aliases:
        w = plain(a)
        if not title or not w or a.strip().upper() == symbol.strip().upper():
            continue
        if len(w) == 1:
            if telling(w[0]) and stands(w[0]):
                return relevance.PHRASE
        elif re.search(r"\b" + r"\s+".join(map(re.escape, w)) + r"\b", title, re.I):
            return relevance.PHRASE
        elif sum(bool(stands(x)) for x in w if telling(x)) >= 2:
            return relevance.TOKENS
    return None


NAMES = [("TOIL", "Tata Oil"), ("INFY", "Infosys"), ("M&M", "Mahindra and Mahindra Ltd"), ("BAJAJ-AUTO", "Bajaj Auto Limited"), ("SBIN", "State Bank of India"), ("RIL", "Reliance Industries Ltd."), ("RPWR", "Reliance Power Limited"), ("GOLD", None), ("TTS", "Tata Tata Steel"), ("ITC", "The ITC Company"), ("UNI", "Ünion Motors"), ("X1", "Trading Alpha Beta Ltd"), ("X2", "Trading Alpha Gamma Ltd"), ("X3", "Trading Delta Gamma Pvt")]
EXTRA = [("toil ", "Big Tata"), ("INFY", "Infy Tech"), ("INFY", "infosys"), ("SBIN", "bank"), ("SBIN", "SBI"), ("GOLD", "Golden Goose"), ("X1", " "), (" ", "none")]
TITLES = [
    "tata oil rises today", "Infosys wins big order", "TATA-OIL slips", "m&m: new plant", "bajaj-auto and M&Ms", "bajaj auto up", "state bank of  india\tdividend", "India bank state of play", "reliance industries", "reliance power, reliance industries",
    "trading alpha: beta test", "alpha gamma trading", "gamma beta", "infosys_x", "infosys.", "RIL! TOIL", "big   tata", "steel by tata", "the itc company", "golden goose", "gold", "Ünion motors", "nion Motors", "motors", "SBI bank", "", None, "x1 x2 x3",
]


def test_aliases_keep_their_order_and_drop_what_says_nothing(spark):
    got = {r.Symbol: r.Aliases for r in relevance.build_aliases(spark.createDataFrame(NAMES, "Symbol string, Name string"), spark.createDataFrame(EXTRA, "Symbol string, Alias string")).collect()}
    assert got["TOIL"] == ["TOIL", "Tata Oil", "Big Tata"] and got["INFY"] == ["INFY", "Infosys", "Infy Tech"]
    assert got["RIL"] == ["RIL", "Reliance Industries Ltd.", "Reliance"] and got["RPWR"] == ["RPWR", "Reliance Power Limited"]
    assert got["SBIN"] == ["SBIN", "State Bank of India", "SBI", "bank"] and got["ITC"] == ["ITC", "The ITC Company"] and got["GOLD"] == ["GOLD", "Golden Goose"]
    assert got["X1"] == ["X1", "Trading Alpha Beta Ltd", "Trading Alpha Beta"]


def test_relevance_equals_a_loop_over_aliases(spark):
    rnd = random.Random(4)
    names = NAMES + [(f"N{i}", " ".join(rnd.choice(["Trading", "Global", "steel", "Alpha", "Beta", "new", "co"]) for _ in range(rnd.randrange(1, 5)))) for i in range(30)]
    titles = TITLES + [rnd.choice([" ", ", ", " - "]).join(rnd.choice(["trading", "GLOBAL", "steel", "alpha", "beta", "new", "co", "n3", "n7", "the"]) for _ in range(rnd.randrange(1, 7))) for _ in range(120)]
    rows = [(i, t, False if i % 3 else None, None) for i, t in enumerate(titles)] + [(900, "tata oil", True, " toil"), (901, "tata oil", True, None), (902, "x", True, "nobody"), (903, None, True, "M&M"), (904, "infosys", False, "TOIL")]
    master, extra = spark.createDataFrame(names, "Symbol string, Name string"), spark.createDataFrame(EXTRA, "Symbol string, Alias string")
    aliases = relevance.build_aliases(master, extra)
    got = {(r.id, r.Symbol): r.Reason for r in relevance.relevance(spark.createDataFrame(rows, "id long, title string, filing boolean, filing_symbol string"), aliases, keep).collect()}
    listed = {r.Symbol: r.Aliases for r in aliases.collect()}
    want = {(i, s): why for i, t, filing, filed in rows for s in listed if (why := about(t, s, listed[s], filing, filed))}
    assert got == want and {relevance.OFFICIAL, relevance.SYMBOL, relevance.PHRASE, relevance.TOKENS} == set(got.values())
    empty = relevance.relevance(spark.createDataFrame([], "id long, title string, filing boolean, filing_symbol string"), aliases, keep)
    assert empty.count() == 0
