"""Clusters of stories: each joins the first leader before it that it matches, as a scan in order would decide.

Stories of one symbol and kind match by URL, by title, or by token sets of a Jaccard similarity of LEAST or more. Equal (URL, title)
rows count once. All that can match share a block: a URL, a title without tokens, or one of the rarest tokens beyond LEAST of a title's
length. In blocks of tokens a story carries a bitmap of 256 bits, each token flipping one: two bitmaps differ in no more bits than the
sets in tokens, which rules out most pairs. Tokens themselves are read for stories of the pairs left alone. Where blocks are large, stories that come first in all their blocks lead and take what matches them; in groups of
near copies this leaves little. The rest is compared within blocks, and leaders are elected along the pairs in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.news import canonical_url, normalize_title, tokens_of

Keep = Callable[[DataFrame, str], DataFrame]
LEAST = 0.9
#: Stories of a block beyond which its first ones lead before pairs are made; turns of this.
LARGE, TURNS = 50, 8
#: Tokens whose frequencies tasks hold, the commonest; all others count as rarer than these, whichever they are. Stories of pairs whose ids are broadcast to pick their tokens.
HEAVY, FEW = 1_000_000, 1_000_000
BITS = [f"bits{i}" for i in range(4)]


def _keyed(stories: DataFrame) -> DataFrame:
    """(id, key, g, u, k, tokens): equal keys match alike; k is the token set, or the title where it has no tokens."""
    g = F.concat_ws("|", F.upper(F.coalesce("Symbol", F.lit(""))), F.coalesce(F.col("filing"), F.lit(False)).cast("string"))
    u = F.nullif(canonical_url(F.col("url")), F.lit(""))
    # step by step, so that a text is normalised and cut once
    out = stories.select("id", g.alias("g"), u.alias("u"), normalize_title(F.col("title")).alias("title")).withColumn("tokens", tokens_of(F.col("title")))
    out = out.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")))
    k = F.when(F.col("tokens").isNotNull(), F.concat(F.lit("k"), F.sha2(F.array_join(F.array_sort("tokens"), " "), 256))).when(F.col("title") != "", F.concat(F.lit("t"), F.col("title")))
    out = out.select("id", "g", "u", k.alias("k"), "tokens")
    own = F.when(F.col("u").isNull() & F.col("k").isNull(), F.col("id").cast("string"))
    return out.withColumn("key", F.sha2(F.to_json(F.struct("g", "u", "k", own.alias("own"))), 256))


def _marked(keyed: DataFrame) -> DataFrame:
    """keyed with n, the number of tokens, prefix, the hashes of a story's rarest ones, and the bitmap of all, in place of the tokens.

    Any order of the tokens that all stories share gives the same matches; the rarer its first ones, the smaller are the blocks.
    """
    spark = keyed.sparkSession
    hashed = keyed.withColumn("hashes", F.transform("tokens", lambda w: F.xxhash64(F.lit("w"), "g", w))).drop("tokens")
    often = hashed.select(F.explode("hashes").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    heavy = often.orderBy(F.col("df").desc(), "block").limit(HEAVY).toArrow()
    block, df = heavy.column("block").to_numpy(), heavy.column("df").to_numpy()
    order = np.argsort(block)
    known = spark.sparkContext.broadcast((block[order], df[order]))
    alone = len(block) < HEAVY  # then all others stand in one story each, and make no block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, df = known.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("hashes"))
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            h, story = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(block, h), max(len(block) - 1, 0))
            often = np.where(block[at] == h, df[at], 0) if len(block) else np.zeros(len(h), np.int64)
            by = np.lexsort((h, often, story))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n - np.ceil(n * LEAST - 1e-9).astype(np.int64) + 1, n)
            if alone:
                first &= often[by] > 0
            sizes = np.bincount(story[first], minlength=len(n))
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(h[by][first], pa.int64()))
            flips = np.bincount(story * 256 + ((h >> 16) & 255), minlength=len(n) * 256).reshape(len(n), 256) & 1
            bits = np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)
            rest = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "hashes"}
            yield pa.RecordBatch.from_pydict(rest | {"n": pa.array(n.astype(np.int32)), "prefix": prefix} | {c: pa.array(bits[:, i]) for i, c in enumerate(BITS)})

    rest = hashed.drop("hashes")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
    return hashed.mapInArrow(run, f"{fields}, n int, prefix array<bigint>, " + ", ".join(f"{c} bigint" for c in BITS))


def _blocks(reps: DataFrame) -> DataFrame:
    """(id, block, n) of stories (id, g, u, k, n, prefix); n is the number of tokens where the block is one of a token, else 0."""
    block = lambda kind, c: F.xxhash64(F.lit(kind), F.col("g"), F.col(c))
    by_url = reps.where("u is not null").select("id", block("u", "u").alias("block"), F.lit(0).alias("n"))
    by_title = reps.where("n = 0 and k is not null").select("id", block("t", "k").alias("block"), F.lit(0).alias("n"))
    by_token = reps.where("n > 0").select("id", F.explode("prefix").alias("block"), "n")
    return by_url.unionByName(by_title).unionByName(by_token)


def _signed(blocks: DataFrame, reps: DataFrame) -> DataFrame:
    return blocks.join(reps.select("id", *BITS).hint("merge"), "id")


def _matching(early: DataFrame, late: DataFrame, stories: DataFrame, keep: Keep) -> DataFrame:
    """(early, late): of the stories in the two signed tables of blocks, those that match, the smaller id first. stories: id, u, k, tokens."""
    a, b = early.alias("a"), late.alias("b")
    some = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= LEAST * F.greatest("a.n", "b.n") - 1e-9)
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in BITS), F.lit(0))
    near = (F.col("a.n") == 0) | (differ <= (F.col("a.n") + F.col("b.n")) * ((1 - LEAST) / (1 + LEAST)) + 1e-6)
    pairs = keep(a.join(b.hint("merge"), F.col("a.block") == F.col("b.block")).where(some & near).select(F.col("a.id").alias("early"), F.col("b.id").alias("late")).distinct(), "likely_pairs")
    ids = keep(pairs.select(F.col("early").alias("id")).union(pairs.select("late")).distinct(), "likely")
    met = stories.join(F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge"), "id", "left_semi")
    side = lambda end, p: met.select(F.col("id").alias(end), *(F.col(c).alias(p + c) for c in ("u", "k", "tokens"))).hint("merge")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    close = both / (F.size("a_tokens") + F.size("b_tokens") - both) >= LEAST
    same = F.array(F.col("a_u") == F.col("b_u"), F.col("a_k") == F.col("b_k"), close)
    return pairs.join(side("early", "a_"), "early").join(side("late", "b_"), "late").where(F.array_contains(F.array_compact(same), True)).select("early", "late")


def _without(df: DataFrame, gone: DataFrame, column: str = "id") -> DataFrame:
    return df.join(gone.select(F.col("id").alias(column)).hint("merge"), column, "left_anti")


def _followed(pointers: DataFrame, keep: Keep) -> DataFrame:
    """(id, root, odd) for pointers (id, root) to smaller ids: where each chain ends, and whether by an odd number of steps; chains halve in each round."""
    at = keep(pointers.withColumn("odd", F.lit(True)), "chains")
    while True:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("_to"), F.col("odd").alias("_odd"))
        step = at.join(up.hint("merge"), "root", "left")
        odd = F.when(F.col("_odd"), ~F.col("odd")).otherwise(F.col("odd"))
        at = keep(step.select("id", F.coalesce("_to", "root").alias("root"), odd.alias("odd"), F.col("_to").isNotNull().alias("moved")), "chains")
        if at.where("moved").isEmpty():
            return at.select("id", "root", "odd")
        at = at.drop("moved")


def elect(nodes: DataFrame, pairs: DataFrame, keep: Keep) -> DataFrame:
    """The leaders (id) among nodes (id) with distinct pairs (early, late): a node leads if no leader is paired with it as an earlier one.

    In each round nodes without an undecided earlier partner lead. A node with just one waits for that one alone: such
    nodes form chains, followed to their ends by pointer jumping, along which leading alternates. Rounds go on until
    all are decided; each decides the first undecided node of every connected part at least.
    """
    leaders = nodes.limit(0)
    while True:
        before = pairs.groupBy(F.col("late").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("early").alias("root"))
        state = keep(nodes.join(before.hint("merge"), "id", "left"), "election")
        if state.isEmpty():
            return leaders
        free = state.where("n is null").select("id")
        chains = _followed(state.where("n = 1").select("id", "root"), keep)
        settled = chains.join(free.withColumnRenamed("id", "root").hint("merge"), "root", "left_semi")
        new = keep(free.unionByName(settled.where("not odd").select("id")), "new_leaders")
        leaders = keep(leaders.unionByName(new), "leaders")
        led = pairs.join(new.withColumnRenamed("id", "early").hint("merge"), "early", "left_semi").select(F.col("late").alias("id"))
        decided = keep(new.unionByName(led).unionByName(settled.where("odd").select("id")).distinct(), "decided")
        nodes = keep(_without(nodes, decided), "undecided")
        pairs = keep(_without(_without(pairs, decided, "early"), decided, "late"), "open_pairs")


def news_dedup(stories: DataFrame, keep: Keep) -> DataFrame:
    """(id, leader) of stories (id, Symbol, filing, url, title): the first earlier leader of its symbol and kind that a story matches, else the story itself.

    A story matches another by its canonical URL, by its normalised title, or by token sets of a Jaccard similarity of 0.9 or more. Ids are unique and give the
    order. Null symbols form one symbol, null filing counts as false; stories without URL and title lead themselves. An empty table gives no rows.
    keep(df, name) writes a table and returns it.
    """
    keyed = keep(_keyed(stories), "keyed")
    facts = ("id", "g", "u", "k", "n", "prefix", *BITS)
    reps = keep(_marked(keyed).groupBy("key").agg(F.min(F.struct(*facts)).alias("r")).select("key", "r.*"), "representatives")
    blocks = keep(_blocks(reps), "blocks")
    open_, leaders = reps.select("id"), reps.select("id").limit(0)
    for _ in range(TURNS):
        live = keep(_signed(blocks.join(open_.hint("merge"), "id", "left_semi"), reps), "live_blocks")
        sizes = live.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
        if sizes.where(F.col("size") > LARGE).isEmpty():
            break
        new = keep(live.select("id", "block").join(sizes.hint("merge"), "block").groupBy("id").agg(F.min(F.col("first") == F.col("id")).alias("free")).where("free").select("id"), "first_leaders")
        led = _matching(live.join(new.hint("merge"), "id", "left_semi"), live, keyed, keep).select(F.col("late").alias("id"))
        open_ = keep(_without(_without(open_, new), led.distinct()), "open_stories")
        leaders = keep(leaders.unionByName(new), "leaders")
    else:
        live = keep(_signed(blocks.join(open_.hint("merge"), "id", "left_semi"), reps), "live_blocks")
    leaders = keep(leaders.unionByName(elect(open_, keep(_matching(live, live, keyed, keep), "pairs"), keep)), "leaders")
    # a story joins its first leader, whichever was found first
    heads = _signed(blocks.join(leaders.hint("merge"), "id", "left_semi"), reps)
    first = _matching(heads, _signed(_without(blocks, leaders), reps), keyed, keep).groupBy(F.col("late").alias("id")).agg(F.min("early").alias("leader"))
    led = reps.select("key", "id").join(first.hint("merge"), "id", "left").select("key", F.coalesce("leader", "id").alias("leader"))
    return keyed.select("id", "key").join(keep(led, "led").hint("merge"), "key").select("id", "leader")


def merged(stories: DataFrame, led: DataFrame) -> DataFrame:
    """One row a cluster: the story first seen (then first published, then first in order; unknown dates last), with All_Sources in that order and Duplicate_Count.

    stories: id, Source, First_Seen, Published and any other columns; led: (id, leader). Null and empty sources are not named.
    """
    order = F.struct(F.col("First_Seen").isNull().alias("a"), F.col("First_Seen").alias("b"), F.col("Published").isNull().alias("c"), F.col("Published").alias("d"), F.col("id").alias("e"))
    rows = stories.join(led.hint("merge"), "id").withColumn("_order", order)
    primary = rows.groupBy("leader").agg(F.min_by(F.struct(*stories.columns), "_order").alias("_p"), F.count(F.lit(1)).alias("Duplicate_Count"))
    named = rows.where("Source != ''").groupBy("leader", "Source").agg(F.min("_order").alias("_o"))
    sources = named.groupBy("leader").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "Source"))), lambda x: x["Source"]), " | ").alias("All_Sources"))
    return primary.join(sources.hint("merge"), "leader", "left").select("leader", "_p.*", F.coalesce("All_Sources", F.lit("")).alias("All_Sources"), "Duplicate_Count")
