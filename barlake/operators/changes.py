"""What changed from one snapshot to the next, for every date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.frames import correlation


def previous_snapshot(scores: DataFrame) -> DataFrame:
    """(Date, Previous_Date): the latest earlier date of the history. One row a date."""
    return scores.select("Date").distinct().withColumn("Previous_Date", F.lag("Date").over(Window.partitionBy(F.lit(1)).orderBy("Date")))


def topn_entries_exits(scores: DataFrame, n: int = 20) -> DataFrame:
    """(Date, Symbol, Change): symbols that entered or left the first n since the snapshot before; none on the first date."""
    top = scores.where(F.col("Opportunity_Rank") <= n).select("Date", "Symbol")
    dates = previous_snapshot(scores).where("Previous_Date is not null")
    now = top.join(F.broadcast(dates), "Date")
    before = top.select(F.col("Date").alias("Previous_Date"), "Symbol").join(F.broadcast(dates), "Previous_Date")
    entered = now.join(before, ["Date", "Symbol"], "left_anti").select("Date", "Symbol", F.lit("entry").alias("Change"))
    left = before.join(now, ["Date", "Symbol"], "left_anti").select("Date", "Symbol", F.lit("exit").alias("Change"))
    return entered.unionByName(left)


def rank_movers(scores: DataFrame, n: int = 5) -> DataFrame:
    """(Date, Symbol, Rank, Previous_Rank, Move, Side): the n largest gains and losses of rank since the snapshot before."""
    dates = previous_snapshot(scores).where("Previous_Date is not null")
    before = scores.select(F.col("Date").alias("Previous_Date"), "Symbol", F.col("Rank").alias("Previous_Rank"))
    both = scores.select("Date", "Symbol", "Rank").join(F.broadcast(dates), "Date").join(before.hint("shuffle_merge"), ["Previous_Date", "Symbol"]).withColumn("Move", F.col("Previous_Rank") - F.col("Rank"))
    up = F.row_number().over(Window.partitionBy("Date").orderBy(F.col("Move").desc(), "Symbol"))
    down = F.row_number().over(Window.partitionBy("Date").orderBy(F.col("Move").asc(), "Symbol"))
    both = both.withColumns({"_u": up, "_d": down})
    gain = both.where((F.col("_u") <= n) & (F.col("Move") > 0)).withColumn("Side", F.lit("gainer"))
    loss = both.where((F.col("_d") <= n) & (F.col("Move") < 0)).withColumn("Side", F.lit("loser"))
    return gain.unionByName(loss).select("Date", "Symbol", "Rank", "Previous_Rank", "Move", "Side")


def regime_change(regime: DataFrame) -> DataFrame:
    """(Date, From_Regime, To_Regime) of the dates whose regime differs from the date before. One row a date."""
    w = Window.partitionBy(F.lit(1)).orderBy("Date")
    df = regime.select("Date", F.lag("Market_Regime").over(w).alias("From_Regime"), F.col("Market_Regime").alias("To_Regime"))
    return df.where("From_Regime is not null and From_Regime != To_Regime")


def symbol_history(scores: DataFrame) -> DataFrame:
    """(Symbol, Current_Rank, Previous_Rank, Best_Rank, Days_In_Top25, Snapshots) over all snapshots."""
    at = Window.partitionBy("Symbol").orderBy(F.col("Date").desc())
    df = scores.withColumn("_k", F.row_number().over(at))
    return df.groupBy("Symbol").agg(F.max(F.when(F.col("_k") == 1, F.col("Rank"))).alias("Current_Rank"), F.max(F.when(F.col("_k") == 2, F.col("Rank"))).alias("Previous_Rank"), F.min("Rank").alias("Best_Rank"), F.count_if(F.col("Rank") <= 25).alias("Days_In_Top25"), F.count(F.lit(1)).alias("Snapshots"))


def trailing_streak(df: DataFrame, holds) -> DataFrame:
    """(Symbol, Streak): length of each symbol's last run of rows that satisfy the predicate `holds`."""
    later_misses = F.sum(F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(1)).over(Window.partitionBy("Symbol").orderBy(F.col("Date").desc()))
    return df.withColumn("_m", later_misses).groupBy("Symbol").agg(F.count_if(F.col("_m") == 0).alias("Streak"))


def risk_flag_changes(scores: DataFrame) -> DataFrame:
    """(Date, Symbol, Change, Risk_Flag, Previous_Flag): flags that are new or other than on the symbol's row before, and flags that went."""
    w = Window.partitionBy("Symbol").orderBy("Date")
    df = scores.select("Date", "Symbol", "Risk_Flag", F.lag("Risk_Flag").over(w).alias("Previous_Flag")).where("Previous_Flag is not null and Risk_Flag != Previous_Flag")
    kind = F.when(F.col("Risk_Flag") == "Clean", "cleared").when(F.col("Previous_Flag") == "Clean", "new").otherwise("changed")
    return df.select("Date", "Symbol", kind.alias("Change"), "Risk_Flag", "Previous_Flag")


def shadow_compare(df: DataFrame, n: int = 25) -> DataFrame:
    """(Date, N, Spearman, Jaccard, Mean_Abs_Delta) of official and shadow ranks of the symbols that have both."""
    for c in ("Opportunity_Rank", "V4_Rank"):
        if df.columns.count(c) != 1:
            raise ValueError(f"needs exactly one column {c}")
    both = df.where("Opportunity_Rank is not null and V4_Rank is not null")
    top = (F.col("Opportunity_Rank") <= n, F.col("V4_Rank") <= n)
    agg = both.groupBy("Date").agg(F.count(F.lit(1)).alias("N"), correlation("Opportunity_Rank", "V4_Rank").alias("Spearman"), (F.count_if(top[0] & top[1]) / F.nullif(F.count_if(top[0] | top[1]), F.lit(0))).alias("Jaccard"), F.avg(F.abs(F.col("Opportunity_Rank") - F.col("V4_Rank"))).alias("Mean_Abs_Delta"))
    return agg


def overlap_summary(df: DataFrame, n: int = 20) -> DataFrame:
    """(Date, Overlap, Added, Dropped): how many of the first n stay, come in and go under the shadow ranks."""
    a, b = F.coalesce(F.col("Opportunity_Rank") <= n, F.lit(False)), F.coalesce(F.col("V4_Rank") <= n, F.lit(False))
    return df.groupBy("Date").agg(F.count_if(a & b).alias("Overlap"), F.count_if(b & ~a).alias("Added"), F.count_if(a & ~b).alias("Dropped"))


def matured_delta(matured: DataFrame) -> DataFrame:
    """(Horizon_Days, Date, Matured, Delta): forward returns known by each exit date, and how many more than by the date before."""
    w = Window.partitionBy("Horizon_Days").orderBy("Date")
    day = matured.where("Net_Forward_Return is not null").groupBy("Horizon_Days", F.col("Exit_Date").alias("Date")).agg(F.count(F.lit(1)).alias("Delta"))
    return day.select("Horizon_Days", "Date", F.sum("Delta").over(w).alias("Matured"), "Delta")


def rebalance_diff(top: DataFrame, scores: DataFrame, vetoed: DataFrame, decay: float = 3.0) -> DataFrame:
    """(Date, Symbol, Action, Reason): what enters, stays in and leaves the basket (Date, Symbol) since the basket before.

    Reasons of an exit: a veto (Symbol), a score that fell by more than `decay`, no row at the date, else outranked. The first basket has entries only.
    """
    dates = top.select("Date").distinct().withColumn("Previous_Date", F.lag("Date").over(Window.partitionBy(F.lit(1)).orderBy("Date")))
    now = top.select("Date", "Symbol", F.lit(True).alias("_now"))
    before = top.select(F.col("Date").alias("Previous_Date"), "Symbol").join(F.broadcast(dates), "Previous_Date").select("Date", "Symbol", F.lit(True).alias("_was"))
    both = now.join(before, ["Date", "Symbol"], "full").join(F.broadcast(dates), "Date")
    s = scores.select("Date", "Symbol", F.col("Confidence_Adjusted_Score").alias("_s"))
    both = both.join(s.hint("shuffle_hash"), ["Date", "Symbol"], "left").join(s.select(F.col("Date").alias("Previous_Date"), "Symbol", F.col("_s").alias("_p")).hint("shuffle_hash"), ["Previous_Date", "Symbol"], "left")
    both = both.join(vetoed.select("Symbol", F.lit(True).alias("_veto")).distinct().hint("shuffle_hash"), "Symbol", "left")
    action = F.when(F.col("_now") & F.col("_was"), "hold").when(F.col("_now"), "entry").otherwise("exit")
    why = F.concat_ws("; ", F.when(F.col("_veto"), "sentiment veto"), F.when(F.col("_s").isNull(), "dropped from universe").when(F.col("_s") < F.col("_p") - decay, "score decay"))
    return both.select("Date", "Symbol", action.alias("Action"), F.when(action == "exit", F.when(why == "", "outranked").otherwise(why)).alias("Reason"))


def rebalance_summary(diff: DataFrame) -> DataFrame:
    """(Date, Holds, Entries, Exits, Turnover_Pct): the basket's changes; turnover is the share of entries."""
    n = lambda a: F.count_if(F.col("Action") == a)
    now = F.greatest(n("hold") + n("entry"), F.lit(1))
    return diff.groupBy("Date").agg(n("hold").alias("Holds"), n("entry").alias("Entries"), n("exit").alias("Exits"), F.round(n("entry") / now * 100, 1).alias("Turnover_Pct"))


def candidate_filter(df: DataFrame, text: str = "", universe: str = "", bucket: str = "", eligible: bool | None = None, flagged: bool | None = None) -> DataFrame:
    """Rows whose symbol or name holds `text` and that are of the universe, bucket, eligibility and flag state asked for; what is not asked for is not looked at."""
    if text:
        df = df.where(F.contains(F.upper(F.concat_ws(" ", "Symbol", "Name")), F.lit(text.upper())))
    if universe:
        df = df.where(F.lower("Universe") == universe.lower())
    if bucket:
        df = df.where(F.col("Bucket") == bucket)
    if eligible is not None:
        df = df.where((F.lower(F.trim("Opportunity_Eligible")) == "yes") == eligible)
    if flagged is not None:
        df = df.where((F.col("Risk_Flag") != "Clean") == flagged)
    return df


def shadow_gate(checks: DataFrame, streak: int = 8, observations: int = 6) -> DataFrame:
    """(State, Failed) of each row (Verdict, Leads, Positives, Observations, Veto): green where all five checks hold, red where the verdict is negative, else amber."""
    failed = F.concat_ws(
        "; ", F.when(F.coalesce("Verdict", F.lit("")) != "Validation Positive", "official verdict is not Validation Positive"), F.when(F.coalesce("Leads", F.lit(0)) < streak, "too few consecutive shadow leads"),
        F.when(F.coalesce("Positives", F.lit(0)) < streak, "too few consecutive positive verdicts"), F.when(F.coalesce("Observations", F.lit(0)) < observations, "too few matured observations"), F.when(F.coalesce("Veto", F.lit(0)) > 0, "shadow list holds vetoed names"),
    )
    state = F.when(failed == "", "green").when(F.col("Verdict") == "Validation Negative", "red").otherwise("amber")
    return checks.withColumns({"State": state, "Failed": failed})


def card_join(top: DataFrame, context: DataFrame, horizon: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Cards: each date's top rows (Date, Symbol, Place) with sector (Symbol), best horizon (Symbol) and benchmark (Date)."""
    return top.join(context.hint("shuffle_hash"), "Symbol", "left").join(horizon.hint("shuffle_hash"), "Symbol", "left").join(benchmark.hint("shuffle_hash"), "Date", "left")


def evidence_rows(cards: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(Date, Symbol, Evidence): one JSON text a pick, with the card's columns and, under each table's name, the columns of the symbol's row in it.

    Of several rows of a symbol the least counts, so that reruns agree. A table without a row for the symbol stands as null, and so do null values.
    """
    own = sorted(c for c in cards.columns if c not in ("Date", "Symbol"))
    rows = cards.select("Date", "Symbol", F.struct(*own).alias("_card"))  # its names may be those of tables
    for k, df in enumerate(tables.values()):
        one = df.groupBy("Symbol").agg(F.min(F.struct(*(c for c in df.columns if c != "Symbol"))).alias(f"_t{k}"))
        rows = rows.join(one.hint("shuffle_hash"), "Symbol", "left")
    fields = [F.col("_card")[c].alias(c) for c in own] + [F.col(f"_t{k}").alias(name) for k, name in enumerate(tables)]
    return rows.select("Date", "Symbol", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("Evidence"))


def review_queue(events: DataFrame, flagged: DataFrame, moves: DataFrame, feeds: DataFrame, n: int = 20) -> DataFrame:
    """(Place, Kind, Item): events inside the holding window, flagged picks, rank moves of 10 or more, feeds that are not green; the first n in that order. A short list."""
    parts = (
        events.where("Event_Risk = 'In_Window'").select(F.lit(1).alias("k"), F.lit("event").alias("Kind"), F.col("Symbol").alias("Item")), flagged.where("Risk_Flag != 'Clean'").select(F.lit(2).alias("k"), F.lit("flag").alias("Kind"), F.col("Symbol").alias("Item")),
        moves.where("abs(Rank_Change) >= 10").select(F.lit(3).alias("k"), F.lit("move").alias("Kind"), F.col("Symbol").alias("Item")), feeds.where("Status != 'green'").select(F.lit(4).alias("k"), F.lit("feed").alias("Kind"), F.col("feed").alias("Item")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    top = out.distinct().orderBy("k", "Item").limit(n)
    return top.withColumn("Place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k", "Item")).cast("long")).select("Place", "Kind", "Item")


def news_candidates(scores: DataFrame, entries: DataFrame, movers: DataFrame, flags: DataFrame, pins: DataFrame | None = None, cap: int = 30) -> DataFrame:
    """(Date, Symbol, Why, Place): symbols to read news of at each date: the first 15, new ones of the first 20, gainers by 5 or more ranks, new risk flags, pinned ones (Symbol) that have a score; each once, by its first reason; `cap` a date."""
    part = lambda df, k, why: df.select("Date", "Symbol", F.lit(k).alias("k"), F.lit(why).alias("Why"))
    every = part(scores.where("Opportunity_Rank <= 15"), 1, "top-15").unionByName(part(entries.where("Change = 'entry'"), 2, "new top-20")).unionByName(part(movers.where("Side = 'gainer' and Move >= 5"), 3, "gainer")).unionByName(part(flags.where("Change = 'new'"), 4, "new risk flag"))
    if pins is not None:
        every = every.unionByName(part(scores.join(pins.select("Symbol").distinct().hint("shuffle_hash"), "Symbol", "left_semi"), 5, "user_pin"))
    first = every.groupBy("Date", "Symbol").agg(F.min(F.struct("k", "Why")).alias("m")).select("Date", "Symbol", "m.k", "m.Why")
    place = F.row_number().over(Window.partitionBy("Date").orderBy("k", "Symbol")).cast("long")
    return first.withColumn("Place", place).where(F.col("Place") <= cap).select("Date", "Symbol", "Why", "Place")
