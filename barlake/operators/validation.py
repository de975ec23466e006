"""Maturation of signals into forward returns, and whether the ranking has an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.ranks import Keep

HORIZONS = (5, 10, 21)
#: Round-trip costs and the traded values that divide funds by liquidity. Fixed values.
COST, STOCK_COST, ETF_COST, ETF_MID_COST, ETF_LOW_COST, ETF_MID_VALUE, ETF_LOW_VALUE = 0.0030, 0.0035, 0.0025, 0.0050, 0.0100, 1e8, 2e7
#: Gates of the verdict. Fixed values.
GATES = {"min_dates": 10, "min_effective": 6, "min_obs": 50, "min_spread": 0.005, "min_hit": 0.55, "min_t": 1.50, "min_boot": 0.70}


def cost_model() -> Column:
    """(cost, note) of a signal by its universe and, for funds, its mean traded value."""
    kind, value = F.lower(F.coalesce("Universe", F.lit(""))), F.col("Avg_Traded_Value_20D")
    pair = lambda c, note: F.struct(F.lit(c).alias("cost"), F.lit(note).alias("note"))
    fund = (
        F.when(value.isNull(), pair(max(ETF_COST, ETF_MID_COST), "ETF cost: missing traded value"))
        .when(value < ETF_LOW_VALUE, pair(max(ETF_COST, ETF_LOW_COST), "ETF low-liquidity cost"))
        .when(value < ETF_MID_VALUE, pair(max(ETF_COST, ETF_MID_COST), "ETF mid-liquidity cost"))
        .otherwise(pair(ETF_COST, "ETF high-liquidity cost"))
    )
    return F.when(kind == "etf", fund).when(kind == "stock", pair(STOCK_COST, "Stock cost")).otherwise(pair(COST, "Default cost"))


def mature_signals(signals: DataFrame, bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """One row for each signal and horizon: entry and exit bar, gross and net return, or the reason that there is none.

    A signal enters at the symbol's first bar on or after its date and leaves `h` bars of that symbol later. Signals and
    bars are stacked and the next bar is filled backward, so one shuffle by symbol serves all horizons.
    """
    w = Window.partitionBy("Symbol").orderBy("Date")
    ahead = [F.struct(F.lead("Date", h).over(w).alias("d"), F.lead("Price", h).over(w).alias("p")).alias(f"x{h}") for h in horizons]
    bar = bars.select("Symbol", "Date", F.struct("Date", "Price", *ahead).alias("bar"), F.lit(1).alias("side"))
    cost = cost_model()
    sig = signals.select("Symbol", "Date", F.struct(F.col("Date").alias("d"), F.col("Confidence_Adjusted_Score").alias("s"), F.col("Final_Score").alias("f"), F.col("Universe").alias("u"), F.col("Opportunity_Eligible").alias("o"), cost.alias("c")).alias("sig"), F.lit(0).alias("side"))
    both = sig.unionByName(bar, allowMissingColumns=True)
    nxt = Window.partitionBy("Symbol").orderBy("Date", "side").rowsBetween(0, Window.unboundedFollowing)
    known = F.count("bar").over(Window.partitionBy("Symbol"))
    met = both.withColumns({"next": F.first("bar", ignorenulls=True).over(nxt), "known": known}).where("side = 0")
    each = met.withColumn("x", F.explode(F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.col(f"next.x{h}.d").alias("d"), F.col(f"next.x{h}.p").alias("p")) for h in horizons))))
    gross = F.col("x.p") / F.nullif(F.col("next.Price"), F.lit(0.0)) - 1
    reason = F.when(F.col("known") == 0, "No price history for symbol").when(F.col("next").isNull(), "No price on or after signal date").when(F.col("x.p").isNull(), "Forward bar not available yet")
    return each.select(
        "Symbol", F.col("Date").alias("Signal_Date"), F.col("x.h").alias("Horizon_Days"), F.col("next.Date").alias("Entry_Date"), F.col("x.d").alias("Exit_Date"),
        gross.alias("Gross_Forward_Return"), F.col("sig.c.cost").alias("Round_Trip_Cost"), (gross - F.col("sig.c.cost")).alias("Net_Forward_Return"),
        F.col("sig.s").alias("Confidence_Adjusted_Score"), F.col("sig.f").alias("Final_Score"), F.col("sig.u").alias("Universe"), F.col("sig.o").alias("Opportunity_Eligible"), reason.alias("Reason"),
    )


def per_symbol_summary(matured: DataFrame) -> DataFrame:
    """Observations, hit rate and spread of net returns by symbol and horizon."""
    net = F.col("Net_Forward_Return")
    return matured.where(net.isNotNull()).groupBy("Symbol", "Horizon_Days").agg(
        F.count(net).alias("Obs"), F.avg(F.when(net > 0, 1.0).otherwise(0.0)).alias("Hit_Rate"), F.avg(net).alias("Avg_Net"), F.percentile(net, 0.5).alias("Median_Net"),
        F.min(net).alias("Worst_Net"), F.max(net).alias("Best_Net"), F.avg("Gross_Forward_Return").alias("Avg_Gross"), F.avg("Round_Trip_Cost").alias("Avg_Cost"),
    )


def maturation_progress(matured: DataFrame) -> DataFrame:
    """Matured, pending and unmatchable signals by horizon."""
    return matured.groupBy("Horizon_Days").agg(
        F.count("Net_Forward_Return").alias("Matured"), F.count_if(F.col("Reason") == "Forward bar not available yet").alias("Pending"),
        F.count_if(F.col("Reason").isNotNull() & (F.col("Reason") != "Forward bar not available yet")).alias("Unmatchable"),
        (F.count("Net_Forward_Return") / F.count(F.lit(1))).alias("Matured_Rate"),
    )


def assign_buckets(matured: DataFrame, least: int = 10) -> DataFrame:
    """Rank, percentile, top-n label, decile and quintile within each signal date and horizon of at least `least` rows.

    Quantiles have interpolated edges on ascending ranks: 1 is the lowest, and among equal scores the first symbol has
    the lower quantile rank though the better rank.
    """
    rows = matured.where(F.col("Net_Forward_Return").isNotNull() & F.col("Confidence_Adjusted_Score").isNotNull() & (F.lower(F.trim("Opportunity_Eligible")) == "yes"))
    group = Window.partitionBy("Signal_Date", "Horizon_Days")
    score = F.round("Confidence_Adjusted_Score", 10)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(group), "r": F.row_number().over(group.orderBy(score.desc(), "Symbol")), "up": F.row_number().over(group.orderBy(score.asc(), "Symbol"))})
    rows = rows.where(F.col("_n") >= least)
    bucket = lambda k: F.greatest(F.lit(1), F.ceil((F.col("up") - 1) * k / (F.col("_n") - 1))).cast("long")
    top = F.when(F.col("r") <= 5, "Top 5").when(F.col("r") <= 10, "Top 6-10").when(F.col("r") <= 25, "Top 11-25").otherwise("Other")
    return rows.withColumns({"Score_Rank_On_Date": F.col("r").cast("long"), "Score_Percentile_On_Date": 1 - (F.col("r") - 1) / (F.col("_n") - 1), "Bucket_TopN": top, "Score_Decile": bucket(10), "Score_Quintile": bucket(5)}).drop("_n", "r", "up")


def medians(rows: DataFrame, keys: list[str], value: str, margin: float = 0.001) -> DataFrame:
    """(keys, median): the exact median of `value` within each of a few large groups.

    Approximate quantiles on both sides of the median bound what has to be sorted: `margin` of a group on each side. The
    values below the bounds are counted, those within them counted by value, and the middle ones read off the running counts. rows are read twice.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    error = int(10 / margin)  # an approximate quantile's rank is off by at most 1 / error of the group
    ends = F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], error)
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ends.alias("_e")).select(*keys, "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    small = F.col("_n") <= 2 * error  # bounds of small groups might miss the middle: all their values count
    bounds = bounds.withColumns({"_lo": F.when(~small, F.col("_lo")), "_hi": F.when(~small, F.col("_hi"))})
    bounds = bounds.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    met = rows.join(F.broadcast(bounds), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    at = met.withColumn("_side", side).where("_side < 1").groupBy(*keys, "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_side", "_v"))
    at = at.withColumns({"_to": upto}).withColumn("_from", F.col("_to") - F.col("_c"))
    holds = lambda k: (F.col("_from") <= k) & (k < F.col("_to"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    return at.groupBy(*keys).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("median"))


def bucket_performance(detail: DataFrame, keep: Keep | None = None) -> DataFrame:
    """Return statistics by horizon and quintile, decile, top-n label, and all, from one set of grouping sets; medians apart. keep(df, name) writes a table and returns it: detail is read three times."""
    net = F.col("Net_Forward_Return")
    if keep:
        detail = keep(detail.select("Horizon_Days", "Score_Quintile", "Score_Decile", "Bucket_TopN", "Net_Forward_Return", "Gross_Forward_Return", "Round_Trip_Cost", "Final_Score"), "detail")
    keyed = detail.select("Horizon_Days", F.concat(F.lit("Q"), "Score_Quintile").alias("q"), F.concat(F.lit("D"), "Score_Decile").alias("d"), F.col("Bucket_TopN").alias("t"), "Net_Forward_Return", "Gross_Forward_Return", "Round_Trip_Cost", "Final_Score")
    cols = [F.col(c) for c in ("Horizon_Days", "q", "d", "t")]
    sets = [[cols[0], c] for c in cols[1:]] + [[cols[0]]]
    agg = keyed.groupingSets(sets, *cols).agg(
        F.count(net).alias("Obs"), F.avg(net).alias("Avg_Net_Return"), F.avg(F.when(net > 0, 1.0).otherwise(0.0)).alias("Hit_Rate_Net"),
        F.min(net).alias("Worst_Net_Return"), F.max(net).alias("Best_Net_Return"), F.stddev_samp(net).alias("Std_Net_Return"), F.avg("Gross_Forward_Return").alias("Avg_Gross_Return"),
        F.avg("Round_Trip_Cost").alias("Avg_Cost"), F.avg("Final_Score").alias("Avg_Final_Score"),
    )
    kind = F.when(F.col("q").isNotNull(), "Score_Quintile").when(F.col("d").isNotNull(), "Score_Decile").when(F.col("t").isNotNull(), "Bucket_TopN").otherwise("All")
    out = agg.withColumns({"Bucket_Type": kind, "Bucket": F.coalesce("q", "d", "t", F.lit("All Eligible"))}).drop("q", "d", "t")
    named = F.array(*(F.struct(F.lit(k).alias("Bucket_Type"), b.alias("Bucket")) for k, b in (("Score_Quintile", F.col("q")), ("Score_Decile", F.col("d")), ("Bucket_TopN", F.col("t")), ("All", F.lit("All Eligible")))))
    long = keyed.select("Horizon_Days", "Net_Forward_Return", F.explode(named).alias("b")).select("Horizon_Days", "b.Bucket_Type", "b.Bucket", "Net_Forward_Return")
    keys = ["Horizon_Days", "Bucket_Type", "Bucket"]
    return out.join(F.broadcast(medians(long, keys, "Net_Forward_Return").withColumnRenamed("median", "Median_Net_Return")), keys, "left")


def spread_by_date(detail: DataFrame) -> DataFrame:
    """Mean net returns of the ends of the ranking by signal date and horizon, and their differences."""
    net, q, r = F.col("Net_Forward_Return"), F.col("Score_Quintile"), F.col("Score_Rank_On_Date")
    mean = lambda cond: F.avg(F.when(cond, net))
    agg = detail.groupBy("Signal_Date", "Horizon_Days").agg(
        F.avg(net).alias("All_Avg"), mean(q == 5).alias("Top_Quintile"), mean(q == 1).alias("Bottom_Quintile"), mean(r <= 10).alias("Top10"), mean(r <= 25).alias("Top25"),
        F.count(F.lit(1)).alias("Obs_All"), F.count_if(q == 5).alias("Obs_Top"), F.count_if(q == 1).alias("Obs_Bottom"),
    )
    return agg.withColumns({"TopMinusBottom": F.col("Top_Quintile") - F.col("Bottom_Quintile"), "Top10MinusAll": F.col("Top10") - F.col("All_Avg"), "Top25MinusAll": F.col("Top25") - F.col("All_Avg")})


def signal_gap(spreads: DataFrame) -> DataFrame:
    """(Horizon_Days, Gap_Days): the median number of days between a horizon's signal dates."""
    w = Window.partitionBy("Horizon_Days").orderBy("Signal_Date")
    gaps = spreads.withColumn("g", F.datediff("Signal_Date", F.lag("Signal_Date").over(w)))
    return gaps.groupBy("Horizon_Days").agg(F.percentile("g", 0.5).alias("Gap_Days"))


def bootstrap_spread(spreads: DataFrame, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """(Horizon_Days, Boot_Mean, Boot_P5, Boot_P95, Boot_Prob_Positive): means of resampled spreads.

    A draw's index comes from the MD5 of its numbers, so that any engine draws the same. Each spread is expanded into
    draws and meets the drawn value by an equi-join on (horizon, index).
    """
    w = Window.partitionBy("Horizon_Days").orderBy("Signal_Date")
    vals = spreads.where("TopMinusBottom is not null").select("Horizon_Days", F.col("TopMinusBottom").alias("v"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    vals = vals.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("Horizon_Days"))).where("n >= 2")
    draws = vals.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    at = F.conv(F.substring(F.md5(F.concat_ws("-", "b", "i", F.lit(seed) + F.col("Horizon_Days"))), 1, 8), 16, 10).cast("long") % F.col("n")
    draws = draws.select("Horizon_Days", "b", at.alias("i"))
    means = draws.join(vals.select("Horizon_Days", "i", "v").hint("shuffle_hash"), ["Horizon_Days", "i"]).groupBy("Horizon_Days", "b").agg(F.avg("v").alias("m"))
    return means.groupBy("Horizon_Days").agg(
        F.avg("m").alias("Boot_Mean"), F.percentile("m", 0.05).alias("Boot_P5"), F.percentile("m", 0.95).alias("Boot_P95"), F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("Boot_Prob_Positive")
    )


def spread_summary(spreads: DataFrame, boot: DataFrame) -> DataFrame:
    """Per horizon: mean spread, its t statistic as is and with overlapping windows counted once, hit rates, bootstrap."""
    s = F.col("TopMinusBottom")
    hit = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
    agg = spreads.groupBy("Horizon_Days").agg(
        F.count(s).alias("Validation_Dates"), F.avg(s).alias("Avg_Spread"), F.percentile(s, 0.5).alias("Median_Spread"), F.stddev_samp(s).alias("Std_Spread"),
        F.avg(F.when(s > 0, 1.0).when(s.isNotNull(), 0.0)).alias("Hit_Rate"), F.avg("Top10MinusAll").alias("Avg_Top10MinusAll"), hit("Top10MinusAll").alias("Hit_Top10"),
        F.avg("Top25MinusAll").alias("Avg_Top25MinusAll"), hit("Top25MinusAll").alias("Hit_Top25"), F.avg("Obs_All").alias("Avg_Obs"),
    )
    df = agg.join(signal_gap(spreads), "Horizon_Days", "left").join(boot, "Horizon_Days", "left")
    factor = F.when(F.col("Gap_Days") > 0, F.greatest(F.lit(1.0), F.col("Horizon_Days") / F.col("Gap_Days"))).otherwise(1.0)
    df = df.withColumn("Overlap_Factor", factor).withColumn("Effective_Dates", F.col("Validation_Dates") / F.col("Overlap_Factor"))
    t = lambda n: F.when(F.col("Std_Spread") > 0, F.col("Avg_Spread") / (F.col("Std_Spread") / F.sqrt(n)))
    return df.withColumns({"TStat": t(F.col("Validation_Dates")), "Adjusted_TStat": F.when(F.col("Effective_Dates") > 1, t(F.col("Effective_Dates")))})


def bayes_shrink(summary: DataFrame, a: float = 10.0, b: float = 10.0, prior: float = 20.0) -> DataFrame:
    """Hit rate drawn to one half, t statistic and spread to zero, by the whole number of effective dates."""
    n = F.floor(F.when(F.coalesce("Effective_Dates", F.lit(0.0)) > 0, F.col("Effective_Dates")).otherwise(F.col("Validation_Dates")))
    keep = n / (prior + n)
    return summary.withColumns({"Shrunk_Hit": F.round((a + F.col("Hit_Rate") * n) / (a + b + n), 6), "Shrunk_T": F.round(F.col("Adjusted_TStat") * keep, 6), "Shrunk_Spread": F.round(F.col("Avg_Spread") * keep, 6)})


def verdict(shrunk: DataFrame, gates: dict = GATES) -> DataFrame:
    """Verdict and grade of each horizon; the shrunk statistics decide, and missing evidence fails."""
    dates, eff, obs = F.col("Validation_Dates"), F.col("Effective_Dates"), F.col("Avg_Obs")
    spread, hit, t, boot = F.col("Shrunk_Spread"), F.col("Shrunk_Hit"), F.col("Shrunk_T"), F.col("Boot_Prob_Positive")
    g = gates
    none = spread.isNull() | hit.isNull() | t.isNull() | boot.isNull()
    good = (spread >= g["min_spread"]) & (hit >= g["min_hit"]) & (t >= g["min_t"]) & (boot >= g["min_boot"])
    bad = (spread <= -g["min_spread"]) & (t <= 0)
    out = (
        F.when(F.coalesce(dates, F.lit(0)) < g["min_dates"], "Insufficient History").when(F.coalesce(eff, F.lit(0.0)) < g["min_effective"], "Insufficient Independent History")
        .when(F.coalesce(obs, F.lit(0.0)) < g["min_obs"], "Insufficient Breadth").when(none, "Insufficient Statistical Evidence")
        .when(good, "Validation Positive").when(bad, "Validation Negative").otherwise("No Proven Edge Yet")
    )
    df = shrunk.withColumn("Verdict", out)
    grade = F.when(F.col("Verdict").startswith("Insufficient"), "Insufficient Evidence").when(F.col("Verdict") == "Validation Positive", F.when((eff >= 20) & (t >= 2.0), "Strong Evidence").otherwise("Moderate Evidence")).otherwise("Weak or Negative Evidence")
    return df.withColumn("Evidence_Grade", grade)


def validation_detail(forward: DataFrame, history: DataFrame) -> DataFrame:
    """Forward returns (Symbol, Signal_Date) with the score history (Symbol, Date) of schema 2 and eligible symbols."""
    rows = history.where((F.coalesce("Schema_Version", F.lit(1)) >= 2) & (F.lower(F.trim("Opportunity_Eligible")) == "yes"))
    return forward.join(rows.withColumnRenamed("Date", "Signal_Date").hint("shuffle_merge"), ["Symbol", "Signal_Date"])


def validation_diagnosis(matured: DataFrame) -> DataFrame:
    """By horizon: signal dates, those with a matured return, their span, symbols that never matured, and rows with a reason instead of a return."""
    known = F.col("Net_Forward_Return").isNotNull()
    keys = [F.col("Horizon_Days"), F.col("Signal_Date"), F.col("Symbol")]
    # by date and by symbol first: what is counted as distinct is then a row each
    each = matured.groupingSets([keys[:2], [keys[0], keys[2]]], *keys).agg(F.grouping("Symbol").alias("_by_date"), F.bool_or(known).alias("_known"), F.count("Reason").alias("_without"))
    by_date = F.col("_by_date") == 1
    day, some = F.when(by_date, F.col("Signal_Date")), F.when(~by_date, F.col("Symbol"))
    return each.groupBy("Horizon_Days").agg(
        F.count(day).alias("Dates"), F.count(F.when(F.col("_known"), day)).alias("Matured_Dates"), F.min(day).alias("First_Date"), F.max(day).alias("Last_Date"),
        (F.count(some) - F.count(F.when(F.col("_known"), some))).alias("Symbols_Lost"), F.sum(F.when(by_date, F.col("_without"))).alias("Unmatured"),
    )


def validation_coverage(history: DataFrame, matured: DataFrame, missing: DataFrame, bars: DataFrame, horizon: int = 10, least: int = 10) -> DataFrame:
    """(Section, Item, Rows, Dates, First_Date, Last_Date): why there is or is no evidence, from the score history to prices.

    history: Symbol, Date, Schema_Version (null is 1), Confidence_Adjusted_Score; matured: Symbol, Signal_Date, Horizon_Days,
    Net_Forward_Return and Opportunity_Eligible; missing: Reason; bars: Symbol, Date. Sections: schema (v1, v2, and v2 rows without a score), matured (rows of the
    horizon, or all rows where it has none), overlap (dates that are matured and of schema 2), breadth (dates with at least `least` scored,
    eligible instruments, and thinner ones), reason, prices, and lost (symbols of the history that have no prices). Sections without rows stay, with counts of 0, but for reasons.
    """
    span = lambda df, section, item, date: df.agg(F.count(F.lit(1)).alias("Rows"), F.count_distinct(date).alias("Dates"), F.min(date).alias("First_Date"), F.max(date).alias("Last_Date")).select(F.lit(section).alias("Section"), F.lit(item).alias("Item"), "Rows", "Dates", "First_Date", "Last_Date")
    two = F.coalesce(F.col("Schema_Version"), F.lit(1)) == 2
    v2 = history.where(two)
    of_horizon = matured.where(F.col("Horizon_Days") == horizon)
    used = of_horizon if of_horizon.limit(1).count() else matured
    dates = v2.select(F.col("Date").alias("Signal_Date")).distinct().hint("shuffle_hash")
    scored = v2.where("Confidence_Adjusted_Score is not null").select(F.col("Date").alias("Signal_Date"), "Symbol").distinct().hint("shuffle_merge")
    good = used.where(F.col("Net_Forward_Return").isNotNull() & (F.lower(F.trim("Opportunity_Eligible")) == "yes")).join(scored, ["Signal_Date", "Symbol"], "left_semi")
    per_date = good.groupBy("Signal_Date").agg(F.count(F.lit(1)).alias("n"))
    lost = history.select("Symbol").distinct().join(bars.select("Symbol").distinct().hint("shuffle_hash"), "Symbol", "left_anti")
    none = F.lit(None).cast("date")
    parts = [
        span(history.where(~two), "schema", "v1", "Date"),
        span(v2, "schema", "v2", "Date"),
        span(v2.where("Confidence_Adjusted_Score is null"), "schema", "v2 without score", "Date"),
        span(used, "matured", "rows", "Signal_Date"),
        span(used.join(dates, "Signal_Date", "left_semi"), "overlap", "rows", "Signal_Date"),
        span(per_date.where(F.col("n") >= least), "breadth", "usable dates", "Signal_Date"),
        span(per_date.where(F.col("n") < least), "breadth", "thin dates", "Signal_Date"),
        missing.where("Reason is not null").groupBy("Reason").agg(F.count(F.lit(1)).alias("Rows")).select(F.lit("reason").alias("Section"), F.col("Reason").alias("Item"), "Rows", F.lit(0).cast("long").alias("Dates"), none.alias("First_Date"), none.alias("Last_Date")),
        span(bars, "prices", "bars", "Date"),
        lost.agg(F.count(F.lit(1)).alias("Rows")).select(F.lit("lost").alias("Section"), F.lit("symbols").alias("Item"), "Rows", F.lit(0).cast("long").alias("Dates"), none.alias("First_Date"), none.alias("Last_Date")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence_fallback(detail: DataFrame) -> DataFrame:
    """(Horizon_Days, Dates, Median_Gap): the median return of the best quintile less that of the worst, where there is no verdict."""
    net = F.col("Net_Forward_Return")
    median = lambda q: F.percentile(F.when(F.col("Score_Quintile") == q, net), 0.5)
    return detail.groupBy("Horizon_Days").agg(F.count_distinct("Signal_Date").alias("Dates"), (median(5) - median(1)).alias("Median_Gap"))
