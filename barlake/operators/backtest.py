"""Backtest of the style score, expected values, sizing and diversification of a basket."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.evaluation import calendar
from barlake.operators.portfolio import style_score

VARIANTS = ("Top5_EW", "Top1", "Benchmark")


def backtest_events(bars: DataFrame, benchmark: DataFrame, lookback: int = 250, every: int = 5, hold: int = 10, top: int = 5) -> DataFrame:
    """(Date, Picks, Top5_EW, Top1, Benchmark): forward returns of the best style scores at every fifth of the last `lookback` sessions.

    Returns are those of `hold` sessions of the shared calendar; a pick without a bar then counts for nothing. No rows where there are fewer than
    lookback + hold + 10 sessions. The calendar has one row a date.
    """
    every_date = Window.partitionBy(F.lit(1))
    cal = calendar(bars).withColumn("n", F.count(F.lit(1)).over(every_date))
    at = cal.where((F.col("n") >= lookback + hold + 10) & (F.col("idx") - 1 >= F.col("n") - lookback) & (F.col("idx") - 1 < F.col("n") - hold) & ((F.col("idx") - 1 - F.col("n") + lookback) % every == 0)).select("Date", "idx")
    order = Window.partitionBy("Date").orderBy(F.round("Style_Score", 10).desc(), "Symbol")
    picks = style_score(bars).where(~F.col("Symbol").startswith("^")).join(F.broadcast(at), "Date").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    dated = bars.select("Symbol", "Date", "Close").join(F.broadcast(cal.select("Date", "idx")), "Date")
    later = dated.select("Symbol", (F.col("idx") - hold).alias("idx"), F.col("Close").alias("later"))
    met = picks.join(dated.drop("Date").hint("shuffle_hash"), ["Symbol", "idx"]).join(later.hint("shuffle_hash"), ["Symbol", "idx"], "left")
    ret = F.col("later") / F.nullif(F.col("Close"), F.lit(0.0)) - 1
    agg = met.groupBy("Date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "Symbol"))), lambda x: x["Symbol"]), ",").alias("Picks"), F.avg(ret).alias("Top5_EW"), F.max(F.when(F.col("place") == 1, ret)).alias("Top1"))
    ahead = F.lead("Benchmark_Close", hold).over(Window.partitionBy(F.lit(1)).orderBy("Date"))
    bench = benchmark.select("Date", (ahead / F.nullif(F.col("Benchmark_Close"), F.lit(0.0)) - 1).alias("Benchmark"))
    return agg.join(F.broadcast(bench), "Date", "left")


def _long(events: DataFrame) -> DataFrame:
    return events.select("Date", "Benchmark", *(F.col(v).alias(f"v_{v}") for v in VARIANTS)).unpivot(["Date", "Benchmark"], [f"v_{v}" for v in VARIANTS], "v", "s").withColumn("Variant", F.substring("v", 3, 99))


def equity_curve(events: DataFrame) -> DataFrame:
    """(Variant, Date, Equity): compounded returns of each variant, a missing one as 0. One row a rebalance and variant."""
    w = Window.partitionBy("Variant").orderBy("Date")
    return _long(events).select("Variant", "Date", F.exp(F.sum(F.log1p(F.coalesce("s", F.lit(0.0)))).over(w)).alias("Equity"))


def backtest_scorecard(events: DataFrame, hold: int = 10) -> DataFrame:
    """Per variant: hit rate, mean win and loss, payoff, Sharpe, Sortino, deepest drawdown, and yearly excess over the benchmark. Deviations are those of a population."""
    w = Window.partitionBy("Variant").orderBy("Date")
    df = _long(events).where("s is not null").withColumn("_e", F.exp(F.sum(F.log1p("s")).over(w)))
    df = df.withColumn("_d", F.col("_e") / F.max("_e").over(w) - 1)
    s = F.col("s")
    year = F.sqrt(F.lit(252.0 / hold))
    down = F.when(s < 0, s)
    agg = df.groupBy("Variant").agg(
        F.count(s).alias("N_Rebalances"), F.avg(F.when(s > 0, 1.0).otherwise(0.0)).alias("Hit_Rate"), F.avg(F.when(s > 0, s)).alias("Avg_Win"), F.avg(down).alias("Avg_Loss"),
        (F.avg(s) / F.nullif(F.stddev_pop(s), F.lit(0.0)) * year).alias("Sharpe"), F.when(F.count(down) > 1, F.avg(s) / F.nullif(F.stddev_pop(down), F.lit(0.0)) * year).alias("Sortino"),
        F.min("_d").alias("Max_Drawdown"), (F.avg(s - F.col("Benchmark")) * (252.0 / hold)).alias("Annual_Excess"),
    )
    return agg.withColumn("Payoff", -F.col("Avg_Win") / F.col("Avg_Loss"))


def expected_value(forward: DataFrame, verdict: str, horizon: int = 10, filters: dict | None = None, hold_days: int = 10, least: int = 30) -> DataFrame:
    """(N, P_Win, Avg_Win, Avg_Loss, EV_Per_Trade, EV_Per_Day, Status): one row. Values are null unless the verdict is positive, all filter columns exist, and there are `least` returns."""
    filters = {k: v for k, v in (filters or {}).items() if v is not None}
    missing = [c for c in (*filters, "Horizon_Days", "Net_Forward_Return") if c not in forward.columns]
    rows = forward
    for c, v in filters.items():
        if c in forward.columns:
            rows = rows.where(F.upper(F.col(c).cast("string")) == str(v).upper())
    if missing:
        status, rows = "EV unavailable - columns missing: " + ", ".join(missing), forward.limit(0).select(F.lit(None).cast("double").alias("x"))
    else:
        status, rows = "", rows.where(F.col("Horizon_Days") == horizon).select(F.col("Net_Forward_Return").alias("x"))
    if verdict.strip().lower() != "validation positive":
        status = status or f"EV unavailable - validation not positive ({verdict})"
    x = F.col("x")
    agg = rows.agg(F.count(x).alias("N"), F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)).alias("P_Win"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("Avg_Win"), F.coalesce(F.abs(F.avg(F.when(x <= 0, x))), F.lit(0.0)).alias("Avg_Loss"))
    state = F.lit(status) if status else F.when(F.col("N") < least, "EV unavailable - too few observations").otherwise("EV computed from validated filtered forward returns")
    agg = agg.withColumn("Status", state)
    ev = F.when(F.col("Status").startswith("EV computed"), F.col("P_Win") * F.col("Avg_Win") - (1 - F.col("P_Win")) * F.col("Avg_Loss"))
    return agg.withColumns({"EV_Per_Trade": ev, "EV_Per_Day": ev / max(hold_days, 1)})


def ev_kelly(sized: DataFrame, scorecard: DataFrame, verdict: str, cap: float = 0.25) -> DataFrame:
    """(Symbol, EV, Kelly_Raw, Kelly_Capped, Agreement, Decision_Use) of sized picks (Symbol, Weight), from the basket's row of the scorecard. The capped fraction is null unless the verdict is positive."""
    valid = verdict.strip().lower() == "validation positive"
    one = F.broadcast(scorecard.where("Variant = 'Top5_EW'").select(F.col("Hit_Rate").alias("p"), F.col("Avg_Win").alias("w"), F.abs("Avg_Loss").alias("l")))
    df = sized.select("Symbol", "Weight").join(one, how="left")
    edge = F.col("p") * F.col("w") - (1 - F.col("p")) * F.col("l")
    raw = F.greatest(F.lit(0.0), edge / F.greatest(F.col("l") * F.col("w"), F.lit(1e-9)))
    capped = F.when(edge.isNotNull() & F.col("Weight").isNotNull(), F.least(raw, cap * F.col("Weight"))) if valid else F.lit(None).cast("double")
    agree = F.when(edge.isNull() | F.col("Weight").isNull(), "").when((edge > 0) & (F.col("Weight") > 0), "Consistent").when(F.col("Weight") > 0, "Inconsistent - EV<=0 but sized").otherwise("Neutral")
    note = agree if valid else F.when(agree == "", "").otherwise(F.concat(agree, F.lit(" (no approval implied)")))
    use = "Decision_Input" if valid else "Not_For_Decisions_Watchlist_Only"
    return df.select("Symbol", edge.alias("EV"), F.when(edge.isNotNull(), raw).alias("Kelly_Raw"), capped.alias("Kelly_Capped"), note.alias("Agreement"), F.lit(use).alias("Decision_Use"))


def volatility_63(bars: DataFrame, picks: DataFrame, window: int = 63) -> DataFrame:
    """(Symbol, Sigma): yearly population deviation of the picks' last `window` returns."""
    w = Window.partitionBy("Symbol").orderBy("Date")
    df = bars.join(picks.select("Symbol").distinct(), "Symbol", "left_semi").withColumn("r", F.col("Close") / F.lag("Close").over(w) - 1).where("r is not null")
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("Symbol").orderBy(F.col("Date").desc()))).where(F.col("k") <= window)
    return df.groupBy("Symbol").agg((F.stddev_pop("r") * F.sqrt(F.lit(252.0))).alias("Sigma"))


def _sized(df: DataFrame, weight: Column, nav: float, buffer: float, stop: float) -> DataFrame:
    """Capital, shares and loss at the stop (a share of the price below it) of weighted picks (Symbol, Price)."""
    capital = weight * nav * (1 - buffer)
    df = df.withColumns({"Weight": weight, "Capital": capital, "Shares": F.when(F.col("Price") > 0, F.floor(capital / F.col("Price") + 0.5)).cast("double")})
    return df.withColumns({"Max_Loss": F.col("Capital") * stop, "Max_Loss_Pct": F.col("Capital") * stop / nav * 100})


def position_sizing(picks: DataFrame, sigma: DataFrame, most: float = 0.30, nav: float = 1e6, buffer: float = 0.10, stop: float = 0.05) -> DataFrame:
    """Inverse-volatility sizes of each date's picks (Date, Symbol, Price): capped at `most` and scaled to one; equal weights on a date without any volatility."""
    w = Window.partitionBy("Date")
    df = picks.join(sigma.hint("shuffle_hash"), "Symbol", "left").withColumn("_i", 1 / F.nullif(F.col("Sigma"), F.lit(0.0)))
    df = df.withColumn("_c", F.least(F.col("_i") / F.sum("_i").over(w), F.lit(most)))
    weight = F.coalesce(F.when(F.sum("_i").over(w).isNull(), 1 / F.count(F.lit(1)).over(w)).otherwise(F.col("_c") / F.sum("_c").over(w)), F.lit(0.0))
    return _sized(df, weight, nav, buffer, stop).drop("_i", "_c")


def equal_risk(cov: np.ndarray, most: float = 0.30, rounds: int = 50, gap: float = 1e-6) -> np.ndarray:
    """Weights of about equal risk contributions, by the reference's fixed-point iteration, cut at `most` and scaled to one in each round.

    As there, the iteration is not damped: where volatilities differ much it may alternate between two solutions, and the last round's counts.
    """
    n = len(cov)
    w = np.full(n, 1 / n)
    for _ in range(rounds if n > 1 else 0):
        m = cov @ w
        new = np.clip(1 / n / np.where(np.abs(m) < 1e-12, 1e-12, m), 1e-6, None)
        new = np.minimum(new / new.sum(), most)
        new /= new.sum()
        done = np.abs(new - w).max() < gap
        w = new
        if done:
            break
    return w


def risk_parity(picks: DataFrame, sigma: DataFrame, corr: DataFrame, target: float = 0.12, most: float = 0.30) -> DataFrame:
    """(Date, Symbol, Weight, Risk_Contribution): equal-risk weights of each date's picks, shrunk to the target volatility.

    One group is a date's basket, a handful of rows; dates are dealt over the cluster. corr: (Symbol_A, Symbol_B, corr), missing pairs 0.
    """
    pairs = picks.select("Date", F.col("Symbol").alias("Symbol_A")).join(picks.select("Date", F.col("Symbol").alias("Symbol_B")).hint("shuffle_hash"), "Date").join(corr.hint("shuffle_hash"), ["Symbol_A", "Symbol_B"])
    known = pairs.groupBy("Date", F.col("Symbol_A").alias("Symbol")).agg(F.map_from_entries(F.collect_list(F.struct("Symbol_B", "corr"))).alias("with"))
    df = picks.select("Date", "Symbol").join(sigma.hint("shuffle_hash"), "Symbol").join(known, ["Date", "Symbol"], "left")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("Symbol")
        names, s = list(frame["Symbol"]), frame["Sigma"].to_numpy()
        c = np.eye(len(names))
        for i, have in enumerate(frame["with"]):
            for other, value in (have or {}).items():
                c[i, names.index(other)] = c[names.index(other), i] = value
        cov = c * np.outer(s, s)
        w = equal_risk(cov, most)
        var = float(w @ cov @ w)
        share = w * (cov @ w) / var if var > 0 else np.full(len(w), np.nan)
        return pd.DataFrame({"Date": frame["Date"], "Symbol": names, "Weight": w * min(1.0, target / np.sqrt(var)) if var > 0 else w, "Risk_Contribution": share})

    return df.groupBy("Date").applyInPandas(solve, "Date date, Symbol string, Weight double, Risk_Contribution double")


def diversified_top_n(candidates: DataFrame, corr: DataFrame, n: int = 5, alpha: float = 0.5) -> DataFrame:
    """(Symbol, Pick): greedy picks of candidates (Symbol, Score): the best score first, then the highest alpha * score / best - (1 - alpha) * largest |correlation| with the picks.

    n - 1 steps, each a join of what is left with the picks; ties go to the smaller symbol. Candidates are a short list (checked: at most 1,000).
    """
    rows = candidates.where("Score is not null").select("Symbol", "Score")
    if rows.limit(1001).count() > 1000:
        raise ValueError("candidates are more than a short list")
    best = F.broadcast(rows.agg(F.max("Score").alias("best")))
    both = corr.select(F.col("Symbol_A").alias("Symbol"), F.col("Symbol_B").alias("Other"), F.abs("corr").alias("c")).unionByName(corr.select(F.col("Symbol_B").alias("Symbol"), F.col("Symbol_A").alias("Other"), F.abs("corr").alias("c")))
    first = rows.orderBy(F.round("Score", 10).desc(), "Symbol").limit(1).select("Symbol", F.lit(1).cast("long").alias("Pick"))
    picks = first
    for k in range(2, n + 1):
        near = both.join(F.broadcast(picks.select(F.col("Symbol").alias("Other"))), "Other").groupBy("Symbol").agg(F.max("c").alias("c"))
        left = rows.join(F.broadcast(picks), "Symbol", "left_anti").join(near, "Symbol", "left").join(best)
        value = F.round(alpha * F.col("Score") / F.col("best") - (1 - alpha) * F.coalesce("c", F.lit(0.0)), 10)
        picks = picks.unionByName(left.orderBy(value.desc(), "Symbol").limit(1).select("Symbol", F.lit(k).cast("long").alias("Pick")))
    return picks


def event_calendar(picks: DataFrame, earnings: DataFrame, as_of: str, hold: int = 10, near: int = 2) -> DataFrame:
    """(Symbol, Next_Earnings, Days, Event_Risk): picks by their distance from the next earnings date: in the holding window, before or after it, clear or unknown."""
    days = F.datediff("Next_Earnings", F.lit(as_of).cast("date"))
    d = F.col("Days")
    inside = (d >= -near) & (d <= hold + near)
    risk = F.when(d.isNull(), "Unknown").when(inside & (d < 0), "Post_Earnings").when(inside, "In_Window").when((d > 0) & (d <= 30), "Pre_Earnings").when((d < 0) & (d >= -30), "Post_Earnings").otherwise("Clear")
    return picks.select("Symbol").join(earnings.hint("shuffle_hash"), "Symbol", "left").withColumn("Days", days).select("Symbol", "Next_Earnings", "Days", risk.alias("Event_Risk"))


def event_ev_merge(events: DataFrame, ev: DataFrame) -> DataFrame:
    """Events and expected values of all symbols that either has."""
    return events.join(ev, "Symbol", "full")


#: Limits of the gate. Fixed values.
GATE = {"corr": 0.6, "loss": 3.0, "sector": 40.0, "hit": 0.45, "survivors": 3}


def portfolio_gate(corr: DataFrame, sized: DataFrame, sectors: DataFrame, scorecard: DataFrame, survivors: DataFrame, regime: str, events: DataFrame, verdict: str, limits: dict = GATE) -> DataFrame:
    """(Verdict, Reasons, Caveats): one row. A reason downgrades, a caveat is shipped with; missing evidence and a verdict that is not positive are reasons.

    Each input is summed up in one row; the rows meet in a join without keys.
    """
    one = corr.agg(F.avg(F.abs("corr")).alias("corr"))
    size = sized.agg(F.sum("Max_Loss_Pct").alias("loss"), F.count(F.lit(1)).alias("n"))
    weight = sized.join(sectors.select("Symbol", "Sector"), "Symbol", "left").groupBy(F.coalesce("Sector", F.lit("Unknown")).alias("Sector")).agg(F.sum(F.col("Weight") * 100).alias("w"))
    top = weight.agg(F.max(F.when(F.col("Sector") != "Unknown", F.col("w"))).alias("sector"))
    hit = scorecard.agg(F.max(F.when(F.col("Variant") == "Top5_EW", F.col("Hit_Rate"))).alias("hit"))
    alphas, inside = survivors.agg(F.count(F.lit(1)).alias("survivors")), events.agg(F.count_if(F.col("Event_Risk") == "In_Window").alias("inside"), F.count(F.lit(1)).alias("events"))
    df = one
    for other in (size, top, hit, alphas, inside):
        df = df.join(F.broadcast(other))
    c = F.col
    say = lambda rules: F.concat_ws("; ", *(F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in rules))
    reasons = say(
        (
            (c("corr") > limits["corr"], "average |corr| too high"), (c("loss") > limits["loss"], "sum of losses too high"), (c("hit") < limits["hit"], "backtest hit rate too low"),
            (F.lit(regime.upper().replace("-", "_") == "RISK_OFF"), "macro regime = RISK_OFF"), ((c("n") == 0) | (c("events") == 0) | c("corr").isNull() | c("hit").isNull(), "missing evidence"),
            (F.lit(verdict.strip().lower() != "validation positive"), f"official validation not positive ({verdict})"),
        )
    )
    caveats = say(((c("sector") > limits["sector"], "sector concentration"), (c("survivors") < limits["survivors"], "few alpha survivors"), (c("inside") >= 2, "earnings inside hold window")))
    df = df.select(reasons.alias("Reasons"), caveats.alias("Caveats"))
    return df.withColumn("Verdict", F.when(c("Reasons") != "", "Downgrade_To_Watch").when(c("Caveats") != "", "Ship_With_Caveats").otherwise("Ship"))


def top5_alignment(expected: DataFrame, other: DataFrame) -> DataFrame:
    """(Date, Aligned, Same_Order) of two lists (Date, Place, Symbol), a handful of rows a date: the same symbols, and in the same order."""
    listed = lambda df, name: df.groupBy("Date").agg(F.transform(F.sort_array(F.collect_list(F.struct("Place", "Symbol"))), lambda x: x["Symbol"]).alias(name))
    both = listed(expected, "a").join(listed(other, "b"), "Date", "full")
    same = F.coalesce(F.sort_array("a") == F.sort_array("b"), F.lit(False))
    return both.select("Date", same.alias("Aligned"), (same & (F.col("a") == F.col("b"))).alias("Same_Order"))
