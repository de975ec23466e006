"""Time-series signals of every symbol at every date. All frames share one partitioning, so bars are shuffled once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.frames import by_symbol, change, correlation, frame_count, frame_mean, frame_sum, rolling, rows, with_sums

HORIZONS = (5, 10, 21, 63, 126, 252)
AVERAGES = (10, 20, 50, 100, 200)
YEAR = 252.0


def enrich_bars(bars: DataFrame, master: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bars with their instrument's columns and the benchmark of the date; both may be missing."""
    return bars.join(master, "Symbol", "left").join(benchmark, "Date", "left")


def returns(df: DataFrame) -> DataFrame:
    """Daily and n-session changes of price and benchmark and their differences; gaps in the benchmark are filled forward."""
    filled = df.withColumn("Benchmark_Close", F.last("Benchmark_Close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    p, b = F.col("Price"), F.col("Benchmark_Close")
    out = {"Daily_Return": change(p), "Benchmark_Return": change(b)}
    for n in HORIZONS:
        out[f"Return_{n}D"] = change(p, n)
        out[f"Benchmark_Return_{n}D"] = change(b, n)
        out[f"Relative_Strength_{n}D"] = change(p, n) - change(b, n)
    return filled.withColumns(out)


def moving_averages(df: DataFrame) -> DataFrame:
    """Means of n closes, with at least max(5, n // 2) of them, and whether the price lies above (not, where there is no mean)."""
    p = F.col("Price")
    df = with_sums(df, {"ma": p})
    df = df.withColumns({f"MA_{n}D": frame_mean("ma", n, max(5, n // 2)) for n in AVERAGES}).drop("_sma", "_nma")
    df = df.withColumns({f"MA_{n}D_Hundreds": F.col(f"MA_{n}D") / 100 for n in AVERAGES})
    return df.withColumns({f"Above_{n}DMA": F.coalesce(p > F.col(f"MA_{n}D"), F.lit(False)) for n in AVERAGES})


def volatility(df: DataFrame) -> DataFrame:
    """Yearly sample deviation of daily returns over 20 and 60 rows, with at least 10 and 20 of them."""
    r = F.col("Daily_Return")
    df = with_sums(df, {"r": r, "rr": r * r})
    return df.withColumns({f"Volatility_{n}D": F.when(frame_count("r", n) >= least, F.sqrt(F.greatest(_spread("rr", "r", "r", n), F.lit(0.0)))) * F.sqrt(F.lit(YEAR)) for n, least in ((20, 10), (60, 20))}).drop("_sr", "_nr", "_srr", "_nrr")


def _spread(product: str, a: str, b: str, n: int) -> Column:
    """Sample covariance over the last n rows from the running sums of the product and of both sides, which have the same rows."""
    k = frame_count(product, n)
    return (frame_sum(product, n) - frame_sum(a, n) * frame_sum(b, n) / F.nullif(k, F.lit(0))) / F.nullif(k - 1, F.lit(0))


def drawdown(df: DataFrame) -> DataFrame:
    """Price below its high of 60 rows, and the lowest such gap over 60 and over 252 rows, with at least 10 rows each."""
    p = F.col("Price")
    gap = {f"_gap{n}": p / rolling(F.max(p), p, n, 10) - 1 for n in (60, 252)}
    df = df.withColumns(gap)
    worst = {f"Max_Drawdown_{n}D": rolling(F.min(f"_gap{n}"), F.col(f"_gap{n}"), n, 10) for n in (60, 252)}
    return df.withColumns({"Current_Drawdown_60D": F.col("_gap60"), **worst}).drop("_gap60", "_gap252")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean gain against mean loss over 14 changes; 50 where there was no loss or too few rows."""
    df = df.withColumn("_d", F.col("Price") - F.lag("Price").over(by_symbol()))
    d = F.col("_d")
    df = with_sums(df, {"up": F.greatest(d, F.when(d.isNotNull(), 0.0)), "down": F.greatest(-d, F.when(d.isNotNull(), 0.0))})
    gain, loss = (F.round(frame_mean(c, n, n), 9) for c in ("up", "down"))
    return df.withColumn("RSI_14", F.coalesce(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))), F.lit(50.0))).drop("_d", "_sup", "_nup", "_sdown", "_ndown")


def liquidity(df: DataFrame) -> DataFrame:
    """Traded value and its mean, volume against its mean, and rows without volume."""
    v = F.col("Volume")
    df = df.withColumn("Traded_Value", F.col("Price") * v)
    none = F.when(F.coalesce(v, F.lit(0.0)) <= 0, 1.0).otherwise(0.0)
    df = with_sums(df, {"value": F.col("Traded_Value"), "volume": v, "none": none})
    return df.withColumns(
        {
            "Avg_Traded_Value_20D": frame_mean("value", 20, 5),
            "Volume_Ratio_20D": v / F.nullif(frame_mean("volume", 20, 5), F.lit(0.0)),
            "Zero_Volume_Days_60D": F.when(frame_count("none", 60) >= 10, frame_sum("none", 60)),
        }
    ).drop("_svalue", "_nvalue", "_svolume", "_nvolume", "_snone", "_nnone")


def beta(df: DataFrame) -> DataFrame:
    """Covariance with the benchmark's returns by their variance over 252 rows, with at least 60 pairs."""
    r, b = F.col("Daily_Return"), F.col("Benchmark_Return")
    both = r.isNotNull() & b.isNotNull()
    df = with_sums(df, {"rb": r * b, "pr": F.when(both, r), "pb": F.when(both, b), "b": b, "bb": b * b})
    cov = F.when(frame_count("rb", 252) >= 60, _spread("rb", "pr", "pb", 252))
    var = F.when(frame_count("b", 252) >= 60, _spread("bb", "b", "b", 252))
    return df.withColumn("Beta_252D", cov / F.nullif(var, F.lit(0.0))).drop(*(f"_{t}{k}" for k in ("rb", "pr", "pb", "b", "bb") for t in "sn"))


def atr_levels(df: DataFrame) -> DataFrame:
    """Mean true range of 14 rows (at least 7) and the levels set by it."""
    last = F.lag("Close").over(by_symbol())
    df = df.withColumn("_tr", F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - last), F.abs(F.col("Low") - last)))
    df = with_sums(df, {"tr": F.col("_tr")})
    df = df.withColumn("ATR_14", frame_mean("tr", 14, 7)).drop("_tr", "_str", "_ntr")
    p, a = F.col("Price"), F.col("ATR_14")
    df = df.withColumns({"ATR_Stop_Level": p - 1.5 * a, "ATR_Target_1": p + 1.5 * a, "ATR_Target_2": p + 2.5 * a})
    return df.withColumn("Risk_Reward_Ratio_2", (F.col("ATR_Target_2") - p) / F.nullif(p - F.col("ATR_Stop_Level"), F.lit(0.0)))


def signals(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All signals of all bars."""
    df = bars.join(F.broadcast(benchmark), "Date", "left")  # a row a date
    for step in (returns, moving_averages, volatility, drawdown, rsi, liquidity, beta, atr_levels):
        df = step(df)
    df = df.withColumns({"Traded_Lakh": F.col("Traded_Value") / 1e5, "Avg_Traded_Lakh_20D": F.col("Avg_Traded_Value_20D") / 1e5})
    return df.withColumn("History_Days", F.row_number().over(by_symbol()).cast("long"))


def latest_rows(df: DataFrame, least: int = 90) -> DataFrame:
    """Each symbol's last row, where it has at least `least`."""
    n = F.count(F.lit(1)).over(Window.partitionBy("Symbol"))
    last = F.row_number().over(Window.partitionBy("Symbol").orderBy(F.col("Date").desc()))
    return df.withColumns({"_n": n, "_last": last}).where((F.col("_last") == 1) & (F.col("_n") >= least)).drop("_n", "_last")


def market_regime(benchmark: DataFrame) -> DataFrame:
    """(Date, Market_Regime, Market_Regime_Score): the benchmark against its means of 20 and 50 rows and its 21-row change.

    The benchmark has one row a date, so one partition holds it.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("Date")
    c = F.col("Benchmark_Close")
    mean = lambda n, least: F.when(F.count(c).over(w.rowsBetween(1 - n, 0)) >= least, F.avg(c).over(w.rowsBetween(1 - n, 0)))
    df = benchmark.withColumns({"m20": mean(20, 10), "m50": mean(50, 20), "r21": c / F.lag(c, 21).over(w) - 1})
    known = F.col("m20").isNotNull() & F.col("m50").isNotNull() & F.col("r21").isNotNull() & c.isNotNull()
    up = (c > F.col("m20")) & (F.col("m20") > F.col("m50")) & (F.col("r21") > 0)
    down = (c < F.col("m20")) & (F.col("m20") < F.col("m50")) & (F.col("r21") < 0)
    label = F.when(~known, "Neutral").when(up, "Risk-On").when(down, "Risk-Off").otherwise("Neutral")
    score = F.when(~known, 50.0).when(up, 85.0).when(down, 25.0).otherwise(55.0)
    return df.select("Date", label.alias("Market_Regime"), score.alias("Market_Regime_Score"))


def breadth(bars: DataFrame, n: int = 50) -> DataFrame:
    """(Date, Breadth_Pct): share of symbols above their mean of n closes, of those that have one."""
    p = F.col("Price")
    df = bars.withColumn("_ma", rolling(F.avg(p), p, n, n)).where("_ma is not null")
    return df.groupBy("Date").agg((F.avg(F.when(p > F.col("_ma"), 1.0).otherwise(0.0)) * 100).alias("Breadth_Pct"), F.count(F.lit(1)).alias("Symbols"))


#: Rows of a symbol whose moving ranks one task counts.
STRETCH = 4096


def _below(n: int, least: int, strict: bool, to: int, stretch: int):
    """Moving ranks of one stretch of a symbol's rows, which come with the rows before it that their frames reach back to."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_k")
        k, part = table.column("_k").to_numpy(), key[1].as_py()
        _, rank = np.unique(table.column("Value").to_numpy(), return_inverse=True)
        own = np.flatnonzero(k // stretch == part)
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - to, -1), rank]), n)[own + 1]  # of row i the n rows up to i + to
        there = frames >= 0
        mine = rank[own][:, None]
        below = (there & ((frames < mine) if strict else (frames <= mine))).sum(axis=1)
        size = there.sum(axis=1)
        share = [b / m * 100 if m >= least and m else None for b, m in zip(below.tolist(), size.tolist(), strict=True)]
        return pa.table({c: table.column(c).take(own) for c in ("Symbol", "Date", "Value")} | {"Share": pa.array(share, pa.float64())})

    return run


def share_below(series: DataFrame, n: int, least: int, strict: bool = True, to: int = 0, stretch: int = STRETCH) -> DataFrame:
    """(Symbol, Date, Value, Share): percentage of n values up to the row `to` (0 or before) below the current one (or at it, if not strict), where there are `least`.

    A symbol's rows are cut into stretches, each with the rows that its frames reach back to, so that a long history lies in many tasks. Null values are left out.
    """
    back = n - 1 - to
    stretch = max(stretch, back, 1)
    k = F.row_number().over(by_symbol()) - 1
    df = series.where("Value is not null").select("Symbol", "Date", F.col("Value").cast("double").alias("Value")).withColumn("_k", k.cast("long"))
    part = F.floor(F.col("_k") / stretch).cast("long")
    parts = F.when(F.col("_k") % stretch >= stretch - back, F.array(part, part + 1)).otherwise(F.array(part))
    each = df.withColumn("_part", F.explode(parts))
    return each.groupBy("Symbol", "_part").applyInArrow(_below(n, least, strict, to, stretch), "Symbol string, Date date, Value double, Share double")


def vix_percentile(series: DataFrame, n: int = 252, least: int = 20) -> DataFrame:
    """(Symbol, Date, Percentile, Regime): share of the last n values below the current one; LOW under 30, HIGH over 70."""
    p = F.col("Share")
    regime = F.when(p.isNull(), "UNKNOWN").when(p < 30, "LOW").when(p <= 70, "MID").otherwise("HIGH")
    return share_below(series, n, least).select("Symbol", "Date", p.alias("Percentile"), regime.alias("Regime"))


def hold_horizon(bars: DataFrame, horizons=(3, 5, 10, 21, 42, 63), cap: float = 0.06, history: int = 252) -> DataFrame:
    """(Symbol, Horizon, N, Median, Q25, Q75, Vol, Downside, Worst, Sharpe_Like, Best): overlapping returns of each horizon.

    Of the last `history` + 68 closes. Best marks the horizon with the highest median by downside among those whose
    downside over the horizon is within `cap`, else among all; ties go to the shorter.
    """
    recent = F.row_number().over(Window.partitionBy("Symbol").orderBy(F.col("Date").desc())) <= history + 68
    df = bars.withColumn("_keep", recent).where("_keep").select("Symbol", "Date", "Price")
    each = df.withColumns({str(h): F.col("Price") / F.lag("Price", h).over(by_symbol()) - 1 for h in (1, *horizons)})
    long = each.unpivot(["Symbol", "Date"], [str(h) for h in (1, *horizons)], "h", "r").where("r is not null").withColumn("Horizon", F.col("h").cast("int"))
    q = lambda p: F.expr(f"percentile(r, {p})")
    minus = F.count_if(F.col("r") < 0)
    down = F.when(minus > 3, F.stddev_pop(F.when(F.col("r") < 0, F.col("r")))).otherwise(F.stddev_pop("r"))
    agg = long.groupBy("Symbol", "Horizon").agg(F.count("r").alias("N"), q(0.5).alias("Median"), q(0.25).alias("Q25"), q(0.75).alias("Q75"), F.stddev_pop("r").alias("_sd"), down.alias("_down"), F.min("r").alias("Worst"))
    one = agg.where("Horizon = 1").select("Symbol", F.col("_sd").alias("_d1"), F.col("_down").alias("_down1"))
    out = agg.where("Horizon > 1").join(one, "Symbol")
    root = F.sqrt(F.col("Horizon").cast("double"))
    out = out.withColumns({"Vol": F.col("_d1") * root, "Downside": F.col("_down1") * root, "Sharpe_Like": F.col("Median") / (F.abs(F.col("_down1") * root) + 1e-6)})
    inside = (F.col("Downside") <= cap).cast("int")
    order = Window.partitionBy("Symbol").orderBy(inside.desc(), F.round("Sharpe_Like", 10).desc(), "Horizon")
    return out.withColumn("Best", F.row_number().over(order) == 1).select("Symbol", F.col("Horizon").cast("long"), "N", "Median", "Q25", "Q75", "Vol", "Downside", "Worst", "Sharpe_Like", "Best")


def macro_tape(benchmark: DataFrame, fear: DataFrame) -> DataFrame:
    """(Date, Above_50, Trend_50, Fear_Pctile, Regime, Previous_Regime): the benchmark's trend over 50 rows against how high `fear` (Date, Value) stands.

    Percentile: share of the last 252 values at or below the current one, of at least 60. One row a date.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("Date")
    at = fear.select("Date", "Value", F.lit("x").alias("Symbol"))
    share = share_below(at, 252, 60, strict=False).select("Date", F.col("Share").alias("Fear_Pctile"))
    df = benchmark.join(share, "Date", "left")
    c = F.col("Benchmark_Close")
    enough = F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) >= 55
    df = df.withColumns({"Above_50": F.when(enough, c >= F.avg(c).over(w.rowsBetween(-49, 0))), "Trend_50": F.when(enough, (c / F.lag(c, 49).over(w) - 1) * 100)})
    trend, p = F.coalesce("Trend_50", F.lit(0.0)), F.col("Fear_Pctile")
    regime = F.when(p.isNull(), "neutral").when((trend > 2) & (p < 40), "risk-on").when((trend < -3) | (p > 70), "risk-off").otherwise("neutral")
    df = df.withColumn("Regime", regime)
    return df.select("Date", "Above_50", "Trend_50", "Fear_Pctile", "Regime", F.lag("Regime").over(w).alias("Previous_Regime"))


def microstructure(bars: DataFrame, nav: DataFrame, least: float, most_z: float = 2.5) -> DataFrame:
    """(Symbol, Date, Traded_Median_20, Spread_Median_20, Premium_Z, Passes, Fails): medians of 20 rows and the z-score of the premium over nav (Symbol, NAV_Gap) over 60."""
    df = bars.join(nav, "Symbol", "left").withColumns({"_tv": F.col("Close") * F.col("Volume"), "_sp": (F.col("High") - F.col("Low")) / F.col("Close"), "_pr": F.col("Close") / F.nullif(F.col("Open") * (1 + F.col("NAV_Gap")), F.lit(0.0)) - 1})
    sd = F.stddev_pop("_pr").over(rows(60))
    z = F.when((F.count("_pr").over(rows(60)) >= 10) & (sd > 1e-12), (F.col("_pr") - F.avg("_pr").over(rows(60))) / sd)
    df = df.withColumns({"Traded_Median_20": F.percentile("_tv", 0.5).over(rows(20)), "Spread_Median_20": F.percentile("_sp", 0.5).over(rows(20)), "Premium_Z": z})
    low, wide = F.col("Traded_Median_20").isNull() | (F.col("Traded_Median_20") < least), F.abs("Premium_Z") > most_z
    fails = F.concat_ws("; ", F.when(low, "LOW_LIQUIDITY"), F.when(wide, "PREMIUM_Z"))
    return df.select("Symbol", "Date", "Traded_Median_20", "Spread_Median_20", "Premium_Z", (fails == "").alias("Passes"), fails.alias("Fails"))


def benchmark_stats(bars: DataFrame, benchmark: DataFrame, window: int = 63, least: int = 20) -> DataFrame:
    """(Symbol, N, Excess_21, Tracking_Error, Information_Ratio, Beta) of each symbol's last `window` returns against the benchmark's.

    Excess: the last 21 compounded returns less the benchmark's. Beta divides a sample covariance by a population variance, as the reference does.
    """
    df = bars.join(benchmark, "Date").withColumns({"r": change(F.col("Close")), "b": change(F.col("Benchmark_Close"))}).where("r is not null and b is not null")
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("Symbol").orderBy(F.col("Date").desc()))).where(F.col("k") <= window)
    grown = lambda c: F.exp(F.sum(F.when(F.col("k") <= 21, F.ln(1 + F.col(c))))) - 1
    year = F.sqrt(F.lit(YEAR))
    agg = df.groupBy("Symbol").agg(F.count(F.lit(1)).alias("N"), (grown("r") - grown("b")).alias("Excess_21"), F.stddev_pop(F.col("r") - F.col("b")).alias("_te"), F.avg(F.col("r") - F.col("b")).alias("_m"), F.covar_samp("r", "b").alias("_c"), F.var_pop("b").alias("_v"))
    te = F.col("_te") * year
    out = agg.where(F.col("N") >= least)
    return out.select("Symbol", "N", "Excess_21", te.alias("Tracking_Error"), (F.col("_m") * YEAR / F.nullif(te, F.lit(0.0))).alias("Information_Ratio"), (F.col("_c") / F.nullif(F.col("_v"), F.lit(0.0))).alias("Beta"))


def sector_rs(df: DataFrame, boost: float = 1.05, cut: float = 0.95) -> DataFrame:
    """(Date, Sector, Sector_Multiplier): 1.05 where the sector's mean 21-row return beats the benchmark by 10 points, 0.95 where it lags by 3."""
    agg = df.groupBy("Date", "Sector").agg(F.avg("Return_21D").alias("s"), F.avg("Benchmark_Return_21D").alias("b")).where("s is not null and b is not null")
    gap = F.round(F.col("s") - F.col("b"), 10)
    return agg.select("Date", "Sector", F.when(gap >= 0.10, boost).when(gap <= -0.03, cut).otherwise(1.0).alias("Sector_Multiplier"))


def combined_rs(stock: Column, sector: Column) -> Column:
    """Half of each multiplier."""
    return F.round(0.5 * stock + 0.5 * sector, 4)


def sector_context(bars: DataFrame, benchmark: DataFrame, master: DataFrame, picks: DataFrame, window: int = 60, peers: int = 3) -> DataFrame:
    """(Symbol, Sector, Return_21, Return_63, Relative_21, Peers, Peer_Median_63) of picked symbols at their last bar.

    Peers: the `peers` symbols whose returns correlate most over the pick's last `window` rows, picks' returns meeting all others' by date.
    """
    df = bars.withColumns({"r": change(F.col("Close")), "Return_21": change(F.col("Close"), 21), "Return_63": change(F.col("Close"), 63)})
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("Symbol").orderBy(F.col("Date").desc())))
    last = df.where("k = 1").select("Symbol", "Date", "Return_21", "Return_63")
    bench = benchmark.withColumn("b21", F.col("Benchmark_Close") / F.lag("Benchmark_Close", 21).over(Window.partitionBy(F.lit(1)).orderBy("Date")) - 1)
    a = df.where((F.col("k") <= window) & F.col("r").isNotNull()).join(picks.select("Symbol").distinct(), "Symbol", "left_semi").select("Date", "Symbol", "r")
    b = df.where("r is not null").select("Date", F.col("Symbol").alias("Peer"), F.col("r").alias("p"))
    both = a.join(b.hint("shuffle_hash"), "Date").where("Symbol != Peer").groupBy("Symbol", "Peer").agg(correlation("r", "p").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 20 and c is not null")
    best = Window.partitionBy("Symbol").orderBy(F.round("c", 8).desc(), "Peer")
    top = both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= peers).join(last.select(F.col("Symbol").alias("Peer"), F.col("Return_63").alias("p63")).hint("shuffle_hash"), "Peer")
    found = top.groupBy("Symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "Peer"))), lambda x: x["Peer"]), ",").alias("Peers"), F.percentile("p63", 0.5).alias("Peer_Median_63"))
    out = found.join(last, "Symbol").join(master.select("Symbol", "Sector"), "Symbol", "left").join(bench.select("Date", "b21"), "Date", "left")
    return out.select("Symbol", "Sector", "Return_21", "Return_63", (F.col("Return_21") - F.col("b21")).alias("Relative_21"), "Peers", "Peer_Median_63")
