"""Formulaic factors of every symbol at every date; higher is better. Deviations are those of a population."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.frames import by_symbol, rows
from barlake.functions.moving import Frame, with_frames
from barlake.functions.ranks import Keep, ranked, share, with_ranks


def prepared(bars: DataFrame) -> DataFrame:
    """Bars with the columns the factors share: row number, return, gap, range, money flow, whether the close rose, and cumulative signed volume."""
    last = F.lag("Close").over(by_symbol())
    df = bars.withColumns({"n": F.row_number().over(by_symbol()), "ret": F.col("Close") / last - 1, "gap": F.col("Open") / last - 1, "signed": F.signum(F.col("Close") - last) * F.col("Volume")})
    spread = F.nullif(F.col("High") - F.col("Low"), F.lit(0.0))
    flow = F.coalesce((2 * F.col("Close") - F.col("High") - F.col("Low")) / spread, F.lit(0.0)) * F.col("Volume")
    illiquid = F.abs("ret") / F.nullif(F.col("Close") * F.col("Volume"), F.lit(0.0))
    up = F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)
    return df.withColumns({"flow": flow, "illiquid": illiquid, "range": F.col("High") - F.col("Low"), "up": up, "obv": F.sum(F.coalesce("signed", F.lit(0.0))).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))})


#: over(kind, column, n, to=0): the aggregate of a column over the last n rows up to `to` rows from the current one.
Over = Callable[..., Column]


def window_over(kind: str, column: str, n: int, to: int = 0) -> Column:
    """As a window of Spark's, whose frame is walked for every row."""
    if kind == "lag":
        return F.lag(column, n).over(by_symbol())
    x = F.col(column)
    agg = {"max": F.max, "sum": F.sum, "avg": F.avg, "deviation": F.stddev_pop, "median": lambda c: F.percentile(c, 0.5), "slope": lambda c: F.regr_slope(c, "n")}[kind]
    return agg(x).over(rows(n, to))


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


#: name -> (family, least rows of history, factor). Callers may add their own.
REGISTRY: dict[str, tuple[str, int, Callable[[Over], Column]]] = {
    "mom_12_1": ("momentum", 252, lambda o: o("lag", "Close", 20) / _some(o("lag", "Close", 251)) - 1),
    "high_52w": ("momentum", 60, lambda o: 1 - (o("max", "Close", 252) - F.col("Close")) / _some(o("max", "Close", 252))),
    "amihud": ("liquidity", 25, lambda o: -o("avg", "illiquid", 20)),
    "obv_slope": ("volume", 25, lambda o: o("slope", "obv", 20) / F.greatest(F.abs(o("avg", "obv", 20)), F.lit(1.0))),
    "chaikin_mf": ("volume", 21, lambda o: o("sum", "flow", 20) / _some(o("sum", "Volume", 20))),
    "mean_rev_z": ("reversal", 25, lambda o: -(F.col("Close") - o("avg", "Close", 20)) / _some(o("deviation", "Close", 20))),
    "breakout": ("momentum", 25, lambda o: (F.col("Close") - o("max", "Close", 20, -1)) / _some(o("avg", "range", 20))),
    "gap": ("reversal", 25, lambda o: o("median", "gap", 20)),
    "vol_term": ("volatility", 65, lambda o: -o("deviation", "ret", 20) / _some(o("deviation", "ret", 60))),
    "low_vol": ("volatility", 60, lambda o: -o("deviation", "ret", 60)),
    "dd_recovery": ("momentum", 60, lambda o: 1 - (o("max", "Close", 60) - F.col("Close")) / _some(o("max", "Close", 60))),
    "up_ratio": ("momentum", 15, lambda o: o("avg", "up", 21)),
    "quiet_uptrend": ("momentum", 20, lambda o: o("slope", "Close", 20) / _some(o("deviation", "Close", 20))),
    "volume_surge": ("volume", 60, lambda o: o("avg", "Volume", 5) / _some(o("avg", "Volume", 60))),
    "over_ma50": ("momentum", 50, lambda o: F.col("Close") / _some(o("avg", "Close", 50)) - 1),
}


def alpha(bars: DataFrame, name: str) -> DataFrame:
    """(Date, Symbol, value) of one factor, where the symbol has enough history and the factor is defined."""
    _, least, column = REGISTRY[name]
    return prepared(bars).withColumn("value", F.when(F.col("n") >= least, column(window_over))).where("value is not null").select("Date", "Symbol", "value")


def alpha_columns(bars: DataFrame, names=tuple(REGISTRY), others: tuple[str, ...] = ()) -> DataFrame:
    """(Date, Symbol, others, a column a factor): all factors from one pass over each symbol's rows; null where there is not enough history."""
    frames: list[Frame] = []

    def over(*of) -> Column:
        frames.append(Frame(*of))
        return F.col(frames[-1].name)

    factors = [F.when(F.col("n") >= REGISTRY[k][1], REGISTRY[k][2](over)).alias(k) for k in names]
    return with_frames(prepared(bars), frames, "n").select("Date", "Symbol", *others, *factors)


def alpha_panel(bars: DataFrame, names=tuple(REGISTRY)) -> DataFrame:
    """(Date, Symbol, alpha, value): all factors in long form, where they are defined."""
    return alpha_columns(bars, names).unpivot(["Date", "Symbol"], list(names), "alpha", "value").where("value is not null")


def alpha_zoo(panel: DataFrame, keep: Keep) -> DataFrame:
    """(Date, Symbol, Zoo_Score, Zoo_Coverage): the mean percentile of a symbol's factors at a date, and how many it has. keep(df, name) writes a table and returns it."""
    shares = ranked(panel, ["Date", "alpha"], "value", keep).withColumn("pr", F.col("rank") / F.col("n") * 100)
    return shares.groupBy("Date", "Symbol").agg(F.avg("pr").alias("Zoo_Score"), F.count("pr").alias("Zoo_Coverage"))


def zoo_columns(wide: DataFrame, names, keep: Keep, most: int | None = None) -> DataFrame:
    """As alpha_zoo, from rows with a column a factor (Date, Symbol, names), which are shuffled once by date. most: as in with_ranks."""
    rows = with_ranks(wide, {f"_{k}": F.col(k) for k in names}, keep, most, ("Date", "Symbol"))
    shares = F.array_compact(F.array(*(share(f"_{k}") * 100 for k in names)))
    total = F.aggregate(shares, F.lit(0.0), lambda s, v: s + v)
    n = F.size(shares)
    return rows.where(n > 0).select("Date", "Symbol", (total / n).alias("Zoo_Score"), n.cast("long").alias("Zoo_Coverage"))


def asof_overlay(signals: DataFrame, overlay: DataFrame, column: str) -> DataFrame:
    """(Symbol, Date, column): the overlay's last non-null value on or before each signal date, null before the first.

    Both sides are stacked and filled forward within the symbol, an as-of join in one shuffle.
    """
    left = signals.select("Symbol", "Date", F.lit(None).cast(overlay.schema[column].dataType).alias(column), F.lit(1).alias("side"))
    right = overlay.select("Symbol", "Date", column, F.lit(0).alias("side"))
    w = by_symbol().orderBy("Date", "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.unionByName(right).withColumn(column, F.last(column, ignorenulls=True).over(w))
    return filled.where("side = 1").drop("side")


def delivery_momentum(overlay: DataFrame, column: str = "Delivery_Pct") -> DataFrame:
    """(Symbol, Date, value): mean of the last 5 less mean of the last 20 values, where there are 20."""
    x = F.col(column)
    df = overlay.where(x.isNotNull())
    value = F.when(F.count(x).over(rows(20)) >= 20, F.avg(x).over(rows(5)) - F.avg(x).over(rows(20)))
    return df.withColumn("value", value).select("Symbol", "Date", "value")


def register_pandas_alpha(name: str, family: str, function) -> None:
    """A factor from a pandas function of one symbol's bars in order of date (a series of the same length); run by pandas_alpha."""
    PANDAS[name] = (family, function)


#: name -> (family, function of a symbol's frame). The way for what columns cannot express.
PANDAS: dict[str, tuple] = {}


def pandas_alpha(bars: DataFrame, name: str) -> DataFrame:
    """(Date, Symbol, value) of a registered pandas factor; a symbol's bars are one group."""
    function = PANDAS[name][1]

    def run(frame):
        frame = frame.sort_values("Date")
        return frame[["Date", "Symbol"]].assign(value=function(frame).astype(float))

    return bars.groupBy("Symbol").applyInPandas(run, "Date date, Symbol string, value double").where("value is not null and not isnan(value)")
