"""Windows over a symbol's bars and over a date's cross-section, and the rules pandas has for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_symbol() -> WindowSpec:
    """A symbol's rows in order of date. Built on call, as windows need a session."""
    return Window.partitionBy("Symbol").orderBy("Date")


def rows(n: int, to: int = 0):
    """The last n rows up to `to` rows from the current one."""
    return by_symbol().rowsBetween(to - n + 1, to)


def rolling(agg: Column, x: Column, n: int, least: int) -> Column:
    """agg over the last n rows, null where fewer than `least` of them have an x."""
    return F.when(F.count(x).over(rows(n)) >= least, agg.over(rows(n)))


def with_sums(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with running sums `_s<name>` and counts `_n<name>` of the columns within a symbol, from which frame_sum and frame_count take those of any frame.

    A frame of n rows then costs two looks instead of n. Running sums of doubles carry rounding of the order of the whole history's sum.
    """
    until = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_x{k}": c for k, c in columns.items()})
    return df.withColumns({f"_s{k}": F.sum(F.coalesce(F.col(f"_x{k}"), F.lit(0.0))).over(until) for k in columns} | {f"_n{k}": F.count(f"_x{k}").over(until) for k in columns}).drop(*(f"_x{k}" for k in columns))


def _last(c: str, n: int) -> Column:
    return F.col(c) - F.coalesce(F.lag(c, n).over(by_symbol()), F.lit(0))


def frame_sum(name: str, n: int) -> Column:
    return _last(f"_s{name}", n)


def frame_count(name: str, n: int) -> Column:
    return _last(f"_n{name}", n)


def frame_mean(name: str, n: int, least: int) -> Column:
    """Mean over the last n rows, null where fewer than `least` of them have a value."""
    k = frame_count(name, n)
    return F.when(k >= least, frame_sum(name, n) / k)


def change(x: Column, n: int = 1) -> Column:
    """x against its value n rows earlier, as a fraction."""
    return x / F.nullif(F.lag(x, n).over(by_symbol()), F.lit(0.0)) - 1


def average_rank(x: Column, *keys: str, ascending: bool = True) -> Column:
    """Ranks within `keys` with ties averaged, null where x is null. x is compared at 10 decimals, so float noise makes no order."""
    v = F.round(x, 10)
    order = Window.partitionBy(*keys).orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_last())
    ties = F.count(v).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # in the rank's own sort
    return F.when(v.isNotNull(), F.rank().over(order) + (ties - 1) / F.lit(2.0))


def percent_rank(x: Column, *keys: str) -> Column:
    """Average rank as a share of the non-null values."""
    return average_rank(x, *keys) / F.count(F.round(x, 10)).over(Window.partitionBy(*keys))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def flag(b: Column) -> Column:
    """1.0 where b holds, else 0.0, null counting as not."""
    return F.when(F.coalesce(b, F.lit(False)), 1.0).otherwise(0.0)


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson's correlation, null where either side does not vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b))), F.lit(0.0))
