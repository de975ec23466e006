"""Small helpers for the operators that are DataFrame functions throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast after its rows were counted.
SMALL_ROWS = 100_000


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it in a lambda for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has at most `rows` rows, else to be merged with."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def sided(df: DataFrame, n: int, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of n rows, to be broadcast if these are at most `rows`, else to be merged with."""
    return F.broadcast(df) if n <= rows else df.hint("merge")
