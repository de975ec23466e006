"""Aggregates over frames of each symbol's rows, all in one pass in Arrow: a look of numpy a step of the frame serves all rows of many symbols."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


class Frame(NamedTuple):
    """An aggregate over the last n rows up to `to` rows from the current one; lag is the value n rows earlier, slope that by the row number."""

    kind: str
    column: str
    n: int
    to: int = 0

    @property
    def name(self) -> str:
        return f"_{self.kind}_{self.column}_{self.n}_{-self.to}"


class _Rows:
    """The frames of rows of whole symbols, each symbol's rows in order. Sums, deviations and slopes take their values one by one, the oldest first, as Spark's own do, so that results are the same to the bit."""

    def __init__(self, table: pa.Table, number: str):
        self.table, self.number, self.rows, self.known = table, number, len(table), {}
        self.place = table.column(number).to_numpy() - 1
        self.longest = int(self.place.max()) + 1

    def column(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none, and where there are some."""
        if name not in self.known:
            c = self.table.column(name).combine_chunks()
            there = c.is_valid().to_numpy(zero_copy_only=False)
            self.known[name] = c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), there
        return self.known[name]

    def moved(self, a: np.ndarray, k: int, empty: float = 0) -> np.ndarray:
        """a moved down by k rows within each symbol."""
        if not k:
            return a
        out = np.full_like(a, empty)
        out[k:] = np.where(self.place[k:] >= k, a[:-k], a.dtype.type(empty)) if k < self.rows else a[:0]
        return out

    def looks(self, f: Frame, *arrays: np.ndarray):
        """The arrays as seen from each row, for each step of the frame, the oldest first."""
        for k in range(min(f.n - f.to, self.longest) - 1, -f.to - 1, -1):
            yield tuple(self.moved(a, k) for a in arrays)

    def once(self, key: tuple, make):
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def sums(self, f: Frame) -> tuple[np.ndarray, np.ndarray]:
        def make():
            total, count = np.zeros(self.rows), np.zeros(self.rows)
            for x, there in self.looks(f, *self.column(f.column)):
                total += x
                count += there
            return total, count

        return self.once(("sums", *f[1:]), make)

    def sum(self, f: Frame):
        total, count = self.sums(f)
        return total, count > 0

    def avg(self, f: Frame):
        total, count = self.sums(f)
        return total / count, count > 0

    def deviation(self, f: Frame):
        n, mean, m2 = (np.zeros(self.rows) for _ in range(3))
        for x, there in self.looks(f, *self.column(f.column)):
            n += there
            delta = np.where(there, x - mean, 0.0)
            step = delta / np.maximum(n, 1.0)
            mean += step
            m2 += delta * (delta - step)
        return np.sqrt(m2 / n), n > 0

    def slope(self, f: Frame):
        (y, some), (x, numbered) = self.column(f.column), self.column(self.number)
        n, mx, my, ck, m2 = (np.zeros(self.rows) for _ in range(5))
        for a, b, there in self.looks(f, x, y, some & numbered):
            n += there
            at = np.maximum(n, 1.0)
            dx, dy = np.where(there, a - mx, 0.0), np.where(there, b - my, 0.0)
            step = dx / at
            mx += step
            my += dy / at
            ck += np.where(there, dx * (b - my), 0.0)
            m2 += dx * (dx - step)
        return ck / m2, (n > 0) & (m2 != 0)

    def max(self, f: Frame):
        """By looks over 1, 2, 4, ... rows."""
        x, some = self.column(f.column)
        high, size = np.where(some, x, -np.inf), 1
        while size < min(f.n, self.longest):
            k = min(size, f.n - size)
            size += k
            high, some = np.maximum(high, self.moved(high, k, -np.inf)), some | self.moved(some, k)
        return self.moved(high, -f.to), self.moved(some, -f.to)

    def median(self, f: Frame):
        seen = [np.where(there, x, np.inf) for x, there in self.looks(f, *self.column(f.column))]
        if not seen:
            return np.zeros(self.rows), np.zeros(self.rows, bool)
        count = self.sums(f)[1].astype(np.int64)
        ordered, at = np.sort(np.stack(seen, 1), axis=1), np.arange(self.rows)
        last = np.maximum(count - 1, 0)
        low, high = ordered[at, last // 2], ordered[at, (last + 1) // 2]
        return np.where(last % 2 == 0, low, 0.5 * low + 0.5 * high), count > 0

    def lag(self, f: Frame):
        return tuple(self.moved(a, f.n) for a in self.column(f.column))


def _whole(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[pa.Table]:
    """The rows of batches, cut where a symbol ends."""
    held, last = [], 0
    for batch in batches:
        if not len(batch):
            continue
        n = batch.column(batch.schema.get_field_index(number)).to_numpy()
        if not np.all((n == 1) | (n == np.concatenate([[last], n[:-1]]) + 1)):
            raise ValueError(f"the rows of a symbol are not together and in order of {number}")
        last = n[-1]
        starts = np.flatnonzero(n == 1)
        if len(starts):
            if held or starts[-1]:
                held.append(batch.slice(0, starts[-1]))
                yield pa.Table.from_batches(held)
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def with_frames(df: DataFrame, frames: list[Frame], number: str) -> DataFrame:
    """df with a column a frame, named by it; null where the frame holds no value.

    number: a column that numbers each symbol's rows from 1, by a window over the symbol, so that these rows are in one partition; a task takes the rows of a few symbols at a time.
    """
    wanted = list(dict.fromkeys(frames))
    if not wanted:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, number):
            rows = _Rows(table, number)
            with np.errstate(all="ignore"):
                for f in wanted:
                    values, there = getattr(rows, f.kind)(f)
                    table = table.append_column(f.name, pa.array(values, pa.float64(), mask=~there))
            yield from table.combine_chunks().to_batches()

    schema = StructType([*df.schema.fields, *(StructField(f.name, DoubleType()) for f in wanted)])
    return df.sortWithinPartitions("Symbol", number).mapInArrow(run, schema)
