"""Words and their hashes from Arrow string columns, as numpy arrays over slices of about a megabyte.

Texts are read from Arrow's buffers as UTF-8 bytes; all separators are ASCII, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64


def _table(is_word) -> np.ndarray:
    return np.array([bool(is_word(c)) for c in range(256)])


#: Words as the contracts define them: all but space and the control characters 9 to 13.
PLAIN = _table(lambda c: c != 0x20 and not 9 <= c <= 13)
#: Letters, digits and everything beyond ASCII.
ALNUM = _table(lambda c: chr(c).isalnum() if c < 128 else True)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Poly:
    """Polynomial hashes modulo 2**64 of ranges of a sequence, from one cumulative sum."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = rng.integers(1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
        self.pw = self.iv = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.pw) < n:
            one = np.ones(1, dtype=np.uint64)
            self.pw = np.concatenate([one, np.cumprod(np.full(n - 1, self.base, dtype=np.uint64))])
            self.iv = np.concatenate([one, np.cumprod(np.full(n - 1, self.inverse, dtype=np.uint64))])

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.pw[: len(values)], out=out[1:])
        return out

    def span(self, sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [i, j)."""
        return (sums[j] - sums[i]) * self.iv[i]

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.span(self.sums(self.bytes[buf]), start, end) + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of the texts of one slice: byte ranges, the row of each, and each row's range of words."""

    row: int
    rows: int
    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, most: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of slices of whole texts, about `limit` bytes and at most `most` rows each."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, i + most, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split_words(row: int, rows: int, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN) -> Words:
    n = len(buf)
    inside = table[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(rows), np.diff(first))
    return Words(row, rows, buf, offsets, start, end, doc, first)


def word_slices(column: pa.Array, table: np.ndarray = PLAIN, limit: int = SLICE_BYTES) -> Iterator[Words]:
    for part in text_slices(column, limit):
        yield split_words(*part, table)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
