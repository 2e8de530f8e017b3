"""Words of Arrow string columns as numpy arrays: ASCII lower-casing, splitting at
``[\\x20\\x09-\\x0D]`` and 64-bit hashes, a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from threadloom.llm.shared import held

CHUNK_BYTES = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = np.random.RandomState(20240101).randint(1, 1 << 62, 256).astype(np.uint64)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 with full avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; those for one run of rows are kept."""
    if _powers and n <= len(_powers[0][0]):
        return _powers[0]
    size = max(CHUNK_BYTES, n)
    with np.errstate(over="ignore"):
        base = np.full(size, _U(_P)), np.full(size, _U(_P_INV))
        for b in base:
            b[0] = _U(1)
            np.multiply.accumulate(b, out=b)
    if size == CHUNK_BYTES:
        _powers.append(base)
    return base


@dataclass
class Words:
    """The words of consecutive rows: row ``i`` owns words ``row[i]`` to ``row[i + 1]``."""

    first: int
    rows: int
    hash: np.ndarray
    row: np.ndarray
    tail: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.row))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(column: pa.Array) -> Iterator[Words]:
    """The words of each run of rows of ``column``."""
    held("words")
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        text = _LOWER[data[offsets[i] : offsets[j]]]
        n = len(text)
        if n == 0:
            yield Words(i, j - i, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64), np.zeros(0, np.int64))
            continue
        inside = ~_GAP[text]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts_row = at[:-1][at[:-1] < n]
        begins[starts_row] = inside[starts_row]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last_of_row = at[1:][at[1:] > 0] - 1
        ends[last_of_row] = inside[last_of_row]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _power(n)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE_CODE[text] * power[:n], out=total[1:])
            h = mix((total[e] - total[b]) * inverse[b] + (e - b).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        last = text[e - 1].astype(np.int64)
        before = np.where(e - b > 1, text[np.maximum(e - 2, 0)], 0).astype(np.int64)
        yield Words(i, j - i, h, np.searchsorted(b, at), last * 256 + before)


def shingle_sets(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets by row); fewer than ``size`` words make one shingle."""
    counts = np.diff(w.row)
    n = len(w.hash)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(w.rows + 1, np.int64)
    with np.errstate(over="ignore"):
        long = n - size + 1
        h = np.zeros(max(long, 0), np.uint64)
        for k in range(size):
            if long > 0:
                h = (h + w.hash[k : k + long]) * _U(_P) + _U(k + 1)
        starts = np.arange(max(long, 0))
        row = np.searchsorted(w.row, starts, "right") - 1
        whole = starts + size <= w.row[row + 1]
        h, row = mix(h[whole]), row[whole]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = counts[short] > k
                extra[has] = (extra[has] + w.hash[w.row[short[has]] + k]) * _U(_P) + _U(k + 1)
            extra = mix(extra + counts[short].astype(np.uint64) * _U(0xA0761D6478BD642F))
            h, row = np.concatenate([h, extra]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(w.rows + 1))
