"""Texts of an Arrow batch as one byte array, and hashes over it; numpy inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of text worked on at once, but for a single longer text.
PART = 1 << 20


def flat(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts; where each text starts and ends. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def parts(batch: pa.RecordBatch, at: int = 1, limit: int = PART, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of column ``at``, and ``rows`` rows at most."""
    if not batch.num_rows:
        return
    _, starts, ends = flat(batch.column(at))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, min(first + rows, int(np.searchsorted(ends, starts[first] + limit, side="right"))))
        yield batch.slice(first, last - first)
        first = last


_MIX = U64(30), U64(0xBF58476D1CE4E5B9), U64(27), U64(0x94D049BB133111EB), U64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    a, b, c, d, e = _MIX
    x = (x ^ (x >> a)) * b
    x = (x ^ (x >> c)) * d
    return x ^ (x >> e)


class Rolling:
    """64-bit hashes of any byte ranges of one array, in a few steps each."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._powers) <= n:
            for name, root in (("_powers", _ROOT), ("_inverse", _INVERSE)):
                x = np.full(n + (n >> 2) + 2, root, np.uint64)
                x[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(x))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * Rolling._powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Rolling._inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that ``space`` (256 booleans) lacks: start, end, and where each text's words begin (one more)."""
    n = len(data)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[starts[starts < n]] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[data[:-1]] | edge[1:n]
    last[:-1] &= space[data[1:]] | edge[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.concatenate([np.searchsorted(a, starts), [len(a)]])


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
