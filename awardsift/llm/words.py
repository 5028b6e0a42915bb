"""Words of whole texts as NumPy arrays, for use inside Arrow tasks.

A batch of texts is one byte buffer with offsets. Words are found on the bytes (UTF-8 bytes of other
letters are all above 0x7F), hashed to 64 bits by prefix sums, and windows of n words by n shifted sums.
Everything is linear in the bytes, whole texts are read, and memory is bounded by ``CHUNK`` bytes at a
time or one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
WHITE = b" \t\n\v\f\r"

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _lower(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[0x41:0x5B] = table[0x61:0x7B]
    return out


_VALUES = {False: _table(7), True: _lower(_table(7))}


def _spaced() -> np.ndarray:
    out = np.ones(256, bool)
    out[list(WHITE)] = False
    return out


def _alnum() -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x41:0x5B] = out[0x61:0x7B] = True
    out[0x80:] = True
    return out


#: Bytes that belong to words: what is not white space, or ASCII letters, digits and everything beyond ASCII.
SPACED, ALNUM = _spaced(), _alnum()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words:
    """Words of some texts: byte positions, the text of each word, and where each text's words begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, lower: bool):
        self.data, self.bounds, self.lower = data, bounds, lower
        inside = np.empty(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = kind[data]
        opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        # a text's last byte and the next one's first may both be word bytes
        edge = bounds[1:-1]
        both = edge[inside[edge] & inside[edge + 1]] if len(edge) else edge
        opens[both] = closes[both] = True
        self.starts, self.ends = np.flatnonzero(opens[:-1]), np.flatnonzero(closes)
        self.first = np.searchsorted(self.starts, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        size = 1 << max(20, int(len(self.data)).bit_length())
        up, down = _powers(size)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[self.lower][self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def windows(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of n words within one text, and the windows' hashes."""
        count = len(hashes) - n + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        room = np.repeat(self.first[1:], self.counts)[:count] - np.arange(count) >= n
        at = np.flatnonzero(room)
        total = np.zeros(count, np.uint64)
        step = 1
        for k in range(n):
            total += hashes[k : k + count] * _U(step)
            step = step * _STEP & 0xFFFFFFFFFFFFFFFF
        return at, mix(total[at] + _U(n))

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()


def texts(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into pieces of about CHUNK bytes: first row, end row, bytes, bounds. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "") if column.null_count else column.cast(pa.large_string())
    if not len(column):
        return
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def words(column, kind: np.ndarray = SPACED, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, bounds in texts(column):
        yield row, end, Words(data, bounds, kind, lower)


#: A-Z only, as all contracts ask for.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
