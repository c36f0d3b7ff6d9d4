"""Words and their hashes for whole batches of texts, with numpy.

Texts arrive as one Arrow binary column. All of a piece's bytes are handled at once:
a table maps each byte to lower case, another tells word bytes, and word hashes come
from one running polynomial over the piece, so there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; a longer text is one piece of its own.
PIECE = 1 << 19
#: Fixed: seeds of the hash tables. All executors must use the same ones.
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but white space: [^\x20\x09-\x0D]
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Letters, digits and all bytes above ASCII, after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASE]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def binary(column: pa.Array) -> pa.Array:
    """The column as large_binary without nulls (null: empty)."""
    return column.cast(pa.large_binary()).fill_null(b"")


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of whole texts."""
    column = binary(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(mapped: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes that ``inside`` holds, cut at rows."""
    n = len(mapped)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = inside[mapped]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends


class Rolling:
    """Hashes of any byte ranges of one piece from running sums; ``which`` picks one of
    two independent hash functions."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self._down = _POWERS[which].upto(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        terms = _BYTE[which][data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self._sums[1:])

    def __call__(self, starts, ends) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def hashed(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(word hashes, row of each word, starts, ends) of one piece, lower-cased (A-Z)."""
    mapped = LOWER[data]
    starts, ends = spans(mapped, offsets, inside)
    row = np.searchsorted(offsets, starts, "right") - 1
    return Rolling(mapped)(starts, ends), row, starts, ends


def word_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's words, for sorted ``row``."""
    return np.searchsorted(row, np.arange(rows + 1))


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
