"""Words and word windows of whole texts as 64-bit hashes, many texts at a time.

A word is a run of bytes outside space, tab, line feed, vertical tab, form feed
and carriage return.  Hashes are polynomials over the bytes (over the word
hashes for windows) modulo 2**64 with random byte values, finished by a mixing
step.  Powers of an odd base have inverses, so all hashes of a batch come from
one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case, and ASCII punctuation as white space.
_PLAIN = _LOWER.copy()
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [
            np.cumprod(np.where(np.arange(size) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64)
            for b in (_BASE, _INVERSE)
        ]
    return _powers[0], _powers[1]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text each."""
    sizes = np.cumsum(np.asarray(pc.binary_length(batch[column]).fill_null(0), dtype=np.int64))
    begin, done = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin, done = end, int(sizes[end - 1])


@dataclass
class Words:
    """``hashes`` of all words; words of text i are ``at[i]:at[i + 1]``."""

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray  # first byte of each word in data
    ends: np.ndarray
    data: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.at) - 1


def words_of(column: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Words of a string column; a null text has none.

    ``lower`` folds A-Z; ``plain`` also parts words at ASCII punctuation.
    """
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), none, none, np.zeros(0, np.uint8))
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[first:last]
    if lower or plain:
        data = (_PLAIN if plain else _LOWER)[data]
    offsets = offsets - first
    inside = ~_SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, over text borders too."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def whole(hashes: np.ndarray) -> int:
    """Hash of the whole word sequence."""
    return int(windows(hashes, len(hashes))[0]) if len(hashes) else 0
