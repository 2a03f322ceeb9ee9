"""Periodic runs of words in whole texts, found by internal pattern matching.

A run is a stretch of words that repeats itself every ``period`` words, three
times or more and over 24 words at least, and that no neighbouring word extends.

Words become numbers, and a suffix array over them (by prefix doubling, every
text for itself) names the block of ``2**k`` words at every place.  A wavelet
tree over the suffix array answers *range successor* queries: which is the next
place, after a given one, among the suffixes that begin with this block.  Every
dyadic block asks for its own occurrences in the window of twice its length
behind it.  Occurrences that overlap by half form a progression whose step is
the block's period; of a progression only the step itself and the members whose
stretch ends (or begins) as the block's own stretch does can be the period of a
longer run.  Each candidate is then extended both ways by block names.

A run of period q holds a dyadic block of the largest size up to q (eight words
for periods below eight) whose copy q words on lies in the run too, so every run
is found.  A text in which no eight words occur twice has none.  All of it is
arrays over about a megabyte of text at a time; one longer text is handled
alone and takes about 60 bytes a word and 4 more for each doubling of its
longest repeat.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches
from truecolumn.llm.words import mix, slices

#: Words of a run at least, and its length in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The smallest blocks that are looked up have ``2**FIRST_LEVEL`` words.
FIRST_LEVEL = 3

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class WordTable:
    """Words of some texts: word j is ``data[begin[j]:begin[j + 1]]``, text i has words ``at[i]:at[i + 1]``."""

    data: np.ndarray
    begin: np.ndarray
    at: np.ndarray

    def numbers(self) -> np.ndarray:
        """One number for each distinct word, equal for equal bytes only."""
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.begin) - 1, [None, pa.py_buffer(self.begin.astype(np.int64)), pa.py_buffer(self.data)]
        )
        return np.asarray(words.dictionary_encode().indices, dtype=np.int64)

    def joined(self, places: np.ndarray) -> bytes:
        """The words at these places, joined by one space."""
        if not len(places):
            return b""
        sizes = (self.begin[1:] - self.begin[:-1])[places]
        ends = np.cumsum(sizes + 1)
        out = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
        within = np.arange(int(sizes.sum()), dtype=np.int64)
        before = np.cumsum(sizes) - sizes
        out[within + np.repeat(np.arange(len(places)), sizes)] = self.data[within + np.repeat(self.begin[places] - before, sizes)]
        return out[:-1].tobytes()


    def texts(self) -> list[bytes]:
        """Every text's words, joined by one space."""
        out = np.full(len(self.data) + len(self.begin), 0x20, dtype=np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))] = self.data
        edges = (self.begin[self.at] + self.at).tolist()
        return [out[a : max(a, b - 1)].tobytes() for a, b in zip(edges, edges[1:], strict=False)]


def split_words(column: pa.Array) -> WordTable:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; a null text has none."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return WordTable(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(len(column) + 1, np.int64))
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[first:last]
    offsets = offsets - first
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    opens[borders] = inside[borders]
    starts = np.flatnonzero(opens)
    # Where each word begins once the white space is gone.
    begin = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside))
    return WordTable(data[inside], begin, np.searchsorted(starts, offsets))


class Wavelet:
    """Wavelet tree (one array per bit) over a list of numbers; all queries work on arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            counts = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(low, out=counts[1:])
            self.zeros.append(counts)
            values = np.concatenate([values[low], values[~low]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers ``left:right`` are less than ``x`` (which fits the bits)."""
        count = np.zeros(len(x), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[left], zeros[right]
            high = (x >> bit) & 1 == 1
            count += np.where(high, b - a, 0)
            left, right = np.where(high, zeros[-1] + left - a, a), np.where(high, zeros[-1] + right - b, b)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the numbers ``left:right``."""
        value = np.zeros(len(k), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[left], zeros[right]
            high = k >= b - a
            value |= high.astype(np.int64) << bit
            k = np.where(high, k - (b - a), k)
            left, right = np.where(high, zeros[-1] + left - a, a), np.where(high, zeros[-1] + right - b, b)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least of the numbers ``left:right`` that is ``x`` or more, -1 where there is none."""
        found = np.full(len(x), -1, dtype=np.int64)
        fits = np.flatnonzero(x < 1 << self.bits)
        left, right, x = left[fits], right[fits], x[fits]
        k = self.below(left, right, x)
        some = k < right - left
        found[fits[some]] = self.smallest(left[some], right[some], k[some])
        return found


class Blocks:
    """Names of the blocks of ``2**k`` words at every place, and the suffix array they add up to.

    Two places have the same name at level k where the same ``2**k`` words of
    the same text begin; a block that would reach beyond its text is like no
    other.  Names follow the order of the suffixes.
    """

    def __init__(self, numbers: np.ndarray, text: np.ndarray, left: np.ndarray):
        """``text`` numbers the text of each word, ``left`` says how many words its text still has (itself included)."""
        n = len(numbers)
        self.left = left
        names = np.unique(text * (int(numbers.max(initial=0)) + 1) + numbers, return_inverse=True)[1]
        self.names = [self._kept(names)]
        most = int(left.max(initial=0)) // LEAST_PERIODS
        size = 1
        while size < most and int(names.max(initial=0)) < n - 1:
            behind = np.zeros(n, dtype=np.int64)
            inner = np.flatnonzero(left > size)
            behind[inner] = names[inner + size] + 1
            names = np.unique(names * (n + 1) + behind, return_inverse=True)[1]
            self.names.append(self._kept(names))
            size *= 2
        self.suffixes = np.argsort(names, kind="stable")

    @staticmethod
    def _kept(names: np.ndarray) -> np.ndarray:
        return np.append(names, -1).astype(np.int32)

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from ``x`` on equal those from ``y`` on (x < y, one text)."""
        x, y, begin = x.copy(), y.copy(), x
        for level in range(len(self.names) - 1, -1, -1):
            names, active = self.names[level], np.arange(len(x))
            while len(active):
                active = active[names[x[active]] == names[y[active]]]
                x[active] += 1 << level
                y[active] += 1 << level
                if level < len(self.names) - 1:
                    break
        return x - begin

    def backward(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many words before ``x`` equal those before ``y``, ``first`` being the place where the text begins."""
        x, y, begin = x.copy(), y.copy(), x
        for level in range(len(self.names) - 1, -1, -1):
            names, step, active = self.names[level], 1 << level, np.arange(len(x))
            while len(active):
                active = active[x[active] - step >= first[active]]
                active = active[names[x[active] - step] == names[y[active] - step]]
                x[active] -= step
                y[active] -= step
                if level < len(self.names) - 1:
                    break
        return begin - x


def candidates(blocks: Blocks, tree: Wavelet, level: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of dyadic blocks of one level, and distances that may be the period of a run around them."""
    size = 1 << level
    names = blocks.names[level][:-1]
    place = np.arange(len(names))
    b = place[((place - first) % size == 0) & (blocks.left >= size)]
    ordered = names[blocks.suffixes]
    left, right = np.searchsorted(ordered, names[b], side="left"), np.searchsorted(ordered, names[b], side="right")
    twice = right - left > 1
    b, left, right = b[twice], left[twice], right[twice]
    x = tree.successor(left, right, b + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        # One occurrence each, in the window behind its block.
        near = (x >= 0) & (x - b < 2 * size)
        b, left, right, x = b[near], left[near], right[near], x[near]
        if not len(b):
            break
        found.append((b, x - b))
        after = tree.successor(left, right, x + 1)
        step = after - x
        many = (after >= 0) & (step <= size // 2)
        if many.any():
            # A progression: its stretch of period ``p`` goes on to ``end``.
            c, y, p, begin = b[many], x[many], step[many], first[b[many]]
            end = y + p + blocks.forward(y, y + p)
            found.append((c, end - (c + p + blocks.forward(c, c + p))))
            found.append((c, (y - blocks.backward(y, y + p, begin)) - (c - blocks.backward(c, c + p, begin))))
            last = y + (end - size - y) // p * p
            after[many] = tree.successor(left[many], right[many], last + 1)
        x = after
    if not found:
        return b, b
    b, d = (np.concatenate(part) for part in zip(*found, strict=True))
    # Shorter periods are found at the levels below.
    good = (d >= (1 if level == FIRST_LEVEL else size)) & (d < 2 * size)
    return b[good], d[good]


def runs_of(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, as places in ``numbers``; text i is ``at[i]:at[i + 1]``."""
    sizes = np.diff(at)
    none = np.zeros(0, dtype=np.int64)
    # A run of 24 words and three periods repeats a block of eight words.
    wide = 1 << FIRST_LEVEL
    h = mix(numbers.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4):
        h = mix(h[:-step] * np.uint64(3) + h[step:]) if len(h) > step else h[:0]
    text = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.flatnonzero(text[: len(h)] == text[wide - 1 : wide - 1 + len(h)])
    key = mix(h[inner] + mix(text[inner].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeats = np.zeros(len(sizes), dtype=bool)
    repeats[text[inner[order[1:][same]]]] = True
    repeats &= sizes >= LEAST_WORDS
    if not repeats.any():
        return none, none, none

    place = np.flatnonzero(repeats[text])
    some = sizes[repeats]
    begin = np.cumsum(some) - some
    first = np.repeat(begin, some)
    left = np.repeat(begin + some, some) - np.arange(len(place))
    blocks = Blocks(numbers[place], np.repeat(np.arange(len(some)), some), left)
    tree = Wavelet(blocks.suffixes)
    levels = range(FIRST_LEVEL, len(blocks.names))
    found = [candidates(blocks, tree, k, first) for k in levels]
    if not found:
        return none, none, none
    b, d = (np.concatenate(part) for part in zip(*found, strict=True))
    start = b - blocks.backward(b, b + d, first[b])
    length = b + d + blocks.forward(b, b + d) - start
    good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d)
    start, length, d = start[good], length[good], d[good]
    order = np.lexsort((d, length, start))
    start, length, d = start[order], length[order], d[order]
    # The same stretch with a multiple of its period is the same run.
    new = np.ones(len(d), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, d = place[start[new]], length[new], d[new]
    order = np.lexsort((d, start))
    return start[order], length[order], d[order]


def _longer(one: tuple[int, int, int], two: tuple[int, int, int]) -> int:
    """Order by exact exponent, largest first, then start, then period."""
    (s, n, p), (t, m, q) = one, two
    return m * p - n * q or s - t or p - q


def planted(key: object, n: int) -> tuple[int, int] | None:
    """Where the text of this key is made periodic, and with which period; for nine keys of ten nowhere."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


OUTPUT = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _texts(column: pa.Array, keys: list | None) -> Iterator[tuple]:
    """A row of ``OUTPUT`` for every text, and its kept words."""
    words = split_words(column)
    at, total = words.at, len(words.begin) - 1
    source = np.arange(total)
    for i, key in enumerate(keys or ()):
        if hit := planted(key, int(at[i + 1] - at[i])):
            a, p = hit
            begin = at[i] + a
            source[begin : at[i + 1]] = begin + np.arange(at[i + 1] - begin) % p
    start, length, period = runs_of(words.numbers()[source], at)
    marks = np.zeros(total + 1, dtype=np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.cumsum(marks[:-1]) == 0
    edges = np.searchsorted(start, at)
    changed = np.concatenate([[0], np.cumsum(~kept | (source != np.arange(total)))])[at]
    whole = words.texts()
    for i in range(len(at) - 1):
        begin, end = int(at[i]), int(at[i + 1])
        of = slice(edges[i], edges[i + 1])
        runs = list(zip((start[of] - begin).tolist(), length[of].tolist(), period[of].tolist(), strict=True))
        text = words.joined(source[begin:end][kept[begin:end]]) if changed[i + 1] > changed[i] else whole[i]
        best = min(runs, key=cmp_to_key(_longer)) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        yield (
            end - begin, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
        ), runs, text


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Runs of every row of ``docs``: its key, ``runs``, the text without repeats, and digests.

    Columns: the key, those of ``OUTPUT``, ``runs`` (start, length, period by
    start and period; word numbers from 0) and ``collapsed`` (the words that no
    run holds after its first period, joined by one space).  ``plant`` makes one
    text of ten periodic first, as ``planted`` says from its key.

    A null or blank text has no words and no runs; a row without a key is never
    planted; repeated rows are all reported; further columns are not read.  The
    pass is narrow: no row meets another.
    """
    arrow_batches(docs.sparkSession)
    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, {OUTPUT}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    shape = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(_texts(part["text"], part["key"].to_pylist() if plant else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*(row for row, _, _ in found), strict=True), types, strict=True)]
                lists = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs, _ in found], shape)
                texts = pa.array([t for _, _, t in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part["key"], *columns, lists, texts],
                    names=["key", *(c.split()[0] for c in OUTPUT.split(", ")), "runs", "collapsed"],
                )

    return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)


def run_digests(docs: DataFrame) -> DataFrame:
    """The query's columns, with every tenth text made periodic."""
    return periodic_runs(docs, plant=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
