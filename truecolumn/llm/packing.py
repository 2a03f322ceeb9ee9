"""Token sequences packed into rows of one length, best fit decreasing.

Documents longer than a row are cut into whole rows and a rest; nothing is
dropped or truncated.  A task packs what it reads in blocks of ``BLOCK_TOKENS``:
pieces are taken by falling length, and a segment tree over the free space finds
the fullest row that still has room.  No shuffle, no global state; memory is one
block, and the waste is at most a few open rows of each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.bpe import read_ranks
from truecolumn.llm.common import arrow_batches

ROW_TOKENS = 2048
BLOCK_TOKENS = 2_000_000
#: An id that no token has, for the free space at a row's end.
PAD = 50_256


class FreeSpace:
    """Open rows by free space; the tightest fit in logarithmic time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, space: int, by: int) -> None:
        i = self.leaves + space
        while i:
            self.counts[i] += by
            i >>= 1

    def put(self, row: int, space: int) -> None:
        if space:
            self.rows[space].append(row)
            self._add(space, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest free space of at least ``least``, and that space."""
        i = self.leaves + least
        if not self.counts[i]:
            # Up until a right neighbour has a row, then down to its leftmost leaf.
            while i > 1 and (i & 1 or not self.counts[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.counts[2 * i] else 2 * i + 1
        space = i - self.leaves
        self._add(space, -1)
        return self.rows[space].pop(), space


@dataclass
class Piece:
    """Tokens ``start`` to ``start + length`` of a document; ``ids`` holds just these."""

    doc_id: int | None
    start: int
    ids: np.ndarray


def cut(doc_id: int | None, ids: np.ndarray, length: int) -> list[Piece]:
    return [Piece(doc_id, i, ids[i : i + length]) for i in range(0, len(ids), length)]


def best_fit(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """Rows of pieces; equal lengths keep their order."""
    rows: list[list[Piece]] = []
    space = FreeSpace(length)
    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        size = len(piece.ids)
        found = space.take(size) if size < length else None
        if found is None:
            rows.append([piece])
            space.put(len(rows) - 1, length - size)
        else:
            row, free = found
            rows[row].append(piece)
            space.put(row, free - size)
    return rows


def _packed_batch(rows: list[list[Piece]], length: int, pad: int, kind: str) -> pa.RecordBatch:
    matrix = np.full((len(rows), length), pad, dtype=kind)
    ends = []
    for i, row in enumerate(rows):
        sizes = [len(p.ids) for p in row]
        at = np.cumsum([0, *sizes])
        matrix[i, : at[-1]] = np.concatenate([p.ids for p in row])
        ends.append(at.tolist())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r.tobytes() for r in matrix], pa.binary()),
            pa.array([e[-1] for e in ends], pa.int32()),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array([e[:-1] + ([e[-1]] if e[-1] < length else []) for e in ends], pa.list_(pa.int32())),
            pa.array([[p.doc_id for p in row] for row in rows], pa.list_(pa.int64())),
            pa.array([[p.start for p in row] for row in rows], pa.list_(pa.int64())),
        ],
        names=["ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
    )


def pack(tokens: DataFrame, length: int = ROW_TOKENS, pad: int = PAD, id_bytes: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ``length`` ids from ``tokens(doc_id, ids)``; ids are binary, little-endian unsigned 32-bit.

    * ``ids``: one row of the matrix, little-endian numbers of ``id_bytes`` bytes, padded with ``pad``;
    * ``n_tokens``: ids before the padding;
    * ``cu_seqlens``: ends of the segments, from 0;
    * ``position_resets``: where positions start at 0 again, the padding included;
    * ``doc_ids``, ``doc_starts``: each segment's document and its first token there.

    A document without tokens (null or empty text) has no segment; a null
    ``doc_id`` stays null; repeated rows are packed as often as they occur.  An
    id that does not fit ``id_bytes`` fails the job.
    """
    arrow_batches(tokens.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    highest = (1 << (8 * id_bytes)) - 1

    def run(batches):
        pieces: list[Piece] = []
        held = 0
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                ids = np.frombuffer(raw or b"", dtype="<u4")
                if len(ids) and int(ids.max()) > highest:
                    raise ValueError(f"id {int(ids.max())} does not fit {id_bytes} bytes")
                pieces += cut(doc_id, ids, length)
                held += len(ids)
                if held >= block:
                    yield from _batches(pieces, length, pad, kind)
                    pieces, held = [], 0
        if pieces:
            yield from _batches(pieces, length, pad, kind)

    schema = "ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"
    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, schema)


def _batches(pieces: list[Piece], length: int, pad: int, kind: str):
    rows = best_fit(pieces, length)
    for i in range(0, len(rows), 500):
        yield _packed_batch(rows[i : i + 500], length, pad, kind)


def position_ids(resets: list[int], length: int) -> np.ndarray:
    """The position of every id of a row."""
    starts = np.asarray(resets, dtype=np.int64)
    return np.arange(length) - np.repeat(starts, np.diff(np.append(starts, length)))


_encodings: dict[str, tiktoken.Encoding] = {}


def token_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of whole texts by a public vocabulary; a null text has no ids."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        if pattern not in _encodings:
            ranks = {token: i for i, token in enumerate(shared.value)}
            _encodings[pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _encodings[pattern].encode_to_numpy
        for batch in batches:
            ids = [encode(x, disallowed_special=()).astype("<u4").tobytes() if x else b"" for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids binary")


def write_packed(packed: DataFrame, folder: str) -> None:
    """The matrix and its side columns as Parquet files."""
    packed.write.option("compression", "zstd").parquet(folder)
