"""Byte-level BPE encoding and decoding with recursive queries inside each partition.

A text is split by the vocabulary's pattern.  The distinct pieces of a batch
that a worker has not met go to an in-process DuckDB as lists of tokens, one
for each byte.  A recursive query joins neighbours with the merge table and
contracts, in every piece, the leftmost pair of the smallest rank, until no
pair is left.  An ordered aggregation over the tokens' bytes turns ids into
bytes again.  Pieces and ids never leave the task.

A contraction per round suits words.  A piece of more than ``LONGEST`` bytes
would need as many rounds as bytes, so a heap takes its pairs in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches
from truecolumn.llm.words import slices

#: Pieces of up to so many bytes are merged by the recursive query.
LONGEST = 200
#: Pieces of a generation.  A worker remembers the pieces it met in this generation and in the last one.
REMEMBERED = 500_000
#: Pieces of one recursive query, and bytes of text that are split at once.
BLOCK = 60_000
TEXT_BYTES = 4 << 20

# A row is a piece.  A round finds the best pair of every piece by a join and an
# aggregation over its neighbours, so no round sorts the tokens.
_MERGE = """
WITH RECURSIVE steps(w, ids, done) AS (
    SELECT w, ids, false FROM pieces
  UNION ALL
    SELECT w,
        CASE WHEN best IS NULL THEN ids
             ELSE list_concat(list_append(ids[:best % 4096 - 1], (best // 4096)::INTEGER), ids[best % 4096 + 2:]) END,
        best IS NULL
    FROM (SELECT w, ids FROM steps WHERE NOT done) LEFT JOIN (
        SELECT w, min(m.id::BIGINT * 4096 + pos) AS best
        FROM (
            SELECT w, generate_subscripts(ids, 1) AS pos, unnest(ids) AS tok, unnest(ids[2:]) AS nxt
            FROM steps WHERE NOT done
        ) s JOIN merges m ON m.a = s.tok AND m.b = s.nxt
        GROUP BY w
    ) USING (w)
)
SELECT w, ids FROM steps WHERE done ORDER BY w
"""


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank; ranks have no gaps."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """The vocabulary and its queries, within one worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int32)
        merges = [
            (self.rank[token[:i]], self.rank[token[i:]], rank)
            for rank, token in enumerate(tokens)
            for i in range(1, len(token))
            if token[:i] in self.rank and token[i:] in self.rank
        ]
        self.pairs = {(a, b): c for a, b, c in merges}
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB"})
        a, b, c = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True)) if merges else [pa.array([], pa.int32())] * 3
        self._fill("merges", pa.table({"a": a, "b": b, "id": c}))
        self.bytes = pa.array(tokens, pa.binary())

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _queried(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.execute(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, as little-endian unsigned 32-bit numbers."""
        at = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        rows = pa.table({
            "w": pa.array(np.arange(len(pieces), dtype=np.int32)),
            "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(self.single[data])),
        })
        ids = self._queried(_MERGE, "pieces", rows)["ids"].combine_chunks()
        flat = np.asarray(ids.flatten()).astype("<u4").tobytes()
        at = (np.asarray(ids.offsets) - ids.offsets[0].as_py()) * 4
        return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def merged_by_heap(self, piece: bytes) -> bytes:
        """The same order of contractions for a long piece: smallest rank, then leftmost."""
        toks = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = [*range(1, len(toks)), -1], [*range(-1, len(toks) - 1)]
        heap = [(self.pairs[p], i, p) for i, p in enumerate(zip(toks, toks[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if toks[i] != pair[0] or j < 0 or toks[j] != pair[1]:
                continue
            toks[i], toks[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (p := (toks[left], toks[right])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p], left, p))
        return np.array([x for x in toks if x >= 0], dtype="<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Ids of all pieces that are not known yet."""
        new = [p for p in pieces if p not in self.seen]
        short, raws = [], []
        for piece in new:
            if piece in self.before:
                self.seen[piece] = self.before[piece]
                continue
            raw = piece.encode()
            if raw in self.rank:
                self.seen[piece] = np.array([self.rank[raw]], dtype="<u4").tobytes()
            elif len(raw) > LONGEST:
                self.seen[piece] = self.merged_by_heap(raw)
            else:
                short.append(piece)
                raws.append(raw)
        for i in range(0, len(short), BLOCK):
            self.seen.update(zip(short[i : i + BLOCK], self.merged(raws[i : i + BLOCK]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit numbers."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.before = {}, self.seen
        split = [self.split(text) for text in texts]
        self.learn(set().union(*split))
        get = self.seen.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """Bytes of id sequences."""
        at = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
        ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(at), self.bytes.take(pa.array(ids)))
        return pc.binary_join(tokens, b"").to_pylist()


_codecs: dict[tuple[int, str], Codec] = {}


def codec(tokens: list[bytes], pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = (hash(tuple(tokens)), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (the bytes the ids stand for).

    A null or empty text has no ids.  Special tokens are ordinary text.  Columns
    of ``docs`` named ``ids`` or ``decoded`` are replaced; ``with_text=False``
    leaves the text out of the result.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = docs.columns if with_text else [c for c in docs.columns if c != text]
    schema = docs.select(*names).schema.add("ids", "binary").add("decoded", "binary")

    def run(batches):
        own = codec(shared.value, pattern)
        for whole in batches:
            for batch in slices(whole, text, TEXT_BYTES):
                ids = own.encode([x or "" for x in batch[text].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in names], pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.binary())],
                    names=[*names, "ids", "decoded"],
                )

    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row; repeated rows give repeated results."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    coded = tokenize(plain, path, pattern, with_text=False)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
