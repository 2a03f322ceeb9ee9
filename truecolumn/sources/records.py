"""Records of delimited files in file order, read in parallel: cells may span lines, rows have numbers.

Whether a line begins inside a quoted cell depends on all lines before it, and so
does its number.  Both are prefix sums over the file, so two scans do:

1. every file split is folded into one summary for either state that it may begin
   in: the state it ends in, its lines, the rows that begin in it;
2. the summaries (a few numbers for 128 MB of text) are chained on the driver, file
   by file, which settles each split's state and numbers;
3. the splits are scanned again, now with the right state, and cut into records.

Records inside a split need no exchange.  Where a split begins inside a cell, the
parts of the record that lies across the border, and only these, are brought
together; that takes a third scan of the files concerned.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truecolumn.errors import LoadError, SchemaError
from truecolumn.sources import quotes as Q

#: A record may have this many bytes; more are taken for a quote that is never closed.
RECORD_BYTES = 64 << 20
#: Encodings in which a line feed byte is always a line feed.
_WIDE = ("UTF-16", "UTF-32", "UCS-2", "UCS-4")
_MARK = "﻿"


def decoded(value: Column, charset: str) -> Column:
    """Text of a raw line; bytes that are no text become replacement characters."""
    if charset.upper() == "UTF-8":
        return F.make_valid_utf8(value)
    return F.decode(value.cast("binary"), charset)


def has_byte_lines(charset: str) -> bool:
    """Whether files in this charset can be cut at line feed bytes."""
    return not charset.upper().startswith(_WIDE)


def _lines(spark: SparkSession, path, charset: str, separator: str, joined: bool) -> DataFrame:
    """``(file, block, text, code)`` of every line, in order within a split."""
    if not has_byte_lines(charset):
        raise SchemaError(f"lines in {charset} cannot be told apart by bytes")
    # Both scans must meet the same splits, also where executors come and go between them.
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    found = spark.read.option("lineSep", "\n").text(path)
    text = decoded(F.col("value"), charset)
    rows = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("text"))
    # A byte order mark hides the quote behind it.
    plain = F.when((F.col("block") == 0) & F.col("text").startswith(_MARK), F.substring("text", 2, 1 << 30)).otherwise(F.col("text"))
    plain = _unreturned(plain)
    code = Q.state_code(plain, separator) if joined else F.when(plain == "", F.lit(Q.KEEPS | Q.EMPTY)).otherwise(F.lit(Q.KEEPS)).cast("byte")
    return rows.withColumn("code", code)


def _unreturned(text: Column) -> Column:
    """Without the carriage return at its end."""
    return F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)


def _states(codes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each line, and after the last one."""
    kind = codes & 3
    fixed = (kind == Q.CLOSES) | (kind == Q.OPENS)
    last = np.maximum.accumulate(np.where(fixed, np.arange(1, len(kind) + 1), 0))
    swaps = np.cumsum(kind == Q.SWAPS)
    base = np.where(last > 0, kind[last - 1] == Q.OPENS, bool(state))
    since = swaps - np.where(last > 0, swaps[last - 1], 0)
    after = base ^ (since % 2 == 1)
    return np.concatenate([[bool(state)], after[:-1]]), int(after[-1])


def _runs(batch: pa.RecordBatch) -> Iterable[tuple[str, int, slice]]:
    """Stretches of a batch that lie in one split."""
    n = batch.num_rows
    files, blocks = batch["file"].dictionary_encode(), np.asarray(batch["block"])
    place = np.asarray(files.indices)
    edges = np.flatnonzero((place[1:] != place[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
        if b > a:
            yield files.dictionary[int(place[a])].as_py(), int(blocks[a]), slice(a, b)


def _summed(batches: Iterable[pa.RecordBatch]):
    held, total = None, None
    names = ["file", "block", "lines", "ends0", "ends1", "rows0", "rows1"]

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(names, (*held, *total), strict=True))])

    for batch in batches:
        codes = np.asarray(batch["code"])
        for file, block, at in _runs(batch):
            if held != (file, block):
                if held is not None:
                    yield row()
                held, total = (file, block), [0, 0, 1, 0, 0]
            own = codes[at]
            total[0] += len(own)
            for s in (0, 1):
                before, total[1 + s] = _states(own, total[1 + s])
                total[3 + s] += int(np.count_nonzero(~before & (own & Q.EMPTY == 0)))
    if held is not None:
        yield row()


@dataclass
class Chain:
    """What each split begins with: ``{(file, block): (inside, line, row, owner, headed)}``.

    ``line`` counts from 1 within the file, ``row`` from 0 over all files in order
    of their paths, headers left out; ``owner`` is the block in which the record
    that lies across the split's beginning started; ``headed`` says that the
    file's header began before.
    """

    at: dict[tuple[str, int], tuple[int, int, int, int, bool]] = field(default_factory=dict)
    across: set[str] = field(default_factory=set)
    rows: int = 0


def chained(summaries: Iterable[tuple]) -> Chain:
    """Settle ``(file, block, lines, ends0, ends1, rows0, rows1)`` of all splits."""
    chain, last = Chain(), None
    for file, block, lines, *pairs in sorted(summaries):
        if file != last:
            last, state, line, owner, headed = file, 0, 1, block, False
        chain.at[file, block] = (state, line, chain.rows, owner, headed)
        started, state_after = pairs[2 + state], pairs[state]
        if started:
            owner = block
            chain.rows += started - (not headed)
            headed = True
        if state_after:
            chain.across.add(file)
        state, line = state_after, line + lines
    return chain


class _Cutter:
    """Cuts the lines of one task's splits into records."""

    def __init__(self, chain: dict, limit: int):
        self.chain, self.limit = chain, limit
        self.key, self.state, self.line, self.row, self.owner, self.headed, self.size = None, 0, 0, 0, 0, False, 0
        self.held: list[str] | None = None
        self.out: list[dict] = []

    def open_split(self, file: str, block: int) -> None:
        self.close_split()
        self.key = (file, block)
        if self.key not in self.chain:
            raise LoadError(f"{file} was split differently in two scans; set spark.sql.files.minPartitionNum")
        self.state, self.line, self.row, self.owner, self.headed = self.chain[self.key]
        self.size = 0
        # Lines of a record that began before this split.
        self.held = [] if self.state else None
        self.begun = (None, None, self.owner)

    def close_split(self) -> None:
        if self.key is not None and self.held is not None:
            self.put(whole=not self.state)
        self.key, self.held = None, None

    def put(self, whole: bool) -> None:
        line, row, owner = self.begun
        text = "\n".join(self.held)
        # A record from before this split is never whole here, nor is one that goes on behind it.
        self.out.append({"file": self.key[0], "owner": owner, "block": self.key[1], "line": line, "row": row, "text": text, "whole": whole and line is not None})
        self.held = None

    def take(self, text: str, outside: bool, empty: bool) -> None:
        if outside and self.held is not None:
            self.put(True)
        if outside and not empty:
            self.held, self.size = [], 0
            self.begun = (self.line, self.row if self.headed else -1, self.key[1])
            self.row += self.headed
            self.headed = True
        if self.held is not None:
            text = text.removeprefix(_MARK) if self.line == 1 else text
            self.held.append(text)
            self.size += len(text)
            if self.size > self.limit:
                raise LoadError(
                    f"the record that begins in line {self.begun[0] or 'before'} of {self.key[0]} is longer than {self.limit} characters; "
                    "a quote is probably not closed"
                )
        self.line += 1


_RECORDS = "file string, owner long, block long, line long, row long, text string, whole boolean"


def _cut(batches: Iterable[pa.RecordBatch], chain: dict, limit: int):
    schema = pa.schema(
        [("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("line", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())]
    )
    cutter = _Cutter(chain, limit)

    def out():
        rows, cutter.out = cutter.out, []
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        codes = np.asarray(batch["code"])
        for file, block, at in _runs(batch):
            if cutter.key != (file, block):
                cutter.open_split(file, block)
            own, n = codes[at], at.stop - at.start
            before, after = _states(own, cutter.state)
            empty = own & Q.EMPTY > 0
            if cutter.headed and cutter.held is None and not before.any() and not after and not empty.any():
                # One record a line, as in most files.
                yield from ([out()] if cutter.out else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * n), pa.array(np.full(n, block)), pa.array(np.full(n, block)),
                        pa.array(np.arange(cutter.line, cutter.line + n)), pa.array(np.arange(cutter.row, cutter.row + n)),
                        batch["text"].slice(at.start, n), pa.array(np.ones(n, bool)),
                    ],
                    schema=schema,
                )
                cutter.line, cutter.row = cutter.line + n, cutter.row + n
                continue
            for text, inside, is_empty in zip(batch["text"].slice(at.start, n).to_pylist(), before.tolist(), empty.tolist(), strict=True):
                cutter.take(text, not inside, is_empty)
            cutter.state = after
            if not after and cutter.held is not None:
                # The last line ends its record.
                cutter.put(True)
        if cutter.out:
            yield out()
    cutter.close_split()
    if cutter.out:
        yield out()


def read_records(
    spark: SparkSession, path, charset: str = "UTF-8", separator: str = ",", joined: bool = True, limit: int = RECORD_BYTES
) -> DataFrame:
    """``(file, line, row, text)`` of every record but the headers.

    ``line`` is the number of the record's first line in its file, from 1; ``row``
    its number among all rows, from 0, files in order of their paths.  Without
    ``joined`` each line is a record.  Empty lines between records are no rows.
    """
    lines = _lines(spark, path, charset, separator, joined)
    summaries = lines.select("file", "block", "code").mapInArrow(
        _summed, "file string, block long, lines long, ends0 long, ends1 long, rows0 long, rows1 long"
    )
    # One small row for each split of 128 MB.
    chain = chained(tuple(r) for r in summaries.collect())
    shared = spark.sparkContext.broadcast(chain.at)

    def cut(some: DataFrame) -> DataFrame:
        return some.mapInArrow(lambda batches: _cut(batches, shared.value, limit), _RECORDS)

    columns = ["file", "line", "row", "text"]
    found = cut(lines).where("whole").select(*columns)
    if chain.across:
        parts = cut(lines).where(F.col("file").isin(sorted(chain.across)) & ~F.col("whole"))
        piece = F.sort_array(F.collect_list(F.struct("block", "text")))
        across = parts.groupBy("file", "owner").agg(F.min("line").alias("line"), F.min("row").alias("row"), piece.alias("parts"))
        across = across.select("file", "line", "row", F.array_join(F.col("parts.text"), "\n").alias("text"))
        found = found.unionByName(across)
    return found.where("row >= 0").withColumn("text", _unreturned(F.col("text")))
