"""Blocks of JSON lines as compressed bodies of bounded size, written and read by Spark tasks.

Each task writes its blocks one after another into a file of bodies and notes
where each one is; the driver only moves the files of successful tasks to their
place, or removes everything if the job fails.  Every body is a complete frame of
its codec, so it can be sent as it is, and a block is never in memory twice.
Codecs are those of Arrow, so zstd needs no native Hadoop library.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from truecolumn.errors import LoadError, SchemaError
from truecolumn.operators.blocks import DEFAULT_BLOCK_BYTES, json_lines, pack_blocks
from truecolumn.sinks.json_export import COMPRESSION

SOURCE = "truecolumn_blocks"
_WRITING = "_writing"
_INDEX = "file string, shard long, block long, place long, wire_bytes long, raw_bytes long, rows long, codec string"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if ":/" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def compressed(body: bytes, codec: str) -> bytes:
    return body if codec == "off" else pa.Codec(codec).compress(body, asbytes=True)


def plain(body: bytes, codec: str, size: int) -> bytes:
    return body if codec == "off" else pa.Codec(codec).decompress(body, decompressed_size=size, asbytes=True)


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """``(shard, block, lines)`` of rows that come block by block."""
    key, lines = None, []
    for batch in batches:
        for line, *now in zip(*(batch.column(c).to_pylist() for c in ("line", "shard", "block")), strict=True):
            if now != key:
                if lines:
                    yield *key, lines
                key, lines = now, []
            lines.append(line.encode())
    if lines:
        yield *key, lines


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, by the names they have while it runs."""

    names: tuple[str, ...]
    blocks: int


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.codec, self.load_id = options["path"], options["codec"], options["load_id"]
        self.limit = int(options["limit"])

    def _folder(self) -> str:
        return f"{self.path}/{_WRITING}/{self.load_id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _opened(self._folder())
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        # Another attempt at the same task has a name of its own.
        name, index, place = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", [], 0
        with files.open_output_stream(f"{folder}/{name}.bodies", compression=None) as out:
            for shard, block, lines in _bodies(iterator):
                raw = b"\n".join(lines)
                if len(raw) > self.limit:
                    raise LoadError(f"a block of {len(raw)} bytes exceeds the limit {self.limit}")
                sent = compressed(raw, self.codec)
                out.write(sent)
                index.append(
                    {"file": f"{name}.bodies", "shard": shard, "block": block, "place": place, "wire_bytes": len(sent),
                     "raw_bytes": len(raw), "rows": len(lines), "codec": self.codec}
                )
                place += len(sent)
        with files.open_output_stream(f"{folder}/{name}.index", compression=None) as out:
            out.write("".join(json.dumps(row) + "\n" for row in index).encode())
        return Written((f"{name}.bodies", f"{name}.index") if index else (), len(index))

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self._folder())
        _, target = _opened(self.path)
        names = sorted(n for m in messages if m for n in m.names)
        # Indexes last: a body without an index is not read.
        for name in sorted(names, key=lambda n: n.endswith(".index")):
            files.move(f"{folder}/{name}", f"{target}/{name}")
        self._clean(files, folder)
        with files.open_output_stream(f"{target}/_SUCCESS", compression=None) as out:
            out.write(json.dumps({"blocks": sum(m.blocks for m in messages if m), "codec": self.codec}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self._folder())
        self._clean(files, folder)

    @staticmethod
    def _clean(files: pafs.FileSystem, folder: str) -> None:
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            files.delete_dir(folder)


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options)


def write_blocks(
    df: DataFrame, path: str, compression: str | None = "zstd", limit: int = DEFAULT_BLOCK_BYTES, lines: bool = False
) -> str:
    """Write rows as blocks of JSON lines into a folder that must not exist yet.

    Each partition is packed as it stands.  ``lines`` says that ``df`` has JSON
    lines in its column ``line`` already.  A row longer than ``limit`` fails the
    job, and nothing is left behind.
    """
    codec = compression or "off"
    if codec not in COMPRESSION:
        raise SchemaError(f"unknown compression {codec!r}; use one of {COMPRESSION}")
    spark = df.sparkSession
    files, folder = _opened(path)
    if files.get_file_info(folder).type != pafs.FileType.NotFound:
        raise LoadError(f"{path} exists already")
    spark.dataSource.register(BlockSource)
    packed = pack_blocks(df.select("line") if lines else json_lines(df), limit)
    options = {"path": path, "codec": codec, "limit": str(limit), "load_id": uuid.uuid4().hex}
    try:
        packed.select("line", "shard", "block").write.format(SOURCE).mode("append").options(**options).save()
    except Exception as problem:
        raise LoadError(f"writing blocks to {path} failed, nothing was created: {problem}") from problem
    return path


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per block: its file, place, bytes and rows."""
    return spark.read.schema(_INDEX).json(f"{path}/*.index")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, block, rows, raw_bytes, wire_bytes, body)`` of every block, its text as it was packed."""

    def run(batches):
        files, folder = _opened(path)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                with files.open_input_file(f"{folder}/{r['file']}") as source:
                    source.seek(r["place"])
                    body = plain(source.read(r["wire_bytes"]), r["codec"], r["raw_bytes"])
                kept = {k: r[k] for k in ("shard", "block", "rows", "raw_bytes", "wire_bytes")} | {"body": body.decode()}
                yield pa.RecordBatch.from_pylist([kept])

    index = block_index(spark, path).repartition(F.col("file"), F.col("block"))
    return index.mapInArrow(run, "shard long, block long, rows long, raw_bytes long, wire_bytes long, body string")


def read_block_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all blocks."""
    return read_blocks(spark, path).select(F.explode(F.split("body", "\n")).alias("line"))
