"""Legacy archives converted to WARC, and both formats read and written by Spark.

An ARC file begins with a version block.  Version 1 headers have five fields
(address, IP, date, type, length), version 2 headers ten (also result code,
checksum, location, offset, file name).  The declared length, not a search for
the next header, ends a record.  The converter gives every record what ARC
lacks: an identifier (a name-based UUID), an ISO timestamp, a record type and
the SHA-1 digests of block and payload.

Files are written by Spark's text writer: a row is a record and the line
separator is what ends a record, so bytes go out unchanged, gzip-compressed, in
any file system Spark knows.  They are read by Spark's binary reader and parsed
in a stream.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, stored
from truecolumn.session import scratch_path

#: Records of one archive file, so that a file fits a task many times over.
FILE_RECORDS = 1000
_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_RECORDS = "key long, target string, date string, ip string, mime string, status int, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(*parts: object) -> str:
    """A name-based UUID: the same record gets the same identifier again."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}"


def arc_date(text: str) -> str:
    """An ARC date of 4 to 14 digits as a WARC timestamp; missing parts are the earliest."""
    full = text + "00000101000000"[len(text) :] if text.isdigit() and 4 <= len(text) <= 14 else "19700101000000"
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def _clean(value: str | None) -> str:
    """A header field: no blanks or line breaks, never empty."""
    return "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in value or "") or "-"


def http_block(key: int | None, payload: bytes, mime: str) -> bytes:
    """The response as a server would have sent it."""
    name = f"X-Record-Key: {key}\r\n" if key is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n{name}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names, status under the empty name) and payload; without a header all is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {"": (lines[0].split(" ") + ["", ""])[1]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, payload


def version_block(version: int) -> bytes:
    body = f"{version} 0 archive\n{_V1 if version == 1 else _V2}\n".encode()
    date = "20240101000000"
    if version == 1:
        return f"filedesc://archive.arc 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body
    return f"filedesc://archive.arc 0.0.0.0 {date} text/plain 200 - - 0 archive.arc {len(body)}\n".encode() + body


def arc_record(version: int, target: str, date: str, mime: str, block: bytes) -> bytes:
    if version == 1:
        return f"{_clean(target)} 0.0.0.0 {date} {_clean(mime)} {len(block)}\n".encode() + block
    return f"{_clean(target)} 0.0.0.0 {date} {_clean(mime)} 200 {digest(block)} - 0 archive.arc {len(block)}\n".encode() + block


class _Stream:
    """Lines and blocks of a file, gzip-compressed (in one or more members) or plain."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.done = memoryview(data), 0, bytearray(), False
        self.unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at : self.at + (1 << 16)]
        self.at += len(chunk)
        if self.unzip is None:
            self.buffer += chunk
            return True
        while len(chunk):
            self.buffer += self.unzip.decompress(chunk)
            chunk = self.unzip.unused_data
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
            else:
                break
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        begin = 0
        while (end := self.buffer.find(b"\n", begin)) < 0:
            begin = len(self.buffer)
            if not self._more():
                if not self.buffer:
                    return None
                end = len(self.buffer)
                break
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 1]
        return out.rstrip(b"\r")

    def block(self, length: int) -> bytes:
        while len(self.buffer) < length:
            if not self._more():
                raise ValueError(f"the archive ends within a record of {length} bytes")
        out = bytes(self.buffer[:length])
        del self.buffer[:length]
        return out


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file after its version block, with the fields its version has."""
    stream, version = _Stream(data), 1
    while (line := stream.line()) is not None:
        if not line:
            continue
        fields = line.decode("utf-8", "replace").split(" ")
        if fields[0].startswith("filedesc:"):
            body = stream.block(int(fields[-1]))
            version = int(body.split(b" ", 1)[0])
            continue
        many = 5 if version == 1 else 10
        if len(fields) < many:
            raise ValueError(f"an ARC header of version {version} has {many} fields, found {len(fields)}: {line[:200]!r}")
        # An address may hold blanks; the other fields may not.
        target, rest = " ".join(fields[: len(fields) - many + 1]), fields[len(fields) - many + 1 :]
        block = stream.block(int(rest[-1]))
        yield {
            "target": target, "ip": rest[0], "date": rest[1], "mime": rest[2],
            "status": int(rest[3]) if version == 2 and rest[3].isdigit() else None, "block": block,
        }


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record."""
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:80]!r}")
        fields: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.block(int(fields["content-length"]))


def _written(rows: DataFrame, folder: str, end: str, per_file: int) -> str:
    """One binary column as files: each row is followed by ``end``."""
    (
        rows.select(F.col(rows.columns[0]).cast("string"))
        .write.option("lineSep", end)
        .option("compression", "gzip")
        # The archives are read back at once: the work to compress them counts for more than a seventh of their size.
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", per_file)
        .text(folder)
    )
    return folder


def write_arc(pages: DataFrame, folder: str, version: int, per_file: int = FILE_RECORDS) -> str:
    """``pages(key, target, date, mime, payload)`` as gzipped ARC files of one version in ``folder``.

    Each file begins with its version block.  Null payloads are empty, null or
    odd addresses are escaped, a null key leaves its header out.
    """
    arrow_batches(pages.sparkSession)

    def run(batches):
        written = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if written % per_file == 0:
                    out.append(version_block(version))
                    written += 1
                block = http_block(row["key"], row["payload"] or b"", _clean(row["mime"]))
                out.append(arc_record(version, row["target"], row["date"], row["mime"], block))
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    wanted = pages.select("key", "target", "date", "mime", "payload")
    return _written(wanted.mapInArrow(run, "record binary"), folder, "\n", per_file)


def _files(spark: SparkSession, *folders: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(folders)).select("content")


def read_arc(spark: SparkSession, *folders: str) -> DataFrame:
    """Records of ARC files of either version: ``(key, target, date, ip, mime, status, payload)``.

    A header with too few fields or a record cut short fails the job.
    """
    arrow_batches(spark)

    def run(batches):
        for batch in batches:
            for data in batch["content"].to_pylist():
                part: list[tuple] = []
                for r in parse_arc(data):
                    http, payload = split_http(r["block"])
                    key = http.get("x-record-key", "")
                    status = r["status"] or int(http.get("", "") or 0) or None
                    part.append((int(key) if key else None, r["target"], arc_date(r["date"]), r["ip"], r["mime"], status, payload))
                    if len(part) >= 200:
                        yield _record_batch(part)
                        part = []
                if part:
                    yield _record_batch(part)

    return _files(spark, *folders).mapInArrow(run, _RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
    names = ["key", "target", "date", "ip", "mime", "status", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def with_types(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records with ``sha`` and ``refers_to``: the largest key of an equal payload of ``least_bytes`` or more.

    ``refers_to`` is null for the record itself, for shorter payloads and for
    records without a key.  Only digests and keys are aggregated, so a payload
    that a third of all records share costs one row per task.  The digests that
    occur twice are stored first: Spark then knows their size and moves the
    payloads only where that table is too large to be sent to every task.
    """
    marked = records.withColumns({"sha": F.sha1("payload"), "size": F.length("payload").cast("long")})
    firsts = (
        marked.where((F.col("size") >= least_bytes) & F.col("key").isNotNull())
        .groupBy("sha", "size")
        .agg(F.max("key").alias("first"), F.min("key").alias("last"))
        .where("first <> last")
        .select("sha", "size", "first")
    )
    met = marked.join(stored(firsts, "equal-payloads"), ["sha", "size"], "left")
    return met.withColumn("refers_to", F.when(F.col("key") < F.col("first"), F.col("first"))).drop("first")


def write_warc(records: DataFrame, folder: str, per_file: int = FILE_RECORDS) -> str:
    """Records of :func:`with_types` as gzipped WARC files in ``folder``; revisits carry no payload."""
    arrow_batches(records.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload, revisit = r["payload"] or b"", r["refers_to"] is not None
                block = http_block(r["key"], payload, r["mime"])
                if revisit:
                    block = block[: len(block) - len(payload)]
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", f"<{record_id(r['key'], r['target'], r['date'])}>"),
                    ("WARC-Date", r["date"]),
                    ("WARC-Target-URI", r["target"]),
                    ("WARC-IP-Address", r["ip"]),
                    ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                    ("WARC-Refers-To-Key", r["refers_to"]),
                    ("WARC-Source-Key", r["key"]),
                    ("WARC-Full-Payload-Length", len(payload)),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                out.append(warc_record(fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    wanted = records.select("key", "target", "date", "ip", "mime", "payload", "refers_to")
    return _written(wanted.mapInArrow(run, "record binary"), folder, "\r\n\r\n", per_file)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Index of WARC files: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, date, target)``.

    A response's payload is digested again and must agree with its header.
    """
    arrow_batches(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "target"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for data in batch["content"].to_pylist():
                rows = []
                for f, block in parse_warc(data):
                    stated = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and digest(payload := split_http(block)[1]) != stated:
                        raise ValueError(f"payload of {f['warc-record-id']} has digest {digest(payload)}, not {stated}")
                    key, other = f.get("warc-source-key"), f.get("warc-refers-to-key")
                    rows.append((
                        int(key) if key else None, int(f["warc-full-payload-length"]), stated, f["warc-type"],
                        int(other) if other else None, f["warc-record-id"].strip("<>"), f["warc-date"], f["warc-target-uri"],
                    ))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, target string"
    return _files(spark, folder).mapInArrow(run, schema)


def _crawl_date(key: Column) -> Column:
    """A 14-digit date for pages that come without one: seconds after a fixed instant."""
    start = datetime(2024, 1, 1, tzinfo=UTC)
    seconds = F.coalesce(F.pmod(key, F.lit(365 * 86400)), F.lit(0))
    return F.date_format(F.timestamp_seconds(F.lit(int(start.timestamp())) + seconds), "yyyyMMddHHmmss")


def converted_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` through ARC files (pages of even keys in version 1, others in version 2) to WARC and back.

    A null html is an empty payload.  Rows with the same key and payload are all
    responses if their key is the largest of that payload; a row without a key is
    a response and revisits nothing.  Empty tables give no rows.
    """
    key = F.col("page_id").cast("long")
    given = pages.select(
        key.alias("key"),
        F.col("url").cast("string").alias("target"),
        _crawl_date(key).alias("date"),
        F.lit("text/html;charset=utf-8").alias("mime"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    even = F.coalesce(F.pmod("key", F.lit(2)) == 0, F.lit(True))
    folders = [
        write_arc(given.where(even), scratch_path(spark, "arc1"), 1),
        write_arc(given.where(~even), scratch_path(spark, "arc2"), 2),
    ]
    records = with_types(read_arc(spark, *folders))
    folder = write_warc(records, scratch_path(spark, "warc"))
    found = read_warc(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
