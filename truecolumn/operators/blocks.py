"""Rows as JSON lines, and lines packed into blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truecolumn.errors import LoadError

# A block may hold nine tenths of 16 MiB.
DEFAULT_BLOCK_BYTES = int(16 * 1024 * 1024 * 0.9)


def json_lines(
    df: DataFrame,
    columns: list[str] | None = None,
    keep: list[str] = (),
    decimals_as_text: list[str] | None = None,
) -> DataFrame:
    """One JSON object per row in ``line``.

    Column order is kept, nulls are written, text stays as it is.  Decimals
    with a fraction and dates go out as text, so no digit is lost; whole
    numbers, also 64-bit unsigned ones, go out as numbers.
    ``decimals_as_text`` names the decimals without a fraction that go out as
    text; by default those that a mapping marked as such.  A row with NaN or an
    infinity, for which JSON has no number, fails the job.
    """
    columns = columns or df.columns
    fields = []
    for name in columns:
        field, column = df.schema[name], F.col(f"`{name}`")
        kind = field.dataType
        whole = isinstance(kind, T.DecimalType) and kind.scale == 0
        logical = (field.metadata or {}).get("logical", "")
        as_text = "Decimal" in logical if decimals_as_text is None else name in decimals_as_text
        as_number = whole and not as_text
        if isinstance(kind, T.DecimalType) and not as_number:
            column = column.cast("string")
        elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            odd = F.isnan(column) | (F.abs(column) == float("inf"))
            message = F.lit(f"column {name!r} holds a value that is no finite number")
            column = F.when(F.coalesce(odd, F.lit(False)), F.raise_error(message).cast(kind)).otherwise(column)
        fields.append(column.alias(name))
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(*[F.col(f"`{k}`") for k in keep], line.alias("line"))


def oversize_rows(lines: DataFrame, limit: int) -> DataFrame:
    """Lines that fit in no block."""
    return lines.where(F.octet_length("line") > limit)


def _block_starts(lengths: np.ndarray, used: int, limit: int):
    """Greedy packing of consecutive lines.

    ``used`` is what the open block already holds (newlines included).  Gives
    the block offset of each line and what the last block holds then.
    """
    if len(lengths) and int(lengths.max()) > limit:
        raise LoadError(f"a row of {int(lengths.max())} bytes exceeds the block limit {limit}")
    ends = np.cumsum(lengths + 1)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    start, base, block = 0, -used, 0
    while start < len(lengths):
        # The newline of the last line of a block is not sent.
        stop = int(np.searchsorted(ends, base + limit + 1, side="right"))
        offsets[start:stop] = block
        if stop >= len(lengths):
            return offsets, int(ends[-1] - base)
        # Every line fits an empty block, so the next block takes at least one.
        base, start, block = int(ends[stop - 1]) if stop else 0, stop, block + 1
    return offsets, used


def pack_blocks(df: DataFrame, limit: int = DEFAULT_BLOCK_BYTES, shard: str | None = None,
                order: str | None = None) -> DataFrame:
    """Assign every line, in order, to a block of at most ``limit`` bytes.

    Without ``shard`` each partition is packed as it stands: no shuffle, no
    sort, and a task holds one Arrow batch at a time.  With ``shard`` and
    ``order`` rows are packed per shard in that order; a shard must be bounded
    by construction, such as a range of row ids.
    """
    if limit <= 0:
        raise LoadError("the block limit must be positive")
    if shard is not None:
        df = df.repartition(shard).sortWithinPartitions(shard, order)
        shard_id = F.col(shard)
    else:
        shard_id = F.spark_partition_id()
    placed = df.withColumns(
        {"_shard": shard_id.cast("bigint"), "_bytes": F.octet_length("line").cast("bigint")}
    )
    names = [n for n in df.columns if n != "shard"]
    added = [T.StructField("shard", T.LongType()), T.StructField("block", T.LongType())]
    schema = T.StructType([df.schema[n] for n in names] + added)

    def pack(batches):
        open_shard, block, used = None, 0, 0
        for batch in batches:
            shards = batch.column("_shard").to_numpy(zero_copy_only=False)
            sizes = batch.column("_bytes").to_numpy(zero_copy_only=False)
            blocks = np.zeros(len(sizes), dtype=np.int64)
            edges = np.flatnonzero(np.diff(shards)) + 1
            for low, high in zip([0, *edges], [*edges, len(sizes)]):
                if high == low:
                    continue
                if shards[low] != open_shard:
                    open_shard, block, used = shards[low], 0, 0
                offsets, used = _block_starts(sizes[low:high], used, limit)
                blocks[low:high] = offsets + block
                block += int(offsets[-1])
            columns = [*[batch.column(n) for n in names], batch.column("_shard")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(blocks, pa.int64())], [*names, "shard", "block"]
            )

    return placed.mapInArrow(pack, schema)


def block_totals(packed: DataFrame) -> DataFrame:
    """Rows and bytes (newlines between rows counted) of each block."""
    return packed.groupBy("shard", "block").agg(
        F.count(F.lit(1)).alias("rows_count"),
        (F.sum(F.octet_length("line") + 1) - 1).alias("block_bytes"),
    )
