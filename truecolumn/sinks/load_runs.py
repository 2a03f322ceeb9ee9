"""Accounting of loads: one record per run, and figures derived from it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from urllib.parse import unquote

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truecolumn.errors import TrueColumnError
from truecolumn.operators import load_plan as L
from truecolumn.operators.blocks import DEFAULT_BLOCK_BYTES, json_lines
from truecolumn.operators.validate import require_valid
from truecolumn.plans.mapping import ColumnMapping
from truecolumn.sinks import tables as S
from truecolumn.sinks.progress import Progress, watched

RUN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("run_id", "target", "source", "outcome", "fate", "error", "spark_version")]
    + [T.StructField(n, T.LongType()) for n in ("rows", "blocks", "src_bytes", "raw_bytes", "wire_bytes", "worker_count")]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("read_s", "convert_s", "serialize_s", "preflight_s", "insert_busy_s", "insert_wall_s", "server_s", "stall_s", "total_s")
    ]
    + [T.StructField("finished_at", T.TimestampNTZType())]
)


@dataclass
class LoadRun:
    """Counters of one load; seconds stay null when a stage was not measured.

    ``raw_bytes`` are the rows as JSON, ``wire_bytes`` the files written,
    ``blocks`` how many blocks of the size limit the rows would fill.
    """

    target: str
    source: str = ""
    outcome: str = "failed"
    fate: str = S.NOT_CREATED
    error: str | None = None
    rows: int = 0
    blocks: int = 0
    src_bytes: int = 0
    raw_bytes: int = 0
    wire_bytes: int = 0
    worker_count: int = 1
    read_s: float | None = None
    convert_s: float | None = None
    serialize_s: float | None = None
    preflight_s: float | None = None
    insert_busy_s: float | None = None
    insert_wall_s: float | None = None
    server_s: float | None = None
    stall_s: float | None = None
    total_s: float | None = None

    @contextmanager
    def timed(self, stage: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            setattr(self, stage, time.perf_counter() - began)


def record(spark: SparkSession, run: LoadRun, path: str) -> str:
    """Append the run to the ``load_runs`` folder under an id of its own."""
    run_id = uuid.uuid4().hex
    values = {**asdict(run), "run_id": run_id, "spark_version": pyspark.__version__}
    row = [values.get(f.name) for f in RUN_SCHEMA.fields if f.name != "finished_at"]
    partial = T.StructType([f for f in RUN_SCHEMA.fields if f.name != "finished_at"])
    df = spark.createDataFrame([tuple(row)], partial)
    stamped = df.withColumn("finished_at", F.localtimestamp())
    stamped.write.mode("append").parquet(path)
    return run_id


def run_ratios(runs: DataFrame) -> DataFrame:
    """Derived figures; null where one cannot be computed.

    * ``compression_ratio`` raw over wire bytes;
    * ``server_share`` server time over wall time, for a single worker only:
      with several workers the sums overlap;
    * ``server_share_of_insert`` server time over the summed insert time;
    * ``worker_occupancy`` busy time over workers times wall time;
    * ``unattributed_s`` wall time outside every measured stage.
    """
    had_blocks = F.col("blocks") > 0
    walled = had_blocks & (F.col("insert_wall_s") > 0)
    measured = F.col("read_s") + F.col("convert_s") + F.col("serialize_s") + F.col("stall_s")
    return runs.withColumns(
        {
            "compression_ratio": F.when(
                F.col("wire_bytes") > 0, F.try_divide(F.col("raw_bytes"), F.col("wire_bytes"))
            ),
            "server_share": F.when(
                walled & (F.col("worker_count") == 1),
                F.try_divide(F.col("server_s"), F.col("insert_wall_s")),
            ),
            "server_share_of_insert": F.when(
                had_blocks & (F.col("insert_busy_s") > 0),
                F.try_divide(F.col("server_s"), F.col("insert_busy_s")),
            ),
            "worker_occupancy": F.when(
                walled & (F.col("worker_count") > 0),
                F.try_divide(
                    F.col("insert_busy_s"), F.col("worker_count") * F.col("insert_wall_s")
                ),
            ),
            "unattributed_s": F.when(walled, F.col("insert_wall_s") - measured),
        }
    )


def run_report(runs: DataFrame) -> DataFrame:
    """One line of text per run."""
    shown = run_ratios(runs)
    ratio = F.coalesce(F.format_number("compression_ratio", 2), F.lit("n/a"))
    busy = F.coalesce(F.format_number(F.col("worker_occupancy") * 100, 0), F.lit("n/a"))
    return shown.select(
        "run_id",
        F.format_string(
            "%s: %s, %d rows in %d blocks, %s MB raw, %s MB on wire (%sx), workers busy %s%%, fate %s",
            "target", "outcome", "rows", "blocks",
            F.format_number(F.col("raw_bytes") / 1048576, 1),
            F.format_number(F.col("wire_bytes") / 1048576, 1),
            ratio, busy, "fate",
        ).alias("report"),
    )


def source_bytes(df: DataFrame) -> int:
    """Size of the files a table is read from; no file is opened for it."""
    paths = [unquote(p) for p in df.inputFiles()]
    if not paths:
        return 0
    sizes = df.sparkSession.read.format("binaryFile").load(paths).select("length")
    return sizes.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def table_bytes(df: DataFrame) -> int:
    """Size of a table's files: one row per file, summed in the plan."""
    sizes = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]


def load(
    text: DataFrame,
    mappings: list[ColumnMapping],
    target: str,
    layout: S.Layout = S.Layout(),
    runs_path: str | None = None,
    preflight_rows: int | None = None,
    preflight: bool = False,
    max_line_bytes: int = DEFAULT_BLOCK_BYTES,
    report: Callable[[Progress], None] | None = None,
) -> LoadRun:
    """Validate, convert and load a text table into a new table, in one pass.

    Conversion is strict and takes place in the job that writes: a bad cell, a
    malformed line or a row of more than ``max_line_bytes`` as JSON stops it, and
    the target is not created.  That job also counts rows and bytes.
    ``preflight`` validates beforehand, all rows or the leading
    ``preflight_rows``, for an error that counts all refusals.  ``report`` is
    called twice a second with the bytes read and the tasks ended so far.
    """
    spark = text.sparkSession
    run = LoadRun(target=target, src_bytes=source_bytes(text), worker_count=spark.sparkContext.defaultParallelism)
    began = time.perf_counter()
    try:
        if preflight or preflight_rows is not None:
            with run.timed("preflight_s"):
                require_valid(text, mappings, max_line_bytes, preflight_rows)
        with run.timed("insert_wall_s"):
            counted = pyspark.sql.Observation()
            typed = L.apply_mapping(text, mappings)
            columns = [F.col(f"`{c}`") for c in typed.columns]
            sized = json_lines(typed.select(F.struct(*columns).alias("row"), *columns), typed.columns, keep=["row"])
            size = F.octet_length("line")
            message = F.format_string(f"a row of %d bytes is longer than {max_line_bytes} bytes", size)
            short = F.when(size <= max_line_bytes, size).otherwise(F.raise_error(message).cast("int"))
            sized = sized.select("row", short.alias("bytes")).observe(
                counted,
                F.count(F.lit(1)).alias("rows"),
                F.coalesce(F.sum(F.col("bytes").cast("bigint")), F.lit(0)).alias("bytes"),
            )
            rows = sized.where("bytes >= 0").select("row.*")
            with watched(spark, report, run.src_bytes):
                S.load_table(rows.to(typed.schema), target, layout)
        run.rows, run.raw_bytes = counted.get["rows"], counted.get["bytes"]
        run.blocks = -(-run.raw_bytes // max_line_bytes)
        run.wire_bytes = table_bytes(spark.table(target))
        run.outcome, run.fate = "ok", S.CREATED
    except TrueColumnError as problem:
        run.error = str(problem)
        if type(problem).__name__ == "CleanupError":
            run.fate = S.CLEANUP_FAILED
        raise
    finally:
        run.total_s = time.perf_counter() - began
        if runs_path:
            record(spark, run, runs_path)
    return run
