"""Export of rows as newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truecolumn.errors import LoadError, SchemaError
from truecolumn.operators.blocks import DEFAULT_BLOCK_BYTES, json_lines

# How the text may be compressed; "off" leaves it plain.
COMPRESSION: tuple[str, ...] = ("off", "zstd", "lz4", "gzip")
# Writers of text need Hadoop's codec for zstd, which needs a native library.
_NEEDS_NATIVE = ("zstd",)


def text_codec(compression: str | None) -> str:
    """The writer's name for a compression choice."""
    if compression in (None, "", "off"):
        return "none"
    if compression not in COMPRESSION:
        raise SchemaError(f"unknown compression {compression!r}; use one of {COMPRESSION}")
    return compression


def native_codecs(spark: SparkSession) -> bool:
    """Whether Hadoop's native library, which its zstd codec needs, is loaded."""
    return bool(spark.sparkContext._jvm.org.apache.hadoop.util.NativeCodeLoader.isNativeCodeLoaded())


def export_json(
    df: DataFrame, path: str, compression: str | None = "gzip", limit: int = DEFAULT_BLOCK_BYTES
) -> str:
    """Write JSON lines in one pass; a row longer than a block fails the job.

    Spark commits all files or none, so nothing is left behind then.  ``zstd``
    and ``lz4`` need the native codecs of the cluster.
    """
    codec = text_codec(compression)
    if codec in _NEEDS_NATIVE and not native_codecs(df.sparkSession):
        raise LoadError(f"this session has no native library for {codec}; use gzip or lz4")
    length = F.octet_length("line")
    message = F.format_string(f"a row of %d bytes is longer than {limit} bytes", length)
    short_enough = F.when(length <= limit, F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    lines = json_lines(df).where(short_enough)
    try:
        lines.write.mode("errorifexists").option("compression", codec).text(path)
    except Exception as problem:
        raise LoadError(f"exporting to {path} failed: {problem}") from problem
    return path
