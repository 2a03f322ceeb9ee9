"""Validation: convert every row, measure its serialized size, report refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.errors import LoadError, SchemaError
from truecolumn.operators import load_plan as L
from truecolumn.operators.blocks import json_lines
from truecolumn.plans.mapping import ColumnMapping

DEFAULT_SAMPLE_ROWS = 200_000


def validate(
    df: DataFrame, mappings: list[ColumnMapping], max_line_bytes: int, sample_rows: int | None = None
) -> DataFrame:
    """One row: rows read, rows refused, cells refused, longest line, long lines.

    One pass and one global aggregation, nothing is kept.  ``sample_rows``
    looks at that many leading rows only.
    """
    if max_line_bytes <= 0:
        raise SchemaError("max_line_bytes must be positive")
    if sample_rows is not None:
        if sample_rows <= 0:
            raise SchemaError("sample_rows must be positive")
        df = df.limit(sample_rows)
    annotated = L.annotate(df, mappings, counted=True)
    columns = [c for c in annotated.columns if c != L.ERRORS]
    sized = json_lines(annotated, columns, keep=[L.ERRORS]).select(
        F.col(L.ERRORS).alias("refused"), F.octet_length("line").alias("bytes")
    )
    return sized.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("refused") > 0).alias("rows_refused"),
        F.coalesce(F.sum("refused"), F.lit(0).cast("bigint")).alias("cells_refused"),
        F.max("bytes").alias("max_line_bytes"),
        F.count_if(F.col("bytes") > max_line_bytes).alias("oversize_lines"),
    )


def require_valid(df, mappings, max_line_bytes, sample_rows=None) -> int:
    """Row count of a table that converts completely, else an error."""
    found = validate(df, mappings, max_line_bytes, sample_rows).first()
    if found["rows_refused"]:
        worst = reject_report(df, mappings).orderBy(F.desc("cells")).first()
        raise SchemaError(
            f"{found['rows_refused']} of {found['rows_total']} rows cannot be converted; most often "
            f"column '{worst['source']}' to {worst['type']}: '{worst['example']}' {worst['reason']}"
        )
    if found["oversize_lines"]:
        raise LoadError(
            f"{found['oversize_lines']} rows exceed {max_line_bytes} bytes; "
            f"the longest has {found['max_line_bytes']}"
        )
    return found["rows_total"]


def refused_cells(df: DataFrame, mappings: list[ColumnMapping], keep: list[str] = ()) -> DataFrame:
    """One row per refused cell."""
    bad = L.rejected(L.annotate(df, mappings, keep))
    kept = [F.col(f"`{k}`") for k in keep]
    return bad.select(*kept, F.explode(L.ERRORS).alias("e")).select(*kept, "e.*")


def reject_report(df: DataFrame, mappings: list[ColumnMapping]) -> DataFrame:
    """Refused cells counted by column, type and reason, with one example."""
    return (
        refused_cells(df, mappings)
        .groupBy("source", "type", "reason")
        .agg(F.count(F.lit(1)).alias("cells"), F.min("value").alias("example"))
    )


def first_bad_value(df: DataFrame, mappings: list[ColumnMapping], row_id: str) -> DataFrame:
    """The first refused value of each column, by row id."""
    first = F.min_by(F.struct("value", "type", "reason"), row_id)
    return (
        refused_cells(df, mappings, [row_id])
        .groupBy("source")
        .agg(F.min(row_id).alias("row_id"), first.alias("f"))
        .select("source", "row_id", "f.*")
    )
