"""Inference: text table -> profile -> types -> an editable mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.errors import SchemaError
from truecolumn.operators import profile as P
from truecolumn.plans.decide import WIDE_DIGITS, decide_types
from truecolumn.plans.header import normalized_names
from truecolumn.plans.mapping import ColumnMapping

DEFAULT_SAMPLE_ROWS = 100_000


def with_exact_bounds(profiles: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Attach the exact text of integer bounds, for notes on very long numbers.

    The profile knows the bounds of all whole numbers of up to 38 digits, so only
    longer ones are compared as text: they lie below or above all others.
    """
    exact = P.exact_integer_bounds(df, columns, over_digits=WIDE_DIGITS[0])
    low, high = F.col("min_integer_text"), F.col("max_integer_text")
    # One row per column on both sides.
    return profiles.join(exact, "column_name", "left").withColumns(
        {
            "min_integer_text": F.when(low.startswith("-"), low).otherwise(F.coalesce(F.col("min_integer").cast("string"), low)),
            "max_integer_text": F.when(~high.startswith("-"), high).otherwise(F.coalesce(F.col("max_integer").cast("string"), high)),
        }
    )


def infer_types(df: DataFrame, columns: list[str] | None = None, lossless: bool = False) -> DataFrame:
    """One row per column: profile plus inferred type, nullability and note."""
    return decide_types(P.profile(df, columns), lossless)


def infer_notes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, final_type, notes`` with exact bounds of any length."""
    columns = columns or df.columns
    profiles = with_exact_bounds(P.profile(df, columns), df, columns)
    return decide_types(profiles).select("column_name", "final_type", "notes")


def infer_mapping(
    df: DataFrame,
    sample_rows: int | None = None,
    with_samples: bool = True,
    lossless: bool = False,
) -> list[ColumnMapping]:
    """The draft mapping of a text table, in column order.

    ``sample_rows`` profiles only that many leading rows; by default the whole
    table is read.  What is collected is one row per column.
    """
    if sample_rows is not None:
        if sample_rows <= 0:
            raise SchemaError("sample_rows must be positive")
        df = df.limit(sample_rows)
    targets = normalized_names(df.columns)
    profiled = P.profile(df)
    found = {row["column_name"]: row for row in profiled.collect()}
    long_ones = [
        name for name, row in found.items()
        if row["max_integer_digits"] > 38 and (row["all_uint"] or row["all_int"])
    ]
    small = df.sparkSession.createDataFrame(list(found.values()), profiled.schema)
    if long_ones:
        small = with_exact_bounds(small, df, long_ones)
    decided = {row["column_name"]: row for row in decide_types(small, lossless).collect()}
    shown = {}
    if with_samples:
        shown = {row["column_name"]: tuple(row["samples"]) for row in P.samples(df).collect()}
    result = []
    for source, target in zip(df.columns, targets):
        row = decided.get(source)  # absent when the table has no rows
        result.append(
            ColumnMapping(
                source_name=source,
                target_name=target,
                final_type=row["final_type"] if row else "String",
                inferred_type=row["inferred_type"] if row else "String",
                sample_values=shown.get(source, ()),
                notes=row["notes"] if row else "all values are empty; String",
            )
        )
    return result
