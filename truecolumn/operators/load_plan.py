"""Apply a mapping to a text table: typed rows, and what was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truecolumn.errors import SchemaError
from truecolumn.functions import convert as X
from truecolumn.plans.mapping import ColumnMapping, check_mappings, check_sources

ERRORS = "_errors"
BAD_LINE = "_bad_line"
_ERROR_TYPE = "array<struct<source:string,target:string,value:string,type:string,reason:string>>"


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def annotate(df: DataFrame, mappings: list[ColumnMapping], keep: list[str] = (), counted: bool = False) -> DataFrame:
    """Typed target columns plus ``_errors``, one entry per refused cell.

    Columns in ``keep`` pass through unchanged.  With ``counted`` the last
    column is the number of refused cells instead, which needs no reasons.
    """
    chosen = check_mappings(mappings)
    check_sources(chosen, df.columns)
    watched = BAD_LINE in df.columns
    kinds = {f"_{i}": m.logical for i, m in enumerate(chosen)}
    carried = [_quoted(k) for k in keep] + ([F.col(BAD_LINE)] if watched else [])
    stripped = df.select(
        *carried,
        *[
            X.stripped_cell(m.source_name, m.logical).alias(f"_{i}_cell")
            for i, m in enumerate(chosen)
        ],
    )
    staged = stripped.select(
        *carried, *[X.present_cell(p, kind).alias(f"{p}_cell") for p, kind in kinds.items()]
    )
    cells = [f"{p}_cell" for p in kinds]
    fast = staged.select(*staged.columns, *[X.fast_value(p, kind).alias(f"{p}_fast") for p, kind in kinds.items()])
    grouped = X.families(kinds)
    gathered = fast.withColumns({f"_family_{f}": X.open_cells(kinds, prefixes) for f, prefixes in grouped.items()})
    kernels = gathered.withColumns({f"_family_{f}": X.settled(f, F.col(f"_family_{f}")) for f in grouped})
    place = {p: (i, f) for f, prefixes in grouped.items() for i, p in enumerate(prefixes)}
    typed = kernels.select(
        *[_quoted(c) for c in staged.columns if c not in cells],
        *cells,
        *[X.value_of(p, kind, *place.get(p, (None, None))).alias(f"{p}_value") for p, kind in kinds.items()],
    )
    refused = [r for p, kind in kinds.items() if (r := X.is_refused(p, kind))]
    if watched:
        refused.append(f"{BAD_LINE} IS NOT NULL")
    number = F.expr(" + ".join(f"CAST({r} AS int)" for r in refused) or "0")
    failed = F.expr(" OR ".join(refused) or "false")
    entries = [
        e
        for i, m in enumerate(chosen)
        if (e := X.refused_entry(f"_{i}", m.logical, m.source_name, m.target_name, m.final_type))
    ]
    # A filter on the errors must not be pushed below the steps: it would be
    # rewritten into one expression that repeats every step many times.  An
    # expression that is not deterministic stops that.
    fence = F.monotonically_increasing_id() >= 0
    # Good rows, the common case, share one empty array.
    none = F.array().cast(_ERROR_TYPE)
    found = none
    if entries:
        found = F.transform(
            F.expr(f"array_compact(array({', '.join(entries)}))"),
            lambda e: F.struct(
                e["source"].alias("source"), e["target"].alias("target"), F.coalesce(e["cell"], F.lit("")).alias("value"),
                e["type"].alias("type"), X.reason_of(e["cell"], e).alias("reason"),
            ),
        )
    if watched:
        line = F.struct(
            F.lit("").alias("source"),
            F.lit("").alias("target"),
            F.col(BAD_LINE).alias("value"),
            F.lit("").alias("type"),
            F.lit("malformed line: too many fields, an open quote or undecodable bytes").alias("reason"),
        )
        found = F.when(F.col(BAD_LINE).isNotNull(), F.array_append(found, line)).otherwise(found)
    errors = F.when(failed & fence, found).otherwise(none)
    values = []
    for i, m in enumerate(chosen):
        value = F.col(f"_{i}_value")
        if m.logical.kind == "string" and not m.nullable:
            value = F.coalesce(value, F.lit(""))
        metadata = m.logical.field(m.target_name, m.notes).metadata
        values.append(value.alias(m.target_name, metadata=metadata))
    last = number if counted else errors
    return typed.select(*[_quoted(k) for k in keep], *values, last.alias(ERRORS))


def accepted(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.size(ERRORS) == 0).drop(ERRORS)


def rejected(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.size(ERRORS) > 0)


def strict(annotated: DataFrame) -> DataFrame:
    """The typed rows; the job fails on the first refused cell it meets.

    The message names column, value and type.
    """
    first = F.col(ERRORS)[0]
    message = F.format_string(
        "cannot convert column '%s', value '%s' to %s: %s",
        first["source"], first["value"], first["type"], first["reason"],
    )
    good = F.when(F.size(ERRORS) == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return annotated.where(good).drop(ERRORS)


def apply_mapping(df: DataFrame, mappings: list[ColumnMapping], mode: str = "strict"):
    """Converted table by mode.

    ``strict`` gives the rows and fails at run time on a bad cell, ``reject``
    gives ``(good rows, bad rows with their errors)``, ``annotate`` gives all
    rows with an ``_errors`` column.
    """
    annotated = annotate(df, mappings)
    if mode == "annotate":
        return annotated
    if mode == "reject":
        return accepted(annotated), rejected(annotated)
    if mode == "strict":
        return strict(annotated)
    raise SchemaError(f"unknown mode {mode!r}; use strict, reject or annotate")


def project(df: DataFrame, mappings: list[ColumnMapping]) -> DataFrame:
    """Only include, rename and reorder; no conversion."""
    chosen = check_mappings(mappings)
    check_sources(chosen, df.columns)
    return df.select(*[_quoted(m.source_name).alias(m.target_name) for m in chosen])
