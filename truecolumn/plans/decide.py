"""The type decision: a profile row in, a column type and a reason out.

Everything is a CASE expression over the profile, so inference stays one
DataFrame and the rules run once per column, not per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bounds of the target's integer and date types, and the
# decimal widths it knows.
UINT64_MAX = 2**64 - 1
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1
WIDE_DIGITS = (38, 76)
DATE_MIN, DATE_MAX = "1970-01-01", "2149-06-06"
DATE32_MIN, DATE32_MAX = "1900-01-01", "2299-12-31"

_c = F.col


def _whole(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


def _within(low: int, high: int) -> Column:
    bounded = (_c("min_integer") >= _whole(low)) & (_c("max_integer") <= _whole(high))
    return (_c("max_integer_digits") <= 38) & bounded


def _integer(native: str, low: int, high: int) -> tuple[Column, Column]:
    values = F.concat(
        F.lit("values from "), _c("min_integer_text"),
        F.lit(" to "), _c("max_integer_text"),
    )
    kind = F.when(_within(low, high), native)
    note = F.when(_within(low, high), "")
    for width in WIDE_DIGITS:
        fits = _c("max_integer_digits") <= width
        kind = kind.when(fits, f"Decimal({width}, 0)")
        note = note.when(
            fits,
            F.concat(values, F.lit(f" do not fit {native}; widened to Decimal({width}, 0)")),
        )
    too_long = F.lit(f" are longer than {WIDE_DIGITS[-1]} digits; kept exact as String")
    return kind.otherwise("String"), note.otherwise(F.concat(values, too_long))


def _decimal(scale: int, widths: tuple[int, ...]) -> tuple[Column, Column]:
    needed = _c("max_decimal_int_digits") + scale
    kind = note = None
    for width in widths:
        text = f"Decimal({width}, {scale})"
        reason = (
            F.lit("")
            if width == widths[0]
            else F.concat(needed.cast("string"), F.lit(f" digits are needed; widened to {text}"))
        )
        kind = F.when(needed <= width, text) if kind is None else kind.when(needed <= width, text)
        note = F.when(needed <= width, reason) if note is None else note.when(needed <= width, reason)
    overflow = F.concat(
        needed.cast("string"), F.lit(" digits exceed the 76 a decimal holds; kept exact as String")
    )
    return kind.otherwise("String"), note.otherwise(overflow)


def _date() -> tuple[Column, Column]:
    def inside(low: str, high: str) -> Column:
        return (_c("min_date") >= F.lit(low).cast("date")) & (
            _c("max_date") <= F.lit(high).cast("date")
        )

    dates = F.concat(
        F.lit("dates from "), _c("min_date").cast("string"),
        F.lit(" to "), _c("max_date").cast("string"),
    )
    kind = (
        F.when(inside(DATE_MIN, DATE_MAX), "Date")
        .when(inside(DATE32_MIN, DATE32_MAX), "Date32")
        .otherwise("String")
    )
    note = (
        F.when(inside(DATE_MIN, DATE_MAX), "")
        .when(
            inside(DATE32_MIN, DATE32_MAX),
            F.concat(dates, F.lit(f" do not fit Date ({DATE_MIN}..{DATE_MAX}); widened to Date32")),
        )
        .otherwise(
            F.concat(dates, F.lit(f" do not fit Date32 ({DATE32_MIN}..{DATE32_MAX}); kept as String"))
        )
    )
    return kind, note


def _rules(lossless: bool) -> list[tuple[Column, Column, Column]]:
    """(condition, type, note) in order of precedence."""

    def fixed(condition: Column, kind: str, note: str = ""):
        return condition, F.lit(kind), F.lit(note)

    numeric = _c("all_uint") | _c("all_int") | _c("all_decimal") | _c("all_float")
    none_left = _c("total_non_empty") == 0
    too_fine = (
        fixed(_c("all_decimal"), "String", "more than 10 decimals; kept exact as String")
        if lossless
        else fixed(_c("all_decimal"), "Float64", "more than 10 decimals; fallback to Float64")
    )
    return [
        fixed(none_left & _c("has_na_marker"), "String", "only missing-value markers; String"),
        fixed(none_left, "String", "all values are empty; String"),
        fixed(_c("all_bool") & _c("has_explicit_bool_literal"), "Bool"),
        fixed(
            _c("has_unsendable_float"),
            "String",
            "infinity, or a nan spelling that is no missing-value marker; kept as String",
        ),
        fixed(
            _c("has_lossy_numeric_text") & numeric,
            "String",
            "leading zeros, a plus sign or non-ASCII digits would be lost; kept as String",
        ),
        (_c("all_uint"), *_integer("UInt64", 0, UINT64_MAX)),
        (_c("all_int"), *_integer("Int64", INT64_MIN, INT64_MAX)),
        (_c("all_decimal") & (_c("max_decimal_scale") <= 2), *_decimal(2, (18, 38, 76))),
        (_c("all_decimal") & (_c("max_decimal_scale") <= 10), *_decimal(10, (38, 76))),
        too_fine,
        (_c("all_date"), *_date()),
        fixed(
            _c("all_datetime") & _c("has_timezone_offset"),
            "String",
            "timestamps carry a zone offset, which DateTime cannot hold; kept as String",
        ),
        fixed(_c("all_datetime"), "DateTime"),
        fixed(_c("all_float"), "Float64"),
        fixed(F.lit(True), "String", "mixed or unsupported values; String"),
    ]


def decide_types(profiles: DataFrame, lossless: bool = False) -> DataFrame:
    """Add ``inferred_type``, ``nullable``, ``final_type`` and ``notes``.

    ``lossless=True`` keeps decimals of more than ten places as text where the
    default falls back to Float64.
    """
    if "min_integer_text" not in profiles.columns:
        profiles = profiles.withColumns(
            {
                "min_integer_text": _c("min_integer").cast("string"),
                "max_integer_text": _c("max_integer").cast("string"),
            }
        )
    kind = note = F
    for condition, rule_kind, rule_note in _rules(lossless):
        kind = kind.when(condition, rule_kind)
        note = note.when(condition, rule_note)
    nullable = _c("has_empty") | (_c("has_na_marker") & (_c("inferred_type") != "String"))
    final = F.when(
        _c("nullable"), F.concat(F.lit("Nullable("), _c("inferred_type"), F.lit(")"))
    ).otherwise(_c("inferred_type"))
    return (
        profiles.withColumn("inferred_type", kind)
        .withColumn("notes", F.coalesce(note, F.lit("")))
        .withColumn("nullable", nullable)
        .withColumn("final_type", final)
    )
