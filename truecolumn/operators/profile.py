"""Column profile: one mergeable aggregation over every cell of a text table.

The table is turned into (column, value) pairs inside the scan stage, each
value is classified by native expressions, and a hash aggregation with
fixed-width buffers folds them on the map side.  What is shuffled is a few
dozen rows per task and column, whatever the size of the table, plus the
distinct values written in an unusual notation.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from truecolumn.functions import text_rules as R

SAMPLES_PER_COLUMN = 5


def cells(df: DataFrame, columns: list[str] | None = None, over_bytes: int = 0) -> DataFrame:
    """``(column_name, value)`` for every cell, or those of more bytes; the text is stripped."""
    columns = columns or df.columns
    tall = df.select(*[F.col(f"`{c}`") for c in columns]).unpivot(
        [], [F.col(f"`{c}`") for c in columns], "column_name", "value"
    )
    if over_bytes:
        tall = tall.where(F.octet_length("value") > over_bytes)
    return tall.select("column_name", R.strip(F.col("value")).alias("value"))


# What a cell is, as a small number.
EMPTY, MARKER, TEXT, WORD, NUMBER, DAY, MOMENT, MOMENT_WITH_OFFSET, UNUSUAL = range(9)


def sorted_by_kind(tall: DataFrame) -> DataFrame:
    """The common notations of each cell, told apart cheaply.

    Plain numbers, ISO dates and date-times, boolean words and ordinary text
    are settled here.  Only values in an unusual notation (exponents,
    underscores, digits of other scripts, week dates, ...) keep their text in
    ``unusual`` for :func:`_unusual_marks`.

    The projections stay short on purpose: a generated method beyond 8000
    bytes of byte code would never be compiled by the JVM.
    """
    value = F.col("value")
    size = F.length(value)
    kind, number, day = F.col("kind"), F.col("is_number"), F.col("day")
    longest_marker = max(map(len, R.NA_MARKERS))
    zero = F.lit(0)
    dashed = F.concat_ws(
        "-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)
    )
    is_number = R.may_be_number(value) & value.rlike(R.PLAIN_NUMBER_PATTERN)
    date_text = F.when(
        R.starts_with_digit(value) & (value >= "0001"),
        F.when(number, F.when((size == 8) & ~F.contains(value, F.lit(".")), dashed))
        .when((size == 10) & value.rlike(R.DATE_PATTERN), value)
        .when((size >= 16) & value.rlike(R.COMMON_TIMESTAMP_PATTERN), F.substring(value, 1, 10)),
    )
    offset_mark = F.substring(value, 12, 1 << 20).rlike("[Z+-]")
    told = (
        F.when(number, NUMBER)
        .when(value == "", EMPTY)
        .when((size <= longest_marker) & R.is_marker(value), MARKER)
        .when((size <= 5) & R.is_explicit_bool(value), WORD)
        .when(day.isNotNull() & (size == 10), DAY)
        .when(day.isNotNull(), F.when(offset_mark, MOMENT_WITH_OFFSET).otherwise(MOMENT))
        .when(R.may_be_number(value) & value.rlike(R.UNUSUAL_PATTERN), UNUSUAL)
        .otherwise(TEXT)
    )
    whole_text = F.substring_index(value, ".", 1)
    point = F.locate(".", value)
    signless = F.when(
        value.startswith("-"), F.substring(value, 2, 2)
    ).otherwise(F.substring(value, 1, 2))
    lossy = ((signless >= "00") & (signless < "0:")) | value.startswith("+")

    def mark(condition: Column, bit: int) -> Column:
        return F.when(condition, bit).otherwise(zero)

    detail = F.when(
        number,
        mark(value.startswith("-"), 1)
        + mark(lossy, 2)
        + mark((size == 1) & value.isin("0", "1"), 4)
        + mark(point > 0, 8)
        + mark(day.isNotNull(), 16),
    ).otherwise(zero)
    whole = number & (F.col("scale") == 0)
    short = F.col("int_digits") <= 18
    return (
        tall.withColumn("is_number", is_number)
        .withColumn("day", date_text.try_cast("date"))
        .withColumns(
            {
                "kind": told,
                "detail": detail,
                "scale": F.when(number, F.when(point > 0, size - point).otherwise(zero)),
                "int_digits": F.when(number, F.length(F.ltrim(whole_text, F.lit("+-0")))),
            }
        )
        .select(
            "column_name",
            "kind",
            "detail",
            F.when(kind == UNUSUAL, value).alias("unusual"),
            "scale",
            "int_digits",
            F.when(whole, F.col("int_digits")).alias("whole_digits"),
            # Most whole numbers fit a long; only longer ones pay for a decimal.
            F.when(whole & short, whole_text.try_cast("bigint")).alias("whole_short"),
            F.when(whole & ~short, whole_text.try_cast("decimal(38,0)")).alias("whole_long"),
            F.when(kind.isin(DAY, NUMBER), day).alias("day"),
        )
    )


def _tallied(tall: DataFrame) -> DataFrame:
    """Cells counted per column, kind and detail, with their extremes.

    At most a few dozen groups per column, besides the distinct values in an
    unusual notation.  Every buffer is fixed width, so this is a hash
    aggregation that combines on the map side.
    """
    return sorted_by_kind(tall).groupBy("column_name", "kind", "detail", "unusual").agg(
        F.count(F.lit(1)).alias("cells"),
        F.max("scale").alias("scale"),
        F.max("int_digits").alias("int_digits"),
        F.max("whole_digits").alias("whole_digits"),
        F.min("whole_short").alias("min_short"),
        F.max("whole_short").alias("max_short"),
        F.min("whole_long").alias("min_long"),
        F.max("whole_long").alias("max_long"),
        F.min("day").alias("min_day"),
        F.max("day").alias("max_day"),
    )


def _unusual_marks(tallied: DataFrame) -> DataFrame:
    """Read the unusual notations in full, one distinct value at a time."""
    value, dec, date_text = F.col("unusual"), F.col("dec"), F.col("date_text")
    return (
        tallied.withColumns({"plain": R.ascii_digits(value), "date_text": R.date_part(value)})
        .withColumn("dec", R.decimal_text_of(F.col("plain")))
        .withColumns(
            {
                "form": R.float_kind_of(F.col("plain"), dec),
                "u_scale": R.decimal_scale(dec),
                "u_digits": R.int_digits(dec),
                "u_day": R.date_from_text(date_text),
                "u_plain": ~F.contains(value, F.lit("_"))
                & ~R.has_exponent(value)
                & ~F.contains(value, F.lit("."))
                & dec.isNotNull(),
            }
        )
        .withColumn("u_whole", F.when(F.col("u_scale") == 0, dec.try_cast("decimal(38,0)")))
    )


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of statistics per column.

    ``min_integer`` and ``max_integer`` cover whole numbers of up to 38 digits;
    ``max_integer_digits`` tells whether longer ones exist, and
    :func:`exact_integer_bounds` gives those exactly.
    """
    return fold(cells(df, columns))


def fold(tall: DataFrame) -> DataFrame:
    """:func:`profile` of a table of ``(column_name, value)`` cells."""
    col = F.col
    value, dec = col("unusual"), col("dec")
    kind, detail = col("kind"), col("detail")
    odd, number = kind == UNUSUAL, kind == NUMBER
    has = {bit: detail.bitwiseAND(F.lit(bit)) > 0 for bit in (1, 2, 4, 8, 16)}
    dated = number & has[16]
    odd_day = odd & col("u_day").isNotNull()
    odd_whole_day = odd_day & (F.length("date_text") == F.length(value))
    numeric = number | (odd & (dec.isNotNull() | col("form").isNotNull()))

    def every(condition: Column, alias: str) -> Column:
        valued = F.when(kind >= TEXT, F.coalesce(condition, F.lit(False)))
        return F.coalesce(F.bool_and(valued), F.lit(True)).alias(alias)

    def some(condition: Column, alias: str) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False)).alias(alias)

    def most(usual: str, unusual: Column, alias: str) -> Column:
        peak = F.greatest(F.max(col(usual)).cast("bigint"), F.max(F.when(odd, unusual)))
        return F.coalesce(peak, F.lit(0).cast("bigint")).alias(alias)

    def as_whole(name: str) -> Column:
        return col(name).cast("decimal(38,0)")

    return _unusual_marks(_tallied(tall)).groupBy("column_name").agg(
        some(kind == EMPTY, "has_empty"),
        some(kind == MARKER, "has_na_marker"),
        F.coalesce(F.sum(F.when(kind >= TEXT, col("cells"))), F.lit(0).cast("bigint")).alias(
            "total_non_empty"
        ),
        every((kind == WORD) | (number & has[4]), "all_bool"),
        some(kind == WORD, "has_explicit_bool_literal"),
        every((number & ~has[8]) | (odd & col("u_plain")), "all_int"),
        every(
            (number & ~has[8] & ~has[1]) | (odd & col("u_plain") & ~dec.startswith("-")),
            "all_uint",
        ),
        every(number | (odd & dec.isNotNull()), "all_decimal"),
        every(number | (odd & col("form").isNotNull()), "all_float"),
        every((kind == DAY) | dated | odd_whole_day, "all_date"),
        every(kind.isin(DAY, MOMENT, MOMENT_WITH_OFFSET) | dated | odd_day, "all_datetime"),
        some(
            numeric & ((number & has[2]) | (odd & R.loses_text_as_number(value))),
            "has_lossy_numeric_text",
        ),
        some(odd & (col("form") != "finite"), "has_unsendable_float"),
        most("scale", col("u_scale"), "max_decimal_scale"),
        most("int_digits", col("u_digits"), "max_decimal_int_digits"),
        F.least(F.min("min_day"), F.min(F.when(odd_whole_day, col("u_day")))).alias("min_date"),
        F.greatest(F.max("max_day"), F.max(F.when(odd_whole_day, col("u_day")))).alias("max_date"),
        some(
            (kind == MOMENT_WITH_OFFSET) | (odd_day & R.has_offset(value)), "has_timezone_offset"
        ),
        most(
            "whole_digits", F.when(col("u_scale") == 0, col("u_digits")), "max_integer_digits"
        ),
        F.least(
            F.min(as_whole("min_short")), F.min("min_long"), F.min("u_whole")
        ).alias("min_integer"),
        F.greatest(
            F.max(as_whole("max_short")), F.max("max_long"), F.max("u_whole")
        ).alias("max_integer"),
    )


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of the union of the profiled tables, from profiles alone."""
    stacked = profiles[0]
    for other in profiles[1:]:
        stacked = stacked.unionByName(other)
    folds = []
    for name in stacked.columns:
        if name == "column_name":
            continue
        if name.startswith("all_"):
            fold = F.bool_and(name)
        elif name.startswith("has_"):
            fold = F.bool_or(name)
        elif name == "total_non_empty":
            fold = F.sum(name)
        elif name.startswith("min_"):
            fold = F.min(name)
        else:
            fold = F.max(name)
        folds.append(fold.alias(name))
    return stacked.groupBy("column_name").agg(*folds)


def exact_integer_bounds(df: DataFrame, columns: list[str] | None = None, over_digits: int = 0) -> DataFrame:
    """Smallest and largest whole number of each column as text, any length.

    Only columns that outgrew 38 digits need this, so it is a separate pass.
    Whole numbers are ordered by sign, then by digit count, then digit by digit.
    With ``over_digits`` only numbers of more digits than that are compared.
    """
    # A text is at least as long as its digits, which spares the others all the rest.
    tall = cells(df, columns, over_bytes=over_digits)
    if over_digits:
        tall = tall.where(F.length(F.ltrim("value", F.lit("+-0"))) > over_digits)
    tall = tall.where(F.col("value").rlike(R.INTEGER_PATTERN))
    negative = F.col("value").startswith("-")
    digits = F.ltrim(F.col("value"), F.lit("+-0"))
    shown = F.when(digits == "", "0").when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)
    size = F.when(negative, -F.length(digits)).otherwise(F.length(digits))
    rank = F.struct(
        size.alias("size"),
        # For negative numbers of one length the larger digits are the smaller number.
        F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits),
    )
    ranked = tall.select("column_name", shown.alias("shown"), rank.alias("rank"))
    return ranked.groupBy("column_name").agg(
        F.min_by("shown", "rank").alias("min_integer_text"),
        F.max_by("shown", "rank").alias("max_integer_text"),
    )


def _smallest_per_batch(batches):
    """Keep the few smallest distinct values of each column seen by one task."""
    kept: dict[str, pa.Array] = {}
    for batch in batches:
        for name in batch.schema.names:
            distinct = pc.unique(batch.column(name))
            if name in kept:
                distinct = pc.unique(pa.concat_arrays([kept[name], distinct]))
            distinct = distinct.filter(pc.not_equal(distinct, ""))
            kept[name] = distinct.take(pc.array_sort_indices(distinct))[:SAMPLES_PER_COLUMN]
    for name, values in kept.items():
        names = pa.array([name] * len(values), pa.string())
        yield pa.RecordBatch.from_arrays([names, values.cast(pa.string())], ["column_name", "value"])


def samples(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Up to five smallest distinct non-empty values of each column.

    Each task reduces its own rows to five per column before anything is
    shuffled, so a value that fills a third of the table costs nothing extra.
    """
    columns = columns or df.columns
    stripped = df.select(*[R.strip(F.col(f"`{c}`")).alias(c) for c in columns])
    reduced = stripped.mapInArrow(_smallest_per_batch, "column_name string, value string")
    # Distinct first, then five per column and partition: neither a repeated
    # value nor the number of tasks makes the last step grow.
    by_value = Window.partitionBy("column_name").orderBy("value")
    smallest = (
        reduced.distinct()
        .withColumn("place", F.row_number().over(by_value))
        .where(F.col("place") <= SAMPLES_PER_COLUMN)
    )
    return smallest.groupBy("column_name").agg(
        F.array_sort(F.collect_list("value")).alias("samples")
    )
