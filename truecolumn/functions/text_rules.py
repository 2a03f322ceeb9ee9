"""What a piece of text may mean: predicates and parsers as Column expressions.

Every function takes and returns a Column, so the rules run inside whole-stage
code generation and never call Python per row.  Unless stated otherwise the
argument is text already stripped with :func:`strip`.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no value" in every type but String.  They
# are the documented default `na_values` of pandas.read_csv.
NA_MARKERS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Boolean spellings, compared in lower case.
TRUE_WORDS: tuple[str, ...] = ("true", "1", "yes", "y")
FALSE_WORDS: tuple[str, ...] = ("false", "0", "no", "n")
BOOL_WORDS: tuple[str, ...] = TRUE_WORDS + FALSE_WORDS
EXPLICIT_BOOL_WORDS: tuple[str, ...] = ("true", "false", "yes", "no", "y", "n")

# Letter pairs left behind when UTF-8 Cyrillic is read as cp1251,
# and the two faces of the replacement character.
MOJIBAKE_PAIRS: tuple[str, ...] = ("С‚", "Рµ", "Р°", "Рё", "Рѕ", "РЅ")
REPLACEMENT_FORMS: tuple[str, ...] = ("пїЅ", "�")
REPLACEMENT_WEIGHT = 10

# The characters Python's str.strip() removes.
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

INTEGER_PATTERN = r"^[+-]?[0-9]+\z"
UNSIGNED_PATTERN = r"^\+?[0-9]+\z"
DECIMAL_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?0*[0-9]{1,18})?\z"
_RUN = "[0-9](_?[0-9])*"
FLOAT_PATTERN = rf"^[+-]?({_RUN}(\.({_RUN})?)?|\.{_RUN})([eE][+-]?{_RUN})?\z"
NON_FINITE_PATTERN = r"^[+-]?(?i:nan|inf|infinity)\z"

# Letters and digits of every script stay in a name; the rest, and runs of
# underscores, become one underscore.
IDENTIFIER_GAP_PATTERN = r"[^\p{L}\p{N}]+"
LEADING_DIGIT_PATTERN = r"^[\p{Nd}¹²³⁰⁴-⁹₀-₉]"

DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
BASIC_DATE_PATTERN = r"^[0-9]{8}\z"
WEEK_DATE_PATTERN = r"^[0-9]{4}(-W[0-9]{2}(-[1-7])?|W[0-9]{2}[1-7]?)\z"
PLAIN_NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"
PLAIN_TIMESTAMP_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,6})?\z"
)
#: The same with a fraction of any length.
NAIVE_TIMESTAMP_PATTERN = PLAIN_TIMESTAMP_PATTERN.replace("{1,6}", "+")
COMMON_TIMESTAMP_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?)?\z"
)
_DATE_PART = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}"
    r"|[0-9]{4}-W[0-9]{2}-[1-7]|[0-9]{4}-W[0-9]{2}|[0-9]{4}W[0-9]{2}[1-7]|[0-9]{4}W[0-9]{2}"
)
_HOUR, _SIXTY = r"(?:[01][0-9]|2[0-3])", r"[0-5][0-9]"
_FRACTION = r"(?:[.,][0-9]+)?"
_CLOCK = (
    rf"{_HOUR}(?::{_SIXTY}(?::{_SIXTY}{_FRACTION})?)?"
    rf"|{_HOUR}{_SIXTY}(?:{_SIXTY}{_FRACTION})?"
)
# group 1: date, group 2: clock, group 3: offset (empty when naive)
# The separator is any one character but a digit or a point, so that no number
# reads as a date-time.
TIMESTAMP_PATTERN = rf"^({_DATE_PART})[^0-9.]({_CLOCK})(Z|[+-](?:{_CLOCK}))?\z"
# Everything that could still be a number or a date in an unusual notation.
UNUSUAL_PATTERN = (
    r"^[+-]?[\p{Nd}_]*\.?[\p{Nd}_]*([eE][+-]?[\p{Nd}_]+)?\z"
    rf"|{NON_FINITE_PATTERN}|{WEEK_DATE_PATTERN}|{TIMESTAMP_PATTERN}"
)


def strip(value: Column) -> Column:
    """Trim with Python's whitespace set; null becomes the empty string."""
    # Text that begins and ends with visible ASCII, the common case, is kept as is.
    last = F.substring(value, -1, 1)
    clean = (value >= "!") & (value < "\x7f") & (last >= "!") & (last < "\x7f")
    trimmed = F.when(clean, value).otherwise(F.btrim(value, F.lit(WHITESPACE)))
    return F.coalesce(trimmed, F.lit(""))


@lru_cache(maxsize=1)
def _digit_alphabet() -> tuple[str, str]:
    """Every non-ASCII decimal digit character and the ASCII digit it stands for."""
    source = [chr(c) for c in range(0x80, 0x110000) if chr(c).isdecimal()]
    return "".join(source), "".join(str(int(ch)) for ch in source)


def is_ascii(value: Column) -> Column:
    """One byte per character; cheaper than a pattern on long text."""
    return F.length(value) == F.octet_length(value)


def ascii_digits(value: Column) -> Column:
    """Decimal digits of any script rewritten as 0-9; other characters stay."""
    source, target = _digit_alphabet()
    return F.when(is_ascii(value), value).otherwise(F.translate(value, source, target))


def starts_with_digit(value: Column) -> Column:
    """First byte is 0-9; a cheap gate in front of the date patterns."""
    return (value >= "0") & (value < ":")


def may_be_number(value: Column) -> Column:
    """Cheap gate: the first character can begin a number in some script."""
    first = F.substring(value, 1, 1)
    return starts_with_digit(value) | first.isin(*"+-._nNiI") | (F.octet_length(first) > 1)


def is_missing(value: Column, na_markers: bool) -> Column:
    """No value: null or empty, and with ``na_markers`` the marker spellings too."""
    if na_markers:
        return value.isNull() | strip(value).isin(*NA_MARKERS)
    return value.isNull() | (value == "")


def is_marker(value: Column) -> Column:
    return value.isin(*[m for m in NA_MARKERS if m])


def is_bool(value: Column) -> Column:
    return F.lower(value).isin(*BOOL_WORDS)


def is_explicit_bool(value: Column) -> Column:
    return F.lower(value).isin(*EXPLICIT_BOOL_WORDS)


def is_int(value: Column) -> Column:
    return ascii_digits(value).rlike(INTEGER_PATTERN)


def is_uint(value: Column) -> Column:
    return ascii_digits(value).rlike(UNSIGNED_PATTERN)


def loses_text_as_number(value: Column) -> Column:
    """Reading this text as a number would not give the same text back."""
    digits = F.when(value.startswith("-"), F.substring(value, 2, 2)).otherwise(
        F.substring(value, 1, 2)
    )
    return value.startswith("+") | ((digits >= "00") & (digits < "0:")) | ~is_ascii(value)


def decimal_text_of(plain: Column) -> Column:
    """:func:`decimal_text` of a value already passed through ascii_digits."""
    joined = F.replace(plain, F.lit("_"), F.lit(""))
    return F.when(joined.rlike(DECIMAL_PATTERN), joined)


def decimal_text(value: Column) -> Column:
    """The value in ASCII decimal notation without underscores, or null."""
    return decimal_text_of(F.when(may_be_number(value), ascii_digits(value)))


def has_exponent(text: Column) -> Column:
    return F.contains(text, F.lit("e")) | F.contains(text, F.lit("E"))


def decimal_parts(text: Column) -> dict[str, Column]:
    """Pieces of a :func:`decimal_text` as string arithmetic.

    76-digit numbers never pass through a Spark decimal or a double.
    ``digits`` are all digits, ``significant`` the same without leading zeros,
    and the value is ``digits * 10**exponent``.
    """
    lowered = F.lower(text)
    mantissa = F.substring_index(lowered, "e", 1)
    written = F.when(
        has_exponent(text), F.substring_index(lowered, "e", -1).try_cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))
    point = F.locate(".", mantissa)
    fraction = F.when(point > 0, F.length(mantissa) - point).otherwise(F.lit(0))
    digits = F.replace(F.ltrim(mantissa, F.lit("+-")), F.lit("."), F.lit(""))
    return {
        "negative": mantissa.startswith("-"),
        "digits": digits,
        "significant": F.ltrim(digits, F.lit("0")),
        "exponent": written - fraction,
    }


def int_digits(text: Column) -> Column:
    """Digits before the decimal point of a :func:`decimal_text`; 0 for zero."""
    parts = decimal_parts(text)
    size = F.length(parts["significant"])
    zero = F.lit(0).cast("bigint")
    shifted = F.when(size == 0, zero).otherwise(F.greatest(size + parts["exponent"], zero))
    plain = F.length(F.ltrim(F.substring_index(text, ".", 1), F.lit("+-0"))).cast("bigint")
    return F.when(has_exponent(text), shifted).otherwise(plain)


def decimal_scale(text: Column) -> Column:
    """Digits after the decimal point of a :func:`decimal_text`."""
    zero = F.lit(0).cast("bigint")
    shifted = F.greatest(-decimal_parts(text)["exponent"], zero)
    point = F.locate(".", text)
    plain = F.when(point > 0, (F.length(text) - point).cast("bigint")).otherwise(zero)
    return F.when(has_exponent(text), shifted).otherwise(plain)


def decimal_shape(value: Column) -> Column:
    """``struct(int_digits, scale)`` of a decimal literal, null for other text."""
    return decimal_shape_of(decimal_text(value))


def decimal_shape_of(text: Column) -> Column:
    """:func:`decimal_shape` of a :func:`decimal_text`; a column of its own keeps it from being worked out anew in every branch."""
    return F.when(
        text.isNotNull(),
        F.struct(int_digits(text).alias("int_digits"), decimal_scale(text).alias("scale")),
    )


def float_kind_of(plain: Column, text: Column) -> Column:
    """:func:`float_kind` from the ASCII form of a value and its decimal text."""
    # Only an exponent or hundreds of digits can leave the range of a double,
    # so ordinary numbers are not parsed at all.
    may_overflow = has_exponent(plain) | (F.length(plain) > 300)
    parsed = F.replace(plain, F.lit("_"), F.lit("")).try_cast("double")
    overflow = F.coalesce(F.abs(parsed) == float("inf"), F.lit(False))
    odd = F.contains(plain, F.lit("_")) | (text.isNull() & may_overflow)
    is_nan = F.contains(F.lower(plain), F.lit("nan"))
    return (
        F.when(text.isNotNull() & ~odd & ~may_overflow, "finite")
        .when(
            (text.isNotNull() & ~odd) | (odd & plain.rlike(FLOAT_PATTERN)),
            F.when(may_overflow & overflow, "infinity").otherwise("finite"),
        )
        .when(
            text.isNull() & (F.length(plain) <= 9) & plain.rlike(NON_FINITE_PATTERN),
            F.when(is_nan, "nan").otherwise("infinity"),
        )
    )


def float_kind(value: Column) -> Column:
    """``finite``, ``nan``, ``infinity``, or null when the text is not a float."""
    return float_kind_of(ascii_digits(value), decimal_text(value))


def date_from_text(value: Column) -> Column:
    """Date of an ISO date text (dashed, basic or week form), or null."""
    size = F.length(value)
    dashed = F.concat_ws(
        "-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)
    )
    packed = F.replace(value, F.lit("-"), F.lit(""))
    year = F.substring(value, 1, 4).try_cast("int")
    week = F.substring(packed, 6, 2).try_cast("int")
    day = F.coalesce(F.substring(packed, 8, 1).try_cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
    week_day = F.date_add(monday, day - 1)
    week_exists = (
        (week >= 1)
        & (F.year(F.date_add(monday, 3)) == year)
        & (week_day <= F.lit("9999-12-31").cast("date"))
    )
    return (
        F.when((size == 10) & value.rlike(DATE_PATTERN), value.try_cast("date"))
        .when((size == 8) & value.rlike(BASIC_DATE_PATTERN), dashed.try_cast("date"))
        .when(
            F.contains(value, F.lit("W")) & value.rlike(WEEK_DATE_PATTERN),
            F.when(week_exists, week_day),
        )
    )


def _in_era(value: Column) -> Column:
    """Starts with a digit and not with year 0000."""
    return (value >= "0001") & (value < ":")


def date_value(value: Column) -> Column:
    """ISO date (dashed, basic or week form) as a date, or null."""
    sized = F.length(value).isin(7, 8, 10)
    return F.when(_in_era(value) & sized, date_from_text(value))


def _timestamp_sized(value: Column) -> Column:
    """Cheap gate: long enough, and the fifth character fits an ISO date."""
    fifth = F.substring(value, 5, 1)
    return _in_era(value) & (F.length(value) >= 10) & ((fifth == "-") | (fifth == "W") | (
        (fifth >= "0") & (fifth < ":")))


def date_part(value: Column) -> Column:
    """The date text inside an ISO date or date-time, or null."""
    sized = _timestamp_sized(value)
    return (
        F.when(_in_era(value) & F.length(value).isin(7, 8, 10) & ~F.contains(value, F.lit(":")), value)
        .when(sized & value.rlike(PLAIN_TIMESTAMP_PATTERN), F.substring(value, 1, 10))
        .when(sized & value.rlike(TIMESTAMP_PATTERN), F.regexp_extract(value, TIMESTAMP_PATTERN, 1))
    )


def has_offset(value: Column) -> Column:
    """The text is a date-time that carries a zone offset."""
    general = _timestamp_sized(value) & ~value.rlike(PLAIN_TIMESTAMP_PATTERN)
    return F.when(general, F.regexp_extract(value, TIMESTAMP_PATTERN, 3) != "").otherwise(
        F.lit(False)
    )


def _clock_text(clock: Column) -> Column:
    """``HH:MM:SS.ffffff`` from any accepted clock spelling."""
    whole = F.regexp_extract(clock, r"^([0-9:]+)", 1)
    fraction = F.regexp_extract(clock, r"[.,]([0-9]+)\z", 1)
    digits = F.rpad(F.replace(whole, F.lit(":"), F.lit("")), 6, "0")
    return F.concat(
        F.substring(digits, 1, 2), F.lit(":"),
        F.substring(digits, 3, 2), F.lit(":"),
        F.substring(digits, 5, 2), F.lit("."),
        F.rpad(F.substring(fraction, 1, 6), 6, "0"),
    )


def timestamp_value(value: Column) -> Column:
    """ISO date-time as a zone-less timestamp (any offset is left out), or null."""
    sized = _timestamp_sized(value)
    date_text = F.regexp_extract(value, TIMESTAMP_PATTERN, 1)
    clock = F.regexp_extract(value, TIMESTAMP_PATTERN, 2)
    general = F.concat_ws(" ", date_from_text(date_text).cast("string"), _clock_text(clock))
    return (
        F.when(sized & value.rlike(PLAIN_TIMESTAMP_PATTERN), value.try_cast("timestamp_ntz"))
        .when(sized & value.rlike(TIMESTAMP_PATTERN), general.try_cast("timestamp_ntz"))
        .otherwise(date_value(value).cast("timestamp_ntz"))
    )


def split_samples(value: Column) -> Column:
    """Comma-separated text as an array of its non-empty stripped parts."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip)
    return F.filter(parts, lambda part: part != "")


def identifier(value: Column) -> Column:
    """A header or label as a column name; null where nothing usable is left."""
    words = F.regexp_replace(F.lower(strip(value)), IDENTIFIER_GAP_PATTERN, "_")
    name = F.btrim(words, F.lit("_"))
    named = F.when(name.rlike(LEADING_DIGIT_PATTERN), F.concat(F.lit("col_"), name))
    return F.when(name != "", named.otherwise(name))


def _occurrences(value: Column, needle: str) -> Column:
    removed = F.replace(value, F.lit(needle), F.lit(""))
    return ((F.length(value) - F.length(removed)) / len(needle)).cast("bigint")


def mojibake_score(value: Column) -> Column:
    """Count of mis-decoding traces; a replacement character weighs ten."""
    text = F.coalesce(value, F.lit(""))
    score = F.lit(0).cast("bigint")
    for form in REPLACEMENT_FORMS:
        score = score + _occurrences(text, form) * REPLACEMENT_WEIGHT
    for pair in MOJIBAKE_PAIRS:
        score = score + _occurrences(text, pair)
    # Plain ASCII text, the common case, cannot contain any of them.
    return F.when(is_ascii(text), F.lit(0).cast("bigint")).otherwise(score)
