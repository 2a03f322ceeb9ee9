"""Strict conversion of text to typed values, as Column expressions.

A conversion gives a value, or null for a cell it refuses; the reason of a
refusal is worked out only for refused cells.  Nothing is ever rounded,
truncated to fit, or read as something else than its text says.

Every column has a little code of its own that settles its type's common
spelling by one pattern.  Other spellings are gathered in one array per type
family and converted there by one kernel, so the code of a wide table stays
small enough to compile.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from truecolumn.functions import text_rules as R
from truecolumn.plans.decide import DATE32_MAX, DATE32_MIN, DATE_MAX, DATE_MIN
from truecolumn.plans.type_text import LogicalType

_DECIMAL_38 = "decimal(38,0)"


def _literals(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STRIPPED = f"""
coalesce(CASE WHEN {{c}} >= '!' AND {{c}} < '\x7f' AND right({{c}}, 1) >= '!' AND right({{c}}, 1) < '\x7f'
              THEN {{c}} ELSE btrim({{c}}, '{R.WHITESPACE}') END, '')"""
_PRESENT = f"""
CASE WHEN NOT (length({{c}}) <= {max(map(len, R.NA_MARKERS))} AND {{c}} IN ({_literals(R.NA_MARKERS)}))
     THEN {{c}} END"""


def stripped_cell(source: str, kind: LogicalType) -> Column:
    """A String cell exactly as it is, any other cell stripped.

    Written as SQL text: a table has one of these per column, and each is a
    single call to the JVM this way.
    """
    name = "`" + source.replace("`", "``") + "`"
    return F.expr(name if kind.kind == "string" else _STRIPPED.format(c=name))


def present_cell(prefix: str, kind: LogicalType) -> Column:
    """Null where there is no value: an empty String cell, a marker elsewhere."""
    name = f"{prefix}_cell"
    return F.expr(f"nullif({name}, '')" if kind.kind == "string" else _PRESENT.format(c=name))


def _bounds(kind: LogicalType) -> tuple[int, int]:
    if kind.signed:
        return -(2 ** (kind.bits - 1)), 2 ** (kind.bits - 1) - 1
    return 0, 2**kind.bits - 1


def _date_bounds(kind: LogicalType) -> tuple[str, str]:
    return (DATE_MIN, DATE_MAX) if kind.base == "Date" else (DATE32_MIN, DATE32_MAX)


def is_wide(kind: LogicalType) -> bool:
    """Numbers no Spark type holds; they stay validated text."""
    return (kind.kind == "decimal" and kind.precision > 38) or (
        kind.kind == "integer" and kind.bits > 64
    )


def literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- common spellings: a little code for every column -------------------------
#
# As SQL text: a table has these for every column, and each is one call to the JVM.


def _fast_integer(c: str, kind: LogicalType) -> str:
    low, high = _bounds(kind)
    # Eighteen digits always fit a long, so this cast cannot fail; a fraction of zeros is whole.
    number = f"try_cast(substring_index({c}, '.', 1) AS bigint)"
    if kind.bits < 64:
        number = f"CASE WHEN {number} BETWEEN {low} AND {high} THEN {number} END"
    elif not kind.signed:
        number = f"CASE WHEN {number} >= 0 THEN {number} END"
    return rf"CASE WHEN {c} RLIKE r'^[+-]?[0-9]{{1,18}}(\.0*)?\z' THEN CAST({number} AS {kind.storage.simpleString()}) END"


def _fast_decimal(c: str, kind: LogicalType) -> str:
    # Plain numbers with few enough digits on either side, outer zeros aside.
    whole = f"0*[0-9]{{1,{kind.precision - kind.scale}}}" if kind.precision > kind.scale else "0+"
    return rf"CASE WHEN {c} RLIKE r'^[+-]?{whole}(\.[0-9]{{0,{kind.scale}}}0*)?\z' THEN try_cast({c} AS {kind.storage.simpleString()}) END"


def _fast_float(c: str, kind: LogicalType) -> str:
    # Adding zero turns -0.0 into 0.0; so few digits never overflow.
    return rf"CASE WHEN length({c}) <= 300 AND {c} RLIKE r'^-?[0-9]+(\.[0-9]+)?\z' THEN try_cast({c} AS double) + 0.0D END"


def _fast_date(c: str, kind: LogicalType) -> str:
    # Dashed dates order like their text.
    low, high = _date_bounds(kind)
    return f"CASE WHEN length({c}) = 10 AND {c} BETWEEN '{low}' AND '{high}' AND {c} RLIKE r'{R.DATE_PATTERN}' THEN try_cast({c} AS date) END"


def _fast_datetime(c: str, kind: LogicalType) -> str:
    # The first nineteen characters are the date-time without its fraction; a date alone is its midnight.
    return (
        f"CASE WHEN {c} >= '0001' AND {c} RLIKE r'{R.NAIVE_TIMESTAMP_PATTERN}' THEN try_cast(substring({c}, 1, 19) AS timestamp_ntz) "
        f"WHEN {c} >= '0001' AND length({c}) = 10 AND {c} RLIKE r'{R.DATE_PATTERN}' THEN CAST(try_cast({c} AS date) AS timestamp_ntz) END"
    )


def _bool(c: str, kind: LogicalType) -> str:
    return f"CASE WHEN lower({c}) IN ({_literals(R.TRUE_WORDS)}) THEN true WHEN lower({c}) IN ({_literals(R.FALSE_WORDS)}) THEN false END"


_FAST = {
    "integer": _fast_integer,
    "decimal": _fast_decimal,
    "float": _fast_float,
    "date": _fast_date,
    "datetime": _fast_datetime,
}


def _refused_at_once(c: str, kind: LogicalType) -> str:
    """Cells in the common spelling whose value the type does not have: no kernel would take them."""
    if kind.kind == "integer":
        return rf"{c} RLIKE r'^[+-]?[0-9]{{1,18}}(\.[0-9]*)?\z'"
    if kind.kind == "decimal":
        return rf"{c} RLIKE r'^[+-]?[0-9]+(\.[0-9]*)?\z'"
    if kind.kind == "date":
        return f"(length({c}) = 10 AND {c} RLIKE r'{R.DATE_PATTERN}')"
    if kind.kind == "datetime":
        return f"({c} >= '0001' AND {c} RLIKE r'{R.NAIVE_TIMESTAMP_PATTERN}')"
    return "false"


def fast_value(prefix: str, kind: LogicalType) -> Column:
    """The value of a cell in its common spelling; null leaves it to the family's kernel."""
    cell = f"{prefix}_cell"
    if is_wide(kind):
        return F.expr("CAST(NULL AS string)")
    if kind.kind == "bool":
        return F.expr(_bool(cell, kind))
    return F.expr(_FAST[kind.kind](cell, kind) if kind.kind in _FAST else cell)


# --- other spellings: one kernel for all columns of a family ------------------
#
# A kernel takes elements ``struct(cell, ...)`` with the limits of the column's
# type beside the cell, so its size does not grow with the number of columns.


def family_of(kind: LogicalType) -> str | None:
    """Whose kernel converts unusual spellings; None where there are none."""
    if is_wide(kind):
        return f"wide_{kind.kind}"
    return kind.kind if kind.kind in _FAST else None


def _limits(kind: LogicalType) -> dict[str, str]:
    """What the family's kernel needs to know of the type."""
    family = family_of(kind)
    if family == "integer":
        return {n: f"CAST('{v}' AS {_DECIMAL_38})" for n, v in zip(("low", "high"), _bounds(kind), strict=True)}
    if family == "wide_integer":
        return {n: f"'{abs(v)}'" for n, v in zip(("low", "high"), _bounds(kind), strict=True)}
    if family in ("decimal", "wide_decimal"):
        return {"precision": str(kind.precision), "scale": str(kind.scale)}
    if family == "date":
        return {n: f"DATE '{v}'" for n, v in zip(("low", "high"), _date_bounds(kind), strict=True)}
    return {}


def _each(items: Column, **steps) -> Column:
    """Fields added to every element; each step sees those of the steps before."""

    def adds(name, step):
        return lambda x: x.withField(name, step(x))

    for name, step in steps.items():
        items = F.transform(items, adds(name, step))
    return items


def _parts(x: Column) -> Column:
    found = R.decimal_parts(x["text"])
    return F.when(x["text"].isNotNull(), F.struct(*[found[n].alias(n) for n in ("negative", "digits", "significant", "exponent")]))


def _trailing_zeros(digits: Column) -> Column:
    return F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))


def _is_whole(parts: Column) -> Column:
    """``1.0`` and ``1e3`` are whole, ``1.7`` is not."""
    digits = parts["significant"]
    return (digits == "") | (parts["exponent"] + _trailing_zeros(digits) >= 0)


def _fits(x: Column) -> Column:
    """The number has at most this many digits on either side of the point."""
    digits, exponent = x["parts"]["significant"], x["parts"]["exponent"]
    size = F.greatest(F.length(digits) + exponent, F.lit(0))
    places = F.greatest(-(exponent + _trailing_zeros(digits)), F.lit(0))
    return (digits == "") | ((size <= x["precision"] - x["scale"]) & (places <= x["scale"]))


def _integers(items: Column) -> Column:
    items = _each(
        items,
        text=lambda x: F.when(x["cell"].rlike(R.DECIMAL_PATTERN), x["cell"]),
        parts=_parts,
        number=lambda x: F.when(_is_whole(x["parts"]), x["text"].try_cast(_DECIMAL_38)),
    )
    return F.transform(items, lambda x: F.when(x["number"].between(x["low"], x["high"]), x["number"]))


def _decimals(items: Column) -> Column:
    # Text that its type holds exactly; the column casts it.
    items = _each(items, text=lambda x: R.decimal_text_of(x["cell"]), parts=_parts)
    return F.transform(items, lambda x: F.when(_fits(x), x["text"]))


def _floats(items: Column) -> Column:
    def value(x: Column) -> Column:
        cell = x["cell"]
        number = cell.try_cast("double") + F.lit(0.0)
        readable = ~F.contains(cell, F.lit("_")) & cell.rlike(R.FLOAT_PATTERN)
        return F.when(readable & (F.abs(number) < float("inf")), number)

    return F.transform(items, value)


def _dates(items: Column) -> Column:
    items = _each(items, day=lambda x: R.date_value(x["cell"]))
    return F.transform(items, lambda x: F.when(x["day"].between(x["low"], x["high"]), x["day"]))


def _datetimes(items: Column) -> Column:
    def value(x: Column) -> Column:
        return F.when(~R.has_offset(x["cell"]), F.date_trunc("second", R.timestamp_value(x["cell"]))).cast("timestamp_ntz")

    return F.transform(items, value)


def _written_out(parts: Column, shift: Column) -> Column:
    """``digits * 10**shift`` without exponent, plus sign or leading zeros."""
    digits = parts["digits"]
    left = F.when(shift >= 0, F.concat(digits, F.repeat(F.lit("0"), shift))).otherwise(
        F.substring(digits, F.lit(1), F.greatest(F.length(digits) + shift, F.lit(0)))
    )
    right = F.when(
        shift < 0, F.right(F.lpad(digits, F.greatest(F.length(digits), -shift), "0"), -shift)
    ).otherwise(F.lit(""))
    whole = F.ltrim(left, F.lit("0"))
    shown = F.concat(
        F.when(parts["negative"] & (parts["significant"] != ""), "-").otherwise(""),
        F.when(whole == "", "0").otherwise(whole),
        F.when(right != "", F.concat(F.lit("."), right)).otherwise(""),
    )
    return F.when(shift.isNotNull(), shown)


def _shift(x: Column, fits: Column) -> Column:
    # Zero may be written with any exponent; other numbers that fit have a small one.
    parts = x["parts"]
    zero = F.greatest(F.lit(-76), F.least(parts["exponent"], F.lit(0))).cast("int")
    return F.when(parts["significant"] == "", zero).when(fits, parts["exponent"].try_cast("int"))


def _wide_integers(items: Column) -> Column:
    def fits(x: Column) -> Column:
        parts = x["parts"]
        return _is_whole(parts) & (F.length(parts["significant"]) + parts["exponent"] <= F.length(x["high"]))

    items = _each(
        items,
        text=lambda x: F.when(~F.contains(x["cell"], F.lit("_")), R.decimal_text_of(x["cell"])),
        parts=_parts,
        shift=lambda x: _shift(x, fits(x)),
        shown=lambda x: F.substring_index(_written_out(x["parts"], x["shift"]), ".", 1),
        most=lambda x: F.when(x["shown"].startswith("-"), x["low"]).otherwise(x["high"]),
        digits=lambda x: F.ltrim(x["shown"], F.lit("-")),
    )

    def value(x: Column) -> Column:
        shorter = F.length(x["digits"]) < F.length(x["most"])
        same = (F.length(x["digits"]) == F.length(x["most"])) & (x["digits"] <= x["most"])
        return F.when((x["most"] != "0") | (x["shown"] == "0"), F.when(shorter | same, x["shown"]))

    return F.transform(items, value)


def _wide_decimals(items: Column) -> Column:
    items = _each(
        items,
        text=lambda x: R.decimal_text_of(x["cell"]),
        parts=_parts,
        shift=lambda x: _shift(x, _fits(x)),
    )
    return F.transform(items, lambda x: _written_out(x["parts"], x["shift"]))


_KERNELS = {
    "integer": _integers,
    "decimal": _decimals,
    "float": _floats,
    "date": _dates,
    "datetime": _datetimes,
    "wide_integer": _wide_integers,
    "wide_decimal": _wide_decimals,
}


def families(kinds: dict[str, LogicalType]) -> dict[str, list[str]]:
    """Prefixes of the columns of each family."""
    found: dict[str, list[str]] = {}
    for prefix, kind in kinds.items():
        if family := family_of(kind):
            found.setdefault(family, []).append(prefix)
    return found


def open_cells(kinds: dict[str, LogicalType], prefixes: list[str]) -> Column:
    """A family's cells that are not settled yet, with their limits, null for the others; null if there are none."""
    unsettled = [
        f"({p}_cell IS NOT NULL AND {p}_fast IS NULL"
        + ("" if is_wide(kinds[p]) else f" AND NOT {_refused_at_once(f'{p}_cell', kinds[p])}")
        + ")"
        for p in prefixes
    ]
    items = []
    for u, p in zip(unsettled, prefixes, strict=True):
        limits = "".join(f", '{n}', {v}" for n, v in _limits(kinds[p]).items())
        items.append(f"CASE WHEN {u} THEN named_struct('cell', {p}_cell{limits}) END")
    return F.expr(f"CASE WHEN {' OR '.join(unsettled)} THEN array({', '.join(items)}) END")


def settled(family: str, items: Column) -> Column:
    """Values of :func:`open_cells`, in the same order."""
    return F.when(items.isNotNull(), _KERNELS[family](items))


def value_of(prefix: str, kind: LogicalType, place: int | None, family: str | None) -> Column:
    """Typed value of ``<prefix>_cell``; null where it is missing or refused."""
    if family is None:
        return F.expr(f"{prefix}_fast")
    # Both branches are null for a missing cell.
    rest = f"_family_{family}[{place}]"
    if family in ("integer", "decimal"):
        rest = f"try_cast({rest} AS {kind.storage.simpleString()})"
    return F.expr(f"coalesce({prefix}_fast, {rest})")


def refused_entry(prefix: str, kind: LogicalType, source: str, target: str, final_type: str) -> str | None:
    """What is kept of a cell if it is refused: where it is from, and which rule refused it."""
    if (refused := is_refused(prefix, kind)) is None:
        return None
    low, high = _date_bounds(kind) if kind.kind == "date" else ("", "")
    known = {"source": source, "target": target, "type": final_type, "kind": kind.kind, "base": kind.base, "low": low, "high": high}
    fields = ", ".join(f"'{n}', {literal(v)}" for n, v in known.items())
    return f"CASE WHEN {refused} THEN named_struct('cell', {prefix}_cell, {fields}) END"


def reason_of(cell: Column, rule: Column) -> Column:
    """Why ``cell`` is refused, given that it is; ``rule`` is a :func:`refused_entry`.

    One expression for all columns, evaluated only for refused cells.
    """
    base = rule["base"]
    readable = ~F.contains(cell, F.lit("_")) & cell.rlike(R.FLOAT_PATTERN)
    kind = rule["kind"]
    return (
        F.when(cell.isNull(), F.concat(F.lit("is empty, and "), base, F.lit(" is not nullable")))
        .when(kind == "integer", F.concat(F.lit("does not fit "), base, F.lit(" or is not a whole number")))
        .when(kind == "decimal", F.concat(F.lit("is not a number that "), base, F.lit(" holds exactly")))
        .when((kind == "float") & readable, F.lit("does not fit Float64 and would become infinity"))
        .when(kind == "float", F.lit("is not a finite number"))
        .when(
            (kind == "date") & R.date_value(cell).isNotNull(),
            F.concat(F.lit("is outside "), base, F.lit(" ("), rule["low"], F.lit(".."), rule["high"], F.lit(")")),
        )
        .when(kind == "date", F.concat(F.lit("is not a date for "), base))
        .when((kind == "datetime") & R.has_offset(cell), F.lit("carries a zone offset, which DateTime cannot hold"))
        .when(kind == "datetime", F.lit("is not a date-time"))
        .when(kind == "bool", F.lit("is not a boolean"))
        .otherwise(F.lit("is refused"))
    )


def is_refused(prefix: str, kind: LogicalType) -> str | None:
    """Whether the cell is refused; None for types that take every cell."""
    if kind.kind == "string" or (kind.kind == "other" and kind.nullable):
        return None
    return f"({prefix}_cell IS NOT NULL AND {prefix}_value IS NULL)" if kind.nullable else f"({prefix}_value IS NULL)"


def integral_text(number: Column) -> Column:
    """A float as JSON number text: whole values without a decimal point."""
    whole = (number == F.floor(number)) & (F.abs(number) < float(2**63))
    return F.when(whole, number.cast("decimal(20,0)").cast("string")).otherwise(
        number.cast("string")
    )
