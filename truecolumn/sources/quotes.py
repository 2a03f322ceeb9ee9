"""Where fields of a delimited line begin and end, as Column expressions.

A quote opens a cell only as the first character of a field; elsewhere it is a
character like any other (``5" pipe``).  Inside a quoted cell a doubled quote
stands for one, and separators and line breaks are text.  What follows a closing
quote up to the separator belongs to the cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a line does to the state "inside a quoted cell": bit 1 is the state after it when it
#: begins outside, bit 2 when it begins inside.  A line without quotes keeps the state.
CLOSES, SWAPS, KEEPS, OPENS = 0, 1, 2, 3
#: Marks an empty line, which is no row when it begins outside.
EMPTY = 4


def _quoted_cell(separators: tuple[str, ...]) -> str:
    # A cell's next part begins where the last one ended: that is a doubled quote.
    literal = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in separators)
    return rf'((?:^|{literal})|\G(?!^))"[^"]*+"'


def without_quoted(line: Column, *separators: str) -> Column:
    """The line without its closed quoted cells; separators between fields stay.

    With several separators a quote behind any of them opens a cell.
    """
    return F.regexp_replace(line, F.lit(_quoted_cell(separators)), F.lit("$1"))


def _open(bare: Column, separator: str) -> Column:
    return bare.startswith('"') | F.contains(bare, F.lit(separator + '"'))


def ends_inside(line: Column, separator: str) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one."""
    return F.contains(line, F.lit('"')) & _open(without_quoted(line, separator), separator)


def separators(line: Column, separator: str) -> Column:
    """How often the separator stands in a text."""
    removed = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(separator), F.lit("")))
    return (removed / len(separator.encode())).cast("int")


def field_count(line: Column, separator: str) -> Column:
    """Fields of a whole record."""
    bare = F.when(F.contains(line, F.lit('"')), without_quoted(line, separator)).otherwise(line)
    return separators(bare, separator) + 1


def state_code(line: Column, separator: str) -> Column:
    """What the line does to the state, as one of the codes above."""
    outside = ends_inside(line, separator).cast("int")
    inside = ends_inside(F.concat(F.lit('"'), line), separator).cast("int")
    code = F.when(line == "", F.lit(KEEPS | EMPTY)).when(~F.contains(line, F.lit('"')), F.lit(KEEPS))
    return code.otherwise(outside + 2 * inside).cast("byte")
