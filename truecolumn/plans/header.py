"""Header names: read as raw text, trimmed, made into column names, checked.

A header is one line, so this is plain driver code.
"""

from __future__ import annotations

import re
from collections import Counter

from truecolumn.errors import SchemaError


def normalize_name(name: str) -> str:
    """Lower-case column name; letters and digits of any script are kept."""
    words = re.findall(r"[^\W_]+", name.strip().lower())
    if not words:
        raise SchemaError("the header contains an empty column name")
    joined = "_".join(words)
    return f"col_{joined}" if joined[0].isdigit() else joined


def repeated(names: list[str]) -> list[str]:
    return sorted(name for name, count in Counter(names).items() if count > 1)


def trimmed_names(raw: list[str | None]) -> list[str]:
    """Header cells without surrounding blanks; a repeat is an error."""
    names = [(name or "").strip() for name in raw]
    if not any(names):
        raise SchemaError("a header line is required")
    if twice := repeated(names):
        raise SchemaError("duplicate names in the header: " + ", ".join(twice))
    return names


def normalized_names(names: list[str]) -> list[str]:
    """Column names for header cells; two cells may not share one name."""
    result = [normalize_name(name) for name in names]
    if twice := repeated(result):
        raise SchemaError("duplicate column names after normalization: " + ", ".join(twice))
    return result
