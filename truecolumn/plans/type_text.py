"""Type expressions: parse, check, and map to Spark types.

A type expression such as ``LowCardinality(Nullable(Decimal(38, 2)))`` is only
ever looked up here; its text is never pasted into a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from truecolumn.errors import SchemaError

# The base types on offer, each also as Nullable(T).
BASE_TYPES: tuple[str, ...] = (
    "String",
    "Int64",
    "UInt64",
    "Float64",
    "Decimal(38, 0)",
    "Decimal(76, 0)",
    "Decimal(18, 2)",
    "Decimal(38, 2)",
    "Decimal(76, 2)",
    "Decimal(38, 10)",
    "Decimal(76, 10)",
    "Date",
    "Date32",
    "DateTime",
    "Bool",
)
TYPE_MENU: tuple[str, ...] = BASE_TYPES + tuple(f"Nullable({t})" for t in BASE_TYPES)

_INTEGER = re.compile(r"^(U?)Int(8|16|32|64|128|256)$")
_DECIMAL = re.compile(r"^Decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)$")
_COMPOSITE = ("Array", "Map", "Tuple", "Nested")
_FORBIDDEN = (";", "--", "/*", "*/", "\n", "\r")

_INTEGER_STORAGE = {
    ("", 8): T.ByteType(),
    ("", 16): T.ShortType(),
    ("", 32): T.IntegerType(),
    ("", 64): T.LongType(),
    ("U", 8): T.ShortType(),
    ("U", 16): T.IntegerType(),
    ("U", 32): T.LongType(),
    ("U", 64): T.DecimalType(20, 0),
}


@dataclass(frozen=True)
class TypeNode:
    """A type as a tree: a name and, after it in brackets, its arguments.

    ``arguments`` is None without brackets.  An argument that is no type (a
    number, a quoted name, a named field) is a node whose name is its text.
    """

    name: str
    arguments: tuple[TypeNode, ...] | None = None

    def __str__(self) -> str:
        if self.arguments is None:
            return self.name
        return f"{self.name}({', '.join(map(str, self.arguments))})"

    @property
    def nullable(self) -> bool:
        return any(node.name == _NULLABLE for node in self.wrappers())

    def wrappers(self):
        """The one-argument wrappers around the base, from outside, and the base itself."""
        node = self
        while node.name in _WRAPPERS and node.arguments and len(node.arguments) == 1:
            yield node
            node = node.arguments[0]
        yield node

    def rebuilt(self, nullable: bool) -> TypeNode:
        """The same base and storage wrapper, nullable or not."""
        *wrappers, base = self.wrappers()
        if nullable and base.name in _COMPOSITE:
            raise SchemaError(f"{base} holds other types and cannot be null itself; mark its elements nullable")
        out = TypeNode(_NULLABLE, (base,)) if nullable else base
        stored_apart = any(w.name == _DICTIONARY for w in wrappers)
        return TypeNode(_DICTIONARY, (out,)) if stored_apart else out


_NULLABLE, _DICTIONARY = "Nullable", "LowCardinality"
_WRAPPERS = (_NULLABLE, _DICTIONARY)
_TOKEN = re.compile(r"""'[^']*'|"[^"]*"|[(),]|[^'"(),]+""")


def parse_tree(text: str) -> TypeNode:
    """The tree of one type expression; SchemaError where brackets or quotes do not match."""
    tokens = _TOKEN.findall(text)
    if "".join(tokens) != text:
        raise SchemaError(f"a quote is not closed in type {text!r}")
    # Each open bracket has the names before it and the arguments so far.
    stack: list[tuple[str, list[TypeNode]]] = []
    word, node = "", None

    def finished() -> TypeNode:
        if node is not None and word.strip():
            node_text = f"{node}{word.rstrip()}"
            return TypeNode(node_text)
        if node is None and not word.strip():
            raise SchemaError(f"a part is missing in type {text!r}")
        return node if node is not None else TypeNode(word.strip())

    for token in tokens:
        if token == "(":
            stack.append((word.strip(), []))
            word, node = "", None
        elif token in ",)":
            if not stack:
                raise SchemaError(f"unexpected {token!r} in type {text!r}")
            empty = token == ")" and not stack[-1][1] and node is None and not word.strip()
            if not empty:
                stack[-1][1].append(finished())
            word, node = "", None
            if token == ")":
                name, arguments = stack.pop()
                node = TypeNode(name, tuple(arguments))
        else:
            word += token
    if stack:
        raise SchemaError(f"a bracket is not closed in type {text!r}")
    return finished()


def check_type_text(text: str) -> str:
    """The trimmed expression, or SchemaError when it is not one safe type."""
    trimmed = text.strip()
    if not trimmed:
        raise SchemaError("a column type cannot be empty")
    starts_with_letter = trimmed[0].isascii() and trimmed[0].isalpha()
    if not starts_with_letter or any(token in trimmed for token in _FORBIDDEN):
        raise SchemaError(f"unsafe type expression: {text}")
    parse_tree(trimmed)
    return trimmed


def is_nullable(text: str) -> bool:
    return parse_tree(text.strip()).nullable


def as_nullable(text: str, nullable: bool) -> str:
    """The type with nullability written where it belongs, inside LowCardinality."""
    return str(parse_tree(text.strip()).rebuilt(nullable))


@dataclass(frozen=True)
class LogicalType:
    """A parsed type expression."""

    text: str
    base: str
    nullable: bool
    low_cardinality: bool
    kind: str  # string, integer, float, decimal, date, datetime, bool, other
    signed: bool = True
    bits: int = 0
    precision: int = 0
    scale: int = 0

    @property
    def storage(self) -> T.DataType:
        if self.kind == "integer" and self.bits <= 64:
            return _INTEGER_STORAGE["" if self.signed else "U", self.bits]
        if self.kind == "decimal" and self.precision <= 38:
            return T.DecimalType(self.precision, self.scale)
        return {
            "float": T.DoubleType(),
            "date": T.DateType(),
            "datetime": T.TimestampNTZType(),
            "bool": T.BooleanType(),
        }.get(self.kind, T.StringType())

    def field(self, name: str, notes: str = "") -> T.StructField:
        metadata = {"logical": self.text}
        if notes:
            metadata["notes"] = notes
        return T.StructField(name, self.storage, self.nullable, metadata)


def parse_type(text: str) -> LogicalType:
    checked = check_type_text(text)
    tree = parse_tree(checked)
    *wrappers, innermost = tree.wrappers()
    nullable, base = tree.nullable, str(innermost)
    low_cardinality = any(w.name == _DICTIONARY for w in wrappers)
    shape: dict = {"kind": "other"}
    if match := _INTEGER.match(base):
        shape = {"kind": "integer", "signed": not match[1], "bits": int(match[2])}
    elif match := _DECIMAL.match(base):
        precision, scale = int(match[1]), int(match[2])
        if not 1 <= precision <= 76 or scale > precision:
            raise SchemaError(f"a decimal holds 1 to 76 digits: {text}")
        shape = {"kind": "decimal", "precision": precision, "scale": scale}
    else:
        named = {
            "String": "string",
            "Float64": "float",
            "Date": "date",
            "Date32": "date",
            "DateTime": "datetime",
            "Bool": "bool",
        }
        shape = {"kind": named.get(base, "other")}
    return LogicalType(checked, base, nullable, low_cardinality, **shape)
