"""Driver-side parts: type expressions, headers, mappings."""

import pytest

from truecolumn.errors import SchemaError
from truecolumn.plans import header as H
from truecolumn.plans import mapping as M
from truecolumn.plans import type_text as T


@pytest.mark.parametrize(
    "text", ["", "  ", "String; DROP", "String--x", "/* x */String", "1abc", "A, B", "Array(", "Array())", "E('a)", "a\nb"]
)
def test_unsafe_types(text):
    with pytest.raises(SchemaError):
        T.check_type_text(text)


def test_safe_types():
    assert T.check_type_text(" Map(String, UInt8) ") == "Map(String, UInt8)"
    assert T.check_type_text("Enum8('a, (b' = 1)") == "Enum8('a, (b' = 1)"


def test_nullability():
    for base in T.BASE_TYPES:
        for wrapped in (base, f"LowCardinality({base})"):
            null = T.as_nullable(wrapped, True)
            assert T.is_nullable(null) and not T.is_nullable(wrapped)
            assert T.as_nullable(null, True) == null and T.as_nullable(null, False) == wrapped
            assert null.count("Nullable(") == 1 and null.endswith(f"Nullable({base})" + ")" * wrapped.count("LowC"))
    assert T.as_nullable("Nullable(LowCardinality(UInt8))", True) == "LowCardinality(Nullable(UInt8))"
    for text in ("Map(String, UInt8)", "Nullable(Array(Date))", "LowCardinality(Nested(x Int8, y Date))"):
        with pytest.raises(SchemaError, match="elements"):
            T.as_nullable(text, True)
    assert str(T.parse_tree("Enum8('a, (b' = 1, 'c' = 2)")) == "Enum8('a, (b' = 1, 'c' = 2)"
    assert T.parse_tree("Map(String,Array( UInt8 ))") == T.TypeNode(
        "Map", (T.TypeNode("String"), T.TypeNode("Array", (T.TypeNode("UInt8"),)))
    )


def test_storage():
    simple = {t: T.parse_type(t).storage.simpleString() for t in T.BASE_TYPES}
    assert simple["UInt64"] == "decimal(20,0)" and simple["Decimal(76, 2)"] == "string"
    assert simple["DateTime"] == "timestamp_ntz" and simple["Decimal(38, 10)"] == "decimal(38,10)"
    assert T.parse_type("LowCardinality(Nullable(Int32))").storage.simpleString() == "int"
    assert len(T.TYPE_MENU) == 30


def test_headers():
    assert H.normalize_name(" A-B KEY#0 ") == "a_b_key_0"
    assert H.normalize_name("Дата - итог №2") == "дата_итог_2"
    assert H.normalize_name("1st") == "col_1st"
    with pytest.raises(SchemaError):
        H.normalize_name(" -- ")
    with pytest.raises(SchemaError, match="a_b"):
        H.normalized_names(["a b", "A-B", "c"])
    with pytest.raises(SchemaError, match="id"):
        H.trimmed_names(["id", " id "])


def test_mapping_checks_and_round_trips():
    good = [
        M.ColumnMapping.build("A", " a ", "Decimal(18, 2)", nullable=True, sample_values=("1", "2")),
        M.ColumnMapping("B", "b", "String", include=False),
    ]
    assert good[0].final_type == "Nullable(Decimal(18, 2))" and good[0].nullable
    assert [m.target_name for m in M.check_mappings(good)] == ["a"]
    assert M.from_json(M.to_json(good)) == good
    rows = M.to_editor_rows(good)
    rows[0]["custom_type"] = "LowCardinality(String)"
    edited = M.from_editor_rows(rows)
    assert edited[0].final_type == "LowCardinality(Nullable(String))"
    assert edited[0].sample_values == ("1", "2")
    with pytest.raises(SchemaError, match="at least one"):
        M.check_mappings(good[1:])
    with pytest.raises(SchemaError, match="duplicate"):
        M.check_mappings([good[0], M.ColumnMapping("C", "a", "String")])
    with pytest.raises(SchemaError, match="empty"):
        M.check_mappings([M.ColumnMapping("C", " ", "String")])
    with pytest.raises(SchemaError, match="not found"):
        M.check_sources(good, ["B"])
