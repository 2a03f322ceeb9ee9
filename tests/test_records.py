"""Records cut in parallel against a reader that goes through the file character by character."""

import random

import pytest

from truecolumn.errors import LoadError, SchemaError
from truecolumn.operators import validate as V
from truecolumn.plans.mapping import ColumnMapping
from truecolumn.sources import csv_text as C
from truecolumn.sources.records import _states, read_records

PIECES = ["a", "b c", "5\" pipe", "", "é漢", '"q"', '"x,y"', '"say ""hi"""', '"two\nlines"', '"a\r\nb"', '"\n\n"', '""', '","', "7'", 'in"ner']


def parsed(data: str, separator: str = ","):
    """``[(line, cells)]``, a plain reader with the same rules."""
    rows, cells, cell, state, line, begun, i = [], [], "", "start", 1, 1, 0
    while i <= len(data):
        c = data[i] if i < len(data) else None
        if state == "quoted" and c is not None:
            if c == '"' and data[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                state = "plain"
            else:
                cell += c
        elif c is None or c == "\n":
            cells.append(cell.removesuffix("\r") if state != "quoted" else cell)
            if cells != [""] or state == "plain" and i and data[i - 1] == '"':
                rows.append((begun, cells))
            cells, cell, state, begun = [], "", "start", line + 1
        elif c == separator:
            cells.append(cell)
            cell, state = "", "start"
        elif c == '"' and state == "start":
            state = "quoted"
        else:
            cell, state = cell + c, "plain"
        line += c == "\n"
        i += 1
    return rows


def written(rng, rows):
    lines = ["k,v,w"]
    for i in range(rows):
        lines.append(f"{i},{rng.choice(PIECES)},{rng.choice(PIECES)}")
        if rng.random() < 0.05:
            lines.append("")
    return "\n".join(lines) + rng.choice(["", "\n", "\n\n"])


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that many records lie across them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_records_across_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    texts = [written(rng, n) for n in (120, 60, 1, 0)] + ["﻿\n\nk,v,w\n1,\"a\n" + "x\n" * 400 + '",z\n2,b,c\n']
    want = []
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
        want += parsed(text.removeprefix("﻿"))[1:]
    table = C.read_text_table(spark, str(tmp_path), C.ReadOptions(multi_line=True), numbered=True)
    got = table.orderBy(C.ROW).collect()
    assert [r[C.ROW] for r in got] == list(range(len(want)))
    assert [(r[C.LINE], [r.k, r.v, r.w]) for r in got] == [(n, cells) for n, cells in want]
    plain = C.read_text_table(spark, str(tmp_path), C.ReadOptions(multi_line=True)).collect()
    assert sorted(map(tuple, plain)) == sorted((r.k, r.v, r.w) for r in got)
    assert table.rdd.getNumPartitions() > 8


def test_line_states():
    rng = random.Random(4)
    import numpy as np

    for _ in range(300):
        codes = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        for s in (0, 1):
            states, now = [], s
            for c in codes:
                states.append(bool(now))
                now = (c >> now) & 1
            before, after = _states(np.array(codes, np.int8), s)
            assert before.tolist() == states and after == now


def test_stray_quotes_do_not_hide_fields(spark, tmp_path):
    lines = ["a,b", "1,2", '5" a,b,c,6" d', '"x,y",2', '3,"open', 'q"r,"s,t"', '"a"b,c', '"a""b",c', '"1","2","3"']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "a.csv")
    found = {r.line: r.fields for r in C.bad_rows(spark, path).collect()}
    assert found == {'5" a,b,c,6" d': 4, '3,"open': 2, "1,2,3": 3}
    table = C.read_text_table(spark, path, watch_width=True, numbered=True).orderBy(C.ROW).collect()
    assert [r[C.LINE] for r in table if r._bad_line] == [3, 5, 9]
    assert (table[4].a, table[4].b) == ('q"r', "s,t")
    for numbered in (False, True):
        with pytest.raises(Exception, match="does not fit the header"):
            C.read_text_table(spark, path, numbered=numbered).collect()
    with pytest.raises(Exception, match="line 3 of"):
        C.read_text_table(spark, path, numbered=True).where("_line = 3").collect()


def test_open_quote_at_the_end(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n" + "3,4\n" * 300 + '5,"open\n' + "6,7\n" * 300)
    path = str(tmp_path / "a.csv")
    bad = C.bad_rows(spark, path, C.ReadOptions(multi_line=True)).collect()
    assert len(bad) == 1 and bad[0].line.startswith('5,"open\n6,7\n')
    with pytest.raises(Exception, match="probably not closed"):
        read_records(spark, path, limit=100).collect()


def test_encodings_of_records(spark, tmp_path):
    text = "ключ;значение\n1;\"при\nвет\"\n2;мир\n"
    for name, encoding in (("a", "cp1251"), ("b", "utf-8-sig")):
        (tmp_path / name).write_bytes(text.encode(encoding))
        table = C.read_text_table(spark, str(tmp_path / name), C.ReadOptions(";", encoding, True))
        assert table.columns == ["ключ", "значение"]
        assert sorted(map(tuple, table.collect())) == [("1", "при\nвет"), ("2", "мир")]
    (tmp_path / "c").write_bytes("a,b\n1,\"x\ny\"\n".encode("utf-16"))
    assert C.read_text_table(spark, str(tmp_path / "c"), C.ReadOptions(",", "UTF-16", True)).collect()[0].b == "x\ny"
    with pytest.raises(SchemaError):
        C.read_text_table(spark, str(tmp_path / "c"), C.ReadOptions(",", "UTF-16", True), numbered=True)


def test_first_bad_value_names_the_line(spark, tmp_path, small_splits):
    rows = ["n,t"] + [f"{i},\"x\n{i}\"" for i in range(200)]
    rows[151] = 'bad,"x\ny"'
    rows[161] = "worse,z"
    (tmp_path / "a.csv").write_text("\n".join(rows))
    table = C.read_text_table(spark, str(tmp_path / "a.csv"), C.ReadOptions(multi_line=True), numbered=True)
    mapping = [ColumnMapping("n", "n", "Int64", "Int64"), ColumnMapping("t", "t", "String", "String")]
    (found,) = V.first_bad_value(table, mapping, C.LINE).collect()
    assert (found.source, found.value) == ("n", "bad") and found.row_id == 2 * 150 + 2
    leading = C.leading_rows(spark, str(tmp_path / "a.csv"), 3, C.ReadOptions(multi_line=True)).collect()
    assert sorted(r.n for r in leading) == ["0", "1", "2"]


def test_splits_must_not_change(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a\n" + "x\n" * 500)
    records = read_records(spark, str(tmp_path / "a.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "111")
    with pytest.raises(Exception, match="split differently"):
        records.collect()
    assert issubclass(LoadError, Exception)
