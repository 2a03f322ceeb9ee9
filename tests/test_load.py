"""Reading, conversion, validation, blocks and tables."""

import gzip
import json
import random
import threading
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry import messy as M
from truecolumn.errors import ExistingTableError, LoadError, ReadCancelled, SchemaError
from truecolumn.functions import convert as X
from truecolumn.functions import text_rules as R
from truecolumn.operators import blocks as B
from truecolumn.operators import infer as N
from truecolumn.operators import load_plan as L
from truecolumn.operators import validate as V
from truecolumn.plans.mapping import ColumnMapping
from truecolumn.session import cancellable, spread, stop
from truecolumn.sinks import json_export, load_runs
from truecolumn.sinks import tables as S
from truecolumn.sources import csv_text as C
from truecolumn.streaming.drop_folder import load_new_files


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reading(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿ id ,b,c\n007,"x ""q"" \\ y",NA\n\n1,"",\n2\n 3 ,"p,q",1.50\n')
    df = C.read_text_table(spark, path)
    assert df.columns == ["id", "b", "c"]
    assert rows(df) == [("007", 'x "q" \\ y', "NA"), ("1", "", ""), ("2", "", ""), (" 3 ", "p,q", "1.50")]
    assert rows(C.read_text_table(spark, path, columns=["c", "id"]))[0] == ("NA", "007")
    with pytest.raises(SchemaError, match="not found"):
        C.read_text_table(spark, path, columns=["zz"])
    gz = tmp_path / "a.csv.gz"
    gz.write_bytes(gzip.compress((tmp_path / "a.csv").read_bytes()))
    assert rows(C.read_text_table(spark, str(gz))) == rows(df)
    multi = write(tmp_path / "m.csv", 'a,b\n1,"x\ny"\n')
    with pytest.raises(Exception, match="open quote"):
        C.read_text_table(spark, multi).collect()
    assert rows(C.read_text_table(spark, multi, C.ReadOptions(multi_line=True))) == [("1", "x\ny")]


def test_header_errors(spark, tmp_path):
    with pytest.raises(SchemaError, match="duplicate"):
        C.header_names(spark, write(tmp_path / "d.csv", "id, id,x\n1,2,3\n"))
    with pytest.raises(SchemaError, match="header"):
        C.header_names(spark, write(tmp_path / "e.csv", ""))


def test_bad_rows(spark, tmp_path):
    path = write(tmp_path / "b.csv", 'a,b\n1,2\n1,2,3\n1,2,\n1\n"x,y",2\n"x,y",2,,4\n')
    found = sorted(rows(C.bad_rows(spark, path)))
    assert found == [('"x,y",2,,4', 4), ("1,2,", 3), ("1,2,3", 3)]
    with pytest.raises(Exception, match="too many fields"):
        C.read_text_table(spark, path, columns=["a"]).collect()
    with pytest.raises(SchemaError, match="3 fields"):
        C.require_regular(spark, write(tmp_path / "c.csv", "a,b\n1,2,3\n"))
    watched = C.read_text_table(spark, path, watch_width=True)
    mapping = [ColumnMapping("a", "a", "String"), ColumnMapping("b", "b", "Nullable(UInt8)")]
    good, bad = L.apply_mapping(watched, mapping, "reject")
    assert good.count() == 3 and bad.count() == 3
    assert {r["value"] for r in V.refused_cells(watched, mapping).collect()} == {f[0] for f in found}


def test_nothing_is_lost_in_silence(spark, tmp_path):
    for name, content in (("q", b'id,name\n1,Ann\n2,"Bob\n'), ("u", b"id,name\n1,\xff\xfe\n"), ("w", b'id,name\n1,"x,y",""""\n')):
        (tmp_path / name).write_bytes(content)
        assert C.bad_rows(spark, str(tmp_path / name)).count() == 1
        mapping = [ColumnMapping("id", "id", "UInt8"), ColumnMapping("name", "name", "String")]
        with pytest.raises(LoadError, match="header"):
            load_runs.load(C.read_text_table(spark, str(tmp_path / name)), mapping, f"lost_{name}")
        assert not spark.catalog.tableExists(f"lost_{name}")
    fine = write(tmp_path / "f", 'id,name\n1,5" pipe\n2,"a ""b"""\n')
    assert rows(C.read_text_table(spark, fine)) == [("1", '5" pipe'), ("2", 'a "b"')]
    long_cell = write(tmp_path / "l", 'id,name\n1,"' + 'x""' * 400_000 + '"\n')
    assert len(rows(C.read_text_table(spark, long_cell))[0][1]) == 800_000
    assert C.sniff_separator(spark, long_cell) == ","


def test_encodings(spark, tmp_path):
    path = write(tmp_path / "w.csv", "ID;NAME\n1;тест\n", "cp1251")
    chosen = C.choose_encoding(spark, path, C.ReadOptions(";"))
    assert chosen.charset == "windows-1251"
    assert rows(C.read_text_table(spark, path, chosen)) == [("1", "тест")]
    assert C.undecodable_lines(spark, path).first()[0] == 1
    assert C.undecodable_lines(spark, path, "cp1251").first()[0] == 0
    late = write(tmp_path / "late.csv", "ID;NAME\n" + "1;plain\n" * 500 + "2;тест\n", "cp1251")
    assert C.choose_encoding(spark, late, C.ReadOptions(";")).charset == "windows-1251"
    mixed = write(tmp_path / "mixed.csv", "ID;NAME\n" + "1;тест\n" * 3000 + "2;Рё\n")
    assert C.choose_encoding(spark, mixed, C.ReadOptions(";", "cp1251")).charset == "UTF-8"
    damaged = write(tmp_path / "x.csv", "ID;NAME\n1;те�т\n")
    with pytest.raises(SchemaError, match="damaged"):
        C.choose_encoding(spark, damaged, C.ReadOptions(";"))


@pytest.mark.parametrize("typed, mark", [(",", ","), (";", ";"), ("\\t", "\t"), ("|", "|")])
def test_separators(spark, tmp_path, typed, mark):
    lines = ["a", "b", "c"], ["1", '"x,;|\t"', "3"], ["4", "", "6"]
    path = write(tmp_path / "s.csv", "\n".join(mark.join(x) for x in lines) + "\n")
    assert C.sniff_separator(spark, path) == mark
    df = C.read_text_table(spark, path, C.ReadOptions.chosen(typed))
    assert rows(df) == [("1", "x,;|\t", "3"), ("4", "", "6")]
    with pytest.raises(SchemaError):
        C.ReadOptions.chosen("")


# type, cell -> value, or None for a refused cell ("" is a missing cell)
CONTRACT = [
    ("String", "abc", "abc"), ("String", " x ", " x "), ("String", "NA", "NA"), ("String", "", ""),
    ("Nullable(String)", "", "null"), ("Nullable(String)", " ", " "),
    ("LowCardinality(Nullable(String))", "NA", "NA"),
    ("Int64", "42", 42), ("Int64", "007", 7), ("Int64", "-7", -7), ("Int64", " 8 ", 8), ("Int64", "1.0", 1),
    ("Int64", "1e3", 1000), ("Int64", "1.7", None), ("Int64", "", None), ("Int64", "NA", None),
    ("Int64", "9223372036854775807", 2**63 - 1), ("Int64", "9223372036854775808", None),
    ("Int64", "1_000", None), ("Int64", "abc", None), ("Int64", "1e400", None), ("Int64", "１２", None),
    ("Nullable(Int64)", "NaN", "null"), ("Int8", "300", None), ("Int8", "-128", -128), ("UInt8", "-1", None),
    ("UInt64", "18446744073709551615", Decimal(2**64 - 1)), ("UInt64", "18446744073709551616", None),
    ("Float64", "1.5", 1.5), ("Float64", "-0.0", 0.0), ("Float64", "inf", None), ("Float64", "-1e999", None),
    ("Float64", "1d", None), ("Float64", "3.141592653589793", 3.141592653589793),
    ("Decimal(18, 2)", "1.50", Decimal("1.50")), ("Decimal(18, 2)", "1.999", None),
    ("Decimal(18, 2)", "1.500", Decimal("1.50")), ("Decimal(18, 2)", "12345678901234.99", Decimal("12345678901234.99")),
    ("Decimal(18, 2)", "12345678901234567", None), ("Decimal(18, 2)", "1.5e2", Decimal("150.00")),
    ("Decimal(38, 10)", "3.1415926536", Decimal("3.1415926536")), ("Decimal(38, 0)", "9" * 38, Decimal("9" * 38)),
    ("Decimal(76, 2)", "1" * 74 + ".25", "1" * 74 + ".25"), ("Decimal(76, 2)", "1" * 75 + ".25", None),
    ("Decimal(76, 2)", "+007.5", "7.5"), ("Decimal(76, 2)", "12e-1", "1.2"), ("Decimal(76, 2)", "-5e3", "-5000"),
    ("Int128", str(2**127 - 1), str(2**127 - 1)), ("Int128", str(2**127), None),
    ("Int128", str(-(2**127)), str(-(2**127))), ("Int256", str(-(2**255)), str(-(2**255))),
    ("Date", "2024-01-02", date(2024, 1, 2)), ("Date", "20000229", date(2000, 2, 29)),
    ("Date", "2023-02-29", None), ("Date", "1950-01-01", None), ("Date32", "1950-01-01", date(1950, 1, 1)),
    ("Date", "2024-01-02T00:00:00", None), ("Nullable(Date)", "null", "null"),
    ("DateTime", "2024-01-02 03:04:05", datetime(2024, 1, 2, 3, 4, 5)),
    ("DateTime", "2024-01-02T03:04:05.999", datetime(2024, 1, 2, 3, 4, 5)),
    ("DateTime", "2024-01-02", datetime(2024, 1, 2)), ("DateTime", "2024-01-02T03:04Z", None),
    ("DateTime", "2024-01-02 25:00:00", None),
    ("Bool", "true", True), ("Bool", "NO", False), ("Bool", "1", True), ("Bool", "t", None),
    ("DateTime('Europe/Moscow')", " 2024 ", "2024"), ("Array(String)", "['a']", "['a']"), ("UUID", "", None),
]


def test_conversion_contract(spark):
    names = [f"c{i}" for i in range(len(CONTRACT))]
    wrong = []
    for low in range(0, len(CONTRACT), 24):
        part = list(zip(names, CONTRACT))[low : low + 24]
        df = spark.createDataFrame([tuple(c[1] for _, c in part)], [n for n, _ in part])
        mapping = [ColumnMapping(n, n, c[0]) for n, c in part]
        row = L.apply_mapping(df, mapping, "annotate").first()
        refused = {e["source"] for e in row[L.ERRORS]}
        for name, (kind, cell, expected) in part:
            got = None if name in refused else ("null" if row[name] is None else row[name])
            if got != expected or type(got) is not type(expected):
                wrong.append((kind, cell, got, expected))
    assert not wrong


def test_strict_and_reject(spark):
    df = spark.createDataFrame([("1", "x"), ("bad", "y"), ("3", "")], ["id", "v"])
    mapping = [ColumnMapping("id", "ID", "UInt8"), ColumnMapping("v", "V", "Nullable(String)")]
    with pytest.raises(Exception, match="column 'id', value 'bad' to UInt8"):
        L.apply_mapping(df, mapping).collect()
    good, bad = L.apply_mapping(df, mapping, "reject")
    assert sorted(rows(good)) == [(1, "x"), (3, None)] and bad.count() == 1
    with pytest.raises(SchemaError, match="'bad'"):
        V.require_valid(df, mapping, 1000)
    assert V.require_valid(df.where("id <> 'bad'"), mapping, 1000) == 2
    with pytest.raises(LoadError, match="exceed"):
        V.require_valid(df.where("id <> 'bad'"), mapping, 5)
    first = V.first_bad_value(df.withColumn("n", F.lit(1)), mapping, "n").first()
    assert first["value"] == "bad"


def test_round_trip_keeps_text(spark):
    """text -> inferred type -> text gives the same text back."""
    rng = random.Random(5)
    columns = {
        "a": [str(rng.randint(0, 10**6)) for _ in range(200)],
        "b": [f"{rng.randint(0, 10**5)}.{rng.randint(10, 99)}" for _ in range(200)],
        "c": [str(rng.randint(0, 99)).zfill(4) for _ in range(200)],
        "d": [f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}" for _ in range(200)],
        "e": [str(rng.randint(10**40, 10**50)) for _ in range(200)],
        "f": [rng.choice(["", "NA", "x"]) for _ in range(200)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), list(columns))
    mapping = N.infer_mapping(df, with_samples=False)
    typed = L.apply_mapping(df, mapping)
    back = typed.select(*[F.coalesce(F.col(m.target_name).cast("string"), F.lit("")) for m in mapping])
    assert sorted(rows(back)) == sorted(rows(df))


def test_json_lines(spark):
    df = spark.sql(
        "SELECT 1L AS `q\"q`, cast(null AS string) AS `back\\slash`, cast('1.50' AS decimal(18,2)) AS `a/b`, "
        "date'0007-01-02' AS `день`, timestamp_ntz'2024-01-02 03:04:05' AS `a.b`, 'тест/\"x\"\\n' AS t"
    )
    line = B.json_lines(df).first()["line"]
    assert json.loads(line) == {
        'q"q': 1, "back\\slash": None, "a/b": "1.50", "день": "0007-01-02",
        "a.b": "2024-01-02 03:04:05", "t": 'тест/"x"\n',
    }
    assert list(json.loads(line)) == df.columns and "тест" in line


SIZES = {
    "fat first": [5000] * 10 + [10] * 1000,
    "fat last": [10] * 1000 + [5000] * 10,
    "mixed": [5000 if i % 100 == 0 else 10 for i in range(1000)],
    "one fat": [10] * 500 + [15000] + [10] * 500,
    "exact": [9999, 10000, 9999, 10000, 20000, 1],
}


def greedy(sizes, limit):
    blocks, used = [], None
    for size in sizes:
        if used is None or used + 1 + size > limit:
            blocks.append([])
            used = size
        else:
            used += 1 + size
        blocks[-1].append(size)
    return [len(b) for b in blocks]


@pytest.mark.parametrize("name", SIZES)
def test_blocks(spark, name):
    data = [(i, "x" * n) for i, n in enumerate(SIZES[name])]
    df = spark.createDataFrame(data, "id long, line string").withColumn("part", F.lit(0))
    packed = B.pack_blocks(df, 20_000, "part", "id").cache()
    totals = B.block_totals(packed).orderBy("block").collect()
    assert [t["rows_count"] for t in totals] == greedy(SIZES[name], 20_000)
    assert max(t["block_bytes"] for t in totals) <= 20_000
    assert sorted(r["id"] for r in packed.collect()) == list(range(len(data)))
    free = B.block_totals(B.pack_blocks(df.drop("part").repartition(3), 20_000)).collect()
    assert sum(t["rows_count"] for t in free) == len(data)
    assert max(t["block_bytes"] for t in free) <= 20_000


def test_block_errors(spark):
    df = spark.createDataFrame([(1, "x" * 50)], "id long, line string")
    with pytest.raises(Exception, match="exceeds the block limit"):
        B.pack_blocks(df, 20).collect()
    assert B.oversize_rows(df, 20).count() == 1 and B.pack_blocks(df.limit(0), 20).count() == 0
    with pytest.raises(LoadError):
        B.pack_blocks(df, 0)


def test_export(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "repeat('x', id) AS v")
    json_export.export_json(df, str(tmp_path / "out"), "gzip")
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted(json.loads(r["value"])["id"] for r in lines) == list(range(100))
    with pytest.raises(LoadError):
        json_export.export_json(df, str(tmp_path / "no"), "off", limit=50)
    with pytest.raises(SchemaError):
        json_export.text_codec("rar")


def test_load_and_run_record(spark, tmp_path):
    path = write(tmp_path / "in.csv", "ID,VALUE,DAY\n1,a,2024-01-01\n2,b,2024-01-02\n3,,2024-01-02\n")
    df = C.read_text_table(spark, path)
    mapping = N.infer_mapping(df)
    runs = str(tmp_path / "runs")
    layout = S.Layout(partition_by=["day"], shard_by="id", shards=2, sort_by=("id",))
    run = load_runs.load(df, mapping, "loaded_once", layout, runs)
    assert (run.rows, run.outcome, run.fate) == (3, "ok", S.CREATED) and run.src_bytes > 0
    assert run.raw_bytes > 0 and run.wire_bytes > 0 and run.blocks == 1
    table = spark.table("loaded_once")
    assert sorted(rows(table.select("id", "value"))) == [(1, "a"), (2, "b"), (3, None)]
    assert table.where("day = '2024-01-02'").count() == 2
    with pytest.raises(ExistingTableError):
        load_runs.load(df, mapping, "loaded_once", layout, runs)
    bad = [ColumnMapping("VALUE", "v", "UInt8")]
    with pytest.raises(LoadError):
        load_runs.load(df, bad, "never_there", runs_path=runs, preflight=False)
    assert not spark.catalog.tableExists("never_there")
    recorded = spark.read.parquet(runs)
    assert sorted(rows(recorded.select("outcome", "fate"))) == [
        ("failed", "not_created"), ("failed", "not_created"), ("ok", "created"),
    ]
    assert "loaded_once: ok, 3 rows" in " ".join(r["report"] for r in load_runs.run_report(recorded).collect())
    with pytest.raises(SchemaError):
        S.load_table(df, "bad name; drop")


@pytest.mark.parametrize("place", [0, 1, 4])
def test_oversize_line_at_any_place(place):
    sizes = [10] * 5
    sizes[place] = 100
    with pytest.raises(LoadError, match="100 bytes"):
        B._block_starts(np.array(sizes), 10, 20)
    assert B._block_starts(np.array([10, 10]), 15, 20)[0].tolist() == [1, 2]


def test_a_table_that_appears_meanwhile_stays(spark):
    df = spark.range(3).selectExpr("id", "cast(id AS string) AS v")
    real = S.existing_tables
    calls = []

    def late(session, names):
        calls.append(names)
        if len(calls) == 1:
            spark.range(7).write.saveAsTable("made_by_another")
            return []
        return real(session, names)

    S.existing_tables = late
    try:
        with pytest.raises(ExistingTableError):
            S.load_table(df, "made_by_another")
    finally:
        S.existing_tables = real
    assert spark.table("made_by_another").count() == 7


def test_buckets_make_few_files(spark):
    df = spark.range(40_000).selectExpr("id", "cast(id AS string) AS v")
    S.load_table(df, "bucketed", S.Layout(shard_by="id", shards=16))
    assert len(spark.table("bucketed").inputFiles()) <= 32


def test_append_and_policy(spark):
    df = spark.range(3).selectExpr("id", "cast(id AS string) AS v")
    S.load_table(df, "appended_to")
    S.append_rows(df.select("v", "id"), "appended_to")
    assert spark.table("appended_to").where("v = cast(id AS string)").count() == 6
    with pytest.raises(SchemaError):
        S.append_rows(df.select("id"), "appended_to")


def test_stopping_a_read(spark):
    spread_out = F.count_if(F.sha2(F.col("id").cast("string"), 512) > "f")
    slow = spark.range(0, 2 * 10**8, 1, 8).agg(spread_out)
    threading.Timer(3.0, lambda: stop(spark, "slow_read")).start()
    with pytest.raises(ReadCancelled):
        with cancellable(spark, "slow_read"):
            slow.collect()


def test_hot_partition_is_written_whole(spark, tmp_path):
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS part")
    path = S.write_folder(df, str(tmp_path / "hot"), S.Layout(partition_by=["part"], sort_by=("id",)))
    back = spark.read.parquet(path)
    assert back.count() == 9000 and back.where("part = 0").count() == df.where("part = 0").count()


def test_drop_folder(spark, tmp_path):
    folder = tmp_path / "drops"
    folder.mkdir()
    mapping = [ColumnMapping("id", "id", "UInt8"), ColumnMapping("v", "v", "Nullable(String)")]
    args = (str(folder), str(tmp_path / "target"), str(tmp_path / "check"), mapping)
    write(folder / "1.csv", "id,v\n1,a\n999,b\n")
    load_new_files(spark, *args).awaitTermination()
    write(folder / "2.csv", "id,v\n2,\n")
    load_new_files(spark, *args).awaitTermination()
    load_new_files(spark, *args).awaitTermination()
    good = spark.read.parquet(str(tmp_path / "target" / "accepted")).select("id", "v")
    assert sorted(rows(good)) == [(1, "a"), (2, None)]
    assert spark.read.parquet(str(tmp_path / "target" / "refused")).count() == 1


def test_plain_spellings_need_no_kernel(spark):
    """Plus signs, fractions, outer zeros and long fractions of seconds are settled, or refused, at once."""
    whole = {"+12": 12, "12.": 12, "12.00": 12, "-0.0": 0, "12.5": None, "-3": -3}
    cases = [("Int32", {**whole, "2147483648": None}), ("UInt8", {**whole, "-3": None, "256": None}), ("UInt64", {**whole, "-3": None})]
    cases += [("Decimal(4, 2)", {"+0012.5000": Decimal("12.50"), "-00": Decimal(0), "123": None, "1.234": None, "5.": Decimal(5)})]
    cases += [("Decimal(2, 2)", {"0.25": Decimal("0.25"), "1.0": None, "00.250": Decimal("0.25")})]
    second = datetime(2024, 1, 2, 3, 4, 5)
    cases += [("DateTime", {"2024-01-02T03:04:05.123456789": second, "2024-01-02": datetime(2024, 1, 2), "2023-02-30 03:04:05.1234567": None})]
    for kind, wanted in cases:
        mapping = ColumnMapping("a", "a", kind)
        df = spark.createDataFrame([(c,) for c in wanted], "a string")
        typed = L.annotate(df, [mapping], keep=["a"]).toDF("text", "value", "errors").collect()
        assert {r.text: r.value for r in typed} == wanted and all((r.value is None) == bool(r.errors) for r in typed)
        cells = df.select(F.col("a").alias("_0_cell")).select("_0_cell", X.fast_value("_0", mapping.logical).alias("_0_fast"))
        assert cells.where(X.open_cells({"_0": mapping.logical}, ["_0"]).isNotNull()).count() == 0


def test_refused_cells_are_counted_alike(spark):
    mappings = [ColumnMapping("a", "n", "Int32"), ColumnMapping("a", "d", "Nullable(Date)"), ColumnMapping("b", "s", "String")]
    df = spark.createDataFrame([("1", ""), ("", "x"), ("2024-01-02", ""), ("x", None), (None, None)], "a string, b string")
    listed = [len(r["_errors"]) for r in L.annotate(df, mappings).collect()]
    assert [r["_errors"] for r in L.annotate(df, mappings, counted=True).collect()] == listed == [1, 1, 1, 2, 1]


def test_tasks_grow_with_the_rows(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    for per_task in (10, 1000):
        parts = spread(table, per_task)
        assert parts.rdd.getNumPartitions() == max(cores, 1000 // per_task) and parts.count() == 1000
    assert M.ROWS_PER_TASK <= 50_000


def test_decimal_shapes_from_their_text(spark):
    texts = ["12.50", "-007", "1e3", "1.5e-2", ".5", "0", "1_0", "x", "+3."]
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("text", R.decimal_text(F.col("v")))
    got = df.select("v", R.decimal_shape_of(F.col("text")).alias("s")).collect()
    want = {"12.50": (2, 2), "-007": (1, 0), "1e3": (4, 0), "1.5e-2": (0, 3), ".5": (0, 1), "0": (0, 0), "1_0": (2, 0), "x": None, "+3.": (1, 0)}
    assert {r.v: r.s and tuple(r.s) for r in got} == want
