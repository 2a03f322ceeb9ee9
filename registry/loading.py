"""Queries that read files, convert, validate, serialize and load."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from registry import balance_queries as BQ
from registry import inputs as I
from registry import messy as M
from truecolumn.errors import LoadError
from truecolumn.functions.convert import integral_text
from truecolumn.operators import blocks as B
from truecolumn.operators import load_plan as L
from truecolumn.operators import validate as V
from truecolumn.operators.load_plan import BAD_LINE
from truecolumn.plans.mapping import ColumnMapping
from truecolumn.session import scratch_path
from truecolumn.sinks import balance_table, block_files, load_runs
from truecolumn.sinks import tables as S
from truecolumn.sinks.json_export import export_json
from truecolumn.sources import csv_text as C

_WRITING = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _csv_copy(spark, df, **options):
    """A CSV copy of a table in the shared folder."""
    path = scratch_path(spark, "csv")
    df.write.options(**{**_WRITING, **options}).csv(path)
    return path


def _scratch_database(spark):
    """A database of its own in the shared folder, so tables never collide."""
    name = f"tc_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'tables')}'")
    return name


# --- sources ---------------------------------------------------------------

_SCANNED = ("order_key", "account_code", "total", "order_date", "padded", "comment")
_TRICKY = (
    "SELECT c_custkey, c_name || ';' || c_mktsegment AS label, "
    "'say \"' || c_mktsegment || '\", | and ' || chr(92) AS quoted FROM customer"
)
_CYRILLIC = "SELECT o_orderkey, 'Заказ № ' || CAST(o_orderkey AS STRING) || ' «' || o_orderstatus || '»' AS label FROM orders"


def csv_scan_text(spark, sf):
    return C.read_text_table(spark, _csv_copy(spark, M.messy(spark, sf, *_SCANNED)))


def csv_select_subset(spark, sf):
    path = _csv_copy(spark, M.messy(spark, sf, *_SCANNED))
    return C.read_text_table(spark, path, columns=["comment", "account_code"])


def csv_scan_gzip(spark, sf):
    path = _csv_copy(spark, M.messy(spark, sf, *_SCANNED), compression="gzip")
    return C.read_text_table(spark, path, spread_rows=True)


def csv_scan_separators(spark, sf):
    customers = I._over(spark, sf, "customer", _TRICKY).select(
        F.col("c_custkey").cast("string").alias("key"), "label", "quoted"
    )
    read = None
    for typed in (",", ";", "\\t", "|", "~~"):
        options = C.ReadOptions.chosen(separator=typed)
        path = _csv_copy(spark, customers, sep=options.separator)
        part = C.read_text_table(spark, path, options).withColumn("sep", F.lit(typed))
        read = part if read is None else read.union(part)
    return read


def csv_scan_cp1251(spark, sf):
    orders = I._over(spark, sf, "orders", _CYRILLIC)
    path = _csv_copy(spark, orders, encoding="windows-1251", sep=";")
    return C.read_text_table(spark, path, C.ReadOptions(";", "cp1251"))


def choose_encoding(spark, sf):
    """The encoding found for a file, and the rows it is then read as."""
    orders = I._over(spark, sf, "orders", _CYRILLIC)
    path = _csv_copy(spark, orders, encoding="windows-1251", sep=";")
    options = C.choose_encoding(spark, path, C.ReadOptions(";"))
    table = C.read_text_table(spark, path, options)
    return table.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("label").startswith("Заказ № ")).alias("rows_readable"),
    ).withColumn("encoding", F.lit(options.encoding))


def encoding_scores(spark, sf):
    """How a file reads in two encodings whose first thousand lines are the same in both, and which one is chosen."""
    orders = I._over(spark, sf, "orders", _CYRILLIC)
    label = F.when(F.col("o_orderkey") <= 1000, F.lit("plain")).otherwise(F.col("label"))
    rows = orders.select("o_orderkey", label.alias("label")).orderBy("o_orderkey")
    path = _csv_copy(spark, rows, encoding="windows-1251", sep=";", header=False)
    chosen = C.choose_encoding(spark, path, C.ReadOptions(";")).encoding
    scores = C.encoding_scores(spark, path, ("utf_8", "cp1251"))
    return scores.select("encoding", "lines", "damaged", "traced", (F.col("encoding") == chosen).alias("chosen"))


def sniff_delimiter(spark, sf):
    path = _csv_copy(spark, I._over(spark, sf, "customer", _TRICKY), sep=";", header=False)
    return C.separator_counts(spark.read.text(path))


def csv_bad_rows(spark, sf):
    status = (
        F.when(F.col("o_orderkey") % 53 == 0, F.concat("o_orderstatus", F.lit(",extra,")))
        .when(F.col("o_orderkey") % 59 == 0, F.concat(F.lit('"a,b'), "o_orderstatus", F.lit('"')))
        .otherwise(F.col("o_orderstatus"))
    )
    # One column per line, under the header of two: written as it stands.
    lines = I.table(spark, sf, "orders").select(
        F.concat_ws(",", "o_orderkey", status).alias("order_key,status")
    )
    path = _csv_copy(spark, lines, sep="\x01", quote="\x02", escape="\x02")
    return C.bad_rows(spark, path)


# --- conversion ------------------------------------------------------------

_K = "o_orderkey"
_BAD_WHOLE = "does not fit {} or is not a whole number"
_TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"
_DAY = "CAST(o_orderdate AS DATE)"


def _conversion(*columns):
    """(target, source, type, SQL value, SQL condition of a refused cell)."""
    return columns


CONVERSIONS = {
    "convert_string": _conversion(
        ("plain", "comment", "String", M.COLUMNS["comment"], "false"),
        ("optional", "comment", "Nullable(String)", f"nullif({M.COLUMNS['comment']}, '')", "false"),
        ("category", "comment", "LowCardinality(Nullable(String))", f"nullif({M.COLUMNS['comment']}, '')", "false"),
        ("padded", "padded", "String", M.COLUMNS["padded"], "false"),
    ),
    "convert_integers": _conversion(
        ("u32", "order_key", "UInt32", f"CAST({_K} AS BIGINT)", "false"),
        ("i16", "signed_key", "Int16",
         f"CAST(CASE WHEN {_K} % 2 = 1 AND {_K} <= 32768 THEN -{_K} WHEN {_K} % 2 = 0 AND {_K} <= 32767 THEN {_K} END AS SMALLINT)",
         f"{_K} > 32768 OR ({_K} = 32768 AND {_K} % 2 = 0)"),
        ("u8", "signed_key", "UInt8",
         f"CAST(CASE WHEN {_K} % 2 = 0 AND {_K} <= 255 THEN {_K} END AS SMALLINT)",
         f"{_K} % 2 = 1 OR {_K} > 255"),
        ("from_code", "account_code", "Int64", f"CAST({_K} AS BIGINT)", "false"),
        ("from_phone", "phone", "UInt64", f"CAST(79000000000 + {_K} AS DECIMAL(20,0))", "false"),
        ("from_scientific", "scientific", "UInt64",
         f"CAST((10 + {_K} % 90) * CASE {_K} % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 ELSE 10000 END AS DECIMAL(20,0))",
         "false"),
        ("from_total", "total", "Nullable(Int64)",
         f"CASE WHEN {_K} % 97 <> 0 AND {_K} % 89 <> 0 AND {_TOTAL} = floor({_TOTAL}) THEN CAST({_TOTAL} AS BIGINT) END",
         f"{_K} % 97 <> 0 AND {_K} % 89 <> 0 AND {_TOTAL} <> floor({_TOTAL})"),
        ("from_padded", "padded", "Int32", f"CAST({_K} AS INTEGER)", "false"),
        ("from_mixed", "with_inf", "Int64", f"CASE WHEN {_K} % 200 <> 7 THEN CAST({_K} AS BIGINT) END", f"{_K} % 200 = 7"),
    ),
    "convert_float": _conversion(
        ("with_inf", "with_inf", "Float64", f"CASE WHEN {_K} % 200 <> 7 THEN CAST({_K} AS DOUBLE) END", f"{_K} % 200 = 7"),
        ("too_large", "too_large", "Float64", f"CASE WHEN {_K} % 200 <> 9 THEN CAST({_K} AS DOUBLE) END", f"{_K} % 200 = 9"),
        ("rate", "rate", "Float64", f"CAST({M.COLUMNS['rate']} AS DOUBLE)", "false"),
        ("with_nan", "with_nan", "Nullable(Float64)", f"CASE WHEN {_K} % 3 <> 0 THEN CAST(1.5 AS DOUBLE) END", "false"),
        ("required", "with_nan", "Float64", f"CASE WHEN {_K} % 3 <> 0 THEN CAST(1.5 AS DOUBLE) END", f"{_K} % 3 = 0"),
    ),
    "convert_decimal": _conversion(
        ("total", "total", "Nullable(Decimal(18, 2))",
         f"CASE WHEN {_K} % 97 <> 0 AND {_K} % 89 <> 0 THEN {_TOTAL} END", "false"),
        ("price", "price6", "Decimal(38, 10)", f"CAST({M.COLUMNS['price6']} AS DECIMAL(38,10))", "false"),
        ("cents", "price6", "Decimal(18, 2)",
         f"CASE WHEN ({_K} % 999983) % 10000 = 0 THEN CAST({M.COLUMNS['price6']} AS DECIMAL(18,2)) END",
         f"({_K} % 999983) % 10000 <> 0"),
        ("wide", "wide_amount", "Decimal(38, 2)", f"CAST({M.COLUMNS['wide_amount']} AS DECIMAL(38,2))", "false"),
        ("narrow", "wide_amount", "Decimal(18, 2)", "CAST(NULL AS DECIMAL(18,2))", "true"),
        ("joined", "underscored", "Decimal(18, 2)", f"CAST(1000 + {_K} % 1000 AS DECIMAL(18,2))", "false"),
    ),
    "convert_wide_decimal": _conversion(
        ("d45", "digits45", "Decimal(76, 0)", M.COLUMNS["digits45"], "false"),
        ("d80", "digits80", "Decimal(76, 0)", "CAST(NULL AS STRING)", "true"),
        ("amount", "wide_amount", "Decimal(76, 2)", M.COLUMNS["wide_amount"], "false"),
        ("from_sci", "scientific", "Decimal(76, 0)",
         f"CAST(10 + {_K} % 90 AS STRING) || CASE {_K} % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '00' WHEN 3 THEN '000' ELSE '0000' END",
         "false"),
        ("i128", "digits20", "Int128", M.COLUMNS["digits20"], "false"),
        ("i128_long", "digits45", "Int128", "CAST(NULL AS STRING)", "true"),
        ("i256", "digits45", "Int256", M.COLUMNS["digits45"], "false"),
    ),
    "convert_date": _conversion(
        ("order_date", "order_date", "Nullable(Date)", f"CASE WHEN {_K} % 101 <> 0 THEN {_DAY} END", "false"),
        ("old_as_date", "old_date", "Date", f"CASE WHEN {_K} % 50 <> 0 THEN {_DAY} END", f"{_K} % 50 = 0"),
        ("old_as_date32", "old_date", "Date32", f"CASE WHEN {_K} % 50 = 0 THEN DATE '1950-06-15' ELSE {_DAY} END", "false"),
        ("basic", "basic_date", "Date", _DAY, "false"),
        ("week", "week_date", "Date",
         f"CASE WHEN {_K} % 5 = 0 THEN DATE '2024-01-01' + CAST(({_K} % 52) * 7 + {_K} % 7 AS INTEGER) ELSE {_DAY} END", "false"),
        ("bad", "bad_date", "Nullable(Date)", f"CASE WHEN {_K} % 300 <> 1 THEN {_DAY} END", f"{_K} % 300 = 1"),
    ),
    "convert_datetime": _conversion(
        ("plain", "order_ts", "DateTime", f"CAST({M.COLUMNS['order_ts']} AS TIMESTAMP)", "false"),
        ("fine", "fine_ts", "DateTime", f"CAST({M.COLUMNS['order_ts']} AS TIMESTAMP)", "false"),
        ("zoned", "zoned_ts", "DateTime", f"CASE WHEN {_K} % 10 <> 0 THEN CAST({M._D} || ' 10:00:00' AS TIMESTAMP) END", f"{_K} % 10 = 0"),
        ("from_date", "order_date", "Nullable(DateTime)", f"CASE WHEN {_K} % 101 <> 0 THEN CAST({_DAY} AS TIMESTAMP) END", "false"),
    ),
    "convert_bool": _conversion(
        ("flag", "flag", "Bool", f"{_K} % 4 <> 1", "false"),
        ("bit", "zero_one", "Bool", f"{_K} % 2 = 1", "false"),
        ("wrong", "priority", "Nullable(Bool)", "CAST(NULL AS BOOLEAN)", "true"),
    ),
    "convert_passthrough": _conversion(
        ("zoned", "zoned_ts", "DateTime('Europe/Moscow')", M.COLUMNS["zoned_ts"], "false"),
        ("list", "padded", "Array(String)", f"CAST({_K} AS STRING)", "false"),
        ("marked", "markers_only", "Nullable(UUID)", "CAST(NULL AS STRING)", "false"),
        ("required", "markers_only", "UUID", "CAST(NULL AS STRING)", "true"),
    ),
}


def _mappings(columns):
    return [ColumnMapping(source, target, kind) for target, source, kind, _, _ in columns]


def _converter(columns):
    def run(spark, sf):
        sources = sorted({c[1] for c in columns} | {"order_key"})
        annotated = L.annotate(M.messy(spark, sf, *sources), _mappings(columns), keep=["order_key"])
        return annotated.withColumn("refused", F.size(L.ERRORS)).drop(L.ERRORS)

    return run


def _refused_sql(columns) -> str:
    return " + ".join(f"CASE WHEN {bad} THEN 1 ELSE 0 END" for *_, bad in columns)


def _conversion_sql(columns) -> str:
    values = ", ".join(f"{value} AS {target}" for target, _, _, value, _ in columns)
    return f"SELECT {M._K} AS order_key, {values}, CAST({_refused_sql(columns)} AS INTEGER) AS refused FROM orders"


_ALL = [
    (f"{name[8:]}_{c[0]}", *c[1:])
    for name in ("convert_integers", "convert_float", "convert_decimal", "convert_date", "convert_datetime", "convert_bool")
    for c in CONVERSIONS[name]
]
_ALL_TEXT_ROWS = "orders"


def apply_mapping(spark, sf):
    """Some columns, renamed and reordered, with one left out."""
    mappings = [
        ColumnMapping("comment", "note", "Nullable(String)"),
        ColumnMapping("total", "skipped", "String", include=False),
        ColumnMapping("order_key", "id", "UInt64"),
    ]
    return L.project(M.messy(spark, sf, "order_key", "total", "comment"), mappings)


def _reason_sql(kind: str, source: str) -> str:
    """Why a cell is refused, for the fixed cases of _ALL."""
    base = kind.removeprefix("Nullable(").removesuffix(")") if kind.startswith("Nullable(") else kind
    if base.startswith(("Int", "UInt")):
        return f"does not fit {base} or is not a whole number"
    if base == "Float64":
        return {
            "with_inf": "is not a finite number",
            "too_large": "does not fit Float64 and would become infinity",
            "with_nan": "is empty, and Float64 is not nullable",
        }.get(source, "")
    if base.startswith("Decimal"):
        return f"is not a number that {base} holds exactly"
    if base == "Date":
        return "is outside Date (1970-01-01..2149-06-06)" if source == "old_date" else "is not a date for Date"
    if base == "DateTime":
        return "carries a zone offset, which DateTime cannot hold"
    return "is not a boolean"


def reject_report(spark, sf):
    return V.reject_report(M.messy(spark, sf), _mappings(_ALL))


def first_bad_value(spark, sf):
    table = M.messy(spark, sf).withColumn("row_id", F.col("order_key").cast("bigint"))
    return V.first_bad_value(table, _mappings(_ALL), "row_id")


def validate_full(spark, sf):
    return V.validate(M.messy(spark, sf), _mappings(_ALL), B.DEFAULT_BLOCK_BYTES).drop("max_line_bytes")


#: Fewer rows than any of the given tables has.
_LEADING = 1000


def validate_sample(spark, sf):
    """The first rows of a file, in file order."""
    path = _csv_copy(spark, M.messy(spark, sf).withColumn("_k", F.col("order_key").cast("bigint")).orderBy("_k").drop("_k"))
    table = C.leading_rows(spark, path, _LEADING)
    return V.validate(table, _mappings(_ALL), B.DEFAULT_BLOCK_BYTES).drop("max_line_bytes")


def clean_value(spark, sf):
    items = I.table(spark, sf, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber",
        integral_text(F.col("l_quantity")).alias("quantity"),
        integral_text(F.col("l_discount")).alias("discount"),
    )


# --- serialization ---------------------------------------------------------

_BLOCK_LIMIT, _SHARD_ROWS = 20_000, 4096


def _typed_orders(spark, sf):
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.concat(F.lit('№ "'), F.col("o_orderstatus"), F.lit("\" a/b \\ 'тест'\t")).alias("note"),
        (F.col("o_orderkey") % 2 == 0).alias("even"),
    )


_LINE_SQL = (
    "'{\"id\":' || CAST(o_orderkey AS STRING) || ',\"total\":\"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) "
    "|| '\",\"order_date\":\"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '\",\"priority\":' "
    "|| CASE WHEN o_orderkey % 7 <> 0 THEN '\"' || o_orderpriority || '\"' ELSE 'null' END "
    "|| ',\"note\":\"№ \\\"' || o_orderstatus || '\\\" a/b \\\\ ''тест''\\t\",\"even\":' "
    "|| CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'"
)


def json_rows(spark, sf):
    return B.json_lines(_typed_orders(spark, sf))


def _packed(spark, sf):
    lines = B.json_lines(
        _typed_orders(spark, sf).withColumn("key_range", F.floor(F.col("id") / _SHARD_ROWS)),
        ["id", "total", "order_date", "priority", "note", "even"],
        keep=["id", "key_range"],
    )
    return B.pack_blocks(lines, _BLOCK_LIMIT, "key_range", "id")


def pack_blocks(spark, sf):
    return B.block_totals(_packed(spark, sf))


def load_summary(spark, sf):
    blocks = B.block_totals(_packed(spark, sf))
    return blocks.groupBy("shard").agg(
        F.sum("rows_count").alias("rows_total"),
        F.count(F.lit(1)).alias("blocks"),
        F.sum("block_bytes").alias("raw_bytes"),
    )


_BLOCKS_SQL = f"""
WITH RECURSIVE lines AS (
  SELECT o_orderkey // {_SHARD_ROWS} AS shard,
         row_number() OVER (PARTITION BY o_orderkey // {_SHARD_ROWS} ORDER BY o_orderkey) AS n,
         strlen({_LINE_SQL}) + 1 AS b
  FROM orders),
ends AS MATERIALIZED (
  SELECT shard, n, b, CAST(sum(b) OVER (PARTITION BY shard ORDER BY n) AS BIGINT) AS e FROM lines),
jumps AS MATERIALIZED (
  SELECT a.shard, a.n, a.e - a.b AS base, z.n AS stop, z.e - z.b AS stop_base
  FROM (SELECT *, e - b + {_BLOCK_LIMIT} + 1 AS reach FROM ends) a
  ASOF LEFT JOIN ends z ON a.shard = z.shard AND a.reach < z.e),
totals AS (SELECT shard, max(n) AS last_n, max(e) AS last_e FROM ends GROUP BY shard),
walk AS (
  SELECT shard, CAST(0 AS BIGINT) AS block, n, base, stop, stop_base FROM jumps WHERE n = 1
  UNION ALL
  SELECT j.shard, w.block + 1, j.n, j.base, j.stop, j.stop_base
  FROM walk w JOIN jumps j ON j.shard = w.shard AND j.n = w.stop)
SELECT shard, block, CAST(coalesce(stop, last_n + 1) - n AS BIGINT) AS rows_count,
       CAST(coalesce(stop_base, last_e) - base - 1 AS BIGINT) AS block_bytes
FROM walk JOIN totals USING (shard)"""


def oversize_rows(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text", "lang")
    lines = B.json_lines(docs, keep=["doc_id"])
    return B.oversize_rows(lines, 10_000).select(
        "doc_id", F.octet_length("line").alias("line_bytes")
    )


def export_json_gzip(spark, sf):
    path = export_json(_typed_orders(spark, sf), scratch_path(spark, "json"), "gzip")
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- tables ----------------------------------------------------------------

def export_blocks(spark, sf):
    """Rows written as zstd bodies of at most 20 000 bytes of text, and the lines read back from them."""
    path = block_files.write_blocks(_typed_orders(spark, sf), scratch_path(spark, "blocks"), "zstd", limit=20_000)
    short = F.when(F.col("raw_bytes") <= 20_000, F.col("body")).otherwise(F.raise_error(F.lit("a body is too long")))
    blocks = block_files.read_blocks(spark, path)
    return blocks.select(F.explode(F.split(short, "\n")).alias("line"))


def load_table(spark, sf):
    table = f"{_scratch_database(spark)}.orders_loaded"
    columns = CONVERSIONS["convert_decimal"][:1] + (
        ("id", "order_key", "UInt64", "", ""), ("note", "comment", "Nullable(String)", "", ""),
    )
    text = M.messy(spark, sf, "order_key", "total", "comment")
    typed = L.apply_mapping(text, _mappings(columns))
    return S.load_table(typed, table, S.Layout(shard_by="id", shards=8, sort_by=("id",)))


def load_partitioned(spark, sf):
    table = f"{_scratch_database(spark)}.orders_by_year"
    layout = S.Layout(
        partition_by={"order_year": F.year("order_date")}, shard_by="id", shards=4, sort_by=("id",)
    )
    return S.load_table(_typed_orders(spark, sf), table, layout)


def shard_assignment(spark, sf):
    keys = I.table(spark, sf, "orders").select(S.shard_of(F.col("o_orderkey"), 16).alias("shard"))
    shards = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    mean = F.sum("n") / 16
    return shards.agg(F.sum("n").alias("rows_total"), ((F.min("n") >= mean / 2) & (F.max("n") <= mean * 1.5)).alias("even"))


def replace_day(spark, sf):
    """Three days computed one after the other; the last one is then repeated."""
    table = f"{_scratch_database(spark)}.balances"
    balance_table.create_balance_table(spark, table)
    versions, turnovers = I.versions(spark, sf), I.turnovers(spark, sf)
    balance_table.process_days(versions, turnovers, table, I.BACKFILL_START, 3, I.PROCESSED_AT)
    balance_table.process_days(versions, turnovers, table, "2024-01-13", 1, I.PROCESSED_AT)
    return spark.table(table)


def run_ratios(spark, sf):
    """Records of two real loads of the orders: what they counted, and whether the ratios are in range."""
    database, runs = _scratch_database(spark), scratch_path(spark, "runs")
    columns = _mappings((("id", "order_key", "UInt64", "", ""), ("note", "comment", "Nullable(String)", "", "")))
    text = M.messy(spark, sf, "order_key", "comment")
    for name in ("first", "second"):
        load_runs.load(text, columns, f"{database}.{name}", runs_path=runs)
    ratios = load_runs.run_ratios(spark.read.parquet(runs))
    return ratios.select(
        F.substring_index("target", ".", -1).alias("target"), "outcome", "rows", "raw_bytes",
        (F.col("wire_bytes") > 0).alias("has_files"),
        (F.col("compression_ratio") > 0).alias("has_ratio"),
        (F.col("insert_wall_s") <= F.col("total_s")).alias("timed"),
    )


def csv_quoted_newlines(spark, sf):
    """Line breaks inside quoted cells, read as one cell each."""
    texts = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    path = _csv_copy(spark, texts)
    read = C.read_text_table(spark, path, C.ReadOptions(multi_line=True))
    return read.select("id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def csv_unclosed_quotes(spark, sf):
    """Lines whose quote is not closed, found; the others stay."""
    lines = I.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 37 == 0, F.concat("o_orderkey", F.lit(',"'), "o_orderpriority"))
        .otherwise(F.concat("o_orderkey", F.lit(","), "o_orderpriority")).alias("value")
    )
    path = _csv_copy(spark, lines.toDF("key,priority"), sep="\x01", quote="\x02", escape="\x02")
    return C.bad_rows(spark, path).select("line")


#: Cells with inch marks, doubled quotes and line breaks; every 53rd line has a field too many behind a stray quote.
_AWKWARD = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '" pipe' WHEN 1 THEN 'say "' || o_orderstatus || '", then go'
         WHEN 2 THEN o_orderpriority || chr(10) || o_orderstatus || chr(13) || chr(10) || 'end' ELSE o_orderstatus END AS note
FROM orders"""


def _awkward_lines(spark, sf):
    """The awkward cells as text: only cells that begin with a quote or hold a separator or a line break are quoted."""
    rows = I._over(spark, sf, "orders", _AWKWARD)
    needs = F.col("note").rlike('^"|[,\\n]')
    cell = F.when(needs, F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("note"))
    line = F.concat_ws(",", F.col("o_orderkey"), cell, F.when(F.col("o_orderkey") % 53 == 0, F.lit('6" d')))
    text = rows.orderBy("o_orderkey").select(line.alias("value"))
    path = scratch_path(spark, "csv")
    # A header for every file; lines are written as they stand.
    text.mapInPandas(_with_header, "value string").write.text(path)
    return path


def _with_header(batches):
    yield pd.DataFrame({"value": ["order_key,note"]})
    yield from batches


def csv_quoted_records(spark, sf):
    """Inch marks, doubled quotes and line breaks in cells, read in parallel with row numbers; lines with a field too many are set aside."""
    path = _awkward_lines(spark, sf)
    table = C.read_text_table(spark, path, C.ReadOptions(multi_line=True), watch_width=True, numbered=True)
    bad = F.col(BAD_LINE).isNotNull()
    return table.select(
        F.when(~bad, F.col("order_key")).alias("order_key"), F.when(~bad, F.col("note")).alias("note"),
        F.col(C.ROW).alias("row_number"), F.when(bad, F.col(BAD_LINE)).alias("refused"),
    )


def first_bad_row(spark, sf):
    """The first refused value of each column of a file, by its place in the file."""
    path = _csv_copy(spark, M.messy(spark, sf).withColumn("_k", F.col("order_key").cast("bigint")).orderBy("_k").drop("_k"))
    table = C.read_text_table(spark, path, numbered=True)
    return V.first_bad_value(table, _mappings(_ALL), C.ROW)


def sniffed_table(spark, sf):
    """A table read with the separator found in it."""
    path = _csv_copy(spark, I._over(spark, sf, "customer", _TRICKY), sep=";")
    separator = C.sniff_separator(spark, path)
    return C.read_text_table(spark, path, C.ReadOptions(separator)).withColumn("separator", F.lit(separator))


def csv_undecodable(spark, sf):
    """Lines with bytes that are no UTF-8, found."""
    lines = I._over(spark, sf, "orders", _CYRILLIC).where("o_orderkey % 5 < 2")
    lines = lines.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("label")).otherwise(F.lit("plain")).alias("label"))
    path = _csv_copy(spark, lines, encoding="windows-1251", sep=";")
    found = C.bad_rows(spark, path, C.ReadOptions(";"))
    return found.select(F.substring_index("line", ";", 1).alias("order_key"))


def load_refuses_bad_lines(spark, sf):
    """A load of a file with malformed lines: its record, and that no table is there."""
    database, runs = _scratch_database(spark), scratch_path(spark, "runs")
    lines = I.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 101 == 0, F.concat("o_orderkey", F.lit(",x,LOST"))).otherwise(F.concat("o_orderkey", F.lit(",x"))).alias("value")
    )
    path = _csv_copy(spark, lines.toDF("key,word"), sep="\x01", quote="\x02", escape="\x02")
    columns = _mappings((("id", "key", "UInt64", "", ""), ("word", "word", "String", "", "")))
    try:
        load_runs.load(C.read_text_table(spark, path), columns, f"{database}.lost", runs_path=runs)
    except LoadError:
        pass
    left = len(spark.catalog.listTables(database))
    return spark.read.parquet(runs).select("outcome", "fate", "rows", F.lit(left).cast("long").alias("tables"))


QUERIES = {
    **{
        f.__name__: f
        for f in (
            csv_scan_text, csv_select_subset, csv_scan_gzip, csv_scan_separators, csv_scan_cp1251,
            choose_encoding, sniff_delimiter, csv_bad_rows, apply_mapping, reject_report,
            first_bad_value, validate_full, validate_sample, clean_value, json_rows, pack_blocks,
            load_summary, oversize_rows, export_json_gzip, load_table, load_partitioned,
            shard_assignment, replace_day, run_ratios, csv_quoted_newlines, csv_unclosed_quotes,
            csv_undecodable, load_refuses_bad_lines, csv_quoted_records, first_bad_row, sniffed_table,
            encoding_scores, export_blocks,
        )
    },
    **{name: _converter(columns) for name, columns in CONVERSIONS.items()},
}

_SCAN_SQL = "SELECT " + ", ".join(f"{M.COLUMNS[c]} AS {c}" for c in _SCANNED) + " FROM orders"
_ROW_LINES = (
    "o_orderkey AS row_id, " + ", ".join(f"{sql} AS {name}" for name, sql in M.COLUMNS.items())
)


def _cell_text(source: str) -> str:
    """The offending text as reported: stripped, and empty where it is missing."""
    text = f"trim({M.COLUMNS[source]}, {M.quoted(' ')})"
    return f"CASE WHEN {text} IN ({M._MARKERS}) THEN '' ELSE {text} END"


_REFUSED_CELLS = "\nUNION ALL ".join(
    f"SELECT {_K} AS row_id, '{source}' AS source, {M.quoted(kind)} AS type, "
    f"{M.quoted(_reason_sql(kind, source))} AS reason, {_cell_text(source)} AS value "
    f"FROM orders WHERE {bad}"
    for _, source, kind, _, bad in _ALL
    if bad != "false"
)

SQL = {
    "csv_scan_text": _SCAN_SQL,
    "csv_select_subset": f"SELECT comment, account_code FROM ({_SCAN_SQL})",
    "csv_scan_gzip": _SCAN_SQL,
    "csv_scan_separators": f"""
SELECT CAST(c_custkey AS STRING) AS key, label, quoted, sep
FROM ({_TRICKY}), (SELECT unnest([',', ';', '\\t', '|', '~~']) AS sep)""",
    "csv_scan_cp1251": f"SELECT CAST(o_orderkey AS STRING) AS o_orderkey, label FROM ({_CYRILLIC})",
    "choose_encoding": """
SELECT count(*) AS rows_total, count(*) AS rows_readable, 'cp1251' AS encoding FROM orders""",
    "encoding_scores": """
SELECT e AS encoding, count(*) AS lines, count(*) FILTER (e = 'utf_8' AND o_orderkey > 1000) AS damaged,
  count(*) FILTER (e = 'utf_8' AND o_orderkey > 1000) AS traced, e = 'cp1251' AS chosen
FROM orders, (VALUES ('utf_8'), ('cp1251')) t(e) GROUP BY e""",
    "sniff_delimiter": """
SELECT s AS separator, CAST(min(n) AS INTEGER) AS fewest, CAST(max(n) AS INTEGER) AS most,
       count(*) AS lines, CAST(sum(n) AS BIGINT) AS total
FROM (SELECT s, CASE WHEN s = ';' THEN 2 ELSE 0 END AS n
      FROM customer, (SELECT unnest([',', ';', chr(9), '|']) AS s))
GROUP BY s""",
    "csv_bad_rows": """
SELECT CAST(o_orderkey AS STRING) || ',' || o_orderstatus || ',extra,' AS line, 4 AS fields
FROM orders WHERE o_orderkey % 53 = 0""",
    "apply_mapping": f"SELECT {M.COLUMNS['comment']} AS note, {M._K} AS id FROM orders",
    "reject_report": f"""
SELECT source, type, reason, count(*) AS cells, min(value) AS example
FROM ({_REFUSED_CELLS}) GROUP BY source, type, reason""",
    "first_bad_value": f"""
SELECT source, min(row_id) AS row_id, f.value AS value, f.type AS type, f.reason AS reason
FROM (SELECT source, row_id, first_value({{'value': value, 'type': type, 'reason': reason}})
             OVER (PARTITION BY source ORDER BY row_id, value, type, reason) AS f
      FROM ({_REFUSED_CELLS}))
GROUP BY source, f""",
    "validate_full": f"""
SELECT count(*) AS rows_total, count(*) FILTER (WHERE refused > 0) AS rows_refused,
       CAST(sum(refused) AS BIGINT) AS cells_refused, CAST(0 AS BIGINT) AS oversize_lines
FROM (SELECT {_refused_sql(_ALL)} AS refused FROM orders)""",
    "validate_sample": f"""
SELECT count(*) AS rows_total, count(*) FILTER (WHERE refused > 0) AS rows_refused,
       CAST(sum(refused) AS BIGINT) AS cells_refused, CAST(0 AS BIGINT) AS oversize_lines
FROM (SELECT {_refused_sql(_ALL)} AS refused FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT {_LEADING}))""",
    "clean_value": """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS STRING)
       ELSE CAST(l_quantity AS STRING) END AS quantity,
  CASE WHEN l_discount = floor(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS STRING)
       ELSE CAST(l_discount AS STRING) END AS discount
FROM lineitem""",
    "json_rows": f"SELECT {_LINE_SQL} AS line FROM orders",
    "pack_blocks": _BLOCKS_SQL,
    "load_summary": f"""
SELECT shard, CAST(sum(rows_count) AS BIGINT) AS rows_total, count(*) AS blocks,
       CAST(sum(block_bytes) AS BIGINT) AS raw_bytes
FROM ({_BLOCKS_SQL}) GROUP BY shard""",
    "oversize_rows": """
SELECT doc_id, CAST(strlen(line) AS INTEGER) AS line_bytes
FROM (SELECT doc_id, '{"doc_id":' || CAST(doc_id AS STRING) || ',"text":' || CAST(to_json(text) AS STRING)
             || ',"lang":"' || lang || '"}' AS line FROM documents)
WHERE strlen(line) > 10000""",
    "export_json_gzip": f"SELECT {_LINE_SQL} AS line FROM orders",
    "export_blocks": f"SELECT {_LINE_SQL} AS line FROM orders",
    "load_table": f"""
SELECT CASE WHEN {_K} % 97 <> 0 AND {_K} % 89 <> 0 THEN {_TOTAL} END AS total,
       CAST({_K} AS DECIMAL(20,0)) AS id, nullif({M.COLUMNS['comment']}, '') AS note
FROM orders""",
    "load_partitioned": f"""
SELECT o_orderkey AS id, {_TOTAL} AS total, {_DAY} AS order_date,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
  '№ "' || o_orderstatus || '" a/b ' || chr(92) || ' ''тест''' || chr(9) AS note,
  o_orderkey % 2 = 0 AS even, CAST(year(o_orderdate) AS INTEGER) AS order_year
FROM orders""",
    "replace_day": BQ._backfill_sql().split("\nUNION ALL SELECT * FROM d3")[0],
    "run_ratios": """
SELECT target, 'ok' AS outcome, count(*) AS rows,
       CAST(sum(strlen('{"id":' || o_orderkey || ',"note":' ||
           CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 11 = 0 THEN '"NA"'
                ELSE '"' || o_orderstatus || '"' END || '}')) AS BIGINT) AS raw_bytes,
       true AS has_files, true AS has_ratio, true AS timed
FROM orders, (VALUES ('first'), ('second')) t(target) GROUP BY target""",
    "csv_quoted_newlines": "SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS chars, md5(text) AS digest FROM documents",
    "csv_unclosed_quotes": """SELECT o_orderkey || ',"' || o_orderpriority AS line FROM orders WHERE o_orderkey % 37 = 0""",
    "csv_quoted_records": f"""
SELECT CASE WHEN NOT bad THEN CAST(o_orderkey AS VARCHAR) END AS order_key, CASE WHEN NOT bad THEN note END AS note,
  row_number() OVER (ORDER BY o_orderkey) - 1 AS row_number,
  CASE WHEN bad THEN o_orderkey || ',' ||
    CASE WHEN regexp_matches(note, '^"|[,\\n]') THEN '"' || replace(note, '"', '""') || '"' ELSE note END || ',6" d' END AS refused
FROM (SELECT *, o_orderkey % 53 = 0 AS bad FROM ({_AWKWARD}))""",
    "first_bad_row": f"""
SELECT source, min(row_id) AS row_id, f.value AS value, f.type AS type, f.reason AS reason
FROM (SELECT source, n AS row_id, first_value({{'value': value, 'type': type, 'reason': reason}})
             OVER (PARTITION BY source ORDER BY n, value, type, reason) AS f
      FROM ({_REFUSED_CELLS})
      JOIN (SELECT {_K} AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) ON key = row_id)
GROUP BY source, f""",
    "sniffed_table": f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, label, quoted, ';' AS separator FROM ({_TRICKY})",
    "csv_undecodable": "SELECT CAST(o_orderkey AS VARCHAR) AS order_key FROM orders WHERE o_orderkey % 5 = 0",
    "load_refuses_bad_lines": "SELECT 'failed' AS outcome, 'not_created' AS fate, CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS tables",
    "shard_assignment": "SELECT count(*) AS rows_total, true AS even FROM orders",
    **{name: _conversion_sql(columns) for name, columns in CONVERSIONS.items()},
}
