"""Messy text made from the orders table, and profile queries over it.

The text columns are built by one SQL text in both engines.  They cover what
real exports contain: leading zeros, markers, mixed dates, huge numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import inputs as I
from truecolumn.functions import text_rules as R
from truecolumn.operators import infer as N
from truecolumn.operators import profile as P
from truecolumn.plans import decide as D
from truecolumn.session import scratch_path, spread
from truecolumn.sources import csv_text as C

_D = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_K = "CAST(o_orderkey AS STRING)"


def _pad(expression: str, width: int, fill: str = "0") -> str:
    return f"lpad(CAST({expression} AS STRING), {width}, '{fill}')"


COLUMNS = {
    "order_key": _K,
    "account_code": _pad("o_orderkey", 9),
    "total": (
        "CASE WHEN o_orderkey % 97 = 0 THEN 'NA' WHEN o_orderkey % 89 = 0 THEN '' "
        "ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END"
    ),
    "signed_key": f"CASE WHEN o_orderkey % 2 = 1 THEN '-' || {_K} ELSE {_K} END",
    "order_date": f"CASE WHEN o_orderkey % 101 = 0 THEN 'null' ELSE {_D} END",
    "old_date": f"CASE WHEN o_orderkey % 50 = 0 THEN '1950-06-15' ELSE {_D} END",
    "far_date": f"CASE WHEN o_orderkey % 50 = 0 THEN '2300-01-01' ELSE {_D} END",
    "basic_date": f"CASE WHEN o_orderkey % 3 = 0 THEN replace({_D}, '-', '') ELSE {_D} END",
    "week_date": (
        f"CASE WHEN o_orderkey % 5 = 0 THEN '2024-W' || {_pad('1 + o_orderkey % 52', 2)} || '-' "
        f"|| CAST(1 + o_orderkey % 7 AS STRING) ELSE {_D} END"
    ),
    "bad_date": f"CASE WHEN o_orderkey % 300 = 1 THEN '2023-02-30' ELSE {_D} END",
    "order_ts": f"{_D} || ' ' || {_pad('o_orderkey % 24', 2)} || ':15:30'",
    "fine_ts": f"{_D} || 'T' || {_pad('o_orderkey % 24', 2)} || ':15:30.' || {_pad('o_orderkey', 9)}",
    "zoned_ts": f"CASE WHEN o_orderkey % 10 = 0 THEN {_D} || 'T10:00:00+03:00' ELSE {_D} || 'T10:00:00' END",
    "flag": "CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Y' ELSE '1' END",
    "zero_one": "CAST(o_orderkey % 2 AS STRING)",
    "rate": f"CAST(o_orderkey % 1000 AS STRING) || '.' || {_pad('(o_orderkey * 7919) % 1000000', 12, '1')}",
    "price6": f"CAST(o_orderkey % 1000 AS STRING) || '.' || {_pad('o_orderkey % 999983', 6)}",
    "scientific": "CAST(10 + o_orderkey % 90 AS STRING) || 'e' || CAST(o_orderkey % 5 AS STRING)",
    "with_inf": f"CASE WHEN o_orderkey % 200 = 7 THEN 'inf' ELSE {_K} END",
    "with_nan": "CASE WHEN o_orderkey % 3 = 0 THEN 'nan' ELSE '1.5' END",
    "too_large": f"CASE WHEN o_orderkey % 200 = 9 THEN '1e400' ELSE {_K} END",
    "digits20": f"'18446744073709551' || {_pad('o_orderkey % 1000', 3)}",
    "digits45": f"'9' || {_pad('o_orderkey', 44, '3')}",
    "digits80": f"'-7' || {_pad('o_orderkey', 79, '1')}",
    "wide_amount": f"'12345678901234567890.' || {_pad('o_orderkey % 100', 2)}",
    "phone": f"'+7900' || {_pad('o_orderkey', 7)}",
    "underscored": f"'1_' || {_pad('o_orderkey % 1000', 3)}",
    "arabic": f"translate({_K}, '0123456789', '٠١٢٣٤٥٦٧٨٩')",
    "padded": f"'  ' || {_K} || ' '",
    "priority": "o_orderpriority",
    "comment": "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'NA' ELSE o_orderstatus END",
    "markers_only": "CASE WHEN o_orderkey % 2 = 0 THEN 'NA' ELSE 'null' END",
    "nothing": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '' END",
}
MESSY_SQL = "SELECT " + ",\n       ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + "\nFROM orders"


#: Orders that one task turns into text and works on.
ROWS_PER_TASK = 50_000


def messy(spark, sf, *names):
    """The messy table, or some of its columns."""
    orders = spread(I.table(spark, sf, "orders"), ROWS_PER_TASK)
    chosen = names or COLUMNS
    return orders.selectExpr(*[f"{COLUMNS[n]} AS {n}" for n in chosen])


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- the rules in SQL, as layers of one query -------------------------------

_MARKERS = ", ".join(quoted(m) for m in R.NA_MARKERS)
_WORDS = ", ".join(quoted(w) for w in R.BOOL_WORDS)
_EXPLICIT = ", ".join(quoted(w) for w in R.EXPLICIT_BOOL_WORDS)
_FROM, _TO = R._digit_alphabet()


def _re(pattern: str) -> str:
    return quoted(pattern)


def rules_sql(source: str, names=None) -> str:
    """A query giving every cell of ``source`` with all of its flags."""
    cells = "\nUNION ALL ".join(
        f"SELECT '{n}' AS column_name, {n} AS raw FROM src" for n in names or COLUMNS
    )
    day = f"""CASE
      WHEN dt < '0001' THEN NULL
      WHEN regexp_matches(dt, {_re(R.DATE_PATTERN)}) THEN try_cast(dt AS DATE)
      WHEN regexp_matches(dt, {_re(R.BASIC_DATE_PATTERN)})
        THEN try_cast(dt[1:4] || '-' || dt[5:6] || '-' || dt[7:8] AS DATE)
      WHEN regexp_matches(dt, {_re(R.WEEK_DATE_PATTERN)}) THEN
        (SELECT CASE WHEN w >= 1 AND year(monday + (w - 1) * 7 + 3) = y
                     THEN monday + (w - 1) * 7 + d - 1 END
         FROM (SELECT y, w, d, make_date(y, 1, 4) - CAST(isodow(make_date(y, 1, 4)) - 1 AS INTEGER) AS monday
               FROM (SELECT try_cast(dt[1:4] AS INTEGER) AS y,
                            try_cast(replace(dt, '-', '')[6:7] AS INTEGER) AS w,
                            try_cast(coalesce(nullif(replace(dt, '-', '')[8:8], ''), '1') AS INTEGER) AS d)))
    END"""
    return f"""
SELECT *, CASE WHEN v IS NULL THEN NULL ELSE {day} END AS parsed_day FROM (
SELECT *,
  CASE WHEN dec IS NULL THEN NULL ELSE greatest(frac - expo, 0) END AS scale,
  CASE WHEN dec IS NULL THEN NULL WHEN sig = '' THEN 0
       ELSE greatest(length(sig) + expo - frac, 0) END AS int_digits
FROM (
SELECT *,
  ltrim(replace(ltrim(mant, '+-'), '.', ''), '0') AS sig,
  CASE WHEN contains(mant, '.') THEN length(split_part(mant, '.', 2)) ELSE 0 END AS frac,
  CASE WHEN contains(lower(dec), 'e') THEN CAST(split_part(lower(dec), 'e', 2) AS BIGINT) ELSE 0 END AS expo
FROM (
SELECT *, split_part(lower(dec), 'e', 1) AS mant,
  CASE WHEN regexp_matches(plain, {_re(R.FLOAT_PATTERN)})
         THEN CASE WHEN coalesce(isinf(try_cast(replace(plain, '_', '') AS DOUBLE)), true)
                   THEN 'infinity' ELSE 'finite' END
       WHEN regexp_matches(plain, {_re(R.NON_FINITE_PATTERN)})
         THEN CASE WHEN contains(lower(plain), 'nan') THEN 'nan' ELSE 'infinity' END
  END AS kind,
  CASE WHEN regexp_matches(v, {_re(R.TIMESTAMP_PATTERN)})
       THEN regexp_extract(v, {_re(R.TIMESTAMP_PATTERN)}, 1) ELSE v END AS dt,
  coalesce(regexp_matches(v, {_re(R.TIMESTAMP_PATTERN)})
    AND regexp_extract(v, {_re(R.TIMESTAMP_PATTERN)}, 3) <> '', false) AS offset_seen
FROM (
SELECT *, CASE WHEN regexp_matches(replace(plain, '_', ''), {_re(R.DECIMAL_PATTERN)})
               THEN replace(plain, '_', '') END AS dec
FROM (
SELECT column_name, s, CASE WHEN s NOT IN ({_MARKERS}) THEN s END AS v,
  translate(CASE WHEN s NOT IN ({_MARKERS}) THEN s END, '{_FROM}', '{_TO}') AS plain
FROM (SELECT column_name, trim(raw, {quoted(R.WHITESPACE)}) AS s
      FROM (WITH src AS ({source}) {cells}))
)))))"""


_LOSSY = (
    "(starts_with(v, '+') OR regexp_matches(v, '^-?0[0-9]') OR strlen(v) <> length(v))"
)

PROFILE_SQL = f"""
SELECT column_name,
  bool_or(s = '') AS has_empty,
  bool_or(s <> '' AND v IS NULL) AS has_na_marker,
  CAST(count(v) AS BIGINT) AS total_non_empty,
  coalesce(bool_and(lower(v) IN ({_WORDS})), true) AS all_bool,
  coalesce(bool_or(lower(v) IN ({_EXPLICIT})), false) AS has_explicit_bool_literal,
  coalesce(bool_and(regexp_matches(plain, {_re(R.INTEGER_PATTERN)})), true) AS all_int,
  coalesce(bool_and(regexp_matches(plain, {_re(R.UNSIGNED_PATTERN)})), true) AS all_uint,
  coalesce(bool_and(dec IS NOT NULL) FILTER (WHERE v IS NOT NULL), true) AS all_decimal,
  coalesce(bool_and(kind IS NOT NULL) FILTER (WHERE v IS NOT NULL), true) AS all_float,
  coalesce(bool_and(parsed_day IS NOT NULL AND dt = v) FILTER (WHERE v IS NOT NULL), true) AS all_date,
  coalesce(bool_and(parsed_day IS NOT NULL) FILTER (WHERE v IS NOT NULL), true) AS all_datetime,
  coalesce(bool_or({_LOSSY} AND (dec IS NOT NULL OR kind IS NOT NULL)), false) AS has_lossy_numeric_text,
  coalesce(bool_or(kind IN ('nan', 'infinity')), false) AS has_unsendable_float,
  CAST(coalesce(max(scale), 0) AS BIGINT) AS max_decimal_scale,
  CAST(coalesce(max(int_digits), 0) AS BIGINT) AS max_decimal_int_digits,
  min(parsed_day) FILTER (WHERE dt = v) AS min_date,
  max(parsed_day) FILTER (WHERE dt = v) AS max_date,
  coalesce(bool_or(offset_seen AND parsed_day IS NOT NULL), false) AS has_timezone_offset,
  CAST(coalesce(max(int_digits) FILTER (WHERE scale = 0), 0) AS BIGINT) AS max_integer_digits,
  min(whole) AS min_integer, max(whole) AS max_integer
FROM (SELECT *, CASE WHEN scale = 0 AND int_digits <= 38 THEN
        CASE WHEN expo = 0 THEN try_cast(split_part(dec, '.', 1) AS DECIMAL(38,0))
             ELSE try_cast(try_cast(dec AS DOUBLE) AS DECIMAL(38,0)) END END AS whole
      FROM ({rules_sql(MESSY_SQL)}))
GROUP BY column_name"""


def _decide_sql(profile: str) -> str:
    def integer(native: str, low: int, high: int) -> str:
        return (
            f"CASE WHEN max_integer_digits <= 38 AND min_integer >= {low}::DECIMAL(38,0) "
            f"AND max_integer <= {high}::DECIMAL(38,0) THEN '{native}' "
            "WHEN max_integer_digits <= 38 THEN 'Decimal(38, 0)' "
            "WHEN max_integer_digits <= 76 THEN 'Decimal(76, 0)' ELSE 'String' END"
        )

    def decimal(scale: int, widths) -> str:
        cases = " ".join(
            f"WHEN max_decimal_int_digits + {scale} <= {w} THEN 'Decimal({w}, {scale})'" for w in widths
        )
        return f"CASE {cases} ELSE 'String' END"

    return f"""
SELECT *, CASE WHEN nullable THEN 'Nullable(' || inferred_type || ')' ELSE inferred_type END AS final_type
FROM (SELECT *, has_empty OR (has_na_marker AND inferred_type <> 'String') AS nullable FROM (
SELECT *, CASE
  WHEN total_non_empty = 0 THEN 'String'
  WHEN all_bool AND has_explicit_bool_literal THEN 'Bool'
  WHEN has_unsendable_float THEN 'String'
  WHEN has_lossy_numeric_text AND (all_uint OR all_int OR all_decimal OR all_float) THEN 'String'
  WHEN all_uint THEN {integer('UInt64', 0, D.UINT64_MAX)}
  WHEN all_int THEN {integer('Int64', D.INT64_MIN, D.INT64_MAX)}
  WHEN all_decimal AND max_decimal_scale <= 2 THEN {decimal(2, (18, 38, 76))}
  WHEN all_decimal AND max_decimal_scale <= 10 THEN {decimal(10, (38, 76))}
  WHEN all_decimal THEN 'Float64'
  WHEN all_date THEN CASE
    WHEN min_date >= DATE '{D.DATE_MIN}' AND max_date <= DATE '{D.DATE_MAX}' THEN 'Date'
    WHEN min_date >= DATE '{D.DATE32_MIN}' AND max_date <= DATE '{D.DATE32_MAX}' THEN 'Date32'
    ELSE 'String' END
  WHEN all_datetime AND has_timezone_offset THEN 'String'
  WHEN all_datetime THEN 'DateTime'
  WHEN all_float THEN 'Float64'
  ELSE 'String' END AS inferred_type
FROM ({profile})))"""


_BOUNDS_SQL = f"""
SELECT column_name, arg_min(shown, place) AS low, arg_max(shown, place) AS high
FROM (SELECT column_name, CASE WHEN digits = '' THEN '0' WHEN negative THEN '-' || digits ELSE digits END AS shown,
             {{'size': CASE WHEN negative THEN -length(digits) ELSE length(digits) END,
              'digits': CASE WHEN negative THEN translate(digits, '0123456789', '9876543210') ELSE digits END}} AS place
      FROM (SELECT column_name, starts_with(v, '-') AS negative, ltrim(v, '+-0') AS digits
            FROM ({rules_sql(MESSY_SQL)}) WHERE regexp_matches(v, {_re(R.INTEGER_PATTERN)})))
GROUP BY column_name"""


def _notes_sql() -> str:
    dates = "'dates from ' || CAST(min_date AS STRING) || ' to ' || CAST(max_date AS STRING)"
    values = "'values from ' || low || ' to ' || high"

    def whole(native: str) -> str:
        return f"""CASE inferred_type WHEN '{native}' THEN ''
         WHEN 'String' THEN {values} || ' are longer than 76 digits; kept exact as String'
         ELSE {values} || ' do not fit {native}; widened to ' || inferred_type END"""

    return f"""
SELECT column_name, final_type, CASE
  WHEN total_non_empty = 0 AND has_na_marker THEN 'only missing-value markers; String'
  WHEN total_non_empty = 0 THEN 'all values are empty; String'
  WHEN inferred_type = 'Bool' THEN ''
  WHEN has_unsendable_float
    THEN 'infinity, or a nan spelling that is no missing-value marker; kept as String'
  WHEN has_lossy_numeric_text AND (all_uint OR all_int OR all_decimal OR all_float)
    THEN 'leading zeros, a plus sign or non-ASCII digits would be lost; kept as String'
  WHEN all_uint THEN {whole('UInt64')}
  WHEN all_int THEN {whole('Int64')}
  WHEN all_decimal AND max_decimal_scale > 10 THEN 'more than 10 decimals; fallback to Float64'
  WHEN all_decimal AND inferred_type IN ('Decimal(18, 2)', 'Decimal(38, 10)') THEN ''
  WHEN all_decimal THEN CAST(max_decimal_int_digits + CASE WHEN max_decimal_scale <= 2 THEN 2 ELSE 10 END AS STRING)
    || CASE WHEN inferred_type = 'String' THEN ' digits exceed the 76 a decimal holds; kept exact as String'
            ELSE ' digits are needed; widened to ' || inferred_type END
  WHEN all_date THEN CASE inferred_type WHEN 'Date' THEN ''
    WHEN 'Date32' THEN {dates} || ' do not fit Date ({D.DATE_MIN}..{D.DATE_MAX}); widened to Date32'
    ELSE {dates} || ' do not fit Date32 ({D.DATE32_MIN}..{D.DATE32_MAX}); kept as String' END
  WHEN all_datetime AND has_timezone_offset
    THEN 'timestamps carry a zone offset, which DateTime cannot hold; kept as String'
  WHEN inferred_type IN ('DateTime', 'Float64') THEN ''
  ELSE 'mixed or unsupported values; String' END AS notes
FROM ({_decide_sql(PROFILE_SQL)}) LEFT JOIN ({_BOUNDS_SQL}) USING (column_name)"""


def profile_columns(spark, sf):
    return P.profile(messy(spark, sf))


def profile_merged(spark, sf):
    """The profile of two halves, merged from their profiles alone."""
    whole = messy(spark, sf)
    odd = F.pmod(F.xxhash64("order_key"), F.lit(2)) == 1
    return P.merge_profiles(P.profile(whole.where(odd)), P.profile(whole.where(~odd)))


def infer_types(spark, sf):
    return N.infer_types(messy(spark, sf)).select(
        "column_name", "inferred_type", "nullable", "final_type"
    )


def infer_notes(spark, sf):
    return N.infer_notes(messy(spark, sf))


def profile_samples(spark, sf):
    return P.samples(messy(spark, sf)).select(
        "column_name", F.explode("samples").alias("sample")
    )


#: Fewer rows than any of the given tables has.
LEADING = 400


def profile_sample_vs_full(spark, sf):
    """Types drawn from the leading rows of a file next to those of the whole file."""
    path = scratch_path(spark, "csv")
    rows = messy(spark, sf).withColumn("_k", F.col("order_key").cast("bigint")).orderBy("_k").drop("_k")
    rows.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    full = N.infer_types(C.read_text_table(spark, path)).select("column_name", F.col("final_type").alias("full_type"))
    head = N.infer_types(C.leading_rows(spark, path, LEADING)).select("column_name", F.col("final_type").alias("sample_type"))
    return full.join(head, "column_name").withColumn(
        "same", F.col("full_type") == F.col("sample_type")
    )


def _values(spark, sf):
    tall = P.cells(messy(spark, sf))
    return tall.where(~F.col("value").isin(*R.NA_MARKERS))


def _counted(df, *keys):
    return df.groupBy("column_name", *keys).agg(F.count(F.lit(1)).alias("cells"))


def missing_mask(spark, sf):
    tall = messy(spark, sf).unpivot([], list(COLUMNS), "column_name", "value")
    v = F.col("value")
    return _counted(
        tall.select(
            "column_name",
            R.is_missing(v, na_markers=False).alias("missing_as_text"),
            R.is_missing(v, na_markers=True).alias("missing_otherwise"),
        ),
        "missing_as_text", "missing_otherwise",
    )


def scalar_predicates(spark, sf):
    v = F.col("value")
    flagged = _values(spark, sf).select(
        "column_name",
        R.is_bool(v).alias("is_bool"),
        R.is_int(v).alias("is_int"),
        R.is_uint(v).alias("is_uint"),
        R.loses_text_as_number(v).alias("loses_text"),
    )
    return _counted(flagged, "is_bool", "is_int", "is_uint", "loses_text")


def decimal_shape(spark, sf):
    texts = _values(spark, sf).select("column_name", R.decimal_text(F.col("value")).alias("text"))
    shaped = texts.select("column_name", R.decimal_shape_of(F.col("text")).alias("shape"))
    return _counted(shaped.select("column_name", "shape.*"), "int_digits", "scale")


def float_kind(spark, sf):
    kinds = _values(spark, sf).select("column_name", R.float_kind(F.col("value")).alias("kind"))
    return _counted(kinds, "kind")


def date_parse(spark, sf):
    days = _values(spark, sf).select("column_name", R.date_value(F.col("value")).alias("day"))
    return _counted(days, "day")


def datetime_parse(spark, sf):
    table = messy(spark, sf, "order_key", "order_ts", "fine_ts", "zoned_ts", "week_date")
    parsed = [R.timestamp_value(R.strip(F.col(c))).alias(c) for c in table.columns[1:]]
    return table.select("order_key", *parsed, R.has_offset(F.col("zoned_ts")).alias("zoned"))


def normalize_identifier(spark, sf):
    part = I.table(spark, sf, "part")
    label = F.concat_ws(" - ", "p_name", "p_type", "p_brand")
    return part.select("p_partkey", R.identifier(label).alias("name"), R.identifier(
        F.concat(F.col("p_size").cast("string"), F.lit(" №  ЦЕНА/"), F.col("p_type"), F.lit("__"))
    ).alias("numbered"))


def normalize_header(spark, sf):
    """Distinct lines of the documents as header cells."""
    docs = I.table(spark, sf, "documents")
    line = F.explode(F.split(F.col("text"), "\n"))
    return docs.select(line.alias("line")).select(F.concat(F.lit("  "), "line", F.lit("\t")).alias("cell")).distinct().select(
        "cell", R.strip(F.col("cell")).alias("trimmed"), R.identifier(F.col("cell")).alias("name")
    )


def duplicate_names(spark, sf):
    """Labels that would collide as column names."""
    part = I.table(spark, sf, "part")
    labels = part.select(F.concat_ws("#", "p_type", "p_brand").alias("label")).distinct()
    both = labels.union(labels.select(F.upper(F.replace("label", F.lit("#"), F.lit("  ")))))
    named = both.select(R.identifier(F.col("label")).alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def split_samples(spark, sf):
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(R.split_samples(F.col("text"))).alias("part")).groupBy(
        "doc_id"
    ).agg(F.count(F.lit(1)).alias("parts"), F.min("part").alias("first_part"))


def mojibake_score(spark, sf):
    docs = I.table(spark, sf, "documents")
    # Some documents get the traces a wrong decoding leaves.
    damaged = F.when(
        F.col("doc_id") % 5 == 0,
        F.concat("text", F.lit(" РЅРµ � пїЅ С‚Рѕ")),
    ).otherwise(F.col("text"))
    return docs.select("doc_id", R.mojibake_score(damaged).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        profile_columns, profile_merged, infer_types, infer_notes, profile_samples,
        profile_sample_vs_full, missing_mask, scalar_predicates, decimal_shape, float_kind,
        date_parse, datetime_parse, normalize_identifier, normalize_header, duplicate_names,
        split_samples, mojibake_score,
    )
}

_CELLS = f"({rules_sql(MESSY_SQL)})"
_GAP = R.IDENTIFIER_GAP_PATTERN


def _identifier_sql(text: str) -> str:
    name = f"trim(regexp_replace(lower(trim({text}, {quoted(R.WHITESPACE)})), '{_GAP}', '_', 'g'), '_')"
    return (
        f"CASE WHEN {name} = '' THEN NULL WHEN regexp_matches({name}, '{R.LEADING_DIGIT_PATTERN}') "
        f"THEN 'col_' || {name} ELSE {name} END"
    )


def _occurrences_sql(text: str) -> str:
    terms = [
        f"{weight} * ((length({text}) - length(replace({text}, '{m}', ''))) // {len(m)})"
        for markers, weight in ((R.REPLACEMENT_FORMS, R.REPLACEMENT_WEIGHT), (R.MOJIBAKE_PAIRS, 1))
        for m in markers
    ]
    return "CAST(" + " + ".join(terms) + " AS BIGINT)"


_TS = "try_cast({d} || ' ' || regexp_replace({c}, '(\\.[0-9]{{6}})[0-9]*$', '\\1') AS TIMESTAMP)"
_HEADER_CELL = "'  ' || unnest(string_split(text, chr(10))) || chr(9)"
_LEADING_PROFILE = PROFILE_SQL.replace("FROM orders", f"FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT {LEADING})")

SQL = {
    "profile_columns": PROFILE_SQL,
    "profile_merged": PROFILE_SQL,
    "infer_types": f"SELECT column_name, inferred_type, nullable, final_type FROM ({_decide_sql(PROFILE_SQL)})",
    "profile_sample_vs_full": f"""
SELECT column_name, a.final_type AS full_type, b.final_type AS sample_type, a.final_type = b.final_type AS same
FROM ({_decide_sql(PROFILE_SQL)}) AS a JOIN ({_decide_sql(_LEADING_PROFILE)}) AS b USING (column_name)""",
    "infer_notes": _notes_sql(),
    "profile_samples": f"""
SELECT column_name, s AS sample FROM (
  SELECT column_name, s, row_number() OVER (PARTITION BY column_name ORDER BY s) AS n
  FROM (SELECT DISTINCT column_name, s FROM {_CELLS} WHERE s <> ''))
WHERE n <= {P.SAMPLES_PER_COLUMN}""",
    "missing_mask": f"""
WITH src AS ({MESSY_SQL})
SELECT column_name, raw = '' AS missing_as_text,
       trim(raw, {quoted(R.WHITESPACE)}) IN ({_MARKERS}) AS missing_otherwise, count(*) AS cells
FROM ({" UNION ALL ".join(f"SELECT '{n}' AS column_name, {n} AS raw FROM src" for n in COLUMNS)})
GROUP BY ALL""",
    "scalar_predicates": f"""
SELECT column_name, lower(v) IN ({_WORDS}) AS is_bool,
  regexp_matches(plain, {_re(R.INTEGER_PATTERN)}) AS is_int,
  regexp_matches(plain, {_re(R.UNSIGNED_PATTERN)}) AS is_uint,
  {_LOSSY} AS loses_text, count(*) AS cells
FROM {_CELLS} WHERE v IS NOT NULL GROUP BY ALL""",
    "decimal_shape": f"""
SELECT column_name, CAST(int_digits AS BIGINT) AS int_digits, CAST(scale AS BIGINT) AS scale,
  count(*) AS cells
FROM {_CELLS} WHERE v IS NOT NULL GROUP BY ALL""",
    "float_kind": f"SELECT column_name, kind, count(*) AS cells FROM {_CELLS} WHERE v IS NOT NULL GROUP BY ALL",
    "date_parse": f"""
SELECT column_name, CASE WHEN dt = v THEN parsed_day END AS day, count(*) AS cells
FROM {_CELLS} WHERE v IS NOT NULL GROUP BY ALL""",
    "datetime_parse": f"""
SELECT {COLUMNS['order_key']} AS order_key,
  try_cast({COLUMNS['order_ts']} AS TIMESTAMP) AS order_ts,
  try_cast({COLUMNS['fine_ts'].replace("|| lpad(CAST(o_orderkey AS STRING), 9, '0')", "|| lpad(CAST(o_orderkey AS STRING), 9, '0')[1:6]")} AS TIMESTAMP) AS fine_ts,
  CAST({_D} || ' 10:00:00' AS TIMESTAMP) AS zoned_ts,
  CAST(CASE WHEN o_orderkey % 5 = 0
       THEN DATE '2024-01-01' + CAST((o_orderkey % 52) * 7 + o_orderkey % 7 AS INTEGER)
       ELSE CAST(o_orderdate AS DATE) END AS TIMESTAMP) AS week_date,
  o_orderkey % 10 = 0 AS zoned
FROM orders""",
    "normalize_identifier": f"""
SELECT p_partkey, {_identifier_sql("(p_name || ' - ' || p_type || ' - ' || p_brand)")} AS name,
  {_identifier_sql("(CAST(p_size AS STRING) || ' №  ЦЕНА/' || p_type || '__')")} AS numbered
FROM part""",
    "normalize_header": f"""
SELECT cell, trim(cell, {quoted(R.WHITESPACE)}) AS trimmed, {_identifier_sql('cell')} AS name
FROM (SELECT DISTINCT {_HEADER_CELL} AS cell FROM documents)""",
    "duplicate_names": f"""
WITH labels AS (SELECT DISTINCT p_type || '#' || p_brand AS label FROM part)
SELECT name, count(*) AS occurrences FROM (
  SELECT {_identifier_sql('label')} AS name
  FROM (SELECT label FROM labels UNION ALL SELECT upper(replace(label, '#', '  ')) FROM labels))
GROUP BY name HAVING count(*) > 1""",
    "split_samples": f"""
SELECT doc_id, count(*) AS parts, min(part) AS first_part
FROM (SELECT doc_id, trim(unnest(string_split(text, ',')), {quoted(R.WHITESPACE)}) AS part FROM documents)
WHERE part <> '' GROUP BY doc_id""",
    "mojibake_score": f"""
SELECT doc_id, {_occurrences_sql('t')} AS score
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' РЅРµ � пїЅ С‚Рѕ' ELSE text END AS t
      FROM documents)""",
}
