"""Delimited text as all-text DataFrames, and a look at what it contains."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truecolumn.errors import SchemaError
from truecolumn.functions import text_rules as R
from truecolumn.operators.load_plan import BAD_LINE
from truecolumn.plans.header import trimmed_names
from truecolumn.session import spread
from truecolumn.sources import quotes as Q
from truecolumn.sources.records import decoded, has_byte_lines, read_records

# What a user may choose from; other choices may be typed in.
SEPARATORS: tuple[str, ...] = (",", ";", "\t", "|")
ENCODINGS: tuple[str, ...] = ("utf_8", "utf-8-sig", "cp1251", "windows-1251")
SNIFF_CHARACTERS = 8192
_EXTRA = "_field_beyond_the_header"
PREVIEW_ROWS = 20
#: A file may have traces of a wrong decoding in one line of so many: what looks like a
#: trace can be text.
TRACED_LINES = 1000
#: Columns of numbered tables: the file, the first line of the row in it (from 1), and the
#: row's number over all files in order of their paths (from 0).
FILE, LINE, ROW = "_file", "_line", "_row"

# Spark wants charset names, and drops a byte order mark by itself.
_CHARSETS = {
    "utf8": "UTF-8",
    "utf8sig": "UTF-8",
    "cp1251": "windows-1251",
    "windows1251": "windows-1251",
}


@dataclass(frozen=True)
class ReadOptions:
    """How a delimited file is written.  Cells may span lines only on request."""

    separator: str = ","
    encoding: str = "utf_8"
    multi_line: bool = False

    @classmethod
    def chosen(cls, separator: str = ",", encoding: str = "utf_8", multi_line: bool = False):
        """Options from user input, where ``\\t`` may be typed as two characters."""
        separator = "\t" if separator == "\\t" else separator
        if not separator:
            raise SchemaError("a separator is required")
        if not encoding.strip():
            raise SchemaError("an encoding is required")
        return cls(separator, encoding.strip(), multi_line)

    @property
    def charset(self) -> str:
        plain = self.encoding.lower().replace("_", "").replace("-", "")
        return _CHARSETS.get(plain, self.encoding)


def reader_options(options: ReadOptions, header: bool) -> dict:
    return {
        "header": header,
        "sep": options.separator,
        "encoding": options.charset,
        "quote": '"',
        "escape": '"',
        "emptyValue": "",
        "mode": "PERMISSIVE",
        "multiLine": options.multi_line,
    }


def header_names(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> list[str]:
    """Trimmed header cells, from the first line only."""
    first = spark.read.options(**reader_options(options, False)).csv(path).limit(1).collect()
    if not first:
        raise SchemaError("a header line is required")
    return trimmed_names([cell for cell in first[0]])


def line_schema(names: list[str]) -> T.StructType:
    """The header's columns, one field more, and the raw line.

    Spark hands out the raw text of a line whose number of fields differs from
    the schema's.  With one column more that is every line but those that have
    just one field too many, and these show by having no raw text.
    """
    return T.StructType([T.StructField(n, T.StringType()) for n in (*names, _EXTRA, BAD_LINE)])


def line_options(options: ReadOptions) -> dict:
    """Reader settings for :func:`line_schema`; a pruned parser would not count fields."""
    return {**reader_options(options, True), "columnNameOfCorruptRecord": BAD_LINE, "columnPruning": False}


def _cell(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def _rewritten(cells: list[Column], separator: str) -> Column:
    """Cells as a line again, quoted where they need it."""
    quoted = [
        F.when(
            F.contains(c, F.lit(separator)) | F.contains(c, F.lit('"')),
            F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')),
        ).otherwise(c)
        for c in cells
    ]
    return F.concat_ws(separator, *quoted)


def malformed_line(names: list[str], separator: str) -> Column:
    """The text of a line that cannot be taken as it is, else null.

    That is a line with more fields than the header, with a quote that opens a
    cell and is not closed (a cell with a line break needs ``multi_line``), or
    with bytes that are no text in the chosen encoding.  Short lines are fine.
    """
    raw = F.col(BAD_LINE)
    one_more = _rewritten([_cell(n) for n in (*names, _EXTRA)], separator)
    return F.when(raw.isNull(), one_more).when(_malformed(raw, len(names), separator), raw)


def _malformed(text: Column, width: int, separator: str) -> Column:
    """Whether a whole record has too many fields, an open quote or damaged characters."""
    wide = Q.separators(text, separator) >= width
    # Patterns are only needed where there are quotes.
    quoted = Q.ends_inside(text, separator) | (wide & (Q.field_count(text, separator) > width))
    return F.contains(text, F.lit("\ufffd")) | F.when(F.contains(text, F.lit('"')), quoted).otherwise(wide)


def _from_records(spark: SparkSession, path: str, options: ReadOptions, names: list[str]) -> DataFrame:
    """Cells under positional names, with the record's text and numbers."""
    found = read_records(spark, path, options.charset, options.separator, options.multi_line)
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    settings = {k: str(v) for k, v in reader_options(options, False).items() if k in ("sep", "quote", "escape", "emptyValue", "mode")}
    # Line ends inside quotes stay as they are written.
    cells = F.from_csv("text", schema, {**settings, "multiLine": "true", "maxColumns": str(max(20480, 2 * len(names)))})
    return found.select(F.col("file").alias(FILE), F.col("line").alias(LINE), F.col("row").alias(ROW), F.col("text").alias(BAD_LINE), cells.alias("_cells"))


def read_text_table(
    spark: SparkSession,
    path: str,
    options: ReadOptions = ReadOptions(),
    columns: list[str] | None = None,
    watch_width: bool = False,
    spread_rows: bool = False,
    numbered: bool = False,
) -> DataFrame:
    """Every cell as raw text, under trimmed header names.

    Nothing is typed at the scan: a typed schema would lose ``007``, ``1.50``
    and ``NA``.  ``columns`` are the only ones kept.  Nothing is lost either: a
    malformed line (see :func:`malformed_line`) fails the job, or with
    ``watch_width`` shows its text in ``_bad_line``, which conversion takes as a
    refused row.  Short lines are padded.  ``spread_rows`` distributes the rows
    of files that cannot be split, such as one large gzip file.

    ``numbered`` adds the columns ``_file``, ``_line`` and ``_row``.  Numbered
    rows, and cells with line breaks (``multi_line``), are read in parallel too
    (see :mod:`truecolumn.sources.records`); only encodings whose line ends are
    not single bytes leave such a file to one task.
    """
    names = header_names(spark, path, options)
    wanted = columns or names
    if missing := [c for c in wanted if c not in names]:
        raise SchemaError("source columns not found: " + ", ".join(missing))
    if numbered or (options.multi_line and has_byte_lines(options.charset)):
        records = _from_records(spark, path, options, names)
        cells = [F.coalesce(F.col("_cells")[f"_{names.index(c)}"], F.lit("")).alias(c) for c in wanted]
        numbers = [FILE, LINE, ROW] if numbered else []
        bad = F.when(_malformed(F.col(BAD_LINE), len(names), options.separator), F.col(BAD_LINE))
        marked = records.select(*numbers, *cells, bad.alias(BAD_LINE))
    else:
        lines = spark.read.options(**line_options(options)).schema(line_schema(names)).csv(path)
        marked = lines.select(*[_cell(c).alias(c) for c in wanted], malformed_line(names, options.separator).alias(BAD_LINE))
    if not watch_width:
        message = F.concat(
            F.lit(
                f"a line does not fit the header of {len(names)} columns with separator {options.separator!r} and encoding "
                f"{options.encoding} (too many fields, an open quote or undecodable bytes): "
            ),
            F.left(BAD_LINE, F.lit(200)),
        )
        if numbered:
            message = F.concat(F.lit("line "), F.col(LINE), F.lit(" of "), F.col(FILE), F.lit(": "), message)
        fine = F.when(F.col(BAD_LINE).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        marked = marked.where(fine).drop(BAD_LINE)
    return spread(marked) if spread_rows else marked


def leading_rows(
    spark: SparkSession, path: str, rows: int, options: ReadOptions = ReadOptions(), watch_width: bool = False
) -> DataFrame:
    """The first ``rows`` rows in file order, the same ones at every run."""
    return read_text_table(spark, path, options, watch_width=watch_width, numbered=True).where(F.col(ROW) < rows).drop(FILE, LINE, ROW)


def bad_rows(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """Malformed lines (see :func:`malformed_line`), and how many fields they have."""
    table = read_text_table(spark, path, options, watch_width=True)
    return table.where(F.col(BAD_LINE).isNotNull()).select(
        F.col(BAD_LINE).alias("line"),
        Q.field_count(F.col(BAD_LINE), options.separator).alias("fields"),
    )


def require_regular(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> None:
    """Fail on a malformed line."""
    found = bad_rows(spark, path, options).limit(1).collect()
    if found:
        raise SchemaError(
            f"cannot parse with separator {options.separator!r} and encoding {options.encoding}: "
            f"a malformed line has {found[0]['fields']} fields: {found[0]['line'][:200]}"
        )


def preview(
    spark: SparkSession, path: str, options: ReadOptions = ReadOptions(), rows: int = PREVIEW_ROWS
) -> DataFrame:
    """The first rows as they are read, malformed lines among them; ``leading_rows`` gives the first of the file for certain."""
    return read_text_table(spark, path, options, watch_width=True).drop(BAD_LINE).limit(rows)


def separator_counts(lines: DataFrame, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Per candidate separator: fewest, most and mean occurrences in a line.

    ``lines`` has one text column ``value``.  All candidates are measured in
    one pass; what is inside quoted cells does not count.
    """
    bare = lines.where("value <> ''").select(Q.without_quoted(F.col("value"), *separators).alias("bare"))
    measured = bare.select(*[Q.separators(F.col("bare"), s).alias(f"n{i}") for i, s in enumerate(separators)])
    folded = measured.agg(
        *[
            F.struct(
                F.lit(s).alias("separator"),
                F.min(f"n{i}").alias("fewest"),
                F.max(f"n{i}").alias("most"),
                F.count(f"n{i}").alias("lines"),
                F.sum(f"n{i}").alias("total"),
            ).alias(f"c{i}")
            for i, s in enumerate(separators)
        ]
    )
    candidates = F.array(*[f"c{i}" for i in range(len(separators))])
    return folded.select(F.explode(candidates).alias("c")).select("c.*")


def best_separator(counts: DataFrame) -> DataFrame:
    """The separator found equally often, at least once, in every line."""
    steady = counts.where("fewest = most AND fewest >= 1")
    return steady.orderBy(F.desc("fewest"), "separator").limit(1)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of a file judged by its first characters; comma if unclear.

    Separators and quotes are ASCII, so the bytes are looked at as Latin-1,
    which reads any file.
    """
    # A line adds at least one character, and none is fetched beyond the limit.
    head = (
        spark.read.text(path)
        .limit(SNIFF_CHARACTERS)
        .select(F.decode(F.substring(F.col("value").cast("binary"), 1, SNIFF_CHARACTERS), "ISO-8859-1").alias("value"))
        .toLocalIterator()
    )
    kept, size = [], 0
    for row in head:
        size += len(row["value"]) + 1
        if kept and size > SNIFF_CHARACTERS:
            break
        kept.append((row["value"],))
    if not kept:
        raise SchemaError("a header line is required")
    counts = separator_counts(spark.createDataFrame(kept, "value string"))
    best = best_separator(counts).first()
    return best["separator"] if best else ","


def undecodable_lines(spark: SparkSession, path: str, encoding: str = "utf_8") -> DataFrame:
    """How many lines are no valid text in the encoding, as one row.

    The CSV reader replaces such bytes silently, so raw lines are looked at:
    for UTF-8 their bytes, otherwise the replacement characters left in them.
    """
    charset = ReadOptions(encoding=encoding).charset
    if charset == "UTF-8":
        lines = spark.read.text(path)
        return lines.agg(F.count_if(~F.is_valid_utf8("value")).alias("undecodable_lines"))
    whole_lines = {"sep": "\x01", "quote": "", "encoding": charset, "header": False}
    lines = spark.read.schema("value string").options(**whole_lines).csv(path)
    damaged = F.contains("value", F.lit("\ufffd"))
    return lines.agg(F.count_if(damaged).alias("undecodable_lines"))


def table_mojibake_score(df: DataFrame) -> DataFrame:
    """Mis-decoding traces summed over all cells, as one row."""
    per_row = sum((R.mojibake_score(F.col(f"`{c}`")) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0).cast("bigint")).alias("score"))


def encoding_scores(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """How every line of the files reads in each encoding, in one scan.

    One row per encoding, in the given order: lines that are not empty, lines
    with characters that cannot be decoded, lines with traces of a wrong
    decoding, and the traces' summed weight.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where("value <> ''")
    read = [decoded(F.col("value"), ReadOptions(encoding=e).charset) for e in encodings]
    texts = lines.select(*[t.alias(f"t{i}") for i, t in enumerate(read)])
    found = texts.select(
        *[F.contains(f"t{i}", F.lit("\ufffd")).alias(f"d{i}") for i in range(len(encodings))],
        *[R.mojibake_score(F.col(f"t{i}")).alias(f"s{i}") for i in range(len(encodings))],
    )
    folded = found.agg(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(e).alias("encoding"),
                F.count(F.lit(1)).alias("lines"),
                F.count_if(f"d{i}").alias("damaged"),
                F.count_if(F.col(f"s{i}") > 0).alias("traced"),
                F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias("score"),
            ).alias(f"c{i}")
            for i, e in enumerate(encodings)
        ]
    )
    return folded.select(F.explode(F.array(*[f"c{i}" for i in range(len(encodings))])).alias("c")).select("c.*")


def choose_encoding(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> ReadOptions:
    """The candidate encoding in which the whole file reads best.

    Candidates after the requested one are the usual choices; two spellings of
    one charset are tried once.  All lines are read in every candidate, in one
    job.  The least traces of a wrong decoding win, the earlier candidate among
    equals.  A file with undecodable characters in every reading, or with traces
    in one line of ``TRACED_LINES`` or more, is refused.
    """
    wanted: dict[str, str] = {}
    for encoding in (options.encoding, *ENCODINGS):
        wanted.setdefault(ReadOptions(encoding=encoding).charset, encoding)
    tried = tuple(e for c, e in wanted.items() if has_byte_lines(c))
    if not has_byte_lines(options.charset):
        # Its line ends are not single bytes, so it is judged as it is asked for.
        shown = preview(spark, path, options)
        if not table_mojibake_score(shown.withColumn("_header", F.lit("".join(shown.columns)))).first()["score"]:
            return options
    scores = sorted(encoding_scores(spark, path, tried).collect(), key=lambda r: (r["score"], r["place"]))
    for r in scores:
        if not r["damaged"] and r["traced"] * TRACED_LINES <= r["lines"]:
            return replace(options, encoding=r["encoding"])
    raise SchemaError(
        "the file shows replacement characters or mis-decoded text in every encoding tried: "
        + ", ".join(f"{r['encoding']} ({r['damaged']} and {r['traced']} of {r['lines']} lines)" for r in scores)
        + "; the file is damaged or was exported with a wrong encoding"
    )
