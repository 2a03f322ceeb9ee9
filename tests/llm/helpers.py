"""Rows that every operator must bear, and plain re-statements to compare with."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, score string, x1 int, n_words string, spans int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def documents(spark, folder="/root/testdata/sf0.001", odd=True):
    """The given documents with extra columns of clashing names, and odd rows."""
    given = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) + (1, "k", "s", 2, "w", 3) for r in given.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    if odd:
        long_text = " ".join(f"w{i % 4099}" for i in range(30_000))
        extra = [
            (900_001, None, None, None, None),
            (900_002, "", "en", "src1", 0),
            (None, "a row without a key " * 20, "en", None, 1),
            (900_003, "one", "en", "src1", 3),
            (900_004, " \t\n\x0b", None, "src1", 4),
            (900_005, long_text, "en", "src2", len(long_text)),
            (900_006, "é漢\U0001f600 12345 !!! " * 30, "fr", "src2", 1),
            (900_007, rows[0][1], "en", "src3", 1),
            (900_007, rows[0][1], "en", "src3", 1),
        ]
        rows += [r + (None,) * 6 for r in extra]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
