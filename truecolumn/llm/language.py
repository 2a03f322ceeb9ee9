"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams of one to three characters in order.
A text's own list is compared with each language's: every n-gram counts by how
many places it is out of place, one that the language lacks by the list's
length.  The language with the smallest sum wins.

Characters are lower-cased; every run without letters is one word border.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truecolumn.llm.common import arrow_batches, held_out, may_learn
from truecolumn.llm.words import slices

#: N-grams of a profile.
PROFILE = 300
UNKNOWN = "und"
#: The mark of a word border; letters follow from 2.
_BORDER = 1
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The mark of each code point: its number + 2 for a letter, else the border's."""
    return np.fromiter((i + 2 if chr(i).isalpha() else _BORDER for i in range(0x110000)), np.int64, 0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = np.empty(len(points) + 2, dtype=np.int64)
    marks[0] = marks[-1] = _BORDER
    marks[1:-1] = _letters()[points]
    letter = marks != _BORDER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    marks = marks[keep]
    if len(marks) < 2:
        return np.zeros(0, dtype=np.int64)
    pairs = (marks[:-1] << _BITS) | marks[1:]
    inner = marks[1:-1] != _BORDER
    triples = ((pairs[:-1] << _BITS) | marks[2:])[inner]
    return np.concatenate((marks[marks != _BORDER], pairs, triples))


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; equal counts by code."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(first, len(codes)))
    if counts.max() < 32768:  # short numbers sort faster, in the same order
        counts = counts.astype(np.int16)
    return codes[first[np.argsort(-counts, kind="stable")[:size]]]


class Profiles:
    """Ranks of every language's n-grams over the n-grams of all of them."""

    def __init__(self, lists: dict[str, list[int]], size: int = PROFILE):
        self.size, self.names = size, sorted(lists)
        self.known = np.unique(np.concatenate([np.asarray(v, dtype=np.int64) for v in lists.values()] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.names), len(self.known)), -1, dtype=np.int32)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.known, lists[name])] = np.arange(len(lists[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much nearer it is than the next one, 0 to 1."""
        codes = grams(text) if text else np.zeros(0, dtype=np.int64)
        if not len(codes) or not self.names or not len(self.known):
            return UNKNOWN, 0.0
        own = ranked(codes, self.size)
        spot = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        found = self.known[spot] == own
        theirs = self.ranks[:, spot[found]]
        off = np.where(theirs < 0, self.size, np.abs(theirs - np.flatnonzero(found)))
        total = off.sum(axis=1) + self.size * int((~found).sum())
        order = np.argsort(total, kind="stable")
        best = float(total[order[0]])
        other = float(total[order[1]]) if len(order) > 1 else float(self.size * len(own))
        return self.names[order[0]], 1.0 - best / other if other > 0 else 0.0


def _counted(batches):
    for whole in batches:
        for batch in slices(whole, "text", 1 << 21):
            names = batch["lang"].to_pylist()
            by: dict[str, list[np.ndarray]] = {}
            for name, text in zip(names, batch["text"].to_pylist(), strict=True):
                by.setdefault(name, []).append(grams(text))
            for name, parts in by.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]).take(pa.array(np.zeros(len(codes), np.int64))), pa.array(codes), pa.array(counts)],
                    names=["lang", "code", "n"],
                )


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the non-null languages of ``labelled(text, lang)``, from every row.

    Counts are summed within batches, then by Spark; only ``size`` codes of each
    language reach the driver.
    """
    arrow_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("place", place).where(F.col("place") <= size)
    lists: dict[str, dict[int, int]] = {}
    for row in top.select("lang", "code", "place").collect():
        lists.setdefault(row.lang, {})[row.place] = row.code
    return Profiles({name: [codes[i] for i in sorted(codes)] for name, codes in lists.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``und`` and 0 for a null text or one without letters.

    Reads nothing but the text.  Columns of ``docs`` with these two names are
    replaced.  Without profiles every text is ``und``.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            judged = [shared.value.judge(x) for x in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in judged], pa.string()), pa.array([x[1] for x in judged], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)


def language_of_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, learned from the rows that are not held out.

    Null texts and texts without letters are ``und``; equal distances go to the
    first language by name; repeated rows are judged alike.  A row with a null
    ``doc_id`` is neither learned from nor held out.
    """
    profiles = learn_profiles(docs.where(may_learn(F.col("doc_id"))))
    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(plain, profiles).select("doc_id", "held_out", "lang_pred", "score")
