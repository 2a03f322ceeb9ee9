"""Repeated passages by counts of word windows over all documents.

This stands in for a relative Lempel-Ziv parse: no reference text or position is kept.

* Index: of each window of ``WINDOW`` words the smallest hash among its
  ``ANCHOR``-word grams is the anchor.  Equal windows have equal anchors at
  equal offsets, so a window can only repeat where its anchor does.
* Look-up: windows whose anchor occurs twice or more anywhere are compared by
  the hash of all their words, again over all documents.
* Factors: runs of windows that each occur twice or more.  Every window is looked
  up on its own, so no border hides one; but the windows of a factor may repeat in
  different texts, and then no other text holds the whole factor.  Words of factors
  are duplicates, the others are literals.

Rows with the same text are one text with several occurrences.  Texts travel
twice: all of them once, to meet their repeated anchors; the few that have some
once more.  Everything else is hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, stored
from truecolumn.llm.words import Words, slices, windows, words_of

WINDOW = 35
_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_TEXT = ["x1", "x2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchor_size(window: int) -> int:
    """Words of an anchor: long enough to be rare, short enough to be few."""
    return max(1, window * 4 // 7)


def window_anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, the anchor position of each, and all anchor hashes by position."""
    size = anchor_size(window)
    grams = windows(words.hashes, size)
    span = window - size + 1
    if len(grams) < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, grams
    # Hash first, then position: of equal grams the leftmost is taken.
    least = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    have = 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = np.arange(len(least))
    ends = np.repeat(words.at[1:], np.diff(words.at))[: len(least)]
    inside = starts + window <= ends
    return starts[inside], (least[inside] & _PLACE).astype(np.int64), grams


def _anchors(window: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch["text"])
                _, places, grams = window_anchors(words, window)
                places = np.unique(places)
                text = np.searchsorted(words.at, places, side="right") - 1
                x1, x2 = (np.asarray(batch[c])[text] for c in _TEXT)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[places].view(np.int64)), pa.array(x1), pa.array((x2 << 32) | (places - words.at[text]))],
                    names=["h", "x1", "p"],
                )

    return run


def _first_of_runs(batches):
    """One row of each run of equal texts."""
    last = None
    for batch in batches:
        numbers = np.asarray(batch["number"])
        fresh = np.ones(len(numbers), dtype=bool)
        if len(numbers):
            fresh[1:] = numbers[1:] != numbers[:-1]
            fresh[0] = numbers[0] != last
            last = numbers[-1]
        yield batch.filter(pa.array(fresh))


def _windows(window: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch["text"])
                starts, places, _ = window_anchors(words, window)
                lists = batch["places"]
                text = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                hit = np.unique(np.asarray(lists.flatten(), dtype=np.int64) + words.at[text])
                starts = starts[np.isin(places, hit)]
                text = np.searchsorted(words.at, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(windows(words.hashes, window)[starts].view(np.int64)),
                        pa.array(np.asarray(batch["number"])[text]),
                        pa.array((starts - words.at[text]).astype(np.int32)),
                    ],
                    names=["h", "number", "start"],
                )

    return run


def parse(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Factors ``(first word, length)`` of a text whose windows at ``starts`` repeat somewhere."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    first = starts[np.concatenate(([0], cut + 1))]
    last = starts[np.concatenate((cut, [len(starts) - 1]))]
    return [(int(a), int(b - a + window)) for a, b in zip(first, last, strict=True)]


def _parsed(window: int):
    def run(batches):
        for batch in batches:
            out = []
            for number, text, starts in zip(batch["number"].to_pylist(), batch["text"].to_pylist(), batch["starts"], strict=True):
                words = text.encode().split()
                factors = parse(np.asarray(starts.values), window)
                keep = np.ones(len(words), dtype=bool)
                for first, length in factors:
                    keep[first : first + length] = False
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                out.append((number, int((~keep).sum()), kept, [{"first": a, "length": b} for a, b in factors]))
            number, removed, kept, factors = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([x.decode() for x in kept], pa.string()),
                    pa.array(factors, pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))),
                ],
                names=["number", "n_removed", "kept_text", "factors"],
            )

    return run


def _measured(batches):
    for batch in batches:
        split = [x.encode().split() for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["x1"],
                batch["x2"],
                pa.array([len(x) for x in split], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in split], pa.string()),
            ],
            names=["doc_id", "x1", "x2", "n_words", "sha"],
        )


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """Texts with the hashes that name them: 64 and 31 bits."""
    plain = docs.withColumn("text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return plain.withColumns({"x1": F.xxhash64("text"), "x2": F.shiftrightunsigned(F.xxhash64(F.lit(7), "text"), 33)})


def factorize(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(x1, x2, n_removed, kept_text, factors)`` for each distinct text with a repeated window.

    ``factors`` lists ``(first, length)`` in words, in order, and may overlap;
    ``kept_text`` holds the other words, joined by one space.  ``x1, x2`` name a
    text as :func:`_texts` does.  A text that several rows share appears once;
    that each of its windows repeats is counted over all rows.
    """
    arrow_batches(docs.sparkSession)
    texts = _texts(docs.select(text), text).select("x1", "x2", "text")
    anchors = texts.mapInArrow(_anchors(window), "h long, x1 long, p long")
    repeated = stored(anchors.groupBy("h").count().where("count > 1").select("h"), "repeated-anchors")
    met = anchors.join(repeated, "h").select(
        "x1", F.shiftright("p", 32).alias("x2"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place")
    )
    hits = met.groupBy("x1", "x2").agg(F.collect_set("place").alias("places"))
    hits = stored(hits.withColumn("number", F.monotonically_increasing_id()), "anchor-hits")

    joined = texts.join(hits, ["x1", "x2"]).select("number", "text", "places")
    hit_texts = stored(joined.mapInArrow(_first_of_runs, joined.schema), "hit-texts")
    looked_up = hit_texts.mapInArrow(_windows(window), "h long, number long, start int")
    held = stored(looked_up.groupBy("h").count().where("count > 1").select("h"), "repeated-windows")
    starts = looked_up.join(held, "h").groupBy("number").agg(F.collect_set("start").alias("starts"))
    parsed = hit_texts.select("number", "text").join(starts, "number").mapInArrow(
        _parsed(window), "number long, n_removed long, kept_text string, factors array<struct<first: long, length: long>>"
    )
    return hits.select("number", "x1", "x2").join(parsed, "number").drop("number")


def removed_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs(doc_id, text)``.

    Every word covered by a window that also starts anywhere else is removed,
    first occurrences too.  A null or empty text has no words.  Repeated rows
    repeat each other's windows, whatever their keys; null keys are kept as they
    are, and other columns are not read.
    """
    texts = _texts(docs.select(F.col("doc_id"), "text"), "text")
    measured = stored(
        texts.select("doc_id", "x1", "x2", "text").mapInArrow(
            _measured, docs.select("doc_id").schema.add("x1", "long").add("x2", "long").add("n_words", "long").add("sha", "string")
        ),
        "measured",
    )
    copies = measured.where(F.col("n_words") >= window).groupBy("x1", "x2").agg(F.count("*").alias("rows"))
    parsed = factorize(docs, "text", window).select(*_TEXT, "n_removed", F.sha2("kept_text", 256).alias("kept_sha"))
    # A text that several rows share has no word left; the others are parsed.
    changed = parsed.join(copies.where("rows > 1").select(*_TEXT), _TEXT, "left_anti")
    changed = changed.select(*_TEXT, "n_removed", "kept_sha")
    gone = copies.where("rows > 1").select(*_TEXT, F.lit(None).cast("long").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha"))
    changed = stored(changed.union(gone).withColumn("changed", F.lit(True)), "changed-texts")
    out = measured.join(changed, _TEXT, "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("changed"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    )
