"""The additive model: held-out accuracy, tables against plain sums, features against a re-statement."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, empty

from truecolumn.llm import additive as A

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def is_held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


def test_held_out_documents(spark):
    docs, labels = documents(spark, FOLDER), spark.read.parquet(f"{FOLDER}/labels.parquet")
    twice = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = A.score_quality(docs, twice).collect()
    assert len(got) == docs.count()
    found = Counter()
    for r in got:
        assert r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in truth:
            found[truth[r.doc_id], r.predicted] += 1
    assert found[1, 0] == 0 and found[0, 0] >= 0.9 * (found[0, 0] + found[0, 1]) > 0
    again = {(r.doc_id, r.score) for r in A.score_quality(docs, twice).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert A.score_quality(empty(spark), labels).count() == 0


def test_nothing_to_learn(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert {(r.score, r.predicted) for r in A.score_quality(docs, labels.limit(0)).collect()} == {(0.5, 0)}
    assert {(r.score, r.predicted) for r in A.score_quality(docs, labels.where("quality = 1")).collect()} == {(1.0, 1)}


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "good words here " * 5 if i % 2 else "bad ### " * 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - i % 2 if is_held_out(i) else i % 2, 0) for i in range(400)]
    labels = spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")
    assert all(r.predicted == r.doc_id % 2 for r in A.score_quality(docs, labels).collect())


def test_model_finds_single_effects_and_pairs():
    rng = np.random.default_rng(4)
    x = rng.random((6000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) != (x[:, 2] > 0.5))).astype(float)
    aside = rng.random(6000) < 0.2
    alone, both = A.fit(x, y, aside, pairs=0), A.fit(x, y, aside)
    right = lambda m: np.mean((m.score(x[aside]) >= 0.5) == y[aside])
    assert right(both) > 0.97 > 0.8 > right(alone) and max(both.pairs, key=lambda k: np.ptp(both.pairs[k])) == (2, 1)
    assert np.ptp(both.tables[0]) > 3 * np.ptp(both.tables[4])
    # Scores are sums of table values.
    for row in x[:50]:
        bins = [int(np.searchsorted(b, v, side="right")) for b, v in zip(both.borders, row, strict=True)]
        total = both.intercept + sum(t[i] for t, i in zip(both.tables, bins, strict=True))
        total += sum(t[both.coarse[f][bins[f]], both.coarse[g][bins[g]]] for (f, g), t in both.pairs.items())
        assert both.log_odds(row[None])[0] == pytest.approx(total)


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(1)
    g, h, n = rng.normal(size=12), rng.random(12) + 0.5, np.full(12, 10.0)
    gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
    cut = max(range(1, 12), key=lambda c: gain(slice(0, c)) + gain(slice(c, 12)))
    values = A.tree(g, h, n)
    assert values[cut - 1] != values[cut] and len(set(values)) == A.LEAVES
    g2, h2 = rng.normal(size=(5, 6)), rng.random((5, 6)) + 0.5
    four = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 6)), (slice(i, 5), slice(0, j)), (slice(i, 5), slice(j, 6))]
    sums = {(i, j): sum(g2[s].sum() ** 2 / (h2[s].sum() + 1) for s in four(i, j)) for i in range(1, 5) for j in range(1, 6)}
    won, table = A.cross(g2, h2, np.full((5, 6), 10.0))
    best = max(sums, key=sums.get)
    assert won == pytest.approx(sums[best] - g2.sum() ** 2 / (h2.sum() + 1))
    for s in four(*best):
        assert np.allclose(table[s], g2[s].sum() / (h2[s].sum() + 1))
    assert not A.tree(np.zeros(3), np.ones(3), np.ones(3)).any() and A.cross(np.ones((1, 4)), np.ones((1, 4)), np.ones((1, 4)))[0] == 0


def restated(text):
    data = (text or "").encode()
    w, n = WORD.findall(data), max(1, len(WORD.findall(data)))
    count = lambda signs: sum(data.count(bytes([s])) for s in signs)
    lines = [x for x in (text or "").split("\n") if x]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    return {
        "words": np.log1p(len(w)), "word_bytes": len(data) / n, "long_words": sum(len(x) > 20 for x in w) / n,
        "short_words": sum(len(x) < 3 for x in w) / n, "symbols": count(A.SYMBOLS) / max(1, len(data)), "bars": count(b"|") / n,
        "exclaims": count(b"!") / n, "stops": count(b".!?") / n, "commas": count(b",;:") / n, "digits": count(b"0123456789") / max(1, len(data)),
        "capitals": upper / max(1, upper + lower), "symbol_ends": sum(x[-1] in A.SYMBOLS for x in w) / n,
        "stop_ends": sum(x[-1] in b".!?" for x in w) / n, "twins": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        "distinct": 1 - (len(w) - len(set(w))) / n, "repeated_windows": (len(triples) - len(set(triples))) / n,
        "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "line_words": np.log1p(len(w) / max(1, len(lines))),
        "space": count(b" \t\n\x0b\x0c\r") / max(1, len(data)),
    }


def test_features(spark):
    texts = [r.text for r in documents(spark).collect()] + ["a a a", "A|b\nA|b\n\nx", "\n\n", "é É ß!? 12"]
    got = A.features(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        want = restated(text)
        assert row == pytest.approx([want[f] for f in A.FEATURES], rel=1e-5, abs=1e-6)
    assert A.features(pa.array([], pa.string())).shape == (0, len(A.FEATURES))
