"""Periodic runs against a search through all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from helpers import documents, empty

from truecolumn.llm import periods as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i, n = 0, len(w) - q
        while i < n:
            j = i
            while j < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(key, text):
    w = WORD.findall(text or "")
    if key is not None and w and (h := zlib.crc32(str(key).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = all_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def sequence(rng):
    n, k, kind = rng.randrange(400), rng.choice([1, 2, 3, 5, 50]), rng.randrange(5)
    if kind == 0:
        return [rng.randrange(k) for _ in range(n)]
    if kind == 1:
        base = [rng.randrange(k) for _ in range(rng.randrange(1, 60))]
        w = [base[i % len(base)] for i in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            w[rng.randrange(n)] = rng.randrange(k)
        return w
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        inner = [rng.randrange(2) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 12)
        return ((inner + [rng.randrange(3) for _ in range(rng.randrange(6))]) * rng.randrange(1, 7))[: n + 50]
    w = []
    while len(w) < n:
        w += [rng.randrange(k) for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 6)
    return w


def test_runs_of_many_sequences():
    rng = random.Random(5)
    for _ in range(150):
        texts = [sequence(rng) for _ in range(rng.randrange(1, 8))]
        at = np.cumsum([0, *map(len, texts)])
        found = P.runs_of(np.array([x for t in texts for x in t], dtype=np.int64), at)
        got = [[] for _ in texts]
        for s, n, q in zip(*(a.tolist() for a in found), strict=True):
            i = int(np.searchsorted(at, s, side="right")) - 1
            got[i].append((s - int(at[i]), n, q))
        assert got == [all_runs(t) for t in texts]


def test_wavelet_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    tree = P.Wavelet(values)
    left = rng.integers(0, 500, 800)
    right, x = np.minimum(500, left + rng.integers(0, 60, 800)), rng.integers(0, 520, 800)
    want = [min((v for v in values[a:b] if v >= y), default=-1) for a, b, y in zip(left, right, x, strict=True)]
    assert tree.successor(left, right, x).tolist() == want


def test_words_of_a_table():
    texts = ["a  b c\n", "", None, "\té漢 x", "one", " "]
    table = P.split_words(pa.array(texts))
    assert [b.decode() for b in table.texts()] == [" ".join(WORD.findall(t or "")) for t in texts]
    assert table.joined(np.array([2, 0])) == "é漢 a".encode() and table.joined(np.array([], int)) == b""


def test_documents(spark):
    docs = documents(spark)
    extra = [(910_000 + i, " ".join(map(str, sequence(random.Random(i))))) for i in range(120)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 900_005]
    got = [tuple(r) for r in P.run_digests(docs.where("doc_id is null or doc_id <> 900005")).collect()]
    order = lambda r: tuple((x is not None, x or 0) for x in r[:2]) + (r[-1],)
    assert sorted(got, key=order) == sorted((expected(*r) for r in rows), key=order)
    assert sum(r[1] for r in got) > 50
    assert P.run_digests(empty(spark)).count() == 0


def test_texts_runs_and_long_texts(spark):
    long_text = " ".join([*map(str, range(40_000)), *"a b c".split() * 20_000, "end"])
    docs = spark.createDataFrame([(1, long_text, 5), (2, "x " * 30, 6), (3, None, 7)], "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(40_000, 60_000, 3)] and got[1].collapsed.endswith(" 39999 a b c end")
    assert got[2].collapsed == "x" and (got[2].n_words, got[2].exponent_milli) == (30, 30_000)
    assert got[3].runs == [] and got[3].collapsed == "" and got[3].n_words == 0
