"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes the numbers ``FEATURES``, each cut into bins.  The model is an
intercept, one table of values per feature and one square table per chosen pair
of features; a text's log-odds are the sum of its bins' values.  Tables grow by
cyclic boosting: feature after feature, a tree of a few leaves over that
feature's bins is fitted to what the model still misses and added to its table
at a small rate.  Then pairs are ranked by what one cut through each feature
would gain, and the best ones grow tables in the same way.

Features are one narrow pass over all rows, written once.  Labels meet these
few numbers, never the texts.  The fit uses a sample of labelled rows of about
``SAMPLE_ROWS``; scoring is a narrow pass of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, key_remainder, stored
from truecolumn.llm.words import mix, slices, windows, words_of

FEATURES = [
    "words", "word_bytes", "long_words", "short_words", "symbols", "bars", "exclaims", "stops", "commas", "digits", "capitals",
    "symbol_ends", "stop_ends", "twins", "distinct", "repeated_windows", "dup_lines", "line_words", "space",
]
#: Labelled rows that the fit uses, about; more than that are thinned by a hash of their numbers.
SAMPLE_ROWS = 100_000
#: Bins per feature, and per axis of a pair.
BINS, PAIR_BINS = 64, 16
#: Rounds at most, rate of learning, leaves of a tree, least rows of a leaf, pairs.
ROUNDS, RATE, LEAVES, LEAF_ROWS, PAIRS = 300, 0.1, 3, 5, 8
#: A round that lowers the loss of the rows set aside by less than this ends the fit, if it is the tenth of its kind.
PATIENCE, LEAST_GAIN = 10, 1e-5
#: Rows that can be set aside, and that must be left to learn from, at least.
ASIDE_ROWS = 40
THRESHOLD = 0.7

#: Signs that prose hardly uses: fixed values.
SYMBOLS = b"#*$%&|<>"
_STOPS, _COMMAS, _SPACES = b".!?", b",;:", b" \t\n\x0b\x0c\r"


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_IN = {
    "symbols": _class(SYMBOLS), "bars": _class(b"|"), "exclaims": _class(b"!"), "stops": _class(_STOPS), "commas": _class(_COMMAS),
    "digits": _class(b"0123456789"), "upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))), "space": _class(_SPACES),
}


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each of the ranges ``at[i]:at[i + 1]``."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]).astype(np.float64)


def _repeats(keys: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text, how many of its keys stood in it before."""
    own = mix(keys + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    again = own[order[1:]] == own[order[:-1]]
    return np.bincount(text[order[1:][again]], minlength=texts).astype(np.float64)


def features(column: pa.Array) -> np.ndarray:
    """``FEATURES`` of every text, a row each; a null text counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    count = {name: _per_text(table[data], offsets) for name, table in _IN.items()}
    w = words_of(column)
    sizes = w.ends - w.starts
    total = np.diff(w.at).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(w.at))
    last = w.data[w.ends - 1] if len(sizes) else w.data[:0]
    twins = np.zeros(len(sizes), dtype=bool)
    twins[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    triples = windows(w.hashes, 3)
    inner = np.flatnonzero(text[: len(triples)] == text[2 : 2 + len(triples)])
    lines = pc.split_pattern(column, "\n")
    parents = np.asarray(pc.list_parent_indices(lines), dtype=np.int64)
    kinds = np.asarray(pc.list_flatten(lines).dictionary_encode().indices).astype(np.uint64)
    full = np.asarray(pc.binary_length(pc.list_flatten(lines))) > 0
    per_line = np.bincount(parents[full], minlength=n).astype(np.float64)
    some, letters, size = np.maximum(total, 1), np.maximum(count["upper"] + count["lower"], 1), np.maximum(np.diff(offsets), 1)
    columns = {
        "words": np.log1p(total),
        "word_bytes": _per_text(np.ones(len(data), bool), offsets) / some,
        "long_words": _per_text(sizes > 20, w.at) / some,
        "short_words": _per_text(sizes < 3, w.at) / some,
        "symbol_ends": _per_text(_IN["symbols"][last], w.at) / some,
        "stop_ends": _per_text(_IN["stops"][last], w.at) / some,
        "twins": _per_text(twins, w.at) / some,
        "distinct": 1 - _repeats(w.hashes, text, n) / some,
        "repeated_windows": _repeats(triples[inner], text[inner], n) / some,
        "dup_lines": _repeats(kinds[full], parents[full], n) / np.maximum(per_line, 1),
        "line_words": np.log1p(total / np.maximum(per_line, 1)),
        "capitals": count["upper"] / letters,
        "symbols": count["symbols"] / size,
        "bars": count["bars"] / some,
        "exclaims": count["exclaims"] / some,
        "stops": count["stops"] / some,
        "commas": count["commas"] / some,
        "digits": count["digits"] / size,
        "space": count["space"] / size,
    }
    return np.column_stack([columns[f] for f in FEATURES]).astype(np.float32)


@dataclass
class Additive:
    """Bin borders and tables; ``pairs`` maps two feature numbers to a square table over coarser bins."""

    intercept: float
    borders: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(b, x[:, f], side="right") for f, b in enumerate(self.borders)])

    def coarse_bins(self, bins: np.ndarray) -> np.ndarray:
        return np.column_stack([c[bins[:, f]] for f, c in enumerate(self.coarse)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """The sum of every row's table values."""
        bins = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        if self.pairs:
            coarse = self.coarse_bins(bins)
            for (f, g), table in self.pairs.items():
                total += table[coarse[:, f], coarse[:, g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _share(self.log_odds(x))


def _share(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of ``LEAVES`` leaves that fits sums of gradients and curvatures per bin."""
    leaves = [(0, len(g))]
    sums = [np.concatenate([[0], np.cumsum(a)]) for a in (g, h, n)]
    total = lambda a, b: [s[b] - s[a] for s in sums]
    while len(leaves) < LEAVES:
        best = (0.0, None, None)
        for leaf in leaves:
            a, b = leaf
            cuts = np.arange(a + 1, b)
            (gl, hl, nl), (gr, hr, nr), (gt, ht, _) = total(a, cuts), total(cuts, b), total(a, b)
            won = np.where((nl >= LEAF_ROWS) & (nr >= LEAF_ROWS), _gain(gl, hl) + _gain(gr, hr) - _gain(gt, ht), 0)
            if len(won) and won.max() > best[0] + 1e-9:
                best = (float(won.max()), leaf, int(cuts[won.argmax()]))
        if best[1] is None:
            break
        a, b = best[1]
        leaves.remove(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    values = np.zeros(len(g))
    for a, b in leaves:
        gs, hs, _ = total(a, b)
        values[a:b] = gs / (hs + 1.0)
    return values if len(leaves) > 1 else np.zeros(len(g))


def cross(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut through both axes of square sums: what it gains over no cut, and the values of its four parts."""
    corner = lambda a: np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    sums = [corner(a) for a in (g, h, n)]
    top, side = (s[-1:, 1:-1] for s in sums), (s[1:-1, -1:] for s in sums)
    parts = []
    for s, t, d in zip(sums, top, side, strict=True):
        a = s[1:-1, 1:-1]
        parts.append([a, d - a, t - a, s[-1, -1] - d - t + a])
    fits = np.all([p >= LEAF_ROWS for p in parts[2]], axis=0)
    gains = sum(_gain(p, q) for p, q in zip(parts[0], parts[1], strict=True)) - _gain(sums[0][-1, -1], sums[1][-1, -1])
    gains = np.where(fits, gains, 0)
    if not gains.size or gains.max() <= 1e-9:
        return 0.0, np.zeros(g.shape)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    v = [float(p[i, j] / (q[i, j] + 1.0)) for p, q in zip(parts[0], parts[1], strict=True)]
    values = np.empty(g.shape)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = v
    return float(gains[i, j]), values


def _boost(grow, loss, keep, rounds: int) -> None:
    """Rounds of ``grow`` until ``loss`` falls no more; ``keep`` is called after every better round."""
    best, idle = loss(), 0
    for _ in range(rounds):
        grow()
        now = loss()
        if now < best - LEAST_GAIN:
            best, idle = now, 0
            keep()
        else:
            idle += 1
            if idle >= PATIENCE:
                break


def fit(
    x: np.ndarray, y: np.ndarray, aside: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS, pairs: int = PAIRS
) -> Additive:
    """The model of rows ``x`` with targets ``y`` (0 to 1) that count ``weight`` times.

    Rows set ``aside`` only say when to stop; if they or the others are few
    (``ASIDE_ROWS``) or all alike, all rows are learned from.
    """
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    if any(np.count_nonzero(part) < ASIDE_ROWS or np.ptp(y[part]) == 0 for part in (aside, ~aside)):
        aside, grown = np.ones(len(y), bool), np.ones(len(y), bool)
    else:
        grown = ~aside
    mean = float(np.clip(np.average(y[grown], weights=weight[grown]), 1e-3, 1 - 1e-3))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    borders = [np.unique(np.quantile(x[grown, f], cuts, method="higher")) for f in range(x.shape[1])]
    model = Additive(float(np.log(mean / (1 - mean))), borders, [np.zeros(len(b) + 1) for b in borders])
    model.coarse = [np.arange(len(b) + 1) * min(PAIR_BINS, len(b) + 1) // (len(b) + 1) for b in borders]
    bins = model.bins(x)
    log_odds = np.full(len(y), model.intercept)
    sums = lambda at, size, value: np.bincount(at[grown], (value * weight)[grown], size)

    def loss() -> float:
        z = log_odds[aside]
        return float(np.average(np.logaddexp(0, z) - y[aside] * z, weights=weight[aside]))

    tables = [t.copy() for t in model.tables]

    def one_cycle():
        for f, table in enumerate(tables):
            share = _share(log_odds)
            at, size = bins[:, f], len(table)
            values = RATE * tree(sums(at, size, y - share), sums(at, size, share * (1 - share)), sums(at, size, 1.0))
            table += values
            log_odds[:] += values[at]

    def keep_tables():
        model.tables = [t.copy() for t in tables]

    _boost(one_cycle, loss, keep_tables, rounds)
    log_odds[:] = model.log_odds(x)

    coarse = model.coarse_bins(bins)
    sides = [int(c.max()) + 1 for c in model.coarse]

    def square(f: int, g: int):
        share = _share(log_odds)
        at, shape = coarse[:, f] * sides[g] + coarse[:, g], (sides[f], sides[g])
        size = shape[0] * shape[1]
        given = (y - share, share * (1 - share), 1.0)
        return cross(*(sums(at, size, v).reshape(shape) for v in given))

    ranked = sorted(((-square(f, g)[0], f, g) for f in range(len(sides)) for g in range(f) if min(sides[f], sides[g]) > 1))
    tables2 = {(f, g): np.zeros((sides[f], sides[g])) for won, f, g in ranked[:pairs] if won < 0}

    def pair_cycle():
        for (f, g), table in tables2.items():
            values = RATE * square(f, g)[1]
            table += values
            log_odds[:] += values[coarse[:, f], coarse[:, g]]

    def keep_pairs():
        model.pairs = {k: t.copy() for k, t in tables2.items()}

    if tables2:
        _boost(pair_cycle, loss, keep_pairs, rounds // 3)
    return model


def held_out(key):
    """Rows whose labels are never learned; false for a null key."""
    return F.coalesce(key_remainder(key, 4) == 2, F.lit(False))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, held_out, text)`` with ``x``, the features as little-endian floats, instead of the text."""
    arrow_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, x binary"

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = pa.array([r.tobytes() for r in features(part["text"])], pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], rows], names=["doc_id", "held_out", "x"])

    return docs.mapInArrow(run, schema)


def _numbers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f4").reshape(-1, len(FEATURES))


def learn(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Additive | float:
    """The model of all labelled rows that are not held out, or their share of good ones if that says it all."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    # Equal rows are one row with their number as weight, so copies do not fill the sample.
    rows = measured.join(known, "doc_id").groupBy("x", "y").agg(F.count("*").alias("n"))
    rows = rows.withColumns({"h": F.pmod(F.xxhash64("x"), F.lit(1 << 20)), "aside": F.pmod(F.xxhash64("x", F.lit(1)), F.lit(5)) == 0})
    rows = stored(rows, "quality-labelled")
    sizes = rows.agg(F.count("*").alias("n"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("share"), F.min("y").alias("least"), F.max("y").alias("most")).first()
    if not sizes.n or sizes.least == sizes.most:
        return float(sizes.share) if sizes.n else 0.5
    part = min(1.0, sample / sizes.n)
    got = rows.where(F.col("h") < int(part * (1 << 20))).select("x", "y", "aside", "n").toArrow().combine_chunks()
    x, y, aside, n = _numbers(got["x"].to_pylist()), *(np.asarray(got[c]) for c in ("y", "aside", "n"))
    # One order, so that the same rows give the same model.
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order], aside[order], n[order])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Labels are learned from rows whose key is known and not held out; several
    labels of one key count as their mean.  A null or empty text has features like any other (all zero, but for
    the share of distinct words); repeated rows are scored alike; further columns
    are not read.  Where all learnable labels agree every score is that label; without any it is 0.5.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("text"))
    measured = stored(with_features(plain), "quality-features")
    model = learn(measured, labels)
    if isinstance(model, float):
        score = F.lit(model)
        return measured.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            score = shared.value.score(_numbers(batch["x"].to_pylist())) if batch.num_rows else np.zeros(0)
            columns = [batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
