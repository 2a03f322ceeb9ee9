"""Benchmark passages in documents, paraphrases included, by latent semantic retrieval.

1. Document frequencies of the benchmark's words, and how often two of them share a
   passage, are counted over all documents in one pass.  Every word keeps a weight:
   a leak that most documents hold makes its words common.
2. A randomised singular value decomposition of the TF-IDF matrix (every passage of
   every document and of the benchmark) gives the latent space, as a series of
   distributed products of a thin random matrix with the matrix's square, which
   the counted pairs of words are: its size is bounded by the vocabulary.
3. Every passage of every document is projected, and its products with all
   benchmark passages are one matrix product per block of text.
4. Passages that hold ``LEAST_HELD`` of an item's weight, whatever stands beside it,
   are confirmed on words: the longest common subsequence must hold ``LEAST_COMMON`` of the item, and enough of its answer if one is given.

The benchmark is the stated query set; it is taken in blocks of ``BLOCK_ITEMS``,
so what a worker holds does not grow with it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, stored
from truecolumn.llm.words import slices, words_of

#: Items searched in one pass over the documents: not more than the space has dimensions, so that it holds them all.
BLOCK_ITEMS = 256
#: Words of a step and steps of a passage.
STEP, STEPS = 16, 3
#: Latent dimensions, and the extra ones that make the random range safe.
RANK, EXTRA = 256, 16
#: All documents together count in the decomposition as much as about so many.
CORPUS_DOCUMENTS = 5_000
#: Weight of benchmark passages in the decomposition: far above what the documents'
#: passages add up to, so that each item's direction is kept.
ITEM_WEIGHT = 300.0
#: Vocabulary up to which a task adds up its pairs in one square table.
DENSE_WORDS = 2_048
#: Pairs that a task holds otherwise before it passes them on.
HELD_PAIRS = 2_000_000
#: Cells of the matrix's rows that are multiplied at once.
BLOCK_CELLS = 2_000_000
#: Share of an item's squared weight in a passage near it.  No bound on the cosine: words of
#: a widespread leak weigh little, and rare words beside them would hide it.
LEAST_HELD = 0.3
LEAST_COMMON = 0.6
LEAST_ANSWER = 0.5


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray

    # Kept with the item, since keys may be null or repeated.
    @cached_property
    def word_list(self) -> list[int]:
        return self.words.tolist()

    @cached_property
    def word_places(self) -> dict[int, int]:
        return places(self.words)

    @cached_property
    def answer_places(self) -> dict[int, int]:
        return places(self.answer)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words = words_of(pa.array(texts, pa.string()), plain=True)
    return [words.hashes[a:b] for a, b in zip(words.at[:-1], words.at[1:], strict=True)]


def read_items(rows: list) -> list[Item]:
    """Items with words from rows ``(item_id, text, answer)``; an answer without words asks for nothing."""
    texts, answers = _hashes([r[1] or "" for r in rows]), _hashes([r[2] or "" for r in rows])
    return [
        Item(r[0], words, answer)
        for r, words, answer in zip(rows, texts, answers, strict=True)
        if len(words)
    ]


def common_words(one: list[int], masks: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence; ``masks`` has a bit for each place of a word in the other text."""
    full = (1 << length) - 1
    left = full
    for word in one:
        if (mask := masks.get(word)) is not None:
            both = left & mask
            left = ((left + both) | (left - both)) & full
    return length - left.bit_count()


def places(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        out[word] = out.get(word, 0) | (1 << i)
    return out


class Vocabulary:
    """Words of the items, by hash."""

    def __init__(self, items: list[Item]):
        self.words = np.unique(np.concatenate([i.words for i in items])) if items else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known words and their numbers."""
        spot = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = np.flatnonzero(self.words[spot] == hashes)
        return known, spot[known]


def word_pairs(passage: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word * size + other, product of their counts)`` with ``word <= other`` for words of one passage.

    ``passage`` does not fall.  A pair comes once for each passage that holds it.
    """
    keys, times = np.unique(passage * size + ids, return_counts=True)
    passage, ids = keys // size, keys % size
    # Each word with itself and the words behind it in its passage.
    partners = np.searchsorted(passage, passage, side="right") - np.arange(len(keys))
    left = np.repeat(np.arange(len(keys)), partners)
    right = left + np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)
    return ids[left] * size + ids[right], times[left] * times[right]


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes = codes[order]
    begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[begins], np.add.reduceat(values[order], begins)


def _counts(known: Vocabulary):
    """``(word, other, n)`` of a task's documents: ``n`` documents hold the word if ``other`` is -1, else see :func:`word_pairs`."""
    size = len(known)

    def rows(codes, n):
        return pa.RecordBatch.from_arrays([pa.array(codes // size), pa.array(codes % size), pa.array(n)], names=["word", "other", "n"])

    def run(batches):
        documents = np.zeros(size, dtype=np.int64)
        table = np.zeros(size * size if size <= DENSE_WORDS else 0, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch["text"], plain=True)
                at, ids = known.find(words.hashes)
                if not len(at):
                    continue
                text = np.searchsorted(words.at, at, side="right") - 1
                documents += np.bincount(np.unique(text * size + ids) % size, minlength=size)
                # Passages that do not overlap, from the beginning of each text.
                lengths = -(-np.diff(words.at) // (STEP * STEPS))
                first = np.concatenate(([0], np.cumsum(lengths)))
                codes, n = word_pairs(first[text] + (at - words.at[text]) // (STEP * STEPS), ids, size)
                if len(table):
                    np.add.at(table, codes, n)
                    continue
                held.append(_summed(codes, n))
                if sum(len(c) for c, _ in held) > HELD_PAIRS:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*_summed(*map(np.concatenate, zip(*held, strict=True))))
        codes = np.flatnonzero(table)
        yield rows(codes, table[codes])
        found = np.flatnonzero(documents)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(np.full(len(found), -1)), pa.array(documents[found])], names=["word", "other", "n"]
        )

    return run


def counted(texts: DataFrame, known: Vocabulary) -> DataFrame:
    """Sums over all texts of what :func:`_counts` gives, stored."""
    found = texts.mapInArrow(_counts(known), "word long, other long, n long")
    return stored(found.groupBy("word", "other").agg(F.sum("n").alias("n")), "word-pairs")


def weights(counts: DataFrame, total: int, size: int) -> np.ndarray:
    """Inverse document frequencies over all documents, smoothed: at least 1."""
    documents = np.zeros(size)
    for row in counts.where("other = -1").collect():
        documents[row.word] = row.n
    return np.log((1 + total) / (1 + documents)) + 1


class Passages:
    """Passages of texts: ``STEPS`` steps of ``STEP`` words, a new one each step."""

    def __init__(self, at: np.ndarray, positions: np.ndarray):
        lengths = np.diff(at)
        steps = -(-lengths // STEP)
        self.at = at
        # Empty steps between texts, so that no passage crosses a border.
        self.first = np.concatenate(([0], np.cumsum(steps + STEPS - 1)))
        self.total = int(self.first[-1])
        text = np.searchsorted(at, positions, side="right") - 1
        self.step = self.first[text] + (positions - at[text]) // STEP

        # Positions by step: how many there are, and their beginnings, fullest steps first.
        begins = np.flatnonzero(np.concatenate(([True], self.step[1:] != self.step[:-1]))) if len(positions) else np.zeros(0, np.int64)
        counts = np.diff(np.append(begins, len(positions)))
        order = np.argsort(-counts, kind="stable")
        self.begins, self.counts = begins[order], counts[order]

    def sums(self, values: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Sums over every passage of the values of its positions: a row for each position, or the row that ``rows`` names."""
        out = np.zeros((self.total + STEPS - 1, *values.shape[1:]), dtype=values.dtype)
        if len(self.begins):
            spot = (lambda at: at) if rows is None else rows.__getitem__
            held = values[spot(self.begins)]
            # The second positions of all steps that have one, then the third ones, and so on.
            for i in range(1, int(self.counts[0])):
                more = int(np.searchsorted(-self.counts, -i, side="left"))
                held[:more] += values[spot(self.begins[:more] + i)]
            out[self.step[self.begins]] = held
        return sum(out[i : self.total + i] for i in range(STEPS))

    def span(self, passage: int) -> tuple[int, int, int]:
        """Text of a passage, and its first and last word there."""
        text = int(np.searchsorted(self.first, passage, side="right")) - 1
        begin = (passage - int(self.first[text])) * STEP
        return text, begin, begin + STEP * STEPS


def item_passages(items: list[Item], known: Vocabulary) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The item number of each benchmark passage and its words and counts."""
    owner, rows = [], []
    size = STEP * STEPS
    for i, item in enumerate(items):
        for begin in range(0, max(1, len(item.words) - size // 2), size):
            _, ids = known.find(item.words[begin : begin + size])
            owner.append(i)
            rows.append(np.unique(ids, return_counts=True))
    return np.array(owner), rows


def block_rows(size: int) -> int:
    """Rows of the square matrix of so many words that are multiplied at once."""
    return max(1, BLOCK_CELLS // max(1, size))


def _product(idf: np.ndarray, thin: np.ndarray):
    """Rows of A'A thin, from the cells ``(word, other, n)`` that A'A weighs; a row may come in parts."""
    size = len(idf)
    rows = block_rows(size)

    def multiplied(cells):
        word, other, n = (np.concatenate(x) for x in zip(*cells, strict=True))
        order = np.argsort(word)
        word, other = word[order], other[order]
        values = n[order] * idf[word] * idf[other]
        for block in np.unique(word // rows).tolist():
            begin = block * rows
            low, high = np.searchsorted(word, [begin, begin + rows])
            spot = (word[low:high] - begin) * size + other[low:high]
            dense = np.bincount(spot, weights=values[low:high], minlength=rows * size).reshape(rows, size)
            found = np.unique(word[low:high])
            out = dense[found - begin] @ thin
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([r.tobytes() for r in out], pa.binary())], names=["row", "sums"]
            )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(tuple(np.asarray(batch[c]) for c in ("word", "other", "n")))
            n += batch.num_rows
            if n >= HELD_PAIRS:
                yield from multiplied(held)
                held, n = [], 0
        if n:
            yield from multiplied(held)

    return run


def _multiplied(cells: DataFrame, idf: np.ndarray, thin: np.ndarray) -> np.ndarray:
    out = np.zeros((len(idf), thin.shape[1]))
    # Stored first: a local iterator alone would run the tasks one after the other.
    for row in stored(cells.mapInArrow(_product(idf, thin), "row long, sums binary"), "product").toLocalIterator():
        out[row.row] += np.frombuffer(row.sums)
    return out


def square(pairs: DataFrame, size: int) -> DataFrame:
    """Both cells of every pair of ``pairs(word, other, n)``, the rows of a block side by side, stored."""
    both = pairs.union(pairs.where("word <> other").select(F.col("other").alias("word"), F.col("word").alias("other"), "n"))
    blocks = -(-size // block_rows(size))
    return stored(both.repartition(max(6, blocks), F.expr(f"word div {block_rows(size)}")).sortWithinPartitions("word"), "weighted-pairs")


def latent_space(pairs: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 1) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix A, a column each, from ``(word, other, n)`` of A'A.

    The driver holds thin matrices of the benchmark's vocabulary only.
    """
    wide = min(rank + EXTRA, len(idf))
    thin = np.random.default_rng(11).standard_normal((len(idf), wide))
    cells = square(pairs, len(idf))
    for _ in range(rounds + 1):
        thin, _ = np.linalg.qr(_multiplied(cells, idf, thin))
    values, turned = np.linalg.eigh(thin.T @ _multiplied(cells, idf, thin))
    order = np.argsort(-values)[:rank]
    return thin @ turned[:, order[values[order] > 1e-9]]


@dataclass
class Index:
    """What a worker needs to search one block of items."""

    items: list[Item]
    known: Vocabulary
    owner: np.ndarray
    share: np.ndarray  # of each word, its latent vector times each unit vector of the benchmark's passages
    square: np.ndarray  # squared weight of each word
    lengths: np.ndarray  # of the benchmark's passages in the latent space
    least: int  # words of items that a passage needs

    def search(self, words) -> list[tuple[int, int, float, float, float | None]]:
        """``(text, item number, cosine, share of the item, share of its answer)`` of confirmed items."""
        at, ids = self.known.find(words.hashes)
        passages = Passages(words.at, at)
        if not passages.total or not len(at):
            return []
        enough = np.flatnonzero(passages.sums(np.ones(len(at), dtype=np.int32)) >= self.least)
        if not len(enough):
            return []
        # Projecting is linear, so a passage's products with the items are sums over
        # its words.  They are taken by the length of the item: what a passage holds
        # besides does not count against it.  The cosine is by the whole passage.
        norms = np.sqrt(passages.sums(self.square, ids)[enough])
        products = passages.sums(self.share, ids)[enough]
        near_passage, near_query = np.nonzero(products >= LEAST_HELD * self.lengths)
        best: dict[tuple[int, int], tuple[float, float, float | None]] = {}
        lists: dict[tuple[int, int], tuple[list[int], frozenset[int]]] = {}
        for p, q in zip(near_passage.tolist(), near_query.tolist(), strict=True):
            item = self.items[number := int(self.owner[q])]
            text, begin, end = passages.span(int(enough[p]))
            reach = max(STEP, len(item.words))
            low, high = int(words.at[text]), int(words.at[text + 1])
            region = (max(low, low + begin - reach), min(high, low + end + reach))
            if region not in lists:
                lists[region] = (part := words.hashes[region[0] : region[1]].tolist(), frozenset(part))
            stretch, held = lists[region]
            # No common subsequence is longer than the item's words that are there at all.
            if sum(map(held.__contains__, item.word_list)) < LEAST_COMMON * len(item.words):
                continue
            share = self._tightest(stretch, item)
            if share is None:
                continue
            found = (float(products[p, q] / norms[p]), *share)
            if (old := best.get((text, number))) is None or found[1] > old[1]:
                best[(text, number)] = found
        return [(t, n, *x) for (t, n), x in best.items()]

    def _tightest(self, region: list[int], item: Item) -> tuple[float, float | None] | None:
        """Shares of the item and its answer (null without one) in a stretch of its own length and half as much again."""
        masks, length = item.word_places, len(item.words)
        if common_words(region, masks, length) < LEAST_COMMON * length:
            return None
        answer, answer_length = item.answer_places, len(item.answer)
        size = max(length + length // 2, 4)
        step = max(1, length // 4)
        top = None
        for begin in range(0, max(1, len(region) - size + step), step):
            part = region[begin : begin + size]
            share = common_words(part, masks, length) / length
            if share >= LEAST_COMMON and (top is None or share > top[0]):
                told = common_words(part, answer, answer_length) / answer_length if answer_length else None
                if told is None or told >= LEAST_ANSWER:
                    top = (share, told)
        return top


def build_index(texts: DataFrame, items: list[Item]) -> Index:
    known = Vocabulary(items)
    owner, rows = item_passages(items, known)
    total = texts.count()
    counts = counted(texts, known)
    idf = weights(counts, total, len(known))
    scale = 1.0 / max(1, total // CORPUS_DOCUMENTS)
    passage = np.repeat(np.arange(len(rows)), [int(n.sum()) for _, n in rows])
    codes, n = _summed(*word_pairs(passage, np.concatenate([np.repeat(ids, n) for ids, n in rows]), len(known)))
    own = texts.sparkSession.createDataFrame(
        list(zip((codes // len(known)).tolist(), (codes % len(known)).tolist(), (n * ITEM_WEIGHT**2).tolist(), strict=True)),
        "word long, other long, n double",
    )
    pairs = counts.where("other >= 0").select("word", "other", (F.col("n") * F.lit(scale)).alias("n")).union(own)
    basis = latent_space(pairs, idf)
    image = (idf[:, None] * basis).astype(np.float32)
    queries = np.stack([counts @ image[ids] for ids, counts in rows]).astype(np.float32)
    lengths = np.linalg.norm(queries, axis=1)
    queries /= np.maximum(lengths, 1e-9)[:, None]
    fewest = min(int(counts.sum()) for _, counts in rows)
    return Index(items, known, owner, image @ queries.T, (idf**2).astype(np.float32), lengths, max(1, min(3, fewest // 2)))


def _blocks(benchmark: DataFrame, key: str, text: str, answer: str | None):
    """Items in blocks of ``BLOCK_ITEMS``; the driver holds one block."""
    told = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
    rows = benchmark.select(F.col(key).cast("long"), F.col(text).cast("string"), told)
    block = []
    for row in rows.distinct().toLocalIterator():
        block.append(tuple(row))
        if len(block) == BLOCK_ITEMS:
            yield read_items(block)
            block = []
    if block:
        yield read_items(block)


def _indexes(docs: DataFrame, benchmark: DataFrame, text: str, answer: str | None):
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    for items in _blocks(benchmark, "item_id", "text", answer):
        if items:
            yield docs.sparkSession.sparkContext.broadcast(build_index(texts, items))


def contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """``(doc_id, item_id, cosine, common, answer)`` of every document that holds a benchmark item.

    ``common`` is the share of the item's words in the longest common
    subsequence, ``answer`` that of its answer, null where none is given.  Null or empty texts and items
    hold nothing and are in nothing; items and documents without a key are
    searched and named null; items of one key and different texts are items of
    their own, so a document that holds two of them has two rows; repeated rows
    of documents are found as often as they occur.  An empty benchmark gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, cosine double, common double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _indexes(docs, benchmark, "text", answer):

        def run(batches, shared=shared):
            for whole in batches:
                for batch in slices(whole, "text"):
                    found = shared.value.search(words_of(batch["text"], plain=True))
                    keys = batch["doc_id"].to_pylist()
                    columns = [
                        pa.array([keys[f[0]] for f in found], pa.int64()),
                        pa.array([shared.value.items[f[1]].item_id for f in found], pa.int64()),
                        *[pa.array([f[i] for f in found], pa.float64()) for i in (2, 3, 4)],
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "cosine", "common", "answer"])

        out = out.union(plain.mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged; needs no shuffle."""
    for shared in _indexes(docs, benchmark, "text", answer):

        def run(batches, shared=shared):
            for whole in batches:
                for batch in slices(whole, "text"):
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[[f[0] for f in shared.value.search(words_of(batch["text"], plain=True))]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
