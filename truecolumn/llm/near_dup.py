"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and
   ``BANDS * ROWS`` MinHash samples of it.  Rows with equal sets are one node.
2. Nodes that share the samples of a band meet in a bucket.
3. The samples are folded into a parity bitmap, the odd sketch.  The ones in the
   XOR of two bitmaps estimate how many samples differ; candidates far below the
   wanted similarity go.
4. Candidates that are left are confirmed on their full sets.

Buckets are not expanded into all pairs.  Members outside the largest component
of their bucket are compared with one hub in it, in three rounds with different
hubs, and only those that are still outside are then compared with the rest of
the bucket.  Pairs that are skipped lie in one component already, so no component is
split.  For this last comparison odd sketches of the whole sets are made: the ones
in their XOR never exceed the shingles that differ, so that even many sets that
are just short of the wanted similarity are told apart without their full sets.
With 40 bands of 6 samples a pair at similarity 0.8 is missed with probability
5e-6, at 0.85 with 4e-9.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, settings, stored
from truecolumn.llm.components import components
from truecolumn.llm.words import mix, slices, windows, words_of

BANDS, ROWS = 40, 6
SKETCH_BITS = 512
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Bits of the sketch of a whole set, for members of crowded buckets.
SET_BITS = 2048
SET_SKETCH = [f"w{i}" for i in range(SET_BITS // 64)]
#: Standard deviations by which an estimate may fall short before a pair goes.
MARGIN = 4.5
#: Spark's Bloom filters for joins, whatever the sizes of the tables.
TEXT_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}
#: Hashes of a set handled at once, so that samples stay in the cache.
CHUNK = 512

_random = np.random.default_rng(20240501)
_FACTOR = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_OFFSET = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FOLD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle as a whole."""
    words = words_of(column, lower=True)
    hashes = windows(words.hashes, size)
    sets = []
    for begin, end in zip(words.at[:-1], words.at[1:], strict=True):
        if end - begin >= size:
            sets.append(np.unique(hashes[begin : end - size + 1]))
        elif end > begin:
            sets.append(windows(words.hashes[begin:end], int(end - begin)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def samples(members: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    low = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), CHUNK):
        part = _FACTOR[:, None] * low[None, i : i + CHUNK]
        part += _OFFSET[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    folded = (mix(least.astype(np.uint64) + _FOLD) * _FOLD).reshape(-1, BANDS, ROWS)
    return mix(folded.sum(axis=2, dtype=np.uint64))


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity of how many samples fall on each bit, as 64-bit words per row."""
    spot = mix(least.astype(np.uint64) ^ _FOLD) % np.uint64(SKETCH_BITS)
    rows = np.repeat(np.arange(len(least)), least.shape[1]) * SKETCH_BITS
    odd = np.bincount(rows + spot.astype(np.int64).ravel(), minlength=len(least) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view(np.uint64)


def set_marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit marks; equal sets have equal marks."""
    one = np.array([int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], dtype=np.uint64)
    two = np.array([int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)))) if len(s) else 0 for s in sets], dtype=np.uint64)
    return one, two


def ones_allowed(similarity: float, margin: float = MARGIN) -> int:
    """Most ones in the XOR of two sketches of sets at least this similar, but for a chance in ``margin``.

    The samples that differ vary binomially, and so do the bits they meet on.
    """
    total = BANDS * ROWS
    expected = lambda differ: SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)
    mean = expected(2 * total * (1 - similarity))
    samples_off = expected(2 * (total * (1 - similarity) + math.sqrt(total * similarity * (1 - similarity)))) - mean
    bits_off = math.sqrt(mean * (1 - mean / SKETCH_BITS)) / 2
    return math.ceil(mean + margin * math.hypot(samples_off, bits_off))


def differing(n: int | Column, m: int | Column, percent: int):
    """Shingles that may be in one of two linked sets only, at most."""
    return (n + m) * (100 - percent) / (100 + percent)


def _set_sketches(batches):
    """Odd sketches of whole sets: parity of how many members fall on each bit."""
    for batch in batches:
        lists = batch["members"]
        members = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
        spot = (mix(members ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SET_BITS)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * SET_BITS + spot, minlength=len(sizes) * SET_BITS) & 1
        words = np.packbits(odd.astype(np.uint8).reshape(-1, SET_BITS), axis=1).view(np.int64)
        columns = [batch["node"], *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(SET_SKETCH))]]
        yield pa.RecordBatch.from_arrays(columns, names=["node", *SET_SKETCH])


def _features(size: int, key: str, text: str):
    def run(batches):
        for whole_batch in batches:
            for batch in slices(whole_batch, text):
                sets = shingle_sets(batch[text], size)
                full = [s for s in sets if len(s)]
                least = np.stack([samples(s) for s in full]) if full else np.zeros((0, BANDS * ROWS), np.uint32)
                keys, sketch = band_keys(least).view(np.int64), odd_sketch(least).view(np.int64)
                where = np.full(len(sets), -1)
                where[[i for i, s in enumerate(sets) if len(s)]] = np.arange(len(full))
                gone = pa.array(where < 0)
                safe = np.maximum(where, 0)
                if not len(full):
                    keys, sketch = np.zeros((1, BANDS), np.int64), np.zeros((1, len(SKETCH)), np.int64)
                one, two = set_marks(sets)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys[safe].ravel())
                )
                columns = [
                    batch[key].cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pc.if_else(gone, pa.scalar(None, bands.type), bands),
                    *[pa.array(np.ascontiguousarray(sketch[safe, i])) for i in range(len(SKETCH))],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "m1", "m2", "bands", *SKETCH])

    return run


def _sets(size: int, text: str):
    """The full sets of ``(node, m1, m2, text)``, where the text's marks are those of the node."""

    def run(batches):
        for whole_batch in batches:
            for batch in slices(whole_batch, text):
                sets = shingle_sets(batch[text], size)
                own = [np.asarray(batch[c]).view(np.uint64) for c in ("m1", "m2")]
                same = np.logical_and(*[x == y for x, y in zip(set_marks(sets), own, strict=True)])
                sets = [s for s, wanted in zip(sets, same, strict=True) if wanted]
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                members = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"].filter(pa.array(same)), pa.ListArray.from_arrays(pa.array(at), pa.array(members))],
                    names=["node", "members"],
                )

    return run


class _Search:
    """Candidate pairs of stored buckets and their confirmation."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, buckets: DataFrame, percent: int):
        self.buckets, self.percent = buckets, percent
        self.marks, self.sets = nodes, sets
        self.names: DataFrame | None = None
        self.tested: DataFrame | None = None

    def marked(self, pairs: DataFrame, end: str) -> DataFrame:
        """Pairs with the size and the sketch of one end."""
        own = self.marks.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("n", *SKETCH)])
        return pairs.join(own, end)

    def near(self) -> Column:
        """What set sizes and sketches of ``a`` and ``b`` leave possible."""
        ones = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH])
        sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * self.percent
        return sizes & (ones <= ones_allowed(self.percent / 100))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Components after the pairs were tried on their full sets; they count as tested from now on."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.marked(self.marked(pairs, "a"), "b").where(self.near()).select("a", "b", "a_n", "b_n")
        one = self.sets.withColumnsRenamed({"node": "a", "members": "a_members"})
        two = self.sets.withColumnsRenamed({"node": "b", "members": "b_members"})
        shared = F.size(F.array_intersect("a_members", "b_members")).cast("long")
        linked = F.col("shared") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("shared")) * self.percent
        tried = pairs.join(one, "a").join(two, "b").withColumn("shared", shared)
        tried = stored(tried.select("a", "b", linked.alias("linked")), "tried")
        done = tried.select("a", "b")
        self.tested = done if self.tested is None else self.tested.union(done)
        self.names = components(tried.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), self.names)
        return self.names

    def placed(self, names: DataFrame | None) -> DataFrame:
        """Bucket rows with the component ``c`` of each node."""
        if names is None:
            return self.buckets.withColumn("c", F.col("node"))
        known = names.withColumnRenamed("component", "c")
        return self.buckets.join(known, "node", "left").withColumn("c", F.coalesce("c", "node"))

    @staticmethod
    def hubs(rows: DataFrame, rank: Column) -> DataFrame:
        """Bucket rows with their bucket's hub, the first node by ``rank`` of its largest component, and whether they are apart from it."""
        own = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("rank"), "node")).alias("first"))
        hub = own.groupBy("key").agg(F.max(F.struct("n", "c", F.col("first.node").alias("node"))).alias("hub"))
        return rows.join(hub, "key").withColumn("away", F.col("c") != F.col("hub.c"))

    def alike(self) -> Column:
        """What the sketches of the whole sets of ``a`` and ``b`` leave possible.

        The ones of two sketches are never more than the shingles that differ,
        so a link never has more than it may differ by.  Where differing
        shingles meet on bits the expected ones, with a margin, are fewer still.
        """
        ones = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SET_SKETCH])
        most = differing(F.col("a_n"), F.col("b_n"), self.percent)
        expected = SET_BITS / 2 * (1 - F.exp(-2 * most / SET_BITS))
        return ones <= F.least(most, expected + MARGIN * F.sqrt(expected) / 2 + 1)

    def run(self) -> DataFrame:
        """``(node, component)`` of every linked node."""
        # One hub for most of a group's buckets first, then another one for every bucket.
        names = None
        for rank in (F.col("node"), F.xxhash64("key", "node"), F.xxhash64("node", "key")):
            met = self.hubs(self.placed(names), rank).where("away")
            names = self.confirm(met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")))
        # What is left apart meets the whole bucket, each pair in its first common bucket only.
        rows = stored(self.hubs(self.placed(names), F.col("node")).drop("hub"), "placed")
        apart = rows.where("away").select("key", F.col("node").alias("a"), F.col("c").alias("ac"))
        if apart.isEmpty():
            return names
        rows = rows.join(apart.select("key").distinct(), "key", "left_semi")
        keys = self.marks.select("node", "bands", "n", *SKETCH)
        wide = self.sets.join(rows.select("node").distinct(), "node", "left_semi")
        wide = wide.mapInArrow(_set_sketches, "node long, " + ", ".join(f"{c} long" for c in SET_SKETCH))
        keys = stored(keys.join(wide, "node"), "crowded")
        names_of = lambda end: {c: f"{end}_{c}" for c in ("bands", "n", *SKETCH, *SET_SKETCH)} | {"node": end}
        left = apart.join(keys.withColumnsRenamed(names_of("a")), "a")
        right = rows.withColumnsRenamed({"node": "b", "c": "bc", "key": "other"}).join(keys.withColumnsRenamed(names_of("b")), "b")
        place = F.array_position("a_bands", F.col("key")).cast("int")
        earlier = F.arrays_overlap(F.slice("a_bands", F.lit(1), place - 1), F.slice("b_bands", F.lit(1), place - 1))
        # Two that are apart in this bucket meet once.
        once = ~F.col("away") | (F.col("a") < F.col("b"))
        found = (F.col("key") == F.col("other")) & (F.col("ac") != F.col("bc")) & once & self.near() & self.alike() & ~earlier
        return self.confirm(left.join(right, found).select("a", "b"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two rows are linked if ``100 * |A and B| >= percent * |A or B|`` for their
    sets of distinct ``size``-word shingles (A-Z in lower case).  A component is
    named by its smallest key; ``kept`` marks the row that bears this name.

    A null or empty text has no shingles and links with nothing.  A row with a
    null key is not compared: its component is null and it is kept.  Rows that
    share a key count as one document with all their links.  Other columns of
    ``docs`` are not read.  ``percent`` below 60 would need other bands.
    """
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "id long, n long, m1 long, m2 long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    marked = source.mapInArrow(_features(size, "id", "text"), schema)
    marked = stored(marked.withColumn("row", F.monotonically_increasing_id()), "shingle-marks")

    # One node for all rows with equal sets, named by the smallest row.
    linked = marked.where("id is not null and n > 0")
    classes = linked.groupBy("m1", "m2", "n").agg(F.min("row").alias("node"))
    members = linked.select("id", "m1", "m2", "n").distinct().join(classes, ["m1", "m2", "n"]).select("id", "node")
    members = stored(members.distinct(), "members")
    nodes = linked.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")

    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    buckets = stored(rows.join(shared, "key"), "buckets")
    nodes = stored(nodes.drop("id").join(buckets.select("node").distinct(), "node", "left_semi"), "nodes")

    # Full sets of the nodes that met another one.  Too many ids to broadcast go to the
    # scan of the texts as a Bloom filter, so that texts which nobody asks for are not
    # shuffled; Spark makes one only of rows under a comparison.
    ids = members.groupBy("node").agg(F.min("id").alias("id"))
    wanted = stored(ids.join(nodes.select("node", "m1", "m2", "n"), "node"), "wanted").where("n > 0")
    texts = source.join(wanted, "id").select("node", "m1", "m2", "text")
    sets = texts.mapInArrow(_sets(size, "text"), "node long, members array<long>")
    with settings(docs.sparkSession, TEXT_FILTER):
        sets = stored(sets.dropDuplicates(["node"]), "sets")

    names = _Search(nodes, sets, buckets, percent).run()
    # A document's rows may lie in several nodes, so documents and nodes are joined once more.
    groups = members.join(names, "node", "left").select("id", F.coalesce("component", "node").alias("group"))
    least = groups.groupBy("group").agg(F.min("id").alias("component_id"))
    named = groups.join(least, "group").select("id", "component_id")
    repeated = groups.groupBy("id").agg(F.countDistinct("group").alias("groups")).where("groups > 1")
    if repeated.isEmpty():
        final = named.distinct()
    else:
        whole = components(named.select(F.col("id").alias("u"), F.col("component_id").alias("v")))
        final = groups.select("id").distinct().join(whole.withColumnRenamed("node", "id"), "id", "left")
        final = final.select("id", F.coalesce("component", "id").alias("component_id"))
    out = marked.select("id", "n").join(final, "id", "left")
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.coalesce("component_id", "id"))).alias("kept"),
    )
