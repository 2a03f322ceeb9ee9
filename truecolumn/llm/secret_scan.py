"""Secrets in whole texts, and who else has them.

Base spans come from three fixed patterns.  Further candidates (well-known token
prefixes, more key names, passwords in addresses, long random-looking strings)
are kept only if the corpus says that they belong to somebody: the hash of each
candidate value is counted over distinct repositories and owners.  What many
owners hold, or several in many repositories, is a copied example; what few hold
looks live, and so does what one owner holds, in however many repositories.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, stored

#: Kinds in the order that settles equal starts.
KINDS = ("assign", "access", "hex", "owned")
#: A value of more owners is an example; so is one of several owners in more repositories.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
#: Bits per character below which a value is no random key.
LEAST_ENTROPY = 3.2

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_NAMED = re.compile(
    r"""(?:pwd|credentials?|private_?key|access_?key|client_?id|auth|bearer)["']?\x20*[:=\x20]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""",
    re.IGNORECASE | re.ASCII,
)
_NAMED_HINTS = ("pwd", "credential", "key", "client", "auth", "bearer")
_PREFIXED = re.compile(r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ)[A-Za-z0-9_.-]{16,}")
#: Names and passwords of any length; the scheme need not be scanned again, its last character tells it.
_IN_ADDRESS = re.compile(r"(?<=[a-z0-9+.-])://[^\s/:@]+:([^\s/:@]{6,})@")
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{24,}")


def entropy(value: str) -> float:
    """Bits per character."""
    total = len(value)
    return -sum(n / total * math.log2(n / total) for n in Counter(value).values())


def looks_random(value: str) -> bool:
    """Digits and letters of both cases, well mixed."""
    return (
        any(c.isdigit() for c in value)
        and any("a" <= c <= "z" for c in value)
        and any("A" <= c <= "Z" for c in value)
        and entropy(value) >= LEAST_ENTROPY
    )


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns, in order; an assignment's span is its value."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        spans += [(m.start(2), 0, m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Further spans ``(start, end)`` that touch neither a base span nor each other."""
    low = text.lower()
    found = [m.span() for m in _PREFIXED.finditer(text)]
    if any(hint in low for hint in _NAMED_HINTS):
        found += [m.span(1) for m in _NAMED.finditer(text) if entropy(m[1]) >= LEAST_ENTROPY and any(c.isdigit() for c in m[1])]
    if "://" in text:
        found += [m.span(1) for m in _IN_ADDRESS.finditer(text)]
    found += [m.span() for m in _RANDOM.finditer(text) if looks_random(m[0])]
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    out = []
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        before = bisect_left(starts, end)
        if (not out or start >= out[-1][1]) and not (before and reach[before - 1] > start):
            out.append((start, end))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("h", pa.string())])


def _scanned(batches):
    for batch in batches:
        base, more = [], []
        for text in batch["text"].to_pylist():
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            more.append(
                [
                    {"start": a, "end": b, "h": hashlib.md5(text[a:b].encode(), usedforsecurity=False).hexdigest()}
                    for a, b in candidates(text, spans)
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [*[batch[c] for c in ("key", "owner", "repository")], pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_CANDIDATE))],
            names=["key", "owner", "repository", "base", "more"],
        )


def _joined(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({kinds})[x.kind], ':', x.start, ':', x.end)), ',')"


def _exploded(found: DataFrame, *keys: str) -> DataFrame:
    """A row for each candidate; a null owner or repository is one of its own."""
    out = found.where("size(more) > 0").select(*keys, "owner", "repository", F.explode("more").alias("c"))
    named = [F.coalesce(c, F.lit("\x00")).alias(c) for c in ("owner", "repository")]
    return out.select(*keys, *named, "c.*")


def live_values(exploded: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """Hashes ``h`` that one owner, or few in few repositories hold; counts are exact and combined before each shuffle."""
    by_repository = exploded.groupBy("h", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("h", "owner").agg(F.count("*").alias("repositories"))
    holders = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    few = (F.col("owners") <= max_owners) & ((F.col("owners") == 1) | (F.col("repositories") <= max_repositories))
    return holders.where(few).select("h")


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """``(key, n_assign, n_access, n_hex, base_spans, spans, added)`` for every row.

    ``spans`` holds ``struct(start, kind, end)`` of the base and of the added
    ones in order, ``added`` how many were added.  Positions count code points,
    ends are exclusive.  A null text is empty; a null owner or repository counts
    as one more owner or repository; repeated rows are one repository and get
    equal results.  The key may be null or repeated.
    """
    arrow_batches(docs.sparkSession)
    columns = {"key": F.col(key), "owner": F.col(owner).cast("string"), "repository": F.col(repository).cast("string")}
    plain = docs.select(
        *[c.alias(n) for n, c in columns.items()], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    schema = plain.select("key").schema.add("owner", "string").add("repository", "string")
    span = "array<struct<start: int, kind: int, end: int>>"
    found = plain.mapInArrow(
        _scanned, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + f", base {span}, more array<struct<start: int, end: int, h: string>>"
    )
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")

    exploded = _exploded(found, "row")
    live = live_values(exploded, max_owners, max_repositories)
    owned = F.struct(F.col("start"), F.lit(KINDS.index("owned")).alias("kind"), F.col("end"))
    added = exploded.join(live, "h").groupBy("row").agg(F.collect_list(owned).alias("more_spans"))

    none = F.expr(f"cast(array() as {span})")
    out = found.drop("more").join(added, "row", "left").withColumn("more_spans", F.coalesce("more_spans", none))
    counts = {f"n_{k}": F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)") for i, k in enumerate(KINDS[:3])}
    return out.select(
        F.col("key").alias(key),
        *[c.alias(n) for n, c in counts.items()],
        F.col("base").alias("base_spans"),
        F.array_sort(F.concat("base", "more_spans")).alias("spans"),
        F.size("more_spans").alias("added"),
    )


def secret_digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``; see :func:`scan`."""
    return scan(docs).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.expr(_joined("base_spans")), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )


def redact(spans: str, text: str, mark: str) -> Column:
    """``text`` with its spans (in order, as of :func:`scan`) replaced by ``mark``; overlapping spans share one mark."""
    merged = f"""aggregate({spans}, cast(array() as array<struct<start: int, end: int>>), (done, x) ->
        if(size(done) > 0 and x.start < done[greatest(size(done) - 1, 0)].end,
           concat(slice(done, 1, greatest(size(done) - 1, 0)), array(named_struct(
               'start', done[greatest(size(done) - 1, 0)].start,
               'end', greatest(done[greatest(size(done) - 1, 0)].end, x.end)))),
           concat(done, array(named_struct('start', x.start, 'end', x.end)))))"""
    pieces = f"""transform(sequence(0, size(m)), i -> substring({text},
        if(i = 0, 1, m[greatest(i - 1, 0)].end + 1),
        if(i = size(m), length({text}), m[least(i, size(m) - 1)].start) - if(i = 0, 0, m[greatest(i - 1, 0)].end)))"""
    return F.expr(
        f"if({text} is null or size({spans}) = 0, {text}, "
        f"array_join(transform(array({merged}), m -> array_join({pieces}, '{mark}')), ''))"
    )


def redact_documents(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    n_chars: str = "n_chars",
    mark: str = "[SECRET]",
) -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mark`` and ``n_chars`` brought up to date.

    No row goes; columns and null texts stay as they are.  Texts without further
    candidates are redacted where they are read; only the few others meet the
    table of live values, by a hash of the text.
    """
    arrow_batches(docs.sparkSession)
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = F.struct(*[F.col(c) for c in docs.columns])
    prepared = docs.select(row.alias("row"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), plain.alias("text"))
    span = "array<struct<start: int, kind: int, end: int>>"
    kinds = f"base {span}, more array<struct<start: int, end: int, h: string>>"

    hashes = [F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(7), "text").alias("x2")]
    keyed = prepared.select(F.struct(*hashes).alias("key"), "owner", "repository", "text")
    found = keyed.mapInArrow(_scanned, f"key struct<x1: long, x2: long>, owner string, repository string, {kinds}")
    exploded = _exploded(stored(found.where("size(more) > 0").drop("base"), "secret-candidates"), "key")
    live = live_values(exploded, MAX_OWNERS, MAX_REPOSITORIES)
    owned = F.struct(F.col("start"), F.lit(KINDS.index("owned")).alias("kind"), F.col("end"))
    added = exploded.join(live, "h").groupBy("key").agg(F.collect_set(owned).alias("more_spans"))
    added = stored(added.select("key.x1", "key.x2", "more_spans"), "secret-added")

    row_type = docs.select(row.alias("row")).schema[0].dataType.simpleString()
    scanned = prepared.select(F.col("row").alias("key"), "owner", "repository", "text").mapInArrow(
        _scanned, f"key {row_type}, owner string, repository string, {kinds}"
    )
    own = F.col("key").getField(text)
    scanned = scanned.select("key", "base", F.size("more").alias("n"))
    simple = scanned.where("n = 0").select("key", F.col("base").alias("spans"))
    whole = F.coalesce(own.cast("string"), F.lit(""))
    others = scanned.where("n > 0").withColumns({"x1": F.xxhash64(whole), "x2": F.xxhash64(F.lit(7), whole)}).join(added, ["x1", "x2"], "left")
    more = F.coalesce("more_spans", F.expr(f"cast(array() as {span})"))
    every = simple.union(others.select("key", F.array_sort(F.concat("base", more)).alias("spans")))
    every = every.withColumn("changed", redact("spans", f"key.`{text}`", mark))
    columns = {c: F.col("key").getField(c) for c in docs.columns}
    if n_chars in columns:
        length = F.when(F.size("spans") > 0, F.length("changed")).otherwise(columns[n_chars])
        columns[n_chars] = length.cast(docs.schema[n_chars].dataType)
    columns[text] = F.col("changed")
    return every.select(*[c.alias(name) for name, c in columns.items()])
