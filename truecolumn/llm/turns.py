"""Repair of conversation structure: cheapest edits of turns, by checkpointed dynamic programming.

A conversation is in order when the first letters of its roles read
``(s?(ua)+)?``.  Each turn may be kept (0), given the role ``user`` or
``assistant`` (2) or deleted (3, required for blank and repeated turns), and
empty turns may be put in anywhere (2); a turn that stays without an ending
costs 1 more.  Of the cheapest edits those whose letters D, I, K, R come first
in ASCII order are taken.

The costs of finishing from every state form a vector of four numbers, worked
out from the last turn back.  Vectors are stored at checkpoints only, every
square root of the turns; walking forward, each block between two checkpoints
is worked out once more.

On Spark the turns are dealt by range over conversation and turn, so that one
conversation may lie in many partitions.  A task finishes every conversation
that it holds as a whole.  What touches the border of a partition, or is longer
than a block, is handed on: repeated turns are found by one aggregation over
all blocks, each block becomes a matrix (least cost from each state before it
to each state behind it), and the matrices alone, folded from the end, give
the checkpoints between blocks.  At last the blocks pass in order and are
worked out again, each with the state that the one before ended in.  That pass
is one stream for each conversation, as its digest is one chain over all its
text; it holds a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from math import inf, isqrt

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, stored

KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 2, 3, 2, 1
#: States: before everything, after a system turn, after a user's, after an assistant's.
STATES = 4
#: Where an empty or reroled turn leads from each state, and the role it has.
FORCED = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: Where a kept turn leads, by its role's first letter and the state.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Costs of ending in each state: the missing turns are put in.
END = (0, 2 * INSERT, INSERT, 0)
#: Turns and bytes of text of a block at most (one turn may be longer).
BLOCK_TURNS, BLOCK_BYTES = 16384, 16 << 20

_BLANK, _END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def before(vector: tuple, initial: str, fault: str) -> tuple:
    """Costs before a turn from the costs behind it."""
    w = [DELETE + v for v in vector]
    if fault not in ("blank", "duplicate"):
        more, kept = OPEN_END * (fault == "truncated"), KEPT.get(initial)
        for s in range(STATES):
            cost = REROLE + more + vector[FORCED[s]]
            if kept and kept[s] is not None:
                cost = min(cost, KEEP + more + vector[kept[s]])
            w[s] = min(w[s], cost)
    return tuple(min(w[s], INSERT + w[(t := FORCED[s])], 2 * INSERT + w[FORCED[t]]) for s in range(STATES))


class Repair:
    """One conversation, fed in blocks of ``(turn, role, text, fault)`` by turn."""

    def __init__(self):
        self.state, self.cost, self.audit = 0, 0, []
        self.digest, self.written = hashlib.sha256(), 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.initial = 0, None
        self.first, self.last, self.distinct = None, None, 0

    def _put(self, edit: str, role: str, text: str) -> tuple:
        self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written += 1
        return self.written - 1, edit, role, text

    def _count(self, turn, role: str, fault: str) -> None:
        self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1

    def feed(self, turns: list[tuple], after: tuple) -> Iterable[tuple]:
        """Repaired turns ``(place, edit, role, text)`` of a block; ``after`` are the costs behind it."""
        for turn, role, _, fault in turns:
            self._count(turn, role, fault)
        n, step = len(turns), isqrt(len(turns)) + 1
        marks, v = {}, after
        for i in range(n - 1, -1, -1):
            if (i + 1) % step == 0 or i == n - 1:
                marks[i // step] = v
            v = before(v, turns[i][1][:1], turns[i][3])
        for begin in range(0, n, step):
            part = turns[begin : begin + step]
            costs = [marks[begin // step]]
            for _, role, _, fault in reversed(part):
                costs.append(before(costs[-1], role[:1], fault))
            costs.reverse()
            for k, (_, role, text, fault) in enumerate(part):
                yield from self._edit(role, text, fault, costs[k], costs[k + 1])

    def _edit(self, role: str, text: str, fault: str, here: tuple, behind: tuple):
        while True:
            s, rest = self.state, here[self.state]
            if DELETE + behind[s] == rest:
                self.audit.append("D")
                self.cost += DELETE
                return
            if INSERT + here[FORCED[s]] == rest:
                yield self._insert()
                continue
            more, kept = OPEN_END * (fault == "truncated"), KEPT.get(role[:1], (None,) * STATES)[s]
            if kept is not None and KEEP + more + behind[kept] == rest:
                self.state, edit, cost = kept, "K", KEEP + more
            else:
                self.state, edit, cost, role = FORCED[s], "R", REROLE + more, ROLES[s]
            self.audit.append(edit)
            self.cost += cost
            yield self._put(edit, role, text)
            return

    def _insert(self) -> tuple:
        role = ROLES[self.state]
        self.state = FORCED[self.state]
        self.audit.append("I")
        self.cost += INSERT
        return self._put("I", role, "")

    def finish(self) -> Iterable[tuple]:
        """Turns put in at the end."""
        while END[self.state]:
            yield self._insert()

    def result(self) -> tuple:
        """Values of ``RESULT``."""
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        counts = [self.counts[k] for k in ("blank", "duplicate", "truncated")]
        return gaps, *counts, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]
#: What tasks hand on: results (one for each block), repaired turns, and turns of blocks that may be parts of a conversation.
_HANDED = f"kind string, block long, place long, turn long, role string, text string, fault string, again boolean, digest binary, edit string, {RESULT}"


def damaged(turns: DataFrame) -> DataFrame:
    """Damage to ``(conv_id, turn, role, text)`` by crc32 of ``conv_id:turn``, modulo 20.

    0 drops a turn (marked ``gone``, so that its conversation stays known), 1
    empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    h = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn"))) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), copies.alias("copies"))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _dealt(turns: DataFrame) -> DataFrame:
    """Turns in order over the partitions; ties by role and digest of the text, equal rows by where they were read."""
    fault = F.when(~F.col("text").rlike(_BLANK), "blank").when(~F.col("text").rlike(_END), "truncated").otherwise("")
    # A key that is never null and tells a null from any other.
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("conv_id").cast("string")))
    rows = turns.withColumns({"key": key, "digest": F.unhex(F.md5("text")), "fault": fault, "read": F.monotonically_increasing_id()})
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    order = ["key", "turn", "role", "digest", "read", "copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("read", "copy")


def _blocks(rows: Iterable[dict], most: int) -> Iterable[tuple[dict, list[dict], bool, bool]]:
    """``(any row, turns, open, cut)`` for every block of a partition's sorted rows.

    A block is open if its conversation may have others: it is the partition's
    first or last conversation, or cut into several blocks here.
    """
    held, turns, size, first, cut = None, [], 0, True, False
    for row in rows:
        if held is not None and row["key"] != held["key"]:
            yield held, turns, first or cut, cut
            held, turns, size, first, cut = None, [], 0, False, False
        if len(turns) >= most or size >= BLOCK_BYTES:
            yield held, turns, True, True
            turns, size, cut = [], 0, True
        held = row
        if not row["gone"]:
            turns.append(row)
            size += len(row["text"])
    if held is not None:
        yield held, turns, True, cut


def _in_tasks(batches: Iterable[pa.RecordBatch], with_turns: bool, most: int) -> Iterable[dict]:
    part = TaskContext.get().partitionId()
    rows = (row for batch in batches for row in batch.to_pylist())
    for number, (held, turns, is_open, cut) in enumerate(_blocks(rows, most)):
        head = {"key": held["key"], "conv_id": held["conv_id"], "block": (part << 32) + number}
        seen = set()
        for t in turns:
            t["again"] = (t["role"], t["digest"]) in seen
            seen.add((t["role"], t["digest"]))
        if is_open:
            # The row without a place stands for a block without turns, too.
            yield head | {"kind": "open", "place": -1}
            for place, t in enumerate(turns):
                yield head | {"kind": "open", "place": place} | {c: t[c] for c in ("turn", "role", "text", "fault", "again", "digest")}
        if cut:
            yield head | {"kind": "result"}
            continue
        # Counts if the conversation turns out to have no other block.
        one = Repair()
        given = [(t["turn"], t["role"], t["text"], "duplicate" if t["again"] and t["fault"] != "blank" else t["fault"]) for t in turns]
        for put in (*one.feed(given, END), *one.finish()):
            if with_turns:
                yield head | {"kind": "turn"} | dict(zip(("place", "edit", "role", "text"), put, strict=True))
        yield head | {"kind": "result"} | dict(zip(RESULT_NAMES, one.result(), strict=True))


def _matrix(codes: list[str]) -> list[float]:
    """Least cost from each state before a block to each state behind it, row by row."""
    columns = []
    for s in range(STATES):
        v = tuple(0 if t == s else inf for t in range(STATES))
        for code in reversed(codes):
            v = before(v, code[0], code[1:])
        columns.append(v)
    return [float(columns[t][s]) for s in range(STATES) for t in range(STATES)]


def _with_matrix(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        found = pa.array([_matrix(codes) for codes in batch["codes"].to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch["key"], batch["block"], found], names=["key", "block", "matrix"])


def _checkpoints(blocks: pd.DataFrame) -> pd.DataFrame:
    """Costs behind every block of one conversation, folded from its end."""
    blocks = blocks.sort_values("block", ascending=False)
    after, found = tuple(map(float, END)), []
    for matrix in blocks["matrix"]:
        found.append(list(after))
        after = tuple(min(matrix[STATES * s + t] + after[t] for t in range(STATES)) for s in range(STATES))
    return pd.DataFrame({"key": blocks["key"], "block": blocks["block"], "after": found})


def _stream(batches: Iterable[pa.RecordBatch], with_turns: bool) -> Iterable[dict]:
    """Turns of conversations of several blocks, in order; one block is held at a time."""
    one, held, turns = Repair(), None, []

    def fed():
        for put in one.feed(turns, tuple(int(x) for x in held["after"])):
            if with_turns:
                yield head | {"kind": "turn"} | dict(zip(("place", "edit", "role", "text"), put, strict=True))

    def ended():
        for put in one.finish():
            if with_turns:
                yield head | {"kind": "turn"} | dict(zip(("place", "edit", "role", "text"), put, strict=True))
        yield head | {"kind": "result"} | dict(zip(RESULT_NAMES, one.result(), strict=True))

    for batch in batches:
        for row in batch.to_pylist():
            if held is not None and row["block"] != held["block"]:
                yield from fed()
                turns = []
            if held is not None and row["key"] != held["key"]:
                yield from ended()
                one = Repair()
            held, head = row, {"key": row["key"], "conv_id": row["conv_id"]}
            if row["place"] >= 0:
                turns.append((row["turn"], row["role"], row["text"], row["fault"]))
    if held is not None:
        yield from fed()
        yield from ended()


def _mapped(rows: DataFrame, work, schema: str) -> DataFrame:
    """``rows`` through a function from batches to dictionaries."""
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches):
        held = []
        for row in work(batches):
            held.append(row)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return rows.mapInArrow(run, schema)


def _repaired(turns: DataFrame, with_turns: bool, most: int) -> DataFrame:
    arrow_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"key string, conv_id {kind}, {_HANDED}"
    handed = stored(_mapped(_dealt(turns), lambda batches: _in_tasks(batches, with_turns, most), schema), "turns")
    several = handed.where("kind = 'result'").groupBy("key").count().where("count > 1").select("key")
    whole = handed.where("kind <> 'open'").join(several, "key", "left_anti")

    parts = handed.where("kind = 'open'").join(several, "key", "left_semi")
    seen = parts.where("place >= 0").groupBy("key", "role", "digest").agg(F.min("block").alias("least"))
    fault = F.when((F.col("fault") != "blank") & (F.col("again") | (F.col("least") < F.col("block"))), "duplicate").otherwise(F.col("fault"))
    parts = parts.join(seen, ["key", "role", "digest"], "left")
    parts = stored(parts.select("key", "conv_id", "block", "place", "turn", "role", "text", fault.alias("fault")), "parts")
    code = F.concat(F.rpad(F.substring("role", 1, 1), 1, " "), "fault")
    codes = F.sort_array(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", code.alias("code")))))
    blocks = parts.groupBy("key", "block").agg(codes["code"].alias("codes"))
    matrices = blocks.mapInArrow(_with_matrix, "key string, block long, matrix array<double>")
    points = matrices.groupBy("key").applyInPandas(_checkpoints, "key string, block long, after array<double>")
    ordered = parts.join(points, ["key", "block"]).repartition("key").sortWithinPartitions("key", "block", "place")
    return whole.unionByName(_mapped(ordered, lambda batches: _stream(batches, with_turns), schema))


def repair_conversations(turns: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """One row for each conversation of ``turns(conv_id, turn, role, text, gone, copies)``.

    Columns: ``conv_id`` and those of ``RESULT``: turn numbers left out between
    the first and the last, turns by first fault, neighbours whose roles may not
    follow each other, the cost, the edits' letters, and a digest of the
    repaired turns.  Turns are taken by number, nulls first; of one number by
    role and text's md5.  A row that is ``gone`` only keeps its conversation
    known; ``copies`` is 2 for a turn that stands twice.  A null key is a
    conversation of its own.  Further columns are not read.  ``most`` bounds the
    turns of a block; results do not depend on it.
    """
    found = _repaired(turns, False, most).where("kind = 'result'")
    return found.select("conv_id", *RESULT_NAMES)


def repaired_turns(turns: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """The repaired conversations: ``(conv_id, place, edit, role, text)`` for every turn that stays, is reroled or put in."""
    return _repaired(turns, True, most).where("kind = 'turn'").select("conv_id", "place", "edit", "role", "text")


#: The same in SQL: costs from the last turn back, then the walk forward, as recursive queries over all conversations at once.
SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS line,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, polynomial
), damaged AS (
  SELECT conv_id, turn, line, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), line, copy) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, line, copy) AS seen
  FROM damaged
), turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS former
  FROM placed
), costs AS (
  SELECT conv_id, n + 1 AS i, 0 AS v0, 4 AS v1, 2 AS v2, 0 AS v3 FROM turns WHERE i = n
  UNION ALL
  SELECT conv_id, i, least(w0, w2 + 2, w3 + 4), least(w1, w2 + 2, w3 + 4), least(w2, w3 + 2), least(w3, w2 + 2)
  FROM (
    SELECT t.conv_id, t.i,
      least(v0 + 3, x + 2 + v2, CASE initial WHEN 's' THEN x + v1 WHEN 'u' THEN x + v2 ELSE 999999999 END) AS w0,
      least(v1 + 3, x + 2 + v2, CASE initial WHEN 'u' THEN x + v2 ELSE 999999999 END) AS w1,
      least(v2 + 3, x + 2 + v3, CASE initial WHEN 'a' THEN x + v3 ELSE 999999999 END) AS w2,
      least(v3 + 3, x + 2 + v2, CASE initial WHEN 'u' THEN x + v2 ELSE 999999999 END) AS w3
    FROM costs AS c
    JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 't' THEN 1 ELSE 999999 END AS x FROM turns) AS t
      ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.i = t.i + 1)
), walk AS (
  SELECT conv_id, i, 0 AS s, v0 AS cost, '' AS audit, [''] [:0] AS lines FROM costs WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
    CASE WHEN edit = 'D' THEN s WHEN edit = 'K' AND initial = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END,
    cost, audit || edit,
    CASE edit WHEN 'D' THEN lines
      WHEN 'K' THEN list_append(lines, role || ':' || text)
      WHEN 'R' THEN list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || text)
      ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) END
  FROM (
    SELECT w.*, t.initial, t.role, t.text,
      CASE WHEN t.i IS NULL THEN 'I'
        WHEN 3 + [b.v0, b.v1, b.v2, b.v3][s + 1] = [h.v0, h.v1, h.v2, h.v3][s + 1] THEN 'D'
        WHEN 2 + [h.v2, h.v2, h.v3, h.v2][s + 1] = [h.v0, h.v1, h.v2, h.v3][s + 1] THEN 'I'
        WHEN (t.fault = 't')::INT + CASE WHEN t.initial = 's' AND s = 0 THEN b.v1 WHEN t.initial = 'u' AND s <> 2 THEN b.v2
          WHEN t.initial = 'a' AND s = 2 THEN b.v3 ELSE 999999999 END = [h.v0, h.v1, h.v2, h.v3][s + 1] THEN 'K'
        ELSE 'R' END AS edit
    FROM walk AS w
    JOIN costs AS h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
    LEFT JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i
    LEFT JOIN costs AS b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1
    WHERE t.i IS NOT NULL OR w.s IN (1, 2))
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM turns GROUP BY conv_id
), repaired AS (
  SELECT w.conv_id, w.cost, w.audit, sha256(array_to_string(w.lines, chr(10))) AS digest
  FROM walk AS w JOIN counts AS c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n + 1 AND w.s IN (0, 3)
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS k
LEFT JOIN counts AS c ON k.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired AS r ON k.conv_id IS NOT DISTINCT FROM r.conv_id
"""
