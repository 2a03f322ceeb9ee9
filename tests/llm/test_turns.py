"""Conversation repair against a shortest-path search over whole edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from truecolumn.llm import turns as T

SCHEMA = "conv_id long, turn long, role string, text string, cost string, block int"


def repaired(rows):
    """Plain re-statement: ``{conv_id: values}`` and the repaired turns."""
    talks = {}
    for c, t, r, x in rows:
        talk = talks.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        if h:
            talk += [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    return {c: values(talk) for c, talk in talks.items()}


def values(talk):
    talk.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(z[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, r, x in talk:
        body = re.sub(r"[\x20\x09-\x0D]", "", x)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    first = [r[:1] for _, r, _ in talk]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    numbers = {t for t, _, _ in talk if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(talk) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        need = "a" if last == "u" else "u"
        name = "assistant:" if need == "a" else "user:"
        heapq.heappush(heap, (cost + 2, audit + "I", i, need, (*lines, name)))
        if i < len(talk):
            (_, r, x), fault = talk[i], faults[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if fault in ("", "truncated"):
                more = len(fault) > 0
                if r[:1] and r[0] in follows[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[0], (*lines, f"{r}:{x}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, need, (*lines, name + x)))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "unit"], ["a.", "b.", "c", "", " ", None, "d!", "e?\n", "é漢."]
    found = []
    for c in range(80):
        for i in range(rng.randrange(1, 25)):
            found.append((c, rng.choice([i, i, i, None, rng.randrange(5)]), rng.choice(roles), rng.choice(texts)))
    # One conversation with a third of all turns, and one without a key.
    found += [(1000, i, rng.choice(roles[:3]), rng.choice([*texts, *[f"x{i}."] * 5])) for i in range(500)]
    found += [(None, rng.choice([None, 3, i]), rng.choice(roles), rng.choice(texts)) for i in range(60)]
    # Turns that are dropped alone make an empty conversation.
    gone = next(c for c in range(5000, 9000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    found += [(gone, 1, "user", "a."), (gone, 1, "assistant", "b.")]
    rng.shuffle(found)
    return found


@pytest.mark.parametrize("parts, most", [(3, 16384), (40, 16384), (4, 7)])
def test_against_shortest_paths(spark, rows, parts, most):
    """Whole conversations, ones that lie in many partitions, and ones cut into small blocks."""
    want = repaired(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
        got = T.repair_conversations(T.damaged(given), most).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_repaired_turns_follow_each_other(spark, rows):
    got = T.repaired_turns(T.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)), 9)
    talks = {}
    for r in got.orderBy("conv_id", "place").collect():
        talks.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    want = repaired(rows)
    for key, talk in talks.items():
        assert [p for p, _, _ in talk] == list(range(len(talk)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in talk))
        assert hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in talk).encode()).hexdigest() == want[key][-1]


def test_long_turns_and_no_turns(spark):
    given = spark.createDataFrame([(7, i, ("user", "assistant")[i % 2], "long " * 200_000 + f"{i}.", "", 0) for i in range(6)], SCHEMA)
    want = repaired([tuple(r)[:4] for r in given.collect()])
    assert {r[0]: tuple(r)[1:] for r in T.repair_conversations(T.damaged(given)).collect()} == want
    assert T.repair_conversations(T.damaged(given.limit(0))).count() == 0


def test_sql(spark, rows):
    db = duckdb.connect()
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).toPandas()
    conversations = given.astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by the query
    db.execute("CREATE TABLE conversations AS SELECT * FROM conversations")
    assert {r[0]: tuple(r[1:]) for r in db.execute(T.SQL).fetchall()} == repaired(rows)


def test_checkpoints_give_the_full_table():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 50, 400):
        talk = [(i, rng.choice(["user", "assistant", "system", "tool"]), f"{i}.", rng.choice(["", "", "blank", "truncated"])) for i in range(n)]
        one = T.Repair()
        list(one.feed(talk, T.END)), list(one.finish())
        costs = T.END
        for _, role, _, fault in reversed(talk):
            costs = T.before(costs, role[:1], fault)
        assert one.cost == costs[0] and one.state in (0, 3)
