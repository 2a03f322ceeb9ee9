"""Balances: hand-made cases, and the one-pass backfill against the daily loop."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from truecolumn.errors import LoadError, SchemaError
from truecolumn.operators import balance as B
from truecolumn.sinks import balance_table

VERSION = "personal_account_id long, wallet_id long, holder_id long, open_dt timestamp_ntz, close_dt timestamp_ntz, ch_processed_at timestamp_ntz"
TURNOVER = "personal_account_id long, day date, credit_amount decimal(18,2), debit_amount decimal(18,2), credit_operations_count long, debit_operations_count long"
AT = "2024-02-01 00:00:00"
DAY = date(2024, 1, 10)


def at(day, hour=0):
    return datetime(day.year, day.month, day.day, hour)


def before(n):
    return DAY - timedelta(days=n)


@pytest.fixture(scope="module")
def hand_made(spark):
    versions = [
        (1, 1, 10, at(before(5)), None, at(before(5))),  # plain account
        (1, 1, 11, at(before(5)), None, at(before(2))),  # its later version
        (2, 2, 20, at(before(5)), at(before(1)), at(before(5))),  # closed the day before
        (3, 3, 30, at(before(5)), at(DAY), at(before(5))),  # closed on the day
        (4, 4, 40, at(before(5)), at(DAY + timedelta(days=1)), at(before(5))),  # closed after
        (5, 5, 50, at(DAY, 23), None, at(DAY, 23)),  # opened late on the day
        (6, 6, 60, at(DAY + timedelta(days=1)), None, at(before(5))),  # opened the day after
        (7, 7, 70, at(before(5)), None, at(before(3))),  # two versions of equal time
        (7, 7, 71, at(before(5)), None, at(before(3))),
    ]
    turnovers = [
        (1, DAY, Decimal("10.00"), Decimal("4.00"), 2, 1),
        (1, DAY, Decimal("15.50"), Decimal("3.00"), 3, 1),  # a later snapshot: maxima win
        (3, before(1), Decimal("99.00"), Decimal("0.00"), 1, 0),  # another day
        (2, DAY, Decimal("5.00"), Decimal("0.00"), 1, 0),  # not an open account
    ]
    old = [
        (1, 10, before(1), 0, 100, 0, 0, 0, 0, at(before(1), 1)),
        (1, 10, before(1), 0, 200, 0, 0, 0, 0, at(before(1), 2)),  # repeated row: latest wins
        (4, 40, before(2), 0, 500, 0, 0, 0, 0, at(before(2))),  # a gap: does not carry over
    ]
    money = [tuple(Decimal(x) if i in (3, 4, 5, 6) else x for i, x in enumerate(r)) for r in old]
    return (
        spark.createDataFrame(versions, VERSION),
        spark.createDataFrame(turnovers, TURNOVER),
        spark.createDataFrame(money, B.BALANCE_SCHEMA),
    )


def test_one_day(hand_made):
    found = {r["personal_account_id"]: r for r in B.daily_balance(*hand_made, DAY, AT).collect()}
    assert sorted(found) == [1, 3, 4, 5, 7]
    one = found[1]
    assert (one["holder_id"], one["balance_by_day"], one["balance"]) == (11, Decimal("11.50"), Decimal("211.50"))
    assert (one["credit_amount"], one["debit_amount"], one["credit_operations_count"]) == (Decimal("15.50"), Decimal("4.00"), 3)
    assert found[3]["balance"] == found[4]["balance"] == found[5]["balance"] == 0
    assert found[7]["holder_id"] == 71
    carried = B.daily_balance(*hand_made, DAY, AT, carry="last_known").collect()
    assert {r["personal_account_id"]: r["balance"] for r in carried}[4] == 500
    with pytest.raises(SchemaError):
        B.daily_balance(*hand_made, DAY, AT, carry="never")


def test_max_account(hand_made):
    assert B.require_max_account_id(hand_made[0], DAY) == 7
    with pytest.raises(LoadError):
        B.require_max_account_id(hand_made[0], "2000-01-01")


def test_ranges_and_days(spark):
    ids = spark.range(1, 101).withColumnRenamed("id", "k")
    ranges = [tuple(r) for r in B.id_ranges(ids, "k", 3).orderBy("range_start").collect()]
    assert ranges == [(0, 34, 33), (34, 68, 34), (68, 101, 33)]
    assert B.id_ranges(ids.limit(0), "k", 3).count() == 0
    days = [r["day"] for r in B.day_list(spark, "2024-02-28", 3).orderBy("day").collect()]
    assert days == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    with pytest.raises(SchemaError):
        B.day_list(spark, "2024-02-28", 0)


def test_left_any_join_with_hot_key(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    right = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 END AS k", "id AS v")
    joined = B.left_any_join(left, right, "k", ["v"]).orderBy("k").collect()
    assert len(joined) == 10 and joined[1]["v"] == 0 and joined[9]["v"] is None


def test_backfill_equals_daily_loop(spark):
    """Random accounts with closings, gaps, a hot account and an opening balance."""
    rng = random.Random(4)
    start, days = date(2024, 3, 1), 6
    versions, turnovers = [], []
    for account in list(range(1, 15)) + [1] * 25:
        opened = start + timedelta(days=rng.randint(-4, 6))
        closed = at(opened + timedelta(days=rng.randint(0, 3))) if rng.random() < 0.6 else None
        versions.append((account, account, rng.randint(1, 999), at(opened, rng.randint(0, 23)), closed, at(opened, rng.randint(0, 3))))
    for _ in range(150):
        turnovers.append((
            rng.choice([1, 1, 1, *range(2, 18)]), start + timedelta(days=rng.randint(-1, days)),
            Decimal(rng.randint(0, 9999)) / 100, Decimal(rng.randint(0, 9999)) / 100, rng.randint(0, 5), rng.randint(0, 5),
        ))
    v, t = spark.createDataFrame(versions, VERSION), spark.createDataFrame(turnovers, TURNOVER)
    table = "balances_loop"
    balance_table.create_balance_table(spark, table)
    seed = start - timedelta(days=1)
    balance_table.process_day(v, t, table, seed, AT)
    before_rows = spark.createDataFrame(spark.table(table).select(*B.BALANCE_COLUMNS).collect(), B.BALANCE_SCHEMA)
    one_pass = B.backfill(v, t, before_rows, start, days, AT)
    counts = balance_table.process_days(v, t, table, start, days, AT)
    looped = spark.table(table).where(f"day >= '{start}'").select(*B.BALANCE_COLUMNS)
    assert sorted(map(tuple, one_pass.collect())) == sorted(map(tuple, looped.collect()))
    assert sum(counts.values()) == looped.count()
    # Repeating a day changes nothing; a day without accounts leaves no rows behind.
    again = balance_table.process_day(v, t, table, start, AT)
    assert again == counts[str(start)]
    assert balance_table.process_day(v.limit(0), t, table, start, AT) == 0
    assert spark.table(table).where(f"day = '{start}'").count() == 0


def test_packed_ids_keep_the_order(spark):
    from truecolumn.operators.balance import latest_id, packed_id, unpacked_id

    ids = [None, -(2**63), -5, 0, 7, 2**63 - 1]
    times = [None, "0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2024-01-15 10:00:00.000001", "9999-12-31 23:59:59.999999"]
    rows = [(t, i) for t in times for i in ids]
    df = spark.createDataFrame(rows, "t string, id bigint").withColumn("v", F.col("t").cast("timestamp_ntz"))
    packed = df.select("t", "id", packed_id("id", "v").alias("p")).select("*", unpacked_id(F.col("p")).alias("back")).collect()
    assert [r.back for r in packed] == [i for _, i in rows]
    numbers = [r.p for r in packed]
    assert numbers == sorted(numbers) and len(set(numbers)) == len(numbers)
    latest = df.where("id is not null").groupBy(F.lit(1)).agg(latest_id("id", "v").alias("id"))
    assert latest.first().id == 2**63 - 1
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
