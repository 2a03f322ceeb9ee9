"""Balance queries over the events table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from registry import inputs as I
from truecolumn.operators import balance as B
from truecolumn.operators import checks as K

_V = I.VERSIONS_SQL.replace("{ntz}", "")
_T = I.TURNOVERS_SQL
_BEFORE = (date.fromisoformat(I.DAY) - timedelta(days=1)).isoformat()


def _no_balances(spark):
    return spark.createDataFrame([], B.BALANCE_SCHEMA)


def _balance_of(spark, sf, day, before):
    return B.daily_balance(I.versions(spark, sf), I.turnovers(spark, sf), before, day, I.PROCESSED_AT)


def daily_balance(spark, sf):
    yesterday = _balance_of(spark, sf, _BEFORE, _no_balances(spark))
    return _balance_of(spark, sf, I.DAY, yesterday)


def balance_backfill(spark, sf):
    return B.backfill(
        I.versions(spark, sf), I.turnovers(spark, sf), _no_balances(spark),
        I.BACKFILL_START, I.BACKFILL_DAYS, I.PROCESSED_AT,
    )


def _day_sql(day: str, opening: str | None) -> str:
    """SQL of one day's balances; ``opening`` selects key and last balance."""
    before = f"LEFT JOIN ({opening}) l USING (personal_account_id)" if opening else ""
    last = "coalesce(l.last_balance, 0)" if opening else "0"
    return f"""
SELECT w.personal_account_id, w.holder_id, DATE '{day}' AS day,
       CAST(coalesce(t.net, 0) AS DECIMAL(18,2)) AS balance_by_day,
       CAST({last} + coalesce(t.net, 0) AS DECIMAL(28,2)) AS balance,
       CAST(coalesce(t.debit_amount, 0) AS DECIMAL(18,2)) AS debit_amount,
       CAST(coalesce(t.credit_amount, 0) AS DECIMAL(18,2)) AS credit_amount,
       CAST(coalesce(t.debit_operations_count, 0) AS BIGINT) AS debit_operations_count,
       CAST(coalesce(t.credit_operations_count, 0) AS BIGINT) AS credit_operations_count,
       TIMESTAMP '{I.PROCESSED_AT}' AS ch_processed_at
FROM (SELECT personal_account_id, arg_max(holder_id, (ch_processed_at, holder_id)) AS holder_id
      FROM versions
      WHERE open_dt < DATE '{day}' + INTERVAL 1 DAY
        AND (close_dt >= DATE '{day}' OR close_dt IS NULL)
      GROUP BY personal_account_id) w
LEFT JOIN (SELECT personal_account_id, max(credit_amount) AS credit_amount,
                  max(debit_amount) AS debit_amount,
                  max(credit_operations_count) AS credit_operations_count,
                  max(debit_operations_count) AS debit_operations_count,
                  max(credit_amount) - max(debit_amount) AS net
           FROM turnovers WHERE day = DATE '{day}' GROUP BY personal_account_id) t
  USING (personal_account_id)
{before}"""


_INPUTS = f"versions AS ({_V}), turnovers AS ({_T})"


def _daily_balance_sql() -> str:
    opening = "SELECT personal_account_id, balance AS last_balance FROM yesterday"
    return f"WITH {_INPUTS}, yesterday AS ({_day_sql(_BEFORE, None)})\n{_day_sql(I.DAY, opening)}"


def _backfill_sql() -> str:
    """Day after day, each reading the day before."""
    start = date.fromisoformat(I.BACKFILL_START)
    parts, names = [], []
    for i in range(I.BACKFILL_DAYS):
        opening = f"SELECT personal_account_id, balance AS last_balance FROM d{i - 1}" if i else None
        day = (start + timedelta(days=i)).isoformat()
        parts.append(f"d{i} AS MATERIALIZED ({_day_sql(day, opening)})")
        names.append(f"SELECT * FROM d{i}")
    return f"WITH {_INPUTS}, {', '.join(parts)}\n" + "\nUNION ALL ".join(names)


def max_account_id(spark, sf):
    return B.max_account_id(I.versions(spark, sf), I.DAY)


def active_accounts(spark, sf):
    return B.active_accounts(I.versions(spark, sf), I.DAY)


def latest_version(spark, sf):
    return B.latest_version(I.versions(spark, sf))


def daily_turnover(spark, sf):
    return B.daily_turnover(I.turnovers(spark, sf), I.DAY)


def left_any_join(spark, sf):
    customers = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_name"
    )
    orders = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderstatus"
    )
    return B.left_any_join(customers, orders, "custkey", ["o_orderkey"])


def day_list(spark, sf):
    """Every day between the first and the last event, with its number of events."""
    events = I.table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    span = events.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    days = B.day_list(spark, span["first"], (span["last"] - span["first"]).days + 1)
    counts = events.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("events"))


def id_ranges(spark, sf):
    return B.id_ranges(I.versions(spark, sf), B.KEY, 12)


def rows_per_day(spark, sf):
    return K.rows_per_day(balance_backfill(spark, sf))


def duplicate_keys(spark, sf):
    return K.duplicate_keys(I.turnovers(spark, sf), [B.KEY, "day"])


def null_counts(spark, sf):
    return K.null_counts(I.versions(spark, sf), ["close_dt", "holder_id"])


def load_check(spark, sf):
    return K.load_check(I.table(spark, sf, "lineitem"), "l_orderkey")


def value_kind_counts(spark, sf):
    versions = I.versions(spark, sf)
    kind = F.when(F.col("close_dt").isNotNull(), F.typeof("close_dt"))
    return K.value_kind_counts(versions, "close_dt", kind)


QUERIES = {
    "daily_balance": daily_balance,
    "balance_backfill": balance_backfill,
    "max_account_id": max_account_id,
    "active_accounts": active_accounts,
    "latest_version": latest_version,
    "daily_turnover": daily_turnover,
    "left_any_join": left_any_join,
    "day_list": day_list,
    "id_ranges": id_ranges,
    "rows_per_day": rows_per_day,
    "duplicate_keys": duplicate_keys,
    "null_counts": null_counts,
    "load_check": load_check,
    "value_kind_counts": value_kind_counts,
}

SQL = {
    "daily_balance": _daily_balance_sql(),
    "balance_backfill": _backfill_sql(),
    "max_account_id": f"""
WITH versions AS ({_V})
SELECT max(personal_account_id) AS max_account_id FROM versions
WHERE open_dt < DATE '{I.DAY}' + INTERVAL 1 DAY""",
    "active_accounts": f"""
WITH versions AS ({_V})
SELECT personal_account_id, arg_max(holder_id, (ch_processed_at, holder_id)) AS holder_id
FROM versions
WHERE open_dt < DATE '{I.DAY}' + INTERVAL 1 DAY
  AND (close_dt >= DATE '{I.DAY}' OR close_dt IS NULL)
GROUP BY personal_account_id""",
    "latest_version": f"""
WITH versions AS ({_V})
SELECT personal_account_id, arg_max(wallet_id, (ch_processed_at, wallet_id)) AS wallet_id,
       arg_max(holder_id, (ch_processed_at, holder_id)) AS holder_id
FROM versions GROUP BY personal_account_id""",
    "daily_turnover": f"""
WITH turnovers AS ({_T})
SELECT personal_account_id, max(credit_amount) AS credit_amount, max(debit_amount) AS debit_amount,
       max(credit_operations_count) AS credit_operations_count,
       max(debit_operations_count) AS debit_operations_count,
       max(credit_amount) - max(debit_amount) AS balance_by_day
FROM turnovers WHERE day = DATE '{I.DAY}' GROUP BY personal_account_id""",
    "left_any_join": """
SELECT c.c_custkey AS custkey, c.c_name, o.o_orderkey, o.o_orderstatus
FROM customer c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) AS n
           FROM orders) o ON o.o_custkey = c.c_custkey AND o.n = 1""",
    "day_list": """
SELECT d.day, count(e.ts) AS events FROM (
  SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM events) AS d
LEFT JOIN events AS e ON CAST(e.ts AS DATE) = d.day GROUP BY d.day""",
    "id_ranges": f"""
WITH versions AS ({_V}),
b AS (SELECT max(personal_account_id) + 1 AS e,
             greatest(1, CAST(ceil((max(personal_account_id) + 1) / 12.0) AS BIGINT)) AS s FROM versions)
SELECT (personal_account_id // s) * s AS range_start,
       least((personal_account_id // s) * s + s, e) AS range_end, count(*) AS ids
FROM versions, b WHERE personal_account_id >= 0 GROUP BY 1, 2""",
    "rows_per_day": f"SELECT day, count(*) AS rows_total FROM ({_backfill_sql()}) GROUP BY day",
    "duplicate_keys": f"""
WITH turnovers AS ({_T})
SELECT personal_account_id, day, count(*) AS rows_count FROM turnovers
GROUP BY personal_account_id, day HAVING count(*) > 1""",
    "null_counts": f"""
WITH versions AS ({_V})
SELECT count(*) FILTER (WHERE close_dt IS NULL) AS null_close_dt,
       count(*) FILTER (WHERE holder_id IS NULL) AS null_holder_id,
       count(*) AS rows_total FROM versions""",
    "load_check": """
SELECT count(*) AS rows_total, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key FROM lineitem""",
    "value_kind_counts": f"""
WITH versions AS ({_V})
SELECT CASE WHEN close_dt IS NOT NULL THEN 'timestamp_ntz' END AS kind, count(*) AS values_count,
       'close_dt' AS column_name
FROM versions GROUP BY 1""",
}
