"""How the given tables stand in for the library's inputs.

The same SQL text builds each input in Spark and in the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY = "2024-01-15"
BACKFILL_START, BACKFILL_DAYS = "2024-01-11", 10
PROCESSED_AT = "2024-02-01 00:00:00"

VERSIONS_SQL = """
SELECT user_id AS personal_account_id, user_id AS wallet_id, event_id AS holder_id,
       ts AS open_dt,
       CASE WHEN event_type = 'error'
            THEN CAST(CAST(ts AS DATE) + INTERVAL 10 DAY AS TIMESTAMP{ntz}) END AS close_dt,
       ts AS ch_processed_at
FROM events"""

TURNOVERS_SQL = """
SELECT user_id AS personal_account_id, CAST(ts AS DATE) AS day,
       CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(18,2)) AS credit_amount,
       CAST(CASE WHEN event_type = 'view' THEN value ELSE 0 END AS DECIMAL(18,2)) AS debit_amount,
       CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS credit_operations_count,
       CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS BIGINT) AS debit_operations_count
FROM events
WHERE event_type IN ('purchase', 'view')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "events", VERSIONS_SQL.replace("{ntz}", "_NTZ"))


def turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "events", TURNOVERS_SQL)
