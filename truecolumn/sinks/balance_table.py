"""The balance table: one partition per day, replaced day by day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from truecolumn.operators import balance as B
from truecolumn.sinks.tables import check_table_name, replace_day


def create_balance_table(spark: SparkSession, name: str) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in B.BALANCE_SCHEMA.fields)
    spark.sql(f"CREATE TABLE {check_table_name(name)} ({columns}) USING parquet PARTITIONED BY (day)")


def process_day(
    versions: DataFrame, turnovers: DataFrame, table: str, day: date | str, processed_at: str
) -> int:
    """Compute one day from the table's previous day and replace it."""
    spark = versions.sparkSession
    before = spark.table(table)
    rows = B.daily_balance(versions, turnovers, before, day, processed_at)
    return replace_day(rows, table, day)


def process_days(
    versions: DataFrame, turnovers: DataFrame, table: str, start: date | str, days: int, processed_at: str
) -> dict[str, int]:
    """Consecutive days one after the other; each reads the day before."""
    first = B.as_day(start)
    listed = [first + timedelta(days=i) for i in range(days)]
    return {str(d): process_day(versions, turnovers, table, d, processed_at) for d in listed}
