"""Checks run on a loaded table: counts, duplicates, nulls, value kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load_check(df: DataFrame, key: str) -> DataFrame:
    """Row count and the smallest and largest key."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
    )


def rows_per_day(df: DataFrame, day: str = "day") -> DataFrame:
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("rows_total"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All keys that occur more than once, and how often; null is a key too."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_count"))
    return counted.where("rows_count > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column and the number of rows."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in columns]
    return df.agg(*nulls, F.count(F.lit(1)).alias("rows_total"))


def value_kind_counts(df: DataFrame, column: str, kind: Column) -> DataFrame:
    """How often each kind of value occurs; null is a kind of its own."""
    return df.select(kind.alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("values_count")
    ).withColumn("column_name", F.lit(column))
