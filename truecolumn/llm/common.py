"""What the operators of this package share: stored steps, input columns, key splits."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truecolumn.session import scratch_path

#: Rows of one Arrow batch.  Texts are long, so Spark's 10 000 would hold too much.
BATCH_ROWS = 1000


def arrow_batches(spark: SparkSession) -> None:
    """Keep the batches that Python workers get small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for the queries that run inside."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Later steps start from these files, so a lost executor costs the tasks that
    were running on it and nothing before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_remainder(key: Column, parts: int = 3) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string")) % parts


def held_out(key: Column) -> Column:
    """Rows that no model may learn labels from; false for a null key."""
    return F.coalesce(key_remainder(key) == 1, F.lit(False))


def may_learn(key: Column) -> Column:
    """Rows whose labels a model may learn; never those without a key."""
    return F.coalesce(key_remainder(key) != 1, F.lit(False))
