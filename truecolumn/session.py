"""Session settings the library relies on, and its scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from truecolumn.errors import LoadError, ReadCancelled

# Expressions over many columns can generate methods the JVM refuses to
# compile (beyond 8000 bytes of byte code).  Below this limit Spark falls back
# to projections it splits into small methods, which run many times faster
# than one large interpreted method.
RUNTIME_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # Needed to read windows-1251 text.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Undecodable bytes become replacement characters, which the readers look for.
    "spark.sql.legacy.codingErrorAction": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Run actions that another thread may stop with :func:`stop`."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield
    except Exception as problem:
        if "cancel" in str(problem).lower():
            raise ReadCancelled(f"{tag} was stopped") from problem
        raise
    finally:
        context.removeJobTag(tag)


def stop(spark: SparkSession, tag: str) -> None:
    """Cancel what runs inside ``cancellable(spark, tag)``."""
    spark.sparkContext.cancelJobsWithTag(tag)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Rows over all cores, where the source has fewer splits than that.

    One gzip file or one Parquet row group is read by a single task, whatever
    follows.  Sources with enough splits are returned unchanged.  With
    ``rows_per_task`` the number of tasks grows with the rows instead, so that
    the time and memory of one task do not: compact files hold many rows in a
    split.  The rows are counted for that, for Parquet from the footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted, splits = cores, df.rdd.getNumPartitions()
    if rows_per_task is not None:
        wanted = max(cores, -(-df.count() // rows_per_task))
    return df.repartition(wanted) if splits < wanted else df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session of one machine may go without it and gets a folder of its own;
    on a cluster a machine's folder would not be seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise LoadError("set spark.checkpoint.dir to a folder that all executors reach")
        named = tempfile.mkdtemp(prefix="truecolumn-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/truecolumn/{name}-{uuid.uuid4().hex}"
