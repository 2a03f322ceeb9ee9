"""Writing typed rows to partitioned, bucketed tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from truecolumn.errors import CleanupError, ExistingTableError, LoadError, SchemaError

# What a load leaves behind.  A table gets its name when it is complete, so a
# half-filled target cannot occur.
CREATED, NOT_CREATED, CLEANUP_FAILED = "created", "not_created", "cleanup_failed"
#: Between a target's name and the id of the load that is writing it.
STAGED = "__load_"


@dataclass(frozen=True)
class Layout:
    """Where rows go: partition columns, bucket (shard) column, sort columns.

    ``partition_by`` maps new partition columns to expressions, for example
    ``{"load_day": F.to_date("created_dt")}``; a plain list names columns.
    """

    partition_by: dict[str, Column] | list[str] = field(default_factory=list)
    shard_by: str | None = None
    shards: int = 32
    sort_by: tuple[str, ...] = ()

    @property
    def partition_columns(self) -> list[str]:
        return list(self.partition_by)

    def derived(self, df: DataFrame) -> DataFrame:
        if isinstance(self.partition_by, dict):
            return df.withColumns(self.partition_by)
        return df


def check_table_name(name: str) -> str:
    parts = name.split(".")
    if not all(p.isascii() and p.isidentifier() for p in parts):
        raise SchemaError(f"unsafe table name: {name}")
    return name


def shard_of(key: Column | str, shards: int) -> Column:
    """Shard number of a key: an even spread by a 64-bit hash."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def existing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [n for n in names if spark.catalog.tableExists(check_table_name(n))]


def arranged(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows gathered by target file, with large groups split.

    The rebalance hint lets adaptive execution merge small groups and split
    one that is too large, so a partition that holds a third of all rows is
    still written by many tasks, and a small one does not become many files.
    """
    keys = [F.col(f"`{c}`") for c in layout.partition_columns]
    if layout.shard_by:
        # The hash that bucketing itself uses, so that a task holds whole buckets.
        bucket = F.pmod(F.hash(F.col(f"`{layout.shard_by}`")), F.lit(layout.shards))
        df = df.withColumn("_shard", bucket)
        keys.append(F.col("_shard"))
    return df.hint("rebalance", *keys).drop("_shard") if keys else df


def _writer(df: DataFrame, layout: Layout):
    writer = df.write.format("parquet").mode("errorifexists").option("compression", "zstd")
    if layout.partition_columns:
        writer = writer.partitionBy(*layout.partition_columns)
    if layout.shard_by:
        writer = writer.bucketBy(layout.shards, layout.shard_by)
        if layout.sort_by:
            writer = writer.sortBy(*layout.sort_by)
    return writer


def drop_tables(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {check_table_name(name)}")


def _written_by(spark: SparkSession, name: str, load_id: str) -> bool:
    """Whether the table in the catalog carries this load's mark."""
    if not existing_tables(spark, [name]):
        return False
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {check_table_name(name)}")
    return not described.where(F.contains(F.col("data_type"), F.lit(load_id))).isEmpty()


def load_table(df: DataFrame, name: str, layout: Layout = Layout()) -> DataFrame:
    """Write a new table and return it.

    An existing target is refused.  Rows go to a table with a name of this load's
    own, which is renamed to the target once it is complete: a load that is killed
    at any point leaves no target and does not stand in the way of the next one
    (:func:`abandoned_loads` finds what it left).  Catalogs do not move a
    partitioned table's partitions along with its name, so such a table is written
    under its own name; Spark puts it into the catalog after all of its files.  If
    a step fails, what this load made is dropped; whether the target was published
    is read from the catalog, and what someone else created meanwhile stays.
    """
    spark = df.sparkSession
    if existing_tables(spark, [name]):
        raise ExistingTableError(f"target table already exists: {name}")
    rows = arranged(layout.derived(df), layout)
    if layout.sort_by and not layout.shard_by:
        rows = rows.sortWithinPartitions(*layout.partition_columns, *layout.sort_by)
    load_id = uuid.uuid4().hex
    staged = not layout.partition_columns
    staging = f"{name}{STAGED}{load_id}" if staged else name
    try:
        _writer(rows, layout).option("load_id", load_id).saveAsTable(staging)
        if staged:
            publish(spark, staging, name)
    except Exception as problem:
        try:
            mine = _written_by(spark, name, load_id)
            if mine and staged:
                # The rename took place, whatever was reported.
                return spark.table(name)
            if mine or staged:
                drop_tables(spark, [staging])
        except Exception as second:
            raise CleanupError(
                f"loading {name} failed ({problem}), and cleaning up failed too ({second}); "
                f"look at {staging} before the next load"
            ) from problem
        if existing_tables(spark, [name]):
            raise ExistingTableError(f"target table already exists: {name}") from problem
        raise LoadError(f"loading {name} failed, nothing was created: {problem}") from problem
    return spark.table(name)


def publish(spark: SparkSession, staging: str, name: str) -> None:
    """Give a complete table its final name; fails if the name is taken."""
    spark.sql(f"ALTER TABLE {check_table_name(staging)} RENAME TO {check_table_name(name)}")


def abandoned_loads(spark: SparkSession, database: str) -> list[str]:
    """Tables that stopped loads left behind in a database, or that loads are writing now."""
    found = spark.sql(f"SHOW TABLES IN {check_table_name(database)} LIKE '*{STAGED}*'").collect()
    return sorted(f"{database}.{row['tableName']}" for row in found)


def append_rows(df: DataFrame, name: str) -> None:
    """Add rows, matched by column name, to an existing table."""
    spark = df.sparkSession
    columns = spark.table(check_table_name(name)).columns
    if sorted(columns) != sorted(df.columns):
        raise SchemaError(f"columns of {name} are {columns}, not {df.columns}")
    df.select(*[F.col(f"`{c}`") for c in columns]).write.insertInto(name)


def write_folder(df: DataFrame, path: str, layout: Layout = Layout()) -> str:
    """The same layout as Parquet files in a folder that must not exist yet."""
    rows = arranged(layout.derived(df), layout)
    if layout.sort_by:
        rows = rows.sortWithinPartitions(*layout.partition_columns, *layout.sort_by)
    writer = rows.write.mode("errorifexists").option("compression", "zstd")
    if layout.partition_columns:
        writer = writer.partitionBy(*layout.partition_columns)
    writer.parquet(path)
    return path


def replace_day(df: DataFrame, table: str, day: date | str, column: str = "day") -> int:
    """Replace one day of a table partitioned by day; gives the rows written.

    Only that partition is overwritten; rows of another day fail the job.  Dynamic overwrite leaves a partition
    alone when no row arrives, so an empty day is dropped explicitly.
    """
    spark = df.sparkSession
    day = str(day)
    date.fromisoformat(day)
    columns = spark.table(check_table_name(table)).columns
    counted = Observation()
    # A row of another day would otherwise be lost without a word.
    message = F.concat(F.lit(f"a row is not of {day} but of "), F.coalesce(F.col(column).cast("string"), F.lit("no day")))
    same = F.when(F.col(column) == F.lit(day).cast("date"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    rows = (
        df.where(same)
        .select(*[F.col(f"`{c}`") for c in columns])
        .observe(counted, F.count(F.lit(1)).alias("rows"))
    )
    # A table that is also read is only overwritten under the session's dynamic mode.
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    written = counted.get["rows"]
    if not written:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = DATE '{day}')")
    return written
