"""Daily account balances with latest-version lookup and carry-forward.

Inputs are three tables:

* account versions: ``personal_account_id, wallet_id, holder_id, open_dt,
  close_dt, ch_processed_at`` - appended rows, the latest version counts;
* turnover snapshots: ``personal_account_id, day, credit_amount, debit_amount,
  credit_operations_count, debit_operations_count`` - cumulative within a day,
  so the maximum counts;
* balances already computed, in the shape this module produces.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from truecolumn.errors import LoadError, SchemaError

KEY = "personal_account_id"
MEASURES = (
    "credit_amount",
    "debit_amount",
    "credit_operations_count",
    "debit_operations_count",
)
BALANCE_COLUMNS = (
    "personal_account_id",
    "holder_id",
    "day",
    "balance_by_day",
    "balance",
    "debit_amount",
    "credit_amount",
    "debit_operations_count",
    "credit_operations_count",
    "ch_processed_at",
)
AMOUNT = T.DecimalType(18, 2)
BALANCE_SCHEMA = T.StructType(
    [
        T.StructField("personal_account_id", T.LongType()),
        T.StructField("holder_id", T.LongType()),
        T.StructField("day", T.DateType()),
        T.StructField("balance_by_day", AMOUNT),
        T.StructField("balance", T.DecimalType(28, 2)),
        T.StructField("debit_amount", AMOUNT),
        T.StructField("credit_amount", AMOUNT),
        T.StructField("debit_operations_count", T.LongType()),
        T.StructField("credit_operations_count", T.LongType()),
        T.StructField("ch_processed_at", T.TimestampNTZType()),
    ]
)


def as_day(day: date | str) -> date:
    return day if isinstance(day, date) else date.fromisoformat(day)


def _day(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def _midnight(day: date) -> Column:
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")


def latest(value: str, version: str) -> Column:
    """The value of the latest version; equal versions are settled by value.

    Ordering by both keeps a rerun, or a lost and recomputed task, identical.
    """
    return F.max_by(value, F.struct(version, value))


#: Places of an id in a packed number, with one more for a missing id.
_IDS = 2**65
_EARLIEST = 2**58


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def packed_id(value: str, version: str) -> Column:
    """A version's microseconds and an id as one decimal in the order of both, nulls first.

    Unlike a structure a decimal is a value that Spark's hash aggregation can
    update in place, so the latest id needs no sort.  Microseconds of the years 1
    to 9999 take 59 bits, so all of it stays below 38 digits.
    """
    micros = F.unix_micros(F.col(version).cast("timestamp")).cast("decimal(20,0)") + _number(_EARLIEST)
    shifted = F.col(value).cast("decimal(20,0)") + _number(2**63 + 1)
    zero = _number(0)
    high = F.coalesce(micros, zero).cast("decimal(18,0)") * _number(_IDS)
    return (high.cast("decimal(38,0)") + F.coalesce(shifted, zero)).cast("decimal(38,0)")


def unpacked_id(packed: Column) -> Column:
    """The id in a :func:`packed_id`."""
    low = packed % _number(_IDS)
    return F.when(low > 0, low - _number(2**63 + 1)).cast("bigint")


def latest_id(value: str, version: str) -> Column:
    """The id of the latest version; equal versions are settled by id."""
    return unpacked_id(F.max(packed_id(value, version)))


def max_account_id(versions: DataFrame, day: date | str) -> DataFrame:
    """Largest account id opened up to the end of the day, as one row."""
    opened = F.col("open_dt") < _midnight(as_day(day) + timedelta(days=1))
    return versions.where(opened).agg(F.max(KEY).alias("max_account_id"))


def require_max_account_id(versions: DataFrame, day: date | str) -> int:
    found = max_account_id(versions, day).first()["max_account_id"]
    if found is None:
        raise LoadError(f"no {KEY} found through {day}")
    return int(found)


def open_versions(versions: DataFrame, day: date | str) -> DataFrame:
    """Versions of accounts that are open on the day."""
    day = as_day(day)
    return versions.where(
        (F.col("open_dt") < _midnight(day + timedelta(days=1)))
        & ((F.col("close_dt") >= _midnight(day)) | F.col("close_dt").isNull())
    )


def active_accounts(versions: DataFrame, day: date | str) -> DataFrame:
    """Accounts open on the day with the user of their latest version."""
    return open_versions(versions, day).groupBy(KEY).agg(
        latest_id("holder_id", "ch_processed_at").alias("holder_id")
    )


def latest_version(versions: DataFrame) -> DataFrame:
    """Wallet and user of the latest version of every account."""
    return versions.groupBy(KEY).agg(
        latest_id("wallet_id", "ch_processed_at").alias("wallet_id"),
        latest_id("holder_id", "ch_processed_at").alias("holder_id"),
    )


def daily_turnover(turnovers: DataFrame, day: date | str) -> DataFrame:
    """Largest snapshot of each measure on the day, per account."""
    return (
        turnovers.where(F.col("day") == _day(as_day(day)))
        .groupBy(KEY)
        .agg(*[F.max(m).alias(m) for m in MEASURES])
        .withColumn("balance_by_day", F.col("credit_amount") - F.col("debit_amount"))
    )


def previous_balance(balances: DataFrame, day: date | str) -> DataFrame:
    """Balance of exactly the day before; an older one does not count."""
    before = as_day(day) - timedelta(days=1)
    return (
        balances.where(F.col("day") == _day(before))
        .groupBy(KEY)
        .agg(latest("balance", "ch_processed_at").alias("last_balance"))
    )


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast(BALANCE_SCHEMA[name].dataType)).alias(name)


def _cast_result(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in BALANCE_SCHEMA.fields]
    )


def daily_balance(
    versions: DataFrame,
    turnovers: DataFrame,
    balances: DataFrame,
    day: date | str,
    processed_at: str,
    carry: str = "exact",
) -> DataFrame:
    """One row per account open on the day.

    Each side is reduced to one row per account before the joins, and the
    joins reuse the exchanges of those aggregations.  ``carry="exact"`` takes
    the balance of the day before or zero; ``carry="last_known"`` takes the
    latest earlier balance instead.
    """
    day = as_day(day)
    if carry == "exact":
        opening = previous_balance(balances, day)
    elif carry == "last_known":
        opening = (
            balances.where(F.col("day") < _day(day))
            .groupBy(KEY)
            .agg(
                F.max_by("balance", F.struct("day", "ch_processed_at", "balance")).alias(
                    "last_balance"
                )
            )
        )
    else:
        raise SchemaError(f"carry must be 'exact' or 'last_known', not {carry!r}")
    joined = (
        active_accounts(versions, day)
        .join(daily_turnover(turnovers, day), KEY, "left")
        .join(opening, KEY, "left")
    )
    zero = F.lit(0)
    return _cast_result(
        joined.select(
            KEY,
            "holder_id",
            _day(day).alias("day"),
            F.coalesce("balance_by_day", zero).alias("balance_by_day"),
            (F.coalesce("last_balance", zero) + F.coalesce("balance_by_day", zero)).alias("balance"),
            *[_or_zero(m) for m in MEASURES],
            F.lit(processed_at).cast("timestamp_ntz").alias("ch_processed_at"),
        )
    )


def left_any_join(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every left row once, with at most one match: the first by ``order``.

    The right side is cut to one row per key by a hash aggregation (a minimum
    over the ordered row), which combines on the map side, so a key that fills
    a third of the right table never gathers in one task.
    """
    rest = [c for c in right.columns if c != key and c not in order]
    row = F.struct(*order, *rest)
    first = right.groupBy(key).agg(F.min(row).alias("_first")).select(key, "_first.*")
    return left.join(first, key, "left")


def day_list(spark: SparkSession, start: date | str, days: int) -> DataFrame:
    """The given number of consecutive days."""
    if days <= 0:
        raise SchemaError("days must be a positive integer")
    first = as_day(start)
    return spark.range(days).select(
        F.date_add(_day(first), F.col("id").cast("int")).alias("day")
    )


def id_ranges(ids: DataFrame, key: str, count: int, start_id: int = 0) -> DataFrame:
    """Count of ids in each of at most ``count`` equal half-open id ranges.

    Spark's own partitioning replaces such ranges for parallelism; they remain
    useful to look at how ids are spread.
    """
    if count <= 0 or start_id < 0:
        raise SchemaError("count must be positive and start_id non-negative")
    top = ids.agg(F.max(key).alias("top")).first()["top"]
    end = start_id if top is None else max(start_id, int(top) + 1)
    step = max(1, -(-(end - start_id) // count))
    low = start_id + F.floor((F.col(key) - start_id) / step) * step
    return (
        ids.where(F.col(key) >= start_id)
        .groupBy(low.cast("bigint").alias("range_start"))
        .agg(F.count(F.lit(1)).alias("ids"))
        .withColumn("range_end", F.least(F.col("range_start") + step, F.lit(end)).cast("bigint"))
        .select("range_start", "range_end", "ids")
    )


def backfill(
    versions: DataFrame,
    turnovers: DataFrame,
    balances: DataFrame,
    start: date | str,
    days: int,
    processed_at: str,
) -> DataFrame:
    """Balances of consecutive days in one pass.

    Gives what running :func:`daily_balance` day after day gives.  Versions
    and turnovers are first reduced with map-side combining; the reduced rows
    are placed by account once, and everything after that (expanding versions
    to days, picking the latest, the running sum) needs no further exchange.
    An account has at most one row per day by then, so no key can grow hot.
    """
    first = as_day(start)
    if days <= 0:
        raise SchemaError("days must be a positive integer")
    last = first + timedelta(days=days - 1)
    low, high = _day(first), _day(last)

    opened = (
        versions.where(
            (F.col("open_dt") < _midnight(last + timedelta(days=1)))
            & ((F.col("close_dt") >= _midnight(first)) | F.col("close_dt").isNull())
        )
        .select(
            KEY,
            F.greatest(F.to_date("open_dt"), low).alias("from_day"),
            F.least(F.coalesce(F.to_date("close_dt"), high), high).alias("to_day"),
            F.lit(True).alias("is_version"),
            packed_id("holder_id", "ch_processed_at").alias("version"),
            *[F.lit(None).cast(BALANCE_SCHEMA[m].dataType).alias(m) for m in MEASURES],
            F.lit(None).cast("decimal(28,2)").alias("opening"),
        )
        .where("from_day <= to_day")
    )
    moved = turnovers.where(F.col("day").between(low, high)).select(
        KEY,
        F.col("day").alias("from_day"),
        F.col("day").alias("to_day"),
        F.lit(False).alias("is_version"),
        F.lit(None).cast(opened.schema["version"].dataType).alias("version"),
        *[F.col(m).cast(BALANCE_SCHEMA[m].dataType).alias(m) for m in MEASURES],
        F.lit(None).cast("decimal(28,2)").alias("opening"),
    )
    reduced = (
        opened.unionByName(moved)
        .groupBy(KEY, "from_day", "to_day", "is_version")
        .agg(F.max("version").alias("version"), *[F.max(m).alias(m) for m in MEASURES], F.max("opening").alias("opening"))
    )
    seed = previous_balance(balances, first).select(
        KEY,
        low.alias("from_day"),
        low.alias("to_day"),
        F.lit(False).alias("is_version"),
        F.lit(None).cast(opened.schema["version"].dataType).alias("version"),
        *[F.lit(None).cast(BALANCE_SCHEMA[m].dataType).alias(m) for m in MEASURES],
        F.col("last_balance").cast("decimal(28,2)").alias("opening"),
    )
    per_day = (
        reduced.unionByName(seed)
        .repartition(KEY)
        .withColumn("day", F.explode(F.sequence("from_day", "to_day")))
        .groupBy(KEY, "day")
        .agg(
            F.max("is_version").alias("open"),
            F.max("version").alias("version"),
            *[F.max(m).alias(m) for m in MEASURES],
            F.max("opening").alias("opening"),
        )
        .where("open")
        .withColumn(
            "balance_by_day",
            F.coalesce(F.col("credit_amount") - F.col("debit_amount"), F.lit(0).cast(AMOUNT)),
        )
    )
    by_day = Window.partitionBy(KEY).orderBy("day")
    # Consecutive days share an island; a missing day starts a new one at zero.
    island = Window.partitionBy(KEY, "island").orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    change = F.col("balance_by_day") + F.coalesce(F.col("opening"), F.lit(0).cast("decimal(28,2)"))
    return _cast_result(
        per_day.withColumn("island", F.date_sub("day", F.row_number().over(by_day)))
        .withColumn("balance", F.sum(change).over(island))
        .select(
            KEY,
            unpacked_id(F.col("version")).alias("holder_id"),
            "day",
            "balance_by_day",
            "balance",
            *[_or_zero(m) for m in MEASURES],
            F.lit(processed_at).cast("timestamp_ntz").alias("ch_processed_at"),
        )
    )
