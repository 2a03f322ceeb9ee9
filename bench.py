"""Timings of the main queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs twice and the better run counts.  ``rows_per_sec`` relates the
time to the rows of the input table.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from registry import QUERIES, inputs  # noqa: E402
from registry.loading import _csv_copy  # noqa: E402
from truecolumn.operators import infer, load_plan, profile, validate  # noqa: E402
from truecolumn.operators.blocks import (  # noqa: E402
    DEFAULT_BLOCK_BYTES,
    block_totals,
    json_lines,
    pack_blocks,
)
from truecolumn.plans.mapping import ColumnMapping  # noqa: E402
from truecolumn.session import prepare, scratch_path, spread  # noqa: E402
from truecolumn.sinks import tables  # noqa: E402
from truecolumn.sources import csv_text  # noqa: E402

REGISTERED = (
    "daily_balance", "balance_backfill", "latest_version", "left_any_join", "duplicate_keys",
    "infer_types", "json_rows", "pack_blocks", "reject_report", "mojibake_score",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    best = None
    for _ in range(2):
        began = time.perf_counter()
        action()
        spent = time.perf_counter() - began
        best = spent if best is None else min(best, spent)
    return round(best, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)

    items = inputs.table(spark, folder, "lineitem")
    rows = items.count()
    # The file a user would load: all columns as delimited text.
    text_path = _csv_copy(spark, items.repartition(int(cpus)))
    text = csv_text.read_text_table(spark, text_path)
    mappings = [
        ColumnMapping("l_orderkey", "l_orderkey", "UInt64"),
        ColumnMapping("l_partkey", "l_partkey", "UInt64"),
        ColumnMapping("l_suppkey", "l_suppkey", "UInt32"),
        ColumnMapping("l_linenumber", "l_linenumber", "UInt8"),
        ColumnMapping("l_quantity", "l_quantity", "Decimal(18, 2)"),
        ColumnMapping("l_extendedprice", "l_extendedprice", "Decimal(18, 2)"),
        ColumnMapping("l_discount", "l_discount", "Float64"),
        ColumnMapping("l_tax", "l_tax", "Float64"),
        ColumnMapping("l_returnflag", "l_returnflag", "String"),
        ColumnMapping("l_linestatus", "l_linestatus", "LowCardinality(String)"),
        ColumnMapping("l_shipdate", "l_shipdate", "DateTime"),
    ]
    typed = load_plan.apply_mapping(text, mappings)
    one_column = items.select("l_orderkey")

    loading = {
        "csv_scan": lambda: run(text),
        "csv_profile": lambda: profile.profile(text).collect(),
        "csv_infer_mapping": lambda: infer.infer_mapping(text),
        "csv_convert": lambda: run(typed),
        "csv_validate": lambda: validate.validate(text, mappings, DEFAULT_BLOCK_BYTES).collect(),
        "json_one_column": lambda: run(json_lines(one_column)),
        "json_all_columns": lambda: run(json_lines(typed)),
        "pack_partitions": lambda: block_totals(pack_blocks(json_lines(spread(items)))).collect(),
        "load_parquet": lambda: tables.write_folder(typed, scratch_path(spark, "bench")),
    }
    seconds = {name: timed(action) for name, action in loading.items()}
    for name in REGISTERED:
        seconds[name] = timed(lambda: run(QUERIES[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "rows": rows,
                "rows_per_sec": {name: int(rows / seconds[name]) for name in loading},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
