"""Load every new file of a folder once, with the same strict conversion."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from truecolumn.operators import load_plan as L
from truecolumn.plans.mapping import ColumnMapping
from truecolumn.sources.csv_text import ReadOptions, header_names, line_options, line_schema, malformed_line


def load_new_files(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    mappings: list[ColumnMapping],
    options: ReadOptions = ReadOptions(),
):
    """Start a stream that appends what is new in ``folder`` to ``target`` and ends.

    Good rows go to ``target/accepted``, refused ones and malformed lines with
    their errors to ``target/refused``.  The checkpoint remembers the files already loaded, so
    a restart neither repeats nor skips one.
    """
    names = header_names(spark, folder, options)
    lines = spark.readStream.schema(line_schema(names)).options(**line_options(options)).csv(folder)
    cells = lines.select(
        *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names],
        malformed_line(names, options.separator).alias(L.BAD_LINE),
    )

    def write(batch, batch_id: int) -> None:
        annotated = L.annotate(batch, mappings).persist()
        try:
            # One folder per batch: repeating a batch replaces its own output.
            part = f"batch_id={batch_id}"
            L.accepted(annotated).write.mode("overwrite").parquet(f"{target}/accepted/{part}")
            L.rejected(annotated).write.mode("overwrite").parquet(f"{target}/refused/{part}")
        finally:
            annotated.unpersist()

    return (
        cells.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
