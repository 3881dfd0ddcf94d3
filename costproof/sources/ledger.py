"""The ledger on disk: parquet partitioned by run, replaced and erased one run at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = ("prompt_text", "response_text", "request_json", "raw_response")


def write_run(rows: DataFrame, path: str) -> None:
    """Write run rows; a run already there is replaced, every other run is left alone."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def erase_content(spark: SparkSession, path: str, run_ids: list[str], staging: str) -> int:
    """Null the texts of some runs and keep every number; returns the rows touched.

    The new rows are written beside the ledger first, because a partition cannot be read and
    overwritten in one job.
    """
    ledger = spark.read.parquet(path)
    mine = ledger.where(F.col("run_id").isin(*run_ids))
    for name in CONTENT:
        if name in ledger.columns:
            mine = mine.withColumn(name, F.lit(None).cast(ledger.schema[name].dataType))
    mine.withColumn("content_erased", F.lit(True)).write.mode("overwrite").partitionBy("run_id").parquet(staging)
    erased = spark.read.parquet(staging)
    write_run(erased, path)
    return erased.count()


def erase_runs(table: DataFrame, runs: DataFrame) -> DataFrame:
    """A table without the listed runs."""
    return table.join(runs.select("run_id").distinct(), "run_id", "left_anti")


def write_queue(queue: DataFrame, path: str) -> None:
    """The review queue as JSON lines."""
    queue.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
