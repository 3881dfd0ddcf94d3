"""Session defaults and the few runtime helpers shared by the jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

# A side is broadcast only when it is known to be at most this many rows.
BROADCAST_ROWS = 50_000

# Whether the shuffle files of a query go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "costproof", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    Without one a local session takes a temporary folder; on a cluster that would be a folder of one
    machine, so the job stops.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    chosen = named or tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(chosen)
    return chosen


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so that later rounds do not replay it.

    A reliable checkpoint outlives the executors that wrote it, unlike a local one.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed columns in the checkpoint folder, where a checkpoint would hold whole rows.

    Shuffle files that made it are given back as soon as it is written.
    """
    spark, path = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a row check; beyond it the join stays a shuffle join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if small(df, limit) else df


# A side is broadcast only when its rows are known to take at most this many bytes.
BROADCAST_BYTES = 64 << 20


def broadcast_below(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a sum of the rows' sizes in bytes; beyond it the join stays a shuffle join.

    Reads ``df`` once more, so give it a table that is cheap to read, such as one that was cut.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few large input splits over all cores, for per-row text work.

    A table that already has as many partitions as cores is returned as it is, so nothing is
    shuffled where the input is large.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
