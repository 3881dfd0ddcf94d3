"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof.runtime import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here.

    Row ids and names drawn while the table is made are fixed from here on, whatever executor is
    lost later.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sha256_hex(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_below(df: DataFrame, size: Column, limit: int = 64 << 20) -> DataFrame:
    """A broadcast hint where the rows' sizes, in bytes, add up to ``limit`` at most; else ``df`` as it is."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def key_of(doc_id: str, text: str) -> Column:
    """What rows are found again by: their id, which may be null, and 128 bits of their text."""
    halves = [F.xxhash64(F.lit(seed), F.col(text)).alias(f"h{seed}") for seed in (1, 2)]
    return F.struct(F.col(doc_id).alias("id"), *halves)


def only(docs: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose key is in the single column of ``keys``; of rows with equal keys one."""
    (key,) = unused(docs, "key")
    keyed = docs.withColumn(key, key_of(doc_id, text))
    return keyed.join(keys.toDF(key), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
