"""Recorded calls: documents to rows, block texts to content-addressed blobs and back, request keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import blocks as B
from costproof.runtime import broadcast_if_small
from costproof.functions.stats import row_number_of

# References to one text that a task joins before the text is copied for another.
SHARE = 100_000
BLOCKS = "array<struct<text:string,cache:string>>"
CALL_SCHEMA = f"""
key string, provider string, model string,
request struct<system:{BLOCKS}, messages:array<struct<role:string,blocks:{BLOCKS}>>, tools:string,
  max_tokens:int, temperature:double, stop_sequences:array<string>, prewarm:boolean, sample_index:int>,
response_text string, raw_usage string, usage map<string,bigint>, latency_ms double, ttft_ms double,
stop_reason string, recorded_at timestamp, origin string, error string, attempt int,
provider_cost_usd string
"""


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """One row per recorded call document, with a declared schema (no inference pass)."""
    return spark.read.schema(CALL_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True)


def request_blocks(request: str = "request") -> Column:
    """All blocks of a request in wire order."""
    r = F.col(request)
    return F.concat(
        F.coalesce(r["system"], F.array().cast(BLOCKS)),
        F.flatten(
            F.coalesce(
                F.transform(r["messages"], lambda m: m["blocks"]), F.array().cast(f"array<{BLOCKS}>")
            )
        ),
    )


def call_key(request: str = "request", provider: str = "provider", model: str = "model") -> Column:
    """Digest of a canonical request: fields in sorted order, the sample index only when not zero."""
    r = F.col(request)
    canonical = F.to_json(
        F.struct(
            r["max_tokens"].alias("max_tokens"),
            r["messages"].alias("messages"),
            F.col(model).alias("model"),
            r["prewarm"].alias("prewarm"),
            F.col(provider).alias("provider"),
            F.when(r["sample_index"] != 0, r["sample_index"]).alias("sample_index"),
            r["stop_sequences"].alias("stop_sequences"),
            r["system"].alias("system"),
            r["temperature"].alias("temperature"),
            r["tools"].alias("tools"),
        )
    )
    return F.sha2(canonical, 256)


def prompt_hash(blocks: Column) -> Column:
    """Digest of all block texts joined by a newline."""
    return F.sha2(B.joined(blocks, "\n"), 256)


def dehydrate(prompts: DataFrame, key: str, threshold: int = fixed.BLOB_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(blocks with references, blobs)``: texts over the threshold are kept once per content.

    ``prompts``: key, ``blocks``. A referenced block has a null text and a ``blob`` digest. A prompt without
    blocks keeps one row, without a position.
    """
    rows = prompts.select(key, F.posexplode_outer("blocks").alias("pos", "b"))
    large = F.length("b.text") > threshold
    digest = F.when(large, F.sha2("b.text", 256))
    slim = rows.select(
        key, "pos", F.when(~large, F.col("b.text")).alias("text"), F.col("b.cache").alias("cache"),
        digest.alias("blob"),
    )
    blobs = rows.where(large).select(F.sha2("b.text", 256).alias("blob"), F.col("b.text").alias("body"))
    # Equal digests mean equal texts; one is kept in the map-side combine.
    return slim, blobs.groupBy("blob").agg(F.min("body").alias("body"))


def missing_blobs(slim: DataFrame, blobs: DataFrame) -> DataFrame:
    """References whose text is not in the store."""
    return slim.where(F.col("blob").isNotNull()).select("blob").distinct().join(blobs, "blob", "left_anti")


def rehydrate(slim: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """Blocks with their texts again; a missing text stops the job.

    A text shared by a third of all blocks would be one hot join key: its references are dealt over
    as many copies of it as their number asks for, so a text referenced seldom is copied once.
    """
    uses = slim.where(F.col("blob").isNotNull()).groupBy("blob").agg(
        F.ceil(F.count("*") / SHARE).cast("bigint").alias("_copies")
    )
    many = broadcast_if_small(uses.where(F.col("_copies") > 1))
    spread = F.coalesce("_copies", F.lit(1).cast("bigint"))
    left = slim.join(many, "blob", "left").withColumn("_salt", F.pmod(F.xxhash64(key, "pos"), spread)).drop("_copies")
    copies = F.sequence(F.lit(0).cast("bigint"), spread - 1)
    right = blobs.join(many, "blob", "left").withColumn("_salt", F.explode(copies)).drop("_copies")
    plain = left.where(F.col("blob").isNull()).withColumn("body", F.col("text"))
    filled = left.where(F.col("blob").isNotNull()).join(right, ["blob", "_salt"], "left")
    body = F.coalesce(
        "body", F.raise_error(F.concat(F.lit("missing blob "), F.col("blob"))).cast("string")
    )
    rows = plain.select(key, "pos", "body", "cache").unionByName(
        filled.select(key, "pos", body.alias("body"), "cache")
    )
    return rows.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "body", "cache")))),
            lambda r: F.struct(r["body"].alias("text"), r["cache"].alias("cache")),
        ).alias("blocks")
    )


def store_digest(calls: DataFrame, columns: list[str]) -> DataFrame:
    """One order-free checksum over all rows of a store; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in columns]
    row = row_number_of(F.concat_ws("|", *parts))
    return calls.agg(
        F.count("*").alias("calls"),
        F.bit_xor(row).alias("digest_xor"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest_sum"),
    )


def store_stats(calls: DataFrame) -> DataFrame:
    """Calls by origin and model, with the earliest and latest record time."""
    return calls.groupBy("origin", "model").agg(
        F.count("*").alias("calls"),
        F.min("recorded_at").alias("first_recorded"),
        F.max("recorded_at").alias("last_recorded"),
    )
