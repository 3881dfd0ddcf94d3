"""Price lists: official rows, gateway listings, their merge, and content-addressed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costproof import fixed

MONEY = "decimal(12,6)"


def load_prices(raw: DataFrame) -> DataFrame:
    """Fill absent cache rates from the input price and say so in the note.

    ``raw``: ``model, provider, input, output`` and nullable cache rates, discount, minimum, note.
    """
    out, derived = raw, []
    for name, multiple in fixed.CACHE_MULTIPLES.items():
        absent = F.col(name).isNull()
        derived.append(F.when(absent, F.lit(name)))
        filled = F.coalesce(
            F.col(name).cast(MONEY), (F.col("input").cast(MONEY) * F.lit(multiple).cast("decimal(4,2)")).cast(MONEY)
        )
        out = out.withColumn(f"_f_{name}", filled)
    names = F.array_compact(F.array(*derived))
    note = F.when(
        F.size(names) > 0,
        F.concat_ws("; ", "note", F.concat(F.array_join(names, ", "), F.lit(" derived from input"))),
    ).otherwise(F.col("note"))
    out = out.withColumn("note", note)
    for name in fixed.CACHE_MULTIPLES:
        out = out.withColumn(name, F.col(f"_f_{name}")).drop(f"_f_{name}")
    return (
        out.withColumn("input", F.col("input").cast(MONEY))
        .withColumn("output", F.col("output").cast(MONEY))
        .withColumn("batch_discount", F.coalesce(F.col("batch_discount"), F.lit(0)).cast("decimal(3,2)"))
    )


def parse_listing(listing: DataFrame, column: str = "payload") -> DataFrame:
    """A gateway's model listing: per-token texts to per-million rates, unusable models skipped.

    Every row is unverified: a gateway reports what it charges, not what the provider publishes.
    """
    schema = (
        "struct<data:array<struct<id:string,name:string,context_length:bigint,pricing:struct<prompt:string,"
        "completion:string,input_cache_read:string,input_cache_write:string>>>>"
    )
    item = F.col("_i")
    rate = lambda c: (
        F.coalesce(c, F.lit("0")).try_cast("decimal(24,15)") * F.lit(1000000)
    ).cast(MONEY)
    rows = listing.select(F.explode(F.from_json(column, schema)["data"]).alias("_i"))
    p = item["pricing"]
    return rows.where(item["id"].isNotNull() & p.isNotNull()).select(
        item["id"].alias("model"),
        F.when(item["id"].contains("/"), F.substring_index(item["id"], "/", 1))
        .otherwise("openrouter")
        .alias("provider"),
        rate(p["prompt"]).alias("input"),
        rate(p["completion"]).alias("output"),
        rate(p["input_cache_write"]).alias("cache_write_5m"),
        F.lit(0).cast(MONEY).alias("cache_write_1h"),
        rate(p["input_cache_read"]).alias("cache_read"),
        F.lit(False).alias("verified"),
    ).where(
        F.col("input").isNotNull() & F.col("output").isNotNull() & ((F.col("input") > 0) | (F.col("output") > 0))
    )


def merge_registry(official: DataFrame, listing: DataFrame) -> DataFrame:
    """Official prices win over listing prices by model."""
    rest = listing.join(official.select("model"), "model", "left_anti")
    return official.unionByName(rest, allowMissingColumns=True)


def snapshot_id(prices: DataFrame) -> DataFrame:
    """16 hex digits over the sorted price rows of a snapshot; a price list is small."""
    fields = ["input", "output", "cache_write_5m", "cache_write_1h", "cache_read", "batch_discount", "verified"]
    row = F.struct("model", *[F.col(c).cast("string").alias(c) for c in fields if c in prices.columns])
    return prices.agg(
        F.substring(F.sha2(F.to_json(F.sort_array(F.collect_list(row))), 256), 1, 16).alias("snapshot_id")
    )


def snapshot_age_days(taken, today):
    """Age of a price list in days; null when undated."""
    return F.datediff(today, taken)
