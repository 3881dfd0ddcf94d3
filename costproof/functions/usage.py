"""Provider usage payloads to one set of token buckets.

A payload is read with a declared schema. Fields of the wrong type, negative remainders and parts
that do not add up are never guessed at: the row gets a ``usage_error`` text and null buckets, so a
caller can quarantine it or stop (``require_clean``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof import fixed

_NUMBERS = (
    "input_tokens",
    "cache_read_input_tokens",
    "cache_creation_input_tokens",
    "output_tokens",
    "prompt_tokens",
    "completion_tokens",
    "prompt_cache_hit_tokens",
    "prompt_cache_miss_tokens",
)
_SCHEMA = (
    ", ".join(f"{name} DOUBLE" for name in _NUMBERS)
    + ", cache_creation STRUCT<ephemeral_5m_input_tokens: DOUBLE, ephemeral_1h_input_tokens: DOUBLE>"
    + ", prompt_tokens_details STRUCT<cached_tokens: DOUBLE>"
    + ", completion_tokens_details STRUCT<reasoning_tokens: DOUBLE>"
    + ", _corrupt_record STRING"
)
MAPPINGS = ("anthropic", "openai", "deepseek", "openrouter")


def _whole(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)).cast("bigint")


def _first_error(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


# What the three shapes call the same numbers; a shape without one has none of it.
_EXCLUSIVE, _INCLUSIVE, _HIT_MISS = 1, 2, 3


def _read(p: Column, shape: Column) -> dict[str, Column]:
    """The payload's numbers by their part in any shape, as whole numbers."""

    def by_shape(exclusive: Column | None, inclusive: Column | None, hit_miss: Column | None) -> Column:
        picked = F.when(shape == _EXCLUSIVE, exclusive if exclusive is not None else F.lit(0.0))
        picked = picked.when(shape == _INCLUSIVE, inclusive if inclusive is not None else F.lit(0.0))
        return _whole(picked.when(shape == _HIT_MISS, hit_miss if hit_miss is not None else F.lit(0.0)))

    completion, reasoning = p["completion_tokens"], p["completion_tokens_details"]["reasoning_tokens"]
    split = (shape == _EXCLUSIVE) & p["cache_creation"].isNotNull()
    return {
        "_usage_input": by_shape(p["input_tokens"], p["prompt_tokens"], p["prompt_cache_miss_tokens"]),
        "_usage_cached": by_shape(p["cache_read_input_tokens"], p["prompt_tokens_details"]["cached_tokens"], p["prompt_cache_hit_tokens"]),
        "_usage_created": by_shape(p["cache_creation_input_tokens"], None, None),
        "_usage_five": _whole(F.when(split, p["cache_creation"]["ephemeral_5m_input_tokens"])),
        "_usage_hour": _whole(F.when(split, p["cache_creation"]["ephemeral_1h_input_tokens"])),
        "_usage_parts": F.coalesce(split, F.lit(False)),
        "_usage_stated": F.when(shape == _HIT_MISS, p["prompt_tokens"]).cast("bigint"),
        "_usage_out": by_shape(p["output_tokens"], completion, completion),
        "_usage_thought": by_shape(None, reasoning, reasoning),
    }


def _exclusive_error() -> Column:
    """Input counts only what follows the last breakpoint; writes may be split by lifetime."""
    created = F.col("_usage_created")
    return _first_error(
        (F.col("_usage_input") < 0, "input_uncached is negative"),
        (F.col("_usage_cached") < 0, "cache_read is negative"),
        (created < 0, "cache_creation_input_tokens is negative"),
        (F.col("_usage_parts") & (created != 0) & (F.col("_usage_five") + F.col("_usage_hour") != created), "cache write split does not add up"),
        (F.col("_usage_out") < 0, "output_visible is negative"),
    )


def _inclusive_error() -> Column:
    """Prompt includes the cached part and completion includes reasoning: subtract both."""
    return _first_error(
        (F.col("_usage_input") < 0, "prompt_tokens is negative"),
        (F.col("_usage_out") < 0, "completion_tokens is negative"),
        (F.col("_usage_input") - F.col("_usage_cached") < 0, "cached_tokens exceeds prompt_tokens"),
        (F.col("_usage_out") - F.col("_usage_thought") < 0, "reasoning_tokens exceeds completion_tokens"),
    )


def _hit_miss_error() -> Column:
    """Hits and misses partition the prompt."""
    parts = F.col("_usage_cached") + F.col("_usage_input")
    prompt = F.coalesce("_usage_stated", parts)
    return _first_error(
        (F.col("_usage_cached") < 0, "prompt_cache_hit_tokens is negative"),
        (F.col("_usage_input") < 0, "prompt_cache_miss_tokens is negative"),
        ((prompt != 0) & (parts != prompt), "hits and misses do not sum to prompt_tokens"),
        (F.col("_usage_out") < 0, "completion_tokens is negative"),
        (F.col("_usage_out") - F.col("_usage_thought") < 0, "output_visible is negative"),
    )


def normalize_usage(df: DataFrame, mapping: str = "mapping", raw: str = "raw") -> DataFrame:
    """Add the nine buckets, their sources, the gateway's own cost and ``usage_error``.

    ``mapping`` names the payload shape of each row, so one scan serves every provider.
    """
    p, shape = F.col("_payload"), F.col("_usage_shape")
    # A field that is there but null still makes the shape; only one mapping asks.
    named = F.arrays_overlap(
        F.json_object_keys(F.col(raw)),
        F.array(F.lit("prompt_cache_hit_tokens"), F.lit("prompt_cache_miss_tokens")),
    )
    kind = (
        F.when(F.col(mapping) == "anthropic", _EXCLUSIVE)
        .when(F.col(mapping).isin("openai", "openrouter"), _INCLUSIVE)
        .when(F.col(mapping) == "deepseek", F.when(named, _HIT_MISS).otherwise(_INCLUSIVE))
    )
    own_cost = F.when(F.col(mapping) == "openrouter", F.get_json_object(F.col(raw), "$.cost"))
    # Numbers, then errors, then buckets: each step's code stays below the 8,000 bytes that the JVM compiles.
    parsed = df.withColumns({"_payload": F.from_json(F.col(raw), _SCHEMA), "_usage_shape": kind, "_cost": own_cost})
    parsed = parsed.withColumns(
        {
            **_read(p, shape),
            "_usage_unread": F.col(raw).isNull() | p["_corrupt_record"].isNotNull(),
            "_usage_dollars": F.col("_cost").try_cast("decimal(24,12)"),
        }
    )
    error = (
        F.when(shape.isNull(), F.lit("unknown mapping"))
        .when(F.col("_usage_unread"), F.lit("malformed payload"))
        .when(F.col("_cost").isNotNull() & F.col("_usage_dollars").isNull(), F.lit("cost is not a number"))
        .when(shape == _EXCLUSIVE, _exclusive_error())
        .when(shape == _INCLUSIVE, _inclusive_error())
        .otherwise(_hit_miss_error())
    )
    out = parsed.withColumn("usage_error", error)
    clean = F.col("usage_error").isNull()
    less = lambda whole, part: F.col(whole) - F.when(shape == _INCLUSIVE, F.col(part)).otherwise(0)
    buckets = {
        "input_uncached": less("_usage_input", "_usage_cached"),
        "cache_write_5m": F.when(F.col("_usage_parts"), F.col("_usage_five")).otherwise(F.col("_usage_created")),
        "cache_write_1h": F.col("_usage_hour"),
        "cache_read": F.col("_usage_cached"),
        "output_visible": F.col("_usage_out") - F.col("_usage_thought"),
        "output_reasoning": F.col("_usage_thought"),
    }
    none = F.lit(0).cast("bigint")
    out = out.withColumns({name: F.when(clean, buckets.get(name, none)) for name in fixed.BUCKETS})
    estimated = ~F.col("_usage_parts")
    source = F.map_from_entries(
        F.filter(
            F.array(
                *[
                    F.when(
                        F.col(name) != 0,
                        F.struct(
                            F.lit(name).alias("key"),
                            (
                                F.when(estimated, F.lit("estimated")).otherwise(
                                    F.lit("provider")
                                )
                                if name == "cache_write_5m"
                                else F.lit("provider")
                            ).alias("value"),
                        ),
                    )
                    for name in fixed.BUCKETS
                ]
            ),
            lambda e: e.isNotNull(),
        )
    )
    out = out.withColumn("usage_sources", F.when(clean, source)).withColumn(
        "provider_cost_usd", F.when(clean, F.col("_usage_dollars"))
    )
    return out.drop("_payload", "_usage_shape", "_cost", "_usage_unread", "_usage_dollars", *_read(p, shape))


def require_clean(df: DataFrame) -> DataFrame:
    """Stop the job at the first row whose usage could not be mapped."""
    checked = F.when(
        F.col("usage_error").isNotNull(),
        F.raise_error(F.concat(F.lit("usage could not be mapped: "), F.col("usage_error"))),
    ).otherwise(F.col("usage_error"))
    return df.withColumn("usage_error", checked)


def total_input() -> Column:
    """Every input token the request carried, cached or not."""
    return sum((F.col(b) for b in fixed.INPUT_BUCKETS[1:]), F.col(fixed.INPUT_BUCKETS[0]))


def total_output() -> Column:
    """Visible plus reasoning; both bill at the output rate."""
    return F.col("output_visible") + F.col("output_reasoning")


def usage_source(sources: Column, has_payload: Column) -> Column:
    """``provider``, ``estimated`` or ``mixed``, from the non-zero buckets' sources."""
    kinds = F.array_distinct(F.map_values(sources))
    return (
        F.when(F.size(kinds) > 1, F.lit("mixed"))
        .when(F.size(kinds) == 1, F.element_at(kinds, 1))
        .when(has_payload, F.lit("provider"))
        .otherwise(F.lit("estimated"))
    )


def sum_usage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket sums by ``keys``; a bucket is ``provider`` only if every part that named one was."""
    sums = [F.sum(b).alias(b) for b in fixed.BUCKETS]
    marks = [
        F.bool_or(F.col("usage_sources")[b] == "estimated").alias(f"_est_{b}")
        for b in fixed.BUCKETS
    ] + [
        F.bool_or(F.col("usage_sources")[b].isNotNull()).alias(f"_has_{b}") for b in fixed.BUCKETS
    ]
    out = df.groupBy(*keys).agg(*sums, *marks)
    entries = F.filter(
        F.array(
            *[
                F.when(
                    F.col(f"_has_{b}"),
                    F.struct(
                        F.lit(b).alias("key"),
                        F.when(F.col(f"_est_{b}"), F.lit("estimated"))
                        .otherwise(F.lit("provider"))
                        .alias("value"),
                    ),
                )
                for b in fixed.BUCKETS
            ]
        ),
        lambda e: e.isNotNull(),
    )
    return out.select(
        *keys, *fixed.BUCKETS, F.map_from_entries(entries).alias("usage_sources")
    )
