"""Money: exact column arithmetic over token buckets and price columns.

Two exact money types are supported. ``decimal``: rates are ``decimal(12,6)`` dollars per million
tokens and the result is ``decimal(33,12)`` dollars. ``nano``: rates are whole nano-dollars per token
and the result is a 64-bit integer, which stays inside code generation and is the fast path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costproof import fixed

PER_MILLION = "0.000001"


def _amount(tokens: Column, rate: Column, unit: str) -> Column:
    if unit == "nano":
        return tokens * rate
    return (
        tokens.cast("decimal(12,0)") * rate.cast("decimal(12,6)") * F.lit(PER_MILLION).cast("decimal(7,6)")
    ).cast("decimal(33,12)")


def bucket_cost(
    bucket: str,
    *,
    unit: str = "decimal",
    prefix: str = "",
    batch: bool | Column = False,
    buckets: str = "",
) -> Column:
    """Cost of one bucket. ``prefix`` is put before price column names, ``buckets`` before tokens."""
    amount = _amount(
        F.coalesce(F.col(f"{buckets}{bucket}"), F.lit(0)),
        F.coalesce(F.col(f"{prefix}{fixed.BUCKET_RATE[bucket]}"), F.lit(0)),
        unit,
    )
    if batch is False:
        return amount
    discount = F.lit(1).cast("decimal(3,2)") - F.coalesce(
        F.col(f"{prefix}batch_discount"), F.lit(0)
    ).cast("decimal(3,2)")
    flag = F.lit(True) if batch is True else batch
    discounted = (amount.cast("decimal(33,12)") * discount).cast("decimal(33,12)")
    return F.when(flag, discounted).otherwise(amount.cast("decimal(33,12)"))


def total_cost(
    *, unit: str = "decimal", prefix: str = "", batch: bool | Column = False, media: bool = False
) -> Column:
    """Cost of a call over all billed buckets; a non-zero media bucket is refused."""
    parts = [bucket_cost(b, unit=unit, prefix=prefix, batch=batch) for b in fixed.BILLED_BUCKETS]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    if unit != "nano":
        total = total.cast("decimal(33,12)")
    if not media:
        return total
    priced = F.lit(False)
    for name in fixed.MEDIA_BUCKETS:
        priced = priced | (F.coalesce(F.col(name), F.lit(0)) != 0)
    return F.when(
        priced, F.raise_error(F.lit("image, video and audio tokens are not priced"))
    ).otherwise(total)


def cost_by_bucket(*, unit: str = "decimal", prefix: str = "") -> Column:
    """Map of bucket to cost, non-zero buckets only."""
    entries = [
        F.when(
            F.coalesce(F.col(b), F.lit(0)) != 0,
            F.struct(
                F.lit(b).alias("key"), bucket_cost(b, unit=unit, prefix=prefix).alias("value")
            ),
        )
        for b in fixed.BILLED_BUCKETS
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def cost_formula(by_bucket: Column) -> Column:
    """The non-zero buckets as text, joined by `` + ``."""
    parts = F.transform(
        F.filter(F.map_entries(by_bucket), lambda e: e["value"] != 0),
        lambda e: F.concat(e["key"], F.lit(" x $"), e["value"].cast("string"), F.lit("/Mtok")),
    )
    return F.when(F.size(parts) == 0, F.lit("no billable tokens")).otherwise(
        F.array_join(parts, " + ")
    )


def cost_disagreement(registry: Column, provider: Column) -> Column:
    """Relative gap between the two costs where it is over 2 % in size, else null."""
    gap = (registry - provider) / provider
    return F.when(provider == 0, F.when(registry != 0, F.lit(1.0))).otherwise(
        F.when(F.abs(gap) > F.lit(fixed.COST_DISAGREEMENT), gap.cast("double"))
    )


def worst_case_cost(
    input_tokens: Column, max_output: Column, input_rate: Column, output_rate: Column,
    unit: str = "decimal",
) -> Column:
    """Everything uncached plus a full output cap."""
    return _amount(input_tokens, input_rate, unit) + _amount(max_output, output_rate, unit)


def per_thousand(amount: Column, tasks: Column) -> Column:
    """An amount of one run, scaled to 1,000 tasks; 0 when the run had none."""
    return F.when(tasks > 0, amount * F.lit(1000) / tasks).otherwise(F.lit(0))
