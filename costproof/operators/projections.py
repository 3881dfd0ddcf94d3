"""What a recording will cost: from a pilot's real answers, or from counted prompts before any call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof.operators.ranks import running_before


def pilot_projection(calls: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Pilot cost per task scaled to all tasks and inflated by p95 over mean output, never deflated.

    ``calls``: keys, ``task_id, cost, output_tokens``; ``totals``: keys, ``total_tasks``. The p95 is the
    nearest rank, from counted values, so a pilot of any size is spread.
    """
    pilot = calls.groupBy(*keys).agg(
        F.count_distinct("task_id").alias("pilot_tasks"),
        F.sum("cost").alias("pilot_cost"),
        F.count("*").alias("_n"),
        F.avg("output_tokens").alias("mean_output"),
    )
    counts = calls.groupBy(*keys, "output_tokens").agg(F.count("*").alias("_c"))
    ranked = running_before(
        counts, keys, F.floor(F.log2(F.col("output_tokens") + 1) * 64), [F.col("output_tokens")],
        {"_below": F.col("_c")},
    ).join(pilot.select(*keys, "_n"), keys)
    at = F.bround(F.lit(0.95) * (F.col("_n") - 1))
    covers = (F.col("_below") <= at) & (at < F.col("_below") + F.col("_c"))
    p95 = ranked.groupBy(*keys).agg(F.max(F.when(covers, F.col("output_tokens"))).alias("p95_output"))
    inflation = F.when(
        F.col("mean_output") > 0, F.greatest(F.lit(1.0), F.col("p95_output") / F.col("mean_output"))
    ).otherwise(1.0)
    return pilot.drop("_n").join(p95, keys).join(totals, keys).withColumn(
        "projected_cost",
        F.col("pilot_cost") / F.col("pilot_tasks") * F.col("total_tasks") * inflation,
    )


def plan_band(plan: DataFrame) -> DataFrame:
    """Floor and ceiling of each planned step: one prefix write, then reads; the ceiling adds the cap.

    ``plan``: ``total_tokens, base_prefix, base_total, generation_calls, max_tokens`` and prices ``p_*``.
    The prefix share comes from the base counter, the magnitude from the given total.
    """
    share = F.col("base_prefix") / F.col("base_total")
    prefix = F.when(
        (F.col("base_prefix") > 0) & (F.col("base_total") > 0),
        F.least(F.col("total_tokens"), F.bround(F.col("total_tokens") * share).cast("bigint")),
    ).otherwise(F.lit(0).cast("bigint"))
    staged = plan.withColumn("prefix_tokens", prefix).withColumn(
        "prewarm_calls", (F.col("base_prefix") > 0).cast("int")
    )
    calls: Column = F.col("generation_calls")
    floor = (
        F.col("prefix_tokens") * F.col("p_cache_write_5m") * F.col("prewarm_calls")
        + F.col("prefix_tokens") * F.col("p_cache_read") * calls
        + (F.col("total_tokens") - F.col("prefix_tokens")) * F.col("p_input") * calls
    )
    return staged.withColumn("floor_cost", floor).withColumn(
        "ceiling_cost", floor + F.col("max_tokens") * F.col("p_output") * calls
    )
