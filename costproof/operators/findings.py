"""Waste found in recorded calls: one aggregation per run, one row per finding.

Text that all calls of a run share is measured against the run's first call: each call gives the lengths
it has in common with it from either end, and the run's are the smallest. Lengths merge in any order, so
no text of a call is ever moved or kept in an aggregate; only one row of texts per run is sent out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import blocks, pricing, stats, usage
from costproof.runtime import broadcast_below, cut, written

FINDING_COLUMNS = ("rule", "group", "per_1k", "confidence", "evidence")


def weighted(per_1k: Column, confidence: Column) -> Column:
    """Dollars weighted by how sure the finding is."""
    weight = F.lit(None).cast("double")
    for name, value in fixed.CONFIDENCE_WEIGHT.items():
        weight = F.when(confidence == name, F.lit(float(value))).otherwise(weight)
    return per_1k * weight


def rank(findings: DataFrame, keys: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Findings by weighted dollars, then rule; with ``top`` the first few of each group."""
    scored = findings.withColumn("weighted", weighted(F.col("per_1k"), F.col("confidence")))
    if top is None:
        # A sort of a whole table reads it twice, for the bounds of its ranges and for the rows; findings are costly to make.
        return written(scored).orderBy(F.col("weighted").desc(), "rule", *(keys or []))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("weighted").desc(), "rule", F.col("evidence"))
    # A ranked filter: Spark keeps ``top`` rows of a group before it moves any.
    return scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top).drop("_place")


def total_projected(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of projected savings by group: an upper bound, because fixes overlap."""
    return findings.groupBy(*keys).agg(F.sum("per_1k").alias("upper_bound_per_1k"))


def first_calls(calls: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of each group's first row by the total ``order`` column, as ``first``."""
    least = calls.groupBy(*keys).agg(F.min("order").alias("order"))
    rows = calls.join(least, [*keys, "order"], "left_semi").select(*keys, F.struct(*columns).alias("first"))
    return cut(rows.dropDuplicates(keys))


def beside_first(calls: DataFrame, first: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``calls`` with the texts of their group's first call, broadcast behind a sum of their bytes."""
    size = sum((F.coalesce(F.octet_length(F.col("first")[c]), F.lit(0)) for c in columns), F.lit(64))
    return calls.join(broadcast_below(first, size), keys)


def common_lengths(text: Column, first: Column) -> list[Column]:
    """Aggregates: characters that every text of a group shares with its first one, from either end."""
    return [
        F.min(blocks.common_prefix_length(text, first)).alias("prefix_chars"),
        F.min(blocks.common_suffix_length(text, first)).alias("suffix_chars"),
    ]


def shared_text(calls: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Length of the longest prefix and suffix that every text of a group shares; ``order`` names the first."""
    beside = beside_first(calls, first_calls(calls, keys, [text]), keys, [text])
    return beside.groupBy(*keys).agg(*common_lengths(F.col(text), F.col("first")[text]))


def run_profile(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Everything the run-level rules need, in one aggregation of numbers over real calls.

    ``calls``: keys, ``task_id, attempt, error, system_text, user_text, static_prefix, cost``, the
    token buckets, and a total ``order`` column naming the first call. ``repeated_chars`` is the longest
    text of 400 or more characters that is in every call and outside the first call's prefix: its
    system or user text, or what all calls begin or end with.
    """
    columns = ["system_text", "user_text", "static_prefix"]
    firsts = first_calls(calls, keys, columns)
    beside = beside_first(calls, firsts, keys, columns)
    whole = lambda s, u: F.concat_ws("\n", s, u)
    first = F.col("first")
    texts = beside.withColumn("_text", whole(F.col("system_text"), F.col("user_text"))).withColumn(
        "_first", whole(first["system_text"], first["user_text"])
    )
    text = F.col("_text")
    prefix_key = F.when(F.col("static_prefix") != "", F.sha2("static_prefix", 256))

    def outside(candidate: Column) -> Column:
        """Length of a text that counts as repeated, if every call holds it."""
        counts = (F.length(candidate) >= fixed.REPEATED_BLOCK_CHARS) & ~first["static_prefix"].contains(candidate)
        return F.when(F.coalesce(counts, F.lit(False)), F.length(candidate)).otherwise(0)

    g = texts.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum("cost").alias("cost"),
        F.sum("cache_read").alias("cache_reads"),
        F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cache_writes"),
        F.avg(usage.total_input()).alias("mean_input"),
        F.avg(usage.total_output()).alias("mean_output"),
        F.avg(F.length("system_text") + F.length("user_text") + 1).alias("mean_chars"),
        F.count_distinct(prefix_key).alias("prefixes"),
        F.sum((F.col("attempt") > 1).cast("int")).alias("retries"),
        F.sum(F.when(F.col("attempt") > 1, F.col("cost")).otherwise(0)).alias("retry_cost"),
        F.sum(F.col("error").isNotNull().cast("int")).alias("failures"),
        F.min(F.when(text.contains(first["system_text"]), outside(first["system_text"])).otherwise(0)).alias("_system"),
        F.min(F.when(text.contains(first["user_text"]), outside(first["user_text"])).otherwise(0)).alias("_user"),
        *common_lengths(text, F.col("_first")),
    )
    opening = whole(first["system_text"], first["user_text"])
    start = F.left(opening, F.col("prefix_chars"))
    end = F.when(F.col("suffix_chars") > 0, F.right(opening, F.col("suffix_chars"))).otherwise("")
    return g.join(firsts, keys).select(
        *g.columns,
        (first["static_prefix"] != "").alias("has_prefix"),
        F.greatest("_system", "_user", outside(start), outside(end)).alias("repeated_chars"),
    ).drop("_system", "_user")


def _finding(rule: str, group: str, fires: Column, amount: Column, confidence: str, evidence: Column) -> Column:
    return F.when(
        fires,
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(group).alias("group"),
            amount.cast("double").alias("per_1k"),
            F.lit(confidence).alias("confidence"),
            evidence.alias("evidence"),
        ),
    )


def workload_findings(
    calls: DataFrame, runs: DataFrame, keys: list[str], scale: float = 1.0
) -> DataFrame:
    """Rules over each run's real calls.

    ``runs``: keys, ``task_count, needed_output_tokens, latency_sensitive, total_cost`` and the price
    columns. ``scale`` turns ``tokens x rate`` into money (1e-6 for dollars per million tokens).
    """
    joined = run_profile(calls, keys).join(runs, keys)
    k = F.lit(float(scale))
    saving = (F.col("input") - F.col("cache_read_rate")).cast("double") * k
    per_task = F.when(F.col("task_count") > 0, F.lit(1000.0) / F.col("task_count")).otherwise(0.0)
    mean_input = F.floor("mean_input")
    shared_tokens = F.floor(
        mean_input * F.col("prefix_chars") / F.when(F.col("mean_chars") > 0, F.col("mean_chars")).otherwise(1.0)
    )
    strandable = F.greatest(F.lit(0), mean_input - shared_tokens)
    has_prefix = F.col("has_prefix")
    moving = has_prefix & (
        F.col("prefixes") > F.greatest(F.lit(1), F.floor(F.col("calls") / 10))
    )
    unread = has_prefix & (F.col("prefixes") == 1) & (F.col("cache_reads") == 0) & (
        F.col("cache_writes") > 0
    )
    early = (
        (F.col("cache_reads") == 0)
        & (strandable > shared_tokens)
        & (strandable > fixed.STRANDED_TOKENS)
    )
    written = F.col("cache_writes") * F.col("cache_write_5m_rate").cast("double") * k * per_task
    stranded = strandable * saving * 1000
    excess = F.bround(F.col("mean_output") - F.col("needed_output_tokens"))
    rules = [
        _finding(
            "W01", "Cache",
            (F.col("repeated_chars") > 0) & (F.col("cache_reads") == 0),
            mean_input * saving * 1000, "measured",
            F.format_string("%d calls, %d shared characters", "calls", F.col("repeated_chars").cast("int")),
        ),
        _finding(
            "W02", "Cache", moving | unread | early,
            F.when(moving | unread, written).otherwise(stranded), "measured",
            F.when(moving, F.lit("the prefix changes between calls"))
            .when(unread, F.lit("written on every call and never read"))
            .otherwise(F.lit("requests diverge before the content worth caching")),
        ),
        _finding(
            "W03", "C",
            (F.col("needed_output_tokens") > 0)
            & (F.col("mean_output") > F.col("needed_output_tokens") * fixed.OUTPUT_EXCESS_FACTOR),
            excess * F.col("output").cast("double") * k * 1000, "measured",
            F.format_string("mean output %.0f tokens", "mean_output"),
        ),
        _finding(
            "W05", "Cache",
            ~F.col("latency_sensitive") & (F.col("batch_discount") > 0),
            F.col("total_cost").cast("double") * F.col("batch_discount").cast("double") * per_task,
            "projected", F.lit("no latency requirement declared"),
        ),
        _finding(
            "W06", "Cache",
            (F.col("retries") > 0) | (F.col("failures") > 0),
            F.col("retry_cost").cast("double") * per_task, "measured",
            F.format_string("%d retried, %d failed", "retries", "failures"),
        ),
    ]
    return joined.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("_f")).select(
        *keys, "_f.*"
    )


def cheaper_tier(arms: DataFrame, dearest: str, cheap: str) -> DataFrame:
    """Share of tasks both tiers get right and what routing them would save, per 1,000 tasks.

    The caller passes calibration rows: this finding must not be quoted from the test split. The
    pairing is one aggregation by task.
    """
    is_dear, is_cheap = F.col("pipeline") == dearest, F.col("pipeline") == cheap
    by_task = arms.where(is_dear | is_cheap).groupBy("task_id").agg(
        F.max(F.when(is_dear, F.col("correct"))).alias("_d"),
        F.max(F.when(is_cheap, F.col("correct"))).alias("_c"),
        F.sum(F.when(is_dear, F.col("cost"))).alias("_dc"),
        F.sum(F.when(is_cheap, F.col("cost"))).alias("_cc"),
    )
    s = by_task.agg(
        F.sum(((F.col("_d") == 1) & (F.col("_c") == 1)).cast("bigint")).alias("both_right"),
        F.count("_d").alias("n"),
        F.count("_c").alias("m"),
        F.sum("_dc").alias("dear"),
        F.sum("_cc").alias("low"),
    )
    share = F.col("both_right") / F.col("n")
    gap = F.col("dear") / F.col("n") - F.coalesce(F.col("low") / F.col("m"), F.lit(0))
    return s.select(
        "both_right", "n", share.alias("share"),
        F.when((F.col("both_right") > 0) & (F.col("n") > 0), gap * share * 1000)
        .cast("double")
        .alias("per_1k"),
    )


def scale_to_1k(amount: Column, tasks: Column) -> Column:
    """An amount per 1,000 tasks; 0 without tasks."""
    return pricing.per_thousand(amount, tasks)


__all__ = [
    "FINDING_COLUMNS", "cheaper_tier", "rank", "run_profile", "scale_to_1k",
    "shared_text", "stats", "total_projected", "weighted", "workload_findings",
]
