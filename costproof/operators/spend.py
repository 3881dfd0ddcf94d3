"""Pricing calls and rolling spend up.

Prices are a small dimension: the join is broadcast only behind a row check, and a call without a
price stops the job instead of vanishing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof import fixed
from costproof.operators.ranks import exact_quantiles
from costproof.functions import pricing, usage
from costproof.runtime import broadcast_if_small

RATE_COLUMNS = ("input", "output", "cache_write_5m", "cache_write_1h", "cache_read")


def price_calls(
    calls: DataFrame,
    prices: DataFrame,
    on: list[str] | None = None,
    unit: str = "decimal",
    batch: bool | Column = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Calls with ``cost``, from the price row of their model (and snapshot).

    ``keep`` names price columns carried along. Unknown models are an error naming the model.
    """
    on = on or ["model"]
    extra = [c for c in ("batch_discount",) if c in prices.columns]
    carried = [c for c in (keep or []) if c not in extra]
    side = prices.select(
        *on,
        *[F.col(c).alias(f"_p_{c}") for c in (*RATE_COLUMNS, *extra)],
        *carried,
        F.lit(True).alias("_priced"),
    )
    joined = calls.join(broadcast_if_small(side), on, "left")
    cost = F.when(F.col("_priced"), pricing.total_cost(unit=unit, prefix="_p_", batch=batch)).otherwise(
        F.raise_error(F.concat(F.lit("no price for "), F.concat_ws("/", *[F.col(c) for c in on])))
    )
    out = joined.withColumn("cost", cost)
    return out.drop("_priced", *[f"_p_{c}" for c in (*RATE_COLUMNS, *extra)])


def unpriced_models(calls: DataFrame, prices: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Models that have calls and no price."""
    on = on or ["model"]
    return calls.select(*on).distinct().join(prices.select(*on), on, "left_anti")


def prices_as_of(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with the price row of its model that was valid on its day.

    Price lists are turned into validity ranges once (small), then joined on model and range; the
    call side is never sorted or grouped.
    """
    order = Window.partitionBy("model").orderBy("taken")
    ranges = prices.withColumn("_until", F.lead("taken").over(order)).select(
        F.col("model").alias("_model"),
        F.col("taken").alias("price_taken"),
        "_until",
        *[F.col(c).alias(f"_p_{c}") for c in RATE_COLUMNS],
    )
    condition = (
        (F.col("model") == F.col("_model"))
        & (F.col("day") >= F.col("price_taken"))
        & (F.col("_until").isNull() | (F.col("day") < F.col("_until")))
    )
    return calls.join(broadcast_if_small(ranges), condition, "left").drop("_model", "_until")


def real_calls(calls: DataFrame) -> DataFrame:
    """Calls that count in per-call statistics: pre-warm calls are left out (not of total cost)."""
    return calls.where(~F.col("prewarm"))


def spend_rollup(priced: DataFrame, dimensions: list[str]) -> DataFrame:
    """Spend by every single dimension and in total, by grouping sets.

    ``share`` is of the grand total. One scan; partial sums before the shuffle.
    """
    exprs = [
        F.sum("cost").alias("cost"),
        F.count("*").alias("calls"),
        F.sum(F.when(F.col("scarce"), F.col("cost")).otherwise(0)).alias("scarce_cost"),
        F.grouping_id(*dimensions).alias("_level"),
    ]
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = priced.groupingSets(sets, *dimensions).agg(*exprs)
    full = 2 ** len(dimensions) - 1
    dimension = F.lit(None).cast("string")
    member = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        level = full - 2 ** (len(dimensions) - 1 - i)
        dimension = F.when(F.col("_level") == level, F.lit(d)).otherwise(dimension)
        member = F.when(F.col("_level") == level, F.col(d).cast("string")).otherwise(member)
    long = grouped.select(
        F.when(F.col("_level") == full, "total").otherwise(dimension).alias("dimension"),
        F.when(F.col("_level") == full, "all").otherwise(member).alias("member"),
        "calls",
        "cost",
        "scarce_cost",
    )
    total = long.where(F.col("dimension") == "total").select(F.col("cost").alias("_total"))
    return long.crossJoin(F.broadcast(total)).select(
        "dimension",
        "member",
        "calls",
        "cost",
        "scarce_cost",
        F.when(F.col("_total") != 0, F.col("cost") / F.col("_total"))
        .otherwise(0.0)
        .cast("double")
        .alias("share"),
    )


def run_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, cost and how many prompts and responses are still stored, by run."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum("cost").alias("cost"),
        F.count("prompt_text").alias("stored_prompts"),
        F.count("response_text").alias("stored_responses"),
    )


def run_ledger(calls: DataFrame, keys: list[str]) -> DataFrame:
    """One line per run: cost with and without repeats, cache and token totals, latency medians.

    Needs ``sample_index`` beside the call columns. A median only counts positive latencies; both
    the one over all calls and the one without reused calls are given; both are exact at any size.
    """
    real = ~F.col("prewarm")
    first = F.col("sample_index") == 0
    timed = calls.where(real & (F.col("latency_ms") > 0))
    sums = calls.groupBy(*keys).agg(
        F.count(F.when(real, 1)).alias("calls"),
        F.count(F.when(F.col("prewarm"), 1)).alias("prewarm_calls"),
        F.sum("cost").alias("recorded_cost"),
        F.sum(F.when(first, F.col("cost")).otherwise(0)).alias("cost"),
        F.sum(F.when(F.col("prewarm"), F.col("cost")).otherwise(0)).alias("prewarm_cost"),
        F.sum("cache_read").alias("cache_read"),
        F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cache_write"),
        F.sum(usage.total_input()).alias("input_tokens"),
        F.sum(usage.total_output()).alias("output_tokens"),
    )
    for name, rows in (("p50_latency_all", timed), ("p50_latency", timed.where(~F.col("reused")))):
        middle = exact_quantiles(rows, keys, "latency_ms", (0.5,)).withColumnRenamed("p50", name)
        sums = sums.join(middle, keys, "left") if keys else sums.crossJoin(F.broadcast(middle))
    return sums


def recorded_cost(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of first draws and cost including every repeated sample."""
    return calls.groupBy(*keys).agg(
        F.sum(F.when(F.col("sample_index") == 0, F.col("cost")).otherwise(0)).alias("cost"),
        F.sum("cost").alias("recorded_cost"),
    )


def budget_state(spent: Column, cap: Column) -> Column:
    """``struct(fraction, state, remaining)``: ok, warning from 80 %, stopped from 100 %, uncapped."""
    fraction = F.when(cap > 0, spent / cap)
    state = (
        F.when(cap.isNull(), "uncapped")
        .when((cap <= 0) | (fraction >= 1), "stopped")
        .when(fraction >= fixed.BUDGET_WARNING, "warning")
        .otherwise("ok")
    )
    return F.struct(
        fraction.cast("double").alias("fraction"),
        state.alias("state"),
        F.when(cap.isNotNull(), F.greatest(F.lit(0), cap - spent)).alias("remaining"),
    )


def daily_budget(priced: DataFrame, cap: Column) -> DataFrame:
    """Budget state by day."""
    spent = priced.groupBy("day").agg(F.sum("cost").alias("spent"))
    return spent.withColumn("_b", budget_state(F.col("spent"), cap)).select(
        "day", "spent", "_b.fraction", "_b.state", "_b.remaining"
    )


def verification(prices: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """Whether every price of a snapshot was checked, and which were not."""
    return prices.groupBy(snapshot).agg(
        F.bool_and("verified").alias("all_verified"),
        F.sort_array(F.collect_set(F.when(~F.col("verified"), F.col("model")))).alias("unverified"),
    )


def model_costs(
    requests: DataFrame, prices: DataFrame, ratios: DataFrame, tool_overhead: int = 0
) -> DataFrame:
    """Every request priced at every model: tokens in the model's units, dollars, cacheable or not.

    ``requests``: ``request_id, base_tokens, prefix_tokens, max_tokens, has_tools``. The model side
    is one small row set (checked) attached to each request, not a pairing of two large sides.
    """
    models = prices.join(ratios.select("model", "ratio"), "model", "left")
    listed = models.agg(
        F.collect_list(
            F.struct(
                "model",
                F.coalesce("ratio", F.lit(1.0)).alias("ratio"),
                "input",
                "output",
                F.coalesce("min_cacheable_tokens", F.lit(0)).alias("minimum"),
            )
        ).alias("_models")
    )
    rows = requests.crossJoin(F.broadcast(listed)).withColumn("_m", F.explode("_models"))
    overhead = F.when(F.col("has_tools"), F.lit(tool_overhead)).otherwise(0)
    tokens = (F.bround(F.col("base_tokens") * F.col("_m.ratio")) + overhead).cast("bigint")
    prefix = F.bround(F.col("prefix_tokens") * F.col("_m.ratio")).cast("bigint")
    cost = tokens * F.col("_m.input") + F.col("max_tokens") * F.col("_m.output")
    return rows.select(
        "request_id",
        F.col("_m.model").alias("model"),
        tokens.alias("input_tokens"),
        prefix.alias("prefix_tokens"),
        ((prefix > 0) & (prefix >= F.col("_m.minimum"))).alias("clears_minimum"),
        cost.alias("cost_per_call"),
        (cost * 1000).alias("cost_per_1k"),
    )


def compare_models(calls: DataFrame, task: str = "prompt_hash") -> DataFrame:
    """Side by side: one row per prompt and model, cheapest first within the prompt."""
    return calls.groupBy(task, "model").agg(
        F.min_by("response_text", F.struct("sample_index", "attempt")).alias("response_text"),
        F.sum(usage.total_input()).alias("input_tokens"),
        F.sum(usage.total_output()).alias("output_tokens"),
        F.sum("cost").alias("cost"),
        F.min("ttft_ms").alias("ttft_ms"),
        F.sum("latency_ms").alias("latency_ms"),
    ).orderBy(task, "cost", "model")


def fit_ratios(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least squares through the origin of provider tokens on base tokens, by model.

    Pairs with a zero count carry no slope and are dropped; with none left the ratio is 1.
    """
    keys = keys or ["model"]
    ok = (F.col("base_tokens") > 0) & (F.col("provider_tokens") > 0)
    b = F.col("base_tokens").cast("decimal(18,0)")
    p = F.col("provider_tokens").cast("decimal(18,0)")
    sums = pairs.groupBy(*keys).agg(
        F.sum(F.when(ok, b * p)).alias("_bp"),
        F.sum(F.when(ok, b * b)).alias("_bb"),
        F.count(F.when(ok, 1)).alias("fitted_on"),
    )
    return sums.select(
        *keys,
        F.coalesce(F.col("_bp").cast("double") / F.col("_bb").cast("double"), F.lit(1.0)).alias(
            "ratio"
        ),
        "fitted_on",
        (F.col("fitted_on") >= fixed.MIN_CALLS_FOR_RATIO).alias("is_fitted"),
    )
