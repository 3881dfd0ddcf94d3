"""Step graphs of pipelines: reachability, step statistics, and waste between steps.

``steps``: ``pipeline, step_id, kind, tool, position, called``; ``edges``: ``pipeline, src, dst``;
``traces``: ``pipeline, task_id, step_id, arguments, output, request_text``; ``outputs``: ``pipeline,
output_step``. A step graph is small; traces are large and are only joined on (pipeline, task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import usage
from costproof.runtime import broadcast_if_small, cut


def squash(text: Column) -> Column:
    """White-space-insensitive form of a text."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def reaching(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """``pipeline, step_id`` of every step from which the answering step can be reached, that step included.

    A walk backwards from the outputs, every pipeline at once: each round follows the edges into the steps
    found last and keeps the new ones, so a step is in one round only and no pair of steps is ever made.
    """
    found = cut(outputs.select("pipeline", F.col("output_step").alias("step_id")).distinct())
    into = edges.select("pipeline", F.col("dst").alias("step_id"), "src").distinct()
    last = found
    while True:
        back = last.join(into, ["pipeline", "step_id"]).select("pipeline", F.col("src").alias("step_id")).distinct()
        last = cut(back.join(found, ["pipeline", "step_id"], "left_anti"))
        if last.isEmpty():
            return found
        found = found.unionByName(last)


def reaches_output(steps: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every step with whether its output can reach the step the pipeline answers with."""
    hits = reaching(edges, outputs).withColumn("_hit", F.lit(True))
    return (
        steps.join(outputs, "pipeline")
        .join(hits, ["pipeline", "step_id"], "left")
        .withColumn("reaches", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def step_stats(calls: DataFrame, scale: float = 1.0) -> DataFrame:
    """Per pipeline and step: calls, tokens, dollars in and out, and the input rate actually paid.

    ``calls`` carry the buckets, ``p_*`` prices, ``model, request_text``.
    """
    money_in = (
        F.col("input_uncached") * F.col("p_input")
        + F.col("cache_write_5m") * F.col("p_cache_write_5m")
        + F.col("cache_write_1h") * F.col("p_cache_write_1h")
        + F.col("cache_read") * F.col("p_cache_read")
    )
    money_out = usage.total_output() * F.col("p_output")
    g = calls.groupBy("pipeline", "step_id").agg(
        F.count("*").alias("calls"),
        F.max("model").alias("model"),
        F.sum(usage.total_input()).alias("input_tokens"),
        F.sum(usage.total_output()).alias("output_tokens"),
        (F.sum(money_in) * F.lit(scale)).alias("input_cost"),
        (F.sum(money_out) * F.lit(scale)).alias("output_cost"),
        F.sum(F.length("request_text")).alias("chars"),
        F.max("p_input").alias("p_input"),
    )
    run = Window.partitionBy("pipeline")
    return g.select(
        "*",
        F.when(F.col("input_tokens") > 0, F.col("input_cost") / F.col("input_tokens"))
        .otherwise(0.0)
        .alias("blended_rate"),
        F.when(
            F.sum("chars").over(run) > 0, F.sum("input_tokens").over(run) / F.sum("chars").over(run)
        )
        .otherwise(0.0)
        .alias("tokens_per_char"),
    )


def _tasks(traces: DataFrame) -> DataFrame:
    return traces.groupBy("pipeline").agg(F.count_distinct("task_id").alias("tasks"))


def carried(traces: DataFrame) -> DataFrame:
    """Per (pipeline, source step, carrying step): tasks whose request contains the source's output.

    An equality join on the task, then a containment test; a task has as many rows as its graph has
    steps. Joins of traces with themselves are sort-merge joins by hint: traces that are made by a
    generator look as small as its input, and a side chosen by that size would pass through the driver.
    """
    source = traces.where(F.col("output") != "").select(
        "pipeline", "task_id", F.col("step_id").alias("source"), "output"
    )
    target = traces.where(F.col("request_text").isNotNull()).select(
        "pipeline", "task_id", F.col("step_id").alias("carrier"), F.col("request_text").alias("_r")
    )
    hit = source.join(target.hint("merge"), ["pipeline", "task_id"]).where(
        (F.col("source") != F.col("carrier")) & F.col("_r").contains(F.col("output"))
    )
    return hit.groupBy("pipeline", "source", "carrier").agg(
        F.count("*").alias("tasks_carrying"),
        F.min_by(F.length("output"), "task_id").alias("first_chars"),
        F.min_by(F.length(squash(F.col("output"))), "task_id").alias("first_squashed"),
    )


def _rows(df: DataFrame, rule: str, step: Column, amount: Column, confidence: str) -> DataFrame:
    return df.select(
        "pipeline", F.lit(rule).alias("rule"), step.alias("step_id"),
        amount.cast("double").alias("per_1k"), F.lit(confidence).alias("confidence"),
    )


def shared_context(traces: DataFrame, stats: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The same long output sent to two or more steps: all copies but the cheapest are waste.

    ``held`` is ``carried(traces)`` where the caller has it already.
    """
    held = (carried(traces) if held is None else held).join(_tasks(traces), "pipeline").where(
        (F.col("tasks_carrying") >= fixed.PREVALENCE * F.col("tasks"))
        & (F.col("first_squashed") >= fixed.SHARED_BLOCK_MIN_CHARS)
    )
    priced = held.join(
        stats.select("pipeline", F.col("step_id").alias("carrier"), "blended_rate", "tokens_per_char"),
        ["pipeline", "carrier"],
    )
    g = priced.groupBy("pipeline", "source").agg(
        F.count("*").alias("carriers"),
        (F.sum("blended_rate") - F.min("blended_rate")).alias("_extra"),
        F.max(F.bround(F.col("first_chars") * F.col("tokens_per_char"))).alias("tokens"),
    ).where(F.col("carriers") >= 2)
    best = g.withColumn("_a", F.col("tokens") * F.col("_extra") * 1000).groupBy("pipeline").agg(
        F.max_by("source", F.struct("_a", "source")).alias("source"), F.max("_a").alias("_a")
    )
    return _rows(best, "G01", F.col("source"), F.col("_a"), "measured")


def duplicate_tool_calls(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """Two local steps calling the same tool with the same arguments on nearly every task; no price is
    claimed for a tool."""
    local = steps.where(~F.col("called")).select(
        "pipeline", "step_id", "position", F.coalesce("tool", "kind").alias("_tool")
    )
    rows = traces.where(F.col("arguments").isNotNull()).join(broadcast_if_small(local), ["pipeline", "step_id"]).select(
        "pipeline", "task_id", "step_id", "position", "_tool",
        F.md5(squash(F.col("arguments"))).alias("_args"),
    )
    a = rows.select("pipeline", "task_id", "_tool", "_args", F.col("step_id").alias("first"), F.col("position").alias("_p"))
    b = rows.select("pipeline", "task_id", "_tool", "_args", F.col("step_id").alias("second"), F.col("position").alias("_q"))
    same = a.join(b.hint("merge"), ["pipeline", "task_id", "_tool", "_args"]).where("_p < _q")
    g = same.groupBy("pipeline", "first", "second").agg(F.count("*").alias("_n")).join(
        _tasks(traces), "pipeline"
    ).where(F.col("_n") >= fixed.PREVALENCE * F.col("tasks"))
    return _rows(g, "G02", F.col("second"), F.lit(0.0), "measured").distinct()


def identical_to_prior(traces: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (pipeline, step, prior generation step it reads): share of tasks with the same text."""
    called = steps.where(F.col("called")).select("pipeline", "step_id")
    links = edges.join(called.withColumnRenamed("step_id", "src"), ["pipeline", "src"])
    out = traces.select("pipeline", "task_id", "step_id", F.md5(squash(F.col("output"))).alias("_o"))
    after = out.withColumnRenamed("step_id", "dst").join(broadcast_if_small(links), ["pipeline", "dst"])
    before = out.select("pipeline", "task_id", F.col("step_id").alias("src"), F.col("_o").alias("_b"))
    joined = after.join(before.hint("merge"), ["pipeline", "task_id", "src"])
    return (
        joined.groupBy("pipeline", "dst", "src")
        .agg(F.sum((F.col("_o") == F.col("_b")).cast("int")).alias("same"))
        .join(_tasks(traces), "pipeline")
        .select("pipeline", "dst", "src", "same", (F.col("same") / F.col("tasks")).alias("share"), "tasks")
    )


def pointless_retries(same: DataFrame, steps: DataFrame, stats: DataFrame) -> DataFrame:
    """A retry whose text equals the answer it retried on nearly every task."""
    retry = steps.where(F.col("kind") == "retry").select("pipeline", F.col("step_id").alias("dst"))
    best = same.join(retry, ["pipeline", "dst"]).groupBy("pipeline", "dst", "tasks").agg(
        F.max("share").alias("share")
    ).where(F.col("share") >= fixed.PREVALENCE)
    priced = best.join(stats.withColumnRenamed("step_id", "dst"), ["pipeline", "dst"])
    cost = (F.col("input_cost") + F.col("output_cost")) * F.col("share") * 1000 / F.col("tasks")
    return _rows(priced, "G04", F.col("dst"), cost, "measured")


def idle_verifiers(
    same: DataFrame, steps: DataFrame, edges: DataFrame, outputs: DataFrame, stats: DataFrame,
    traces: DataFrame,
) -> DataFrame:
    """A verifier with no path to the answer, or whose readers return what they already had."""
    verify = reaches_output(steps, edges, outputs).where(F.col("kind") == "verify").select(
        "pipeline", "step_id", "reaches"
    )
    readers = edges.select("pipeline", F.col("src").alias("step_id"), "dst")
    kept = (
        same.join(readers, ["pipeline", "dst"])
        .where(F.col("src") != F.col("step_id"))
        .groupBy("pipeline", "step_id", "dst")
        .agg(F.max("share").alias("_s"))
        .groupBy("pipeline", "step_id")
        .agg(F.min("_s").alias("unchanged"))
    )
    idle = verify.join(kept, ["pipeline", "step_id"], "left").where(
        ~F.col("reaches") | (F.col("unchanged") >= fixed.PREVALENCE)
    )
    priced = idle.join(stats, ["pipeline", "step_id"]).join(_tasks(traces), "pipeline")
    cost = (F.col("input_cost") + F.col("output_cost")) * 1000 / F.col("tasks")
    return _rows(priced, "G03", F.col("step_id"), cost, "measured")


def compressible_input(
    traces: DataFrame, edges: DataFrame, stats: DataFrame, held: DataFrame | None = None
) -> DataFrame:
    """Text of declared inputs carried by the step at the dearest model: a ceiling."""
    dearest = stats.groupBy("pipeline").agg(
        F.max_by(
            F.struct("step_id", "blended_rate", "tokens_per_char"),
            F.struct("p_input", F.col("step_id")),
        ).alias("_d")
    ).select("pipeline", F.col("_d.step_id").alias("carrier"), F.col("_d.blended_rate").alias("_rate"), F.col("_d.tokens_per_char").alias("_tpc"))
    links = edges.select("pipeline", F.col("src").alias("source"), F.col("dst").alias("carrier"))
    held = (
        (carried(traces) if held is None else held)
        .join(_tasks(traces), "pipeline")
        .where(F.col("tasks_carrying") >= fixed.PREVALENCE * F.col("tasks"))
        .join(links, ["pipeline", "source", "carrier"], "left_semi")
        .join(dearest, ["pipeline", "carrier"])
    )
    g = held.groupBy("pipeline", "carrier").agg(
        F.sum(F.bround(F.col("first_chars") * F.col("_tpc"))).alias("_t"), F.max("_rate").alias("_rate")
    )
    return _rows(g, "G05", F.col("carrier"), F.col("_t") * F.col("_rate") * 1000, "projected")


def graph_findings(
    steps: DataFrame, edges: DataFrame, outputs: DataFrame, traces: DataFrame, stats: DataFrame
) -> DataFrame:
    """Every graph rule over every pipeline."""
    # A few rows per graph, each read by two rules: written once.
    same, held, stats = cut(identical_to_prior(traces, steps, edges)), cut(carried(traces)), cut(stats)
    parts = [
        shared_context(traces, stats, held),
        duplicate_tool_calls(traces, steps),
        idle_verifiers(same, steps, edges, outputs, stats, traces),
        pointless_retries(same, steps, stats),
        compressible_input(traces, edges, stats, held),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def deletable_step(findings: DataFrame) -> DataFrame:
    """Per pipeline, the step of the top-ranked finding that proposes deleting one."""
    from costproof.operators.findings import weighted

    scored = findings.withColumn("_w", weighted(F.col("per_1k"), F.col("confidence"))).where(
        F.col("rule").isin("G03", "G04")
    )
    return scored.groupBy("pipeline").agg(
        F.min_by("step_id", F.struct(-F.col("_w"), F.col("rule"), F.col("step_id"))).alias("step_id")
    )


def deletion_pairs(steps: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pipelines equal to another one minus one step, with the same output step.

    Set equality by hashing the sorted reduced step list: an equality join, not a comparison of pairs.
    """
    sets = steps.groupBy("pipeline").agg(F.sort_array(F.collect_set("step_id")).alias("_s")).join(
        outputs, "pipeline"
    )
    reduced = sets.select(
        F.col("pipeline").alias("baseline"), "output_step", F.explode("_s").alias("removed"), "_s"
    ).select("baseline", "output_step", "removed", F.array_remove("_s", F.col("removed")).alias("_s"))
    other = sets.select(F.col("pipeline").alias("candidate"), "output_step", "_s")
    return reduced.join(other, ["output_step", "_s"]).select("baseline", "removed", "candidate")
