"""Arms and paired comparisons.

An *arm* is a long table: one row per (pipeline, task) with ``correct`` 0/1, ``cost`` in an exact
money type, and optionally ``scarce_cost``, ``resolved_tier`` and task attributes. Pairing is a join
on the task, every statistic is a column over grouped counts, and a comparison of different task sets
is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import stats


def arm_summary(arms: DataFrame, keys: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """n, successes, accuracy with its Wilson interval, cost totals and cost per success by arm."""
    keys = keys or ["pipeline"]
    scarce = F.col("scarce_cost") if "scarce_cost" in arms.columns else F.lit(0)
    grouped = arms.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("correct").alias("successes"),
        F.sum("cost").alias("total_cost"),
        F.sum(scarce).alias("scarce_cost"),
    )
    interval = stats.wilson(F.col("successes"), F.col("n"), level)
    total = F.col("total_cost")
    return grouped.withColumn("_w", interval).select(
        *keys,
        "n",
        "successes",
        "total_cost",
        "scarce_cost",
        F.col("_w.point").alias("accuracy"),
        F.col("_w.low").alias("accuracy_low"),
        F.col("_w.high").alias("accuracy_high"),
        (total / F.col("n")).cast("double").alias("cost_per_task"),
        stats.cost_per_success(total, F.col("successes")).cast("double").alias("cost_per_success"),
        F.when(total != 0, F.col("scarce_cost") / total)
        .otherwise(0.0)
        .cast("double")
        .alias("scarce_share"),
    )


def pair(arms: DataFrame, baseline: str, carry: list[str] | None = None) -> DataFrame:
    """Every other arm joined to the baseline on the task.

    Result: ``pipeline, task_id, b_correct, b_cost, c_correct, c_cost`` plus the candidate's
    ``carry`` columns. Task ids are unique in an arm, so the join keys are spread evenly. A comparison over
    different task sets stops the job: a candidate's task that the baseline lacks is refused where it is met, a
    baseline's task that one of the candidates lacks by its number of answers.
    """
    base = arms.where(F.col("pipeline") == baseline).select(
        "task_id", F.col("correct").alias("b_correct"), F.col("cost").alias("b_cost")
    )
    rest = arms.where(F.col("pipeline") != baseline).select(
        "pipeline",
        "task_id",
        F.col("correct").alias("c_correct"),
        F.col("cost").alias("c_cost"),
        *(carry or []),
    )
    names = rest.select("pipeline").distinct().agg(F.count("*").alias("_arms"))
    answers = rest.groupBy("task_id").agg(F.count("*").alias("_answers"))
    base = base.join(answers, "task_id", "left").crossJoin(F.broadcast(names))
    met = F.col("_answers") == F.col("_arms")
    joined = rest.join(base, "task_id", "full")
    refusal = F.raise_error(
        F.concat(F.lit("arms answered different task sets, at task "), F.col("task_id").cast("string"))
    ).cast("boolean")
    return joined.where(F.when(F.coalesce(met & F.col("pipeline").isNotNull(), F.lit(False)), True).otherwise(refusal)).select(
        "pipeline", "task_id", "b_correct", "b_cost", "c_correct", "c_cost", *(carry or [])
    )


def check_same_tasks(arms: DataFrame, baseline: str) -> DataFrame:
    """Per pipeline: tasks missing on either side. All zero means a comparison is allowed."""
    marks = (
        arms.where(F.col("pipeline") == baseline)
        .select("task_id")
        .withColumn("_in_base", F.lit(True))
    )
    rest = arms.where(F.col("pipeline") != baseline).select("pipeline", "task_id")
    joined = rest.join(marks, "task_id", "left")
    sides = joined.groupBy("pipeline").agg(
        F.count("*").alias("candidate_tasks"),
        F.count("_in_base").alias("shared_tasks"),
    )
    size = marks.agg(F.count("*").alias("baseline_tasks"))
    return sides.crossJoin(F.broadcast(size)).select(
        "pipeline",
        (F.col("candidate_tasks") - F.col("shared_tasks")).alias("missing_in_baseline"),
        (F.col("baseline_tasks") - F.col("shared_tasks")).alias("missing_in_candidate"),
    )


def require_same_tasks(arms: DataFrame, baseline: str) -> None:
    """Refuse arms over different task sets; one pass over the task ids."""
    bad = check_same_tasks(arms, baseline).where(
        (F.col("missing_in_baseline") > 0) | (F.col("missing_in_candidate") > 0)
    )
    found = bad.limit(1).collect()
    if found:
        raise ValueError(f"arms answered different task sets: {found[0].asDict()}")


def paired_counts(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Discordant counts and the sums every paired statistic needs, in one pass."""
    keys = keys or ["pipeline"]
    b, c = F.col("b_correct"), F.col("c_correct")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when((b == 1) & (c == 0), 1).otherwise(0)).alias("baseline_only"),
        F.sum(F.when((b == 0) & (c == 1), 1).otherwise(0)).alias("candidate_only"),
        F.sum(b).alias("b_successes"),
        F.sum(c).alias("c_successes"),
        F.sum("b_cost").alias("b_total"),
        F.sum("c_cost").alias("c_total"),
    )


def power(counts: DataFrame, margin: float = fixed.MARGIN, alpha: float = fixed.ALPHA) -> DataFrame:
    """Size of the split a conclusive verdict needs, from the observed discordant counts."""
    n = F.col("n").cast("double")
    p10, p01 = F.col("baseline_only") / n, F.col("candidate_only") / n
    needed = stats.required_n(p10, p01, p01 - p10, margin, alpha)
    return (
        counts.withColumn("p10", p10)
        .withColumn("p01", p01)
        .withColumn("delta", p01 - p10)
        .withColumn("required_n", needed)
        .withColumn(
            "sufficient", F.coalesce(F.col("n") >= F.col("required_n"), F.lit(False))
        )
        .withColumn(
            "shortfall",
            F.coalesce(F.greatest(F.lit(0), F.col("required_n") - F.col("n")), F.lit(0)),
        )
    )


def verdicts(
    counts: DataFrame, low: Column, high: Column, margin: float = fixed.MARGIN
) -> DataFrame:
    """Label each comparison by where its delta interval sits, with the tasks that would settle it."""
    sized = power(counts, margin)
    label = stats.verdict_label(low, high, margin)
    return sized.withColumn("verdict", label).withColumn(
        "additional_tasks", stats.more_tasks(label, F.col("required_n"), F.col("n"))
    )


def proof(
    pairs: DataFrame,
    keys: list[str] | None = None,
    margin: float = fixed.MARGIN,
    seed: int = fixed.SEED,
    resamples: int = fixed.RESAMPLES,
) -> DataFrame:
    """The whole paired comparison by group: accuracies, delta interval, verdict, exact p, power.

    Cost intervals are a separate bootstrap (``operators.bootstrap``) over the same pairs.
    """
    keys = keys or ["pipeline"]
    counts = paired_counts(pairs, keys)
    same = F.col("n") - F.col("baseline_only") - F.col("candidate_only")
    delta = stats.multinomial_delta(seed, resamples)(
        F.col("baseline_only"), same, F.col("candidate_only")
    )
    judged = verdicts(
        counts.withColumn("_d", delta), F.col("_d.low"), F.col("_d.high"), margin
    )
    ratio = (F.col("c_total") / F.col("c_successes")) / (F.col("b_total") / F.col("b_successes"))
    return judged.select(
        *keys,
        "n",
        "baseline_only",
        "candidate_only",
        "b_successes",
        "c_successes",
        "b_total",
        "c_total",
        "delta",
        F.col("_d.low").alias("delta_low"),
        F.col("_d.high").alias("delta_high"),
        "verdict",
        "additional_tasks",
        "required_n",
        "shortfall",
        stats.mcnemar_p(F.col("baseline_only"), F.col("candidate_only")).alias("mcnemar_p"),
        F.when(
            (F.col("b_successes") > 0) & (F.col("c_successes") > 0) & (F.col("b_total") != 0), ratio
        )
        .cast("double")
        .alias("cost_ratio"),
    )


def by_question_type(pairs: DataFrame) -> DataFrame:
    """Both accuracies, cost per success of both arms and the candidate's tier shares by type.

    ``pairs`` carries ``question_type`` and ``resolved_tier``.
    """
    keys = ["pipeline", "question_type"]
    totals = paired_counts(pairs, keys)
    tiers = pairs.groupBy(*keys, "resolved_tier").agg(F.count("*").alias("_k"))
    shares = tiers.groupBy(*keys).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("resolved_tier", "_k")))
        ).alias("tier_counts")
    )
    return totals.join(shares, keys).select(
        *keys,
        "n",
        (F.col("b_successes") / F.col("n")).alias("baseline_accuracy"),
        (F.col("c_successes") / F.col("n")).alias("candidate_accuracy"),
        F.transform_values("tier_counts", lambda _, v: v / F.col("n")).alias("tier_shares"),
        stats.cost_per_success(F.col("b_total"), F.col("b_successes"))
        .cast("double")
        .alias("baseline_cost_per_success"),
        stats.cost_per_success(F.col("c_total"), F.col("c_successes"))
        .cast("double")
        .alias("candidate_cost_per_success"),
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    """Tasks the two arms were graded differently on."""
    return pairs.where(F.col("b_correct") != F.col("c_correct"))


def waterfall(arms: DataFrame, baseline: str, **options) -> DataFrame:
    """Every pipeline with its own summary and its verdict against the baseline (null for itself)."""
    compared = proof(pair(arms, baseline), **options).select(
        "pipeline", "delta", "delta_low", "delta_high", "verdict", "additional_tasks"
    )
    return arm_summary(arms).join(compared, "pipeline", "left")


def repayment(saving_per_task: Column, proof_cost: Column) -> Column:
    """Tasks until a proof has paid for itself; null when nothing is saved."""
    return F.when(saving_per_task > 0, F.ceil(proof_cost / saving_per_task).cast("bigint"))


def proof_cost(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Itemised cost of a proof from ledger rows classified by ``spend_line``."""
    lines = ("baseline", "calibration", "candidate", "other", "sampling", "prewarm")
    sums = [
        F.sum(F.when(F.col("line") == name, F.col("cost")).otherwise(0)).alias(f"{name}_cost")
        for name in lines
    ]
    return ledger.groupBy(*(keys or [])).agg(*sums, F.sum("cost").alias("proof_cost"))


def spend_line(
    split: Column, pipeline: Column, prewarm: Column, sample_index: Column, baseline: str,
    candidate: str,
) -> Column:
    """Which line of the proof's bill a call belongs to; each call has exactly one."""
    return (
        F.when(prewarm, "prewarm")
        .when(sample_index > 0, "sampling")
        .when(split == "calibration", "calibration")
        .when(pipeline == baseline, "baseline")
        .when(pipeline == candidate, "candidate")
        .otherwise("other")
    )


def both_right(arms: DataFrame, left: str, right: str) -> DataFrame:
    """Tasks both arms answered correctly: a semi join of the two sets of correct ids."""
    ok = arms.where(F.col("correct") == 1)
    return (
        ok.where(F.col("pipeline") == left)
        .select("task_id")
        .join(ok.where(F.col("pipeline") == right).select("task_id"), "task_id", "left_semi")
    )


def sanity_gate(
    accuracies: DataFrame,
    dearest: str,
    cheap: str,
    floor: float = fixed.SANITY_ACCURACY_FLOOR,
    gap: float = fixed.SANITY_GAP_FLOOR,
) -> DataFrame:
    """Whether a recording is worth proving on: the dearest tier is good and the cheap one is worse."""
    sides = accuracies.agg(
        F.max(F.when(F.col("pipeline") == dearest, F.col("accuracy"))).alias("dearest_accuracy"),
        F.max(F.when(F.col("pipeline") == cheap, F.col("accuracy"))).alias("cheap_accuracy"),
    )
    problem = F.array_compact(
        F.array(
            F.when(F.col("dearest_accuracy") < floor, F.lit("dearest tier below its floor")),
            F.when(
                F.col("dearest_accuracy") - F.col("cheap_accuracy") < gap,
                F.lit("gap to the cheap tier below its floor"),
            ),
        )
    )
    return sides.withColumn("problems", problem).withColumn("passes", F.size("problems") == 0)
