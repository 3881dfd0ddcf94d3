"""Buying strong labels under a budget, and estimates that stay unbiased with few of them.

One row per task: the cheap judge's verdict and confidence on both arms, a sampling rate, whether the
task was drawn, and strong labels where they were bought. Every estimate is a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import grading, stats
from costproof.operators.ranks import running_sums
from costproof.runtime import cut

# ----------------------------------------------------------------------- allocation


def uncertainty_weight() -> Column:
    """Judge's uncertainty on both arms, plus a boost where its verdicts on the arms differ."""
    return (
        grading.binary_entropy(F.col("confidence_baseline"))
        + grading.binary_entropy(F.col("confidence_candidate"))
        + F.when(
            F.col("judge_baseline") != F.col("judge_candidate"), fixed.DISCORDANT_BOOST
        ).otherwise(0.0)
    )


POLICIES: dict[str, Callable[[], Column]] = {
    "cost-optimal": uncertainty_weight,
    "uniform": lambda: F.lit(1.0),
}


def register_policy(name: str, weight: Callable[[], Column]) -> None:
    if name in POLICIES:
        raise ValueError(f"policy {name!r} is already registered")
    POLICIES[name] = weight


def solve_scale(
    df: DataFrame, weight: str, target: float, floor: float = fixed.MIN_SAMPLING_RATE
) -> tuple[float, float]:
    """``(scale, top_up)`` so that the mean of ``clip(scale * weight, floor, 1)`` is the target.

    The mean is piecewise linear in the scale: a weight u leaves the floor at ``floor / u`` and reaches
    one at ``1 / u``. Running sums of slope and height over these points, in order, give the mean at each;
    the first point that reaches the target ends the piece in which the line is solved. The sums of that
    piece are then taken afresh, so no rounding of the running sums is left in the answer. Where every
    positive weight at rate one falls short (most weights are zero), ``top_up`` is what every rate below
    1 is raised by.
    """
    if not 0 < floor <= 1 or not floor <= target <= 1:
        raise ValueError("target must be in [floor, 1] and floor in (0, 1]")
    counted = cut(df.groupBy(F.col(weight).cast("double").alias("u")).agg(F.count("*").alias("c")))
    positive = F.col("u") > 0
    n, least, smallest, above = counted.agg(
        F.sum("c"), F.min("u"), F.min(F.when(positive, F.col("u"))), F.sum(F.when(positive, F.col("c")))
    ).first()
    if not n:
        raise ValueError("need at least one item")
    if least < 0:
        raise ValueError("uncertainty scores cannot be negative")
    if not above:
        return 0.0, target - floor
    rest = n - above
    if above + floor * rest < target * n:
        return 1 / smallest, (target * n - above - floor * rest) / rest
    c, u = F.col("c").cast("double"), F.col("u")
    points = F.inline(F.array(
        F.struct((F.lit(floor) / u).alias("s"), (c * u).alias("slope"), (-floor * c).alias("height")),
        F.struct((F.lit(1.0) / u).alias("s"), (-c * u).alias("slope"), c.alias("height")),
    ))
    bends = counted.where(positive).select(points).groupBy("s").agg(F.sum("slope").alias("slope"), F.sum("height").alias("height"))
    line = running_sums(bends, [], ["s"], {"_slope": F.col("slope"), "_height": F.col("height")})
    mean = F.lit(floor) * n + F.col("_height") + F.col("_slope") * F.col("s")
    short = mean < F.lit(target) * n
    low, high = line.agg(F.max(F.when(short, F.col("s"))), F.min(F.when(~short, F.col("s")))).first()
    if low is None:  # the floor alone is the target
        return high, 0.0
    high = high if high is not None else 1 / smallest
    # A weight of zero never leaves the floor.
    leaves, ends = (F.coalesce(F.try_divide(F.lit(x), u), F.lit(float("inf"))) for x in (floor, 1.0))
    rising, full = (leaves <= low) & (ends >= high), ends <= low
    slope, ones, floored = counted.agg(
        F.sum(F.when(rising, c * u)), F.sum(F.when(full, c)), F.sum(F.when(leaves > low, c))
    ).first()
    scale = (target * n - (ones or 0.0) - floor * (floored or 0.0)) / slope if slope else high
    return min(max(scale, low), high), 0.0


def rate_column(weight: Column, scale: float, top_up: float, floor: float) -> Column:
    """The rate a weight gets under a solved scale."""
    base = F.least(F.lit(1.0), F.greatest(F.lit(floor), weight * F.lit(scale)))
    return F.when(base < 1, F.least(F.lit(1.0), base + F.lit(top_up))).otherwise(base)


def allocate(
    features: DataFrame,
    budget: float,
    cost_per_item: float,
    policy: str = "cost-optimal",
    seed: int = fixed.SEED,
    floor: float = fixed.MIN_SAMPLING_RATE,
) -> DataFrame:
    """Rates under a budget and the fixed draw: adds ``weight, rate, draw, sampled``."""
    if cost_per_item <= 0 or budget < 0:
        raise ValueError("a strong label costs something and a budget is not negative")
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; registered: {sorted(POLICIES)}")
    weighted = features.withColumn("weight", POLICIES[policy]())
    n = features.count()
    if not n:
        raise ValueError("there is nothing to allocate over")
    target = min(1.0, max(floor, budget / cost_per_item / n))
    scale, top_up = solve_scale(weighted, "weight", target, floor)
    drawn = weighted.withColumn(
        "rate", rate_column(F.col("weight"), scale, top_up, floor)
    ).withColumn("draw", stats.uniform_draw(F.col("task_id"), seed))
    return drawn.withColumn("sampled", (F.col("draw") < F.col("rate")).cast("int"))


def floor_exceeds_budget(n: Column, cost_per_item: float, budget: float, floor: float) -> Column:
    """Whether the floor alone already costs more than the budget."""
    return n * F.lit(floor * cost_per_item) > F.lit(budget)


def restrict_to_budget(
    annotated: DataFrame,
    budget: float,
    recorded: float,
    seed: int = fixed.SEED,
    floor: float = fixed.MIN_SAMPLING_RATE,
    resolve: bool = False,
    cost_per_item: float | None = None,
) -> DataFrame:
    """The same annotation set as a smaller budget would have drawn it.

    Rates are rescaled and clipped, the draws are the same, labels outside the smaller draw are
    dropped. Raising a budget is refused: the extra labels were never bought. ``resolve`` solves the
    rates afresh instead of rescaling them.
    """
    if budget > recorded:
        raise ValueError("labels beyond the recorded budget were never bought")
    if budget == recorded:
        return annotated
    if resolve:
        if cost_per_item is None:
            raise ValueError("a fresh solve needs the cost of an item")
        base = annotated.drop("weight", "rate", "draw", "sampled")
        out = allocate(base, budget, cost_per_item, seed=seed, floor=floor)
    else:
        scale = budget / recorded if recorded > 0 else 0.0
        rate = F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col("rate") * F.lit(scale)))
        out = annotated.withColumn("rate", rate).withColumn(
            "sampled",
            (stats.uniform_draw(F.col("task_id"), seed) < F.col("rate")).cast("int"),
        )
    for name in ("strong_baseline", "strong_candidate"):
        out = out.withColumn(name, F.when(F.col("sampled") == 1, F.col(name)))
    return out


# ------------------------------------------------------------------------ estimators


def checked_rate(rate: Column) -> Column:
    """The rate, or a stop when it is not in (0, 1]."""
    return F.when((rate > 0) & (rate <= 1), rate).otherwise(
        F.raise_error(F.lit("sampling rates must be in (0, 1]"))
    )


def correction_term(cheap: Column, strong: Column, sampled: Column, rate: Column) -> Column:
    """``G + (H - G) * drawn / rate``; a drawn item without a strong label stops the job."""
    labelled = F.when(
        (sampled == 1) & strong.isNull(),
        F.raise_error(F.lit("a sampled item has no strong label")).cast("double"),
    ).otherwise(F.coalesce(strong, F.lit(0)).cast("double"))
    g = cheap.cast("double")
    return F.when(sampled == 1, g + (labelled - g) / checked_rate(rate)).otherwise(
        F.when(checked_rate(rate) > 0, g)
    )


def active_estimate(
    df: DataFrame, keys: list[str], cheap: Column, strong: Column, sampled: Column, rate: Column,
    level: float = 0.95,
) -> DataFrame:
    """Mean of the strong rater's score, its standard error and interval, by group."""
    term = correction_term(cheap, strong, sampled, rate)
    s = df.select(*keys, term.alias("_t"), sampled.alias("_x")).groupBy(*keys).agg(
        F.avg("_t").alias("estimate"),
        (F.stddev_samp("_t") / F.sqrt(F.count("_t"))).alias("standard_error"),
        F.sum("_x").alias("n_sampled"),
        F.count("*").alias("n"),
    )
    i = stats.normal_interval(F.col("estimate"), F.col("standard_error"), level)
    return s.withColumn("_i", i).select(
        *keys, "estimate", "standard_error", F.col("_i.low").alias("low"),
        F.col("_i.high").alias("high"), "n_sampled", "n",
    )


def ht_mean(value: Column, drawn: Column, rate: Column) -> Column:
    """Inverse-probability mean over **all** items, as an aggregate."""
    return F.sum(F.when(drawn & value.isNotNull(), value / rate).otherwise(0.0)) / F.count("*")


def judged_comparison(
    annotated: DataFrame,
    keys: list[str] | None = None,
    cost_per_item: float = 1.0,
    judge_cost_per_item: float = 0.05,
    margin: float = fixed.MARGIN,
    level: float = 0.95,
) -> DataFrame:
    """Two arms compared without an answer key, in one pass.

    The paired corrected delta with its interval and verdict, both arms' corrected accuracies, what
    the judge alone would have said, and what strong-only grading would have taken. An item counts as
    sampled only when both strong labels came back.
    """
    keys = keys or []
    both = F.col("strong_baseline").isNotNull() & F.col("strong_candidate").isNotNull()
    drawn = (F.col("sampled") == 1) & both
    x = drawn.cast("int")
    rate = checked_rate(F.col("rate").cast("double"))
    gb, gc = F.col("judge_baseline"), F.col("judge_candidate")
    hb = F.when(drawn, F.col("strong_baseline"))
    hc = F.when(drawn, F.col("strong_candidate"))
    failed = F.col("strong_failed") if "strong_failed" in annotated.columns else F.lit(False)
    rows = annotated.select(
        *keys,
        drawn.alias("_drawn"),
        F.col("sampled").alias("_sampled"),
        rate.alias("_rate"),
        gb.alias("_gb"),
        gc.alias("_gc"),
        (hc - hb).cast("double").alias("_dh"),
        (gc - gb).cast("double").alias("_dg"),
        correction_term(gc - gb, hc - hb, x, F.col("rate")).alias("_tp"),
        correction_term(gb, hb, x, F.col("rate")).alias("_tb"),
        correction_term(gc, hc, x, F.col("rate")).alias("_tc"),
        (F.coalesce(failed, F.lit(False)) & (F.col("sampled") == 1)).cast("int").alias("_failed"),
    )
    n = F.count("*")
    sums = rows.groupBy(*keys).agg(
        n.alias("n"),
        F.sum("_sampled").alias("n_sampled"),
        F.sum(F.col("_drawn").cast("int")).alias("n_annotated"),
        F.sum("_failed").alias("failed_annotations"),
        F.avg("_tp").alias("delta"),
        (F.stddev_samp("_tp") / F.sqrt(n)).alias("standard_error"),
        F.avg("_tb").alias("baseline_accuracy"),
        F.avg("_tc").alias("candidate_accuracy"),
        F.avg(F.col("_gc") - F.col("_gb")).alias("judge_only_delta"),
        F.avg(((F.col("_gb") == 1) & (F.col("_gc") == 0)).cast("double")).alias("p10"),
        F.avg(((F.col("_gb") == 0) & (F.col("_gc") == 1)).cast("double")).alias("p01"),
        ht_mean(F.col("_dh") * F.col("_dh"), F.col("_drawn"), F.col("_rate")).alias("_second"),
        ht_mean(
            (F.col("_dh") - F.col("_dg")) * (F.col("_dh") - F.col("_dg")),
            F.col("_drawn"),
            F.col("_rate"),
        ).alias("judge_mse"),
    )
    variance = F.greatest(F.lit(0.0), F.col("_second") - F.col("delta") * F.col("delta"))
    z = stats._z_for_level(level)
    low = F.col("delta") - z * F.col("standard_error")
    high = F.col("delta") + z * F.col("standard_error")
    out = sums.withColumn("strong_variance", variance).withColumn("low", low).withColumn("high", high)
    label = stats.verdict_label(F.col("low"), F.col("high"), margin)
    needed = stats.required_n(F.col("p10"), F.col("p01"), F.col("delta"), margin)
    items = stats.strong_only_items(F.col("strong_variance"), F.col("standard_error"))
    guard = F.when(F.col("n_annotated") > 0, F.col("delta")).otherwise(
        F.raise_error(F.lit("no item has a strong label on both arms"))
    )
    return out.select(
        *keys, "n", "n_sampled", "n_annotated", "failed_annotations", guard.alias("delta"),
        "standard_error", "low", "high", label.alias("verdict"),
        stats.more_tasks(label, needed, F.col("n")).alias("additional_tasks"),
        "baseline_accuracy", "candidate_accuracy", "judge_only_delta",
        (F.col("judge_only_delta") - F.col("delta")).alias("judge_bias"),
        "strong_variance", "judge_mse",
        stats.optimal_rate(
            F.col("judge_mse"), F.col("strong_variance"), F.lit(judge_cost_per_item), F.lit(cost_per_item)
        ).alias("cost_optimal_rate"),
        items.alias("strong_only_items"),
        (items * F.lit(cost_per_item)).alias("strong_only_cost"),
    )


def contract_tradeoff(
    annotated: DataFrame,
    arms: DataFrame,
    baseline: str,
    candidate: str,
    cheap_per_arm: float,
    strong_per_arm: float,
    target: float = fixed.TARGET_STANDARD_ERROR,
) -> DataFrame:
    """What a checkable output contract costs and buys, both halves in one row.

    ``arms``: ``pipeline, accuracy, generation_cost``. The accuracy delta keeps its sign.
    """
    both = F.col("strong_baseline").isNotNull() & F.col("strong_candidate").isNotNull()
    drawn, rate = (F.col("sampled") == 1) & both, F.col("rate")
    miss = lambda side: (
        (F.col(f"judge_{side}") - F.col(f"strong_{side}")).cast("double")
    )
    m = annotated.agg(
        F.count("*").alias("n"),
        F.sum(drawn.cast("int")).alias("annotated"),
        *[
            ht_mean(miss(s) * miss(s), drawn, rate).alias(f"mse_{s}")
            for s in ("baseline", "candidate")
        ],
    )
    cheap, strong = F.lit(cheap_per_arm), F.lit(strong_per_arm)
    for s in ("baseline", "candidate"):
        m = m.withColumn(
            f"_b_{s}",
            stats.annotation_budget(F.col(f"mse_{s}"), F.col("n"), target, cheap, strong),
        )
    sides = arms.agg(
        *[
            F.max(F.when(F.col("pipeline") == p, F.col(c))).cast("double").alias(f"{c}_{s}")
            for p, s in ((baseline, "baseline"), (candidate, "candidate"))
            for c in ("accuracy", "generation_cost")
        ]
    )
    saving = F.col("_b_baseline.budget") - F.col("_b_candidate.budget")
    premium = F.col("generation_cost_candidate") - F.col("generation_cost_baseline")
    return m.crossJoin(F.broadcast(sides)).select(
        "n",
        "annotated",
        (1 - F.col("mse_baseline")).alias("agreement_baseline"),
        (1 - F.col("mse_candidate")).alias("agreement_candidate"),
        F.col("_b_baseline.rate").alias("rate_baseline"),
        F.col("_b_candidate.rate").alias("rate_candidate"),
        (F.col("accuracy_candidate") - F.col("accuracy_baseline")).alias("accuracy_delta"),
        saving.alias("annotation_saving"),
        premium.alias("generation_premium"),
        (saving > premium).alias("pays_for_itself"),
    )


# -------------------------------------------------------------------- review queue


def review_queue(annotated: DataFrame) -> DataFrame:
    """One row per (task, arm) for a human grader; the human label is null on every row."""
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("arm"),
                    F.col(f"answer_{s}").alias("answer"),
                    F.col(f"judge_{s}").alias("judge_correct"),
                    F.col(f"confidence_{s}").alias("judge_confidence"),
                )
                for s in ("baseline", "candidate")
            ]
        )
    )
    return annotated.where(F.col("sampled") == 1).select(
        "task_id", "question", F.col("rate").alias("sampling_rate"), sides.alias("_s")
    ).select(
        "task_id", "_s.arm", "question", "_s.answer", "_s.judge_correct", "_s.judge_confidence",
        "sampling_rate", F.lit(None).cast("string").alias("human_correct"),
    )


def read_review(queue: DataFrame) -> DataFrame:
    """Completed rows only, as 0/1; anything else than 0, 1, yes or no stops the job."""
    said = F.lower(F.trim(F.col("human_correct")))
    decided = F.when(said.isin(*fixed.VERDICT_TRUE), 1).when(said.isin(*fixed.VERDICT_FALSE), 0)
    checked = F.coalesce(
        decided,
        F.raise_error(
            F.concat(F.lit("not a human verdict for task "), F.col("task_id").cast("string"))
        ).cast("int"),
    )
    return queue.where(F.col("human_correct").isNotNull()).select(
        "task_id", "arm", checked.alias("human_correct")
    )


def merge_review(annotated: DataFrame, queue: DataFrame) -> DataFrame:
    """Human labels as strong labels; rows left null stay without one."""
    wide = read_review(queue).groupBy("task_id").agg(
        *[
            F.max(F.when(F.col("arm") == s, F.col("human_correct"))).alias(f"_h_{s}")
            for s in ("baseline", "candidate")
        ]
    )
    out = annotated.join(wide, "task_id", "left")
    for s in ("baseline", "candidate"):
        out = out.withColumn(
            f"strong_{s}", F.coalesce(F.col(f"_h_{s}"), F.col(f"strong_{s}"))
        ).drop(f"_h_{s}")
    return out


# ------------------------------------------------------------------------- repricing


def projected_item_cost(
    calls: DataFrame, scale: float, rates: dict[str, float], arms_per_item: int = 2
) -> DataFrame:
    """Cost of one strong-graded item projected from the cheap judge's recorded usage.

    Token buckets are scaled by the ratio of the two models' tokenizers (half-even per bucket) and
    priced at the strong model; the pre-warm part is a fixed cost, kept apart.
    """

    def grown(bucket: str) -> Column:
        tokens = F.col(bucket)
        return tokens if scale == 1.0 else F.bround(tokens * F.lit(float(scale)))

    cost = F.lit(0.0)
    for bucket in fixed.BILLED_BUCKETS:
        cost = cost + grown(bucket) * F.lit(float(rates[fixed.BUCKET_RATE[bucket]]))
    real = ~F.col("prewarm")
    return calls.agg(
        (F.sum(F.when(real, cost)) / F.count(F.when(real, 1)) * arms_per_item).alias("per_item"),
        F.coalesce(F.sum(F.when(F.col("prewarm"), cost)), F.lit(0.0)).alias("fixed_cost"),
    )


def verdict_audit(stored: DataFrame, calls: DataFrame) -> DataFrame:
    """Stored verdicts against the reply they came from, parsed again: missing and disagreeing rows."""
    replies = calls.select("call_key", F.col("response_text").alias("_reply"), F.lit(True).alias("_has"))
    joined = stored.join(replies, "call_key", "left")
    parsed = grading.parse_verdict(F.col("_reply"))["correct"]
    problem = F.when(F.col("_has").isNull(), "missing call").when(
        ~parsed.eqNullSafe(F.col("correct")), "verdict differs"
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").drop("_reply", "_has")
