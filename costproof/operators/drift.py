"""What a set of tasks looks like, how far traffic moved from it, and where its items came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof import fixed
from costproof.operators.ranks import exact_quantiles, hash_rank, running_before
from costproof.runtime import broadcast_if_small
from costproof.functions.stats import row_number_of


def type_mix(items: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Count and share (six places) of each question type by group; ``weight`` says how many items a row stands for."""
    keys = keys or []
    counts = items.groupBy(*keys, "question_type").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    joined = counts.join(totals, keys) if keys else counts.crossJoin(F.broadcast(totals))
    return joined.select(
        *keys, "question_type", "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"),
        (F.col("n") / F.col("_total")).alias("_exact"),
    )


def length_quantiles(items: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """p10, p50, p90 and p99 of question tokens, linear interpolation, four places."""
    q = exact_quantiles(items, keys or [], "tokens", fixed.QUANTILES, weight=weight)
    names = [f"p{round(x * 100)}" for x in fixed.QUANTILES]
    return q.select(*(keys or []), *[F.round(n, 4).alias(n) for n in names])


def fingerprint(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per group: the type mix as a map, length quantiles, concentration, rarest share.

    ``items``: keys, ``question_type, tokens``. The map holds one entry per declared type.
    """
    keys = keys or []
    mix = type_mix(items, keys)
    kinds, herf = F.count("*"), F.sum(F.col("_exact") * F.col("_exact"))
    shape = mix.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("question_type", "share")))).alias(
            "mix"
        ),
        F.round(
            F.when(kinds > 1, (herf - 1 / kinds) / (1 - 1 / kinds)).otherwise(1.0), 6
        ).alias("type_concentration"),
        F.round(F.min("_exact"), 6).alias("rarest_type_share"),
    )
    lengths = length_quantiles(items, keys)
    means = items.groupBy(*keys).agg(F.round(F.avg("tokens"), 4).alias("mean_question_tokens"))
    if keys:
        return shape.join(lengths, keys).join(means, keys)
    return shape.crossJoin(F.broadcast(lengths)).crossJoin(F.broadcast(means))


def mix_alignment(certified: DataFrame, recent: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both mixes side by side over the union of their types; an absent type has share 0."""
    keys = keys or []
    a = certified.select(*keys, "question_type", F.col("share").alias("certified_share"))
    b = recent.select(*keys, "question_type", F.col("share").alias("recent_share"))
    return a.join(b, [*keys, "question_type"], "full_outer").fillna(
        0.0, ["certified_share", "recent_share"]
    )


def divergence(
    certified: DataFrame,
    recent: DataFrame,
    certified_lengths: DataFrame,
    recent_lengths: DataFrame,
    keys: list[str] | None = None,
    same_counter: bool = True,
) -> DataFrame:
    """Total variation, uncovered types, moved lengths, the three types that moved most, and whether
    the certified set still covers the traffic. Token counts of different counters are refused."""
    if not same_counter:
        raise ValueError("lengths counted with different counters cannot be compared")
    keys = keys or []
    both = mix_alignment(certified, recent, keys).withColumn(
        "_move", F.abs(F.col("recent_share") - F.col("certified_share"))
    )
    uncovered = (F.col("recent_share") >= fixed.UNCOVERED_SHARE) & (
        F.col("certified_share") < fixed.UNCOVERED_FLOOR
    )
    entry = F.struct((-F.col("_move")).alias("o"), F.col("question_type").alias("t"))
    g = both.groupBy(*keys).agg(
        (F.sum("_move") / 2).alias("_tvd"),
        F.sort_array(F.collect_list(F.when(uncovered, F.col("question_type")))).alias("uncovered"),
        F.transform(
            F.slice(F.sort_array(F.collect_list(entry)), 1, 3), lambda e: e["t"]
        ).alias("most_moved"),
    )
    names = [f"p{round(x * 100)}" for x in fixed.QUANTILES]
    left = certified_lengths.select(*keys, *[F.col(n).alias(f"_c_{n}") for n in names])
    right = recent_lengths.select(*keys, *[F.col(n).alias(f"_r_{n}") for n in names])
    if keys:
        g = g.join(left, keys, "left").join(right, keys, "left")
    else:
        g = g.crossJoin(F.broadcast(left)).crossJoin(F.broadcast(right))
    moved = []
    for n in names:
        was, now = F.col(f"_c_{n}"), F.coalesce(F.col(f"_r_{n}"), F.lit(0.0))
        ratio = now / was
        moved.append(
            F.when(
                (was > 0)
                & ~ratio.between(F.lit(1 / fixed.LENGTH_RATIO), F.lit(fixed.LENGTH_RATIO)),
                F.lit(n),
            )
        )
    g = g.withColumn("length_moves", F.array_compact(F.array(*moved)))
    return g.select(
        *keys,
        F.round("_tvd", 6).alias("total_variation"),
        "uncovered",
        "length_moves",
        F.when(F.col("_tvd") >= fixed.DRIFT_TVD, F.col("most_moved")).alias("most_moved"),
        (
            (F.col("_tvd") >= fixed.DRIFT_TVD)
            | (F.size("uncovered") > 0)
            | (F.size("length_moves") > 0)
        ).alias("drifted"),
    )


# ------------------------------------------------------------------------- splits


def split_tasks(tasks: DataFrame, calibration_size: int, seed: int) -> DataFrame:
    """Calibration and test splits, stratified by type, topped up in a fixed order.

    The order inside a type is a seeded hash, ranked without putting a type into one task.
    """
    sizes = tasks.groupBy("question_type").agg(F.count("*").alias("_size"))
    total = tasks.agg(F.count("*").alias("_n"))
    quota = sizes.crossJoin(F.broadcast(total)).select(
        "question_type",
        F.least(
            F.col("_size"),
            F.bround(F.col("_size") * (F.lit(calibration_size) / F.col("_n"))).cast("bigint"),
        ).alias("_take"),
        "_size",
    )
    # Leftovers are taken type by type: how many come before each type's own.
    spread = running_before(
        quota, [], F.lit(0), [F.col("question_type")],
        {"_before": F.col("_size") - F.col("_take"), "_taken_before": F.col("_take")},
    )
    taken = quota.agg(F.sum("_take").alias("_taken"))
    ranked = hash_rank(tasks, ["question_type"], "task_id", seed, "_rank")
    # A row per type: broadcast, so that no type's tasks meet in one join task.
    joined = ranked.join(broadcast_if_small(spread.drop("_taken_before")), "question_type").crossJoin(
        F.broadcast(taken)
    )
    short = F.lit(calibration_size) - F.col("_taken")
    leftover_rank = F.col("_before") + F.col("_rank") - F.col("_take")
    chosen = (F.col("_rank") <= F.col("_take")) | (leftover_rank <= short)
    return joined.select(
        *[c for c in tasks.columns if c != "split"],
        F.when(chosen, "calibration").otherwise("test").alias("split"),
    )


def stratified_subset(
    tasks: DataFrame, stratum: str, fraction: float = fixed.CANARY_FRACTION, seed: int = fixed.SEED
) -> DataFrame:
    """A fraction of every stratum, at least one task of each."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be in (0, 1]")
    sizes = tasks.groupBy(stratum).agg(
        F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(fraction)).cast("bigint")).alias("_take")
    )
    ranked = hash_rank(tasks, [stratum], "task_id", seed, "_rank")
    return ranked.join(broadcast_if_small(sizes), stratum).where(F.col("_rank") <= F.col("_take")).select(*tasks.columns)


def split_digest(tasks: DataFrame) -> DataFrame:
    """A digest of each split's membership that any moved task changes.

    Order-free sums of a digest of each id with the count, so no id list is ever collected.
    """
    task = row_number_of(F.col("task_id").cast("string"))
    return tasks.groupBy("split").agg(
        F.count("*").alias("n"),
        F.substring(F.sha2(F.concat_ws("|", F.count("*"), F.sum(task.cast("decimal(38,0)")), F.bit_xor(task)), 256), 1, 16).alias("digest"),
    )


# ---------------------------------------------------------------------- provenance


def tail_shape(items: DataFrame, space: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Coverage of a template space, share of items in rare templates, Gini of the counts.

    ``items``: keys, ``template_id``; ``space``: keys, ``template_id``. One row per template after the
    first aggregation, so the ranks behind the Gini index are small.
    """
    keys = keys or []
    counts = items.groupBy(*keys, "template_id").agg(F.count("*").alias("c"))
    ranked = running_before(
        counts, keys, F.floor(F.log2("c")), [F.col("c"), F.col("template_id")], {"_r": F.lit(1)}
    )
    total, n = F.sum("c"), F.count("*")
    weighted = F.sum((F.col("_r") + 1) * F.col("c"))
    shape = ranked.groupBy(*keys).agg(
        total.alias("items"),
        n.alias("templates"),
        (F.sum(F.when(F.col("c") <= fixed.TAIL_OCCURRENCES, F.col("c")).otherwise(0)) / total).alias(
            "tail_share"
        ),
        F.when(n > 1, (2 * weighted) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"),
    )
    known = space.select(*keys, "template_id").distinct()
    marked = known.join(
        counts.select(*keys, "template_id", F.lit(1).alias("_in")), [*keys, "template_id"], "left"
    )
    coverage = marked.groupBy(*keys).agg(
        F.count("*").alias("template_space"),
        F.count("_in").alias("templates_present"),
        (F.count("_in") / F.count("*")).alias("tail_coverage"),
    )
    return (
        shape.join(coverage, keys, "left") if keys else shape.crossJoin(F.broadcast(coverage))
    )


def missing_templates(items: DataFrame, space: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Templates of the space no item uses."""
    on = [*(keys or []), "template_id"]
    return space.select(*on).distinct().join(items.select(*on).distinct(), on, "left_anti")


def provenance_shares() -> list[Column]:
    """Model-generated, synthetic and real shares of ``n``."""
    n = F.col("n")
    ratio = lambda v: F.when(n > 0, v / n).otherwise(0.0)
    return [
        ratio(F.col("model_items")).alias("model_share"),
        ratio(F.col("model_items") + F.col("program_items")).alias("synthetic_share"),
        ratio(F.col("real_items")).alias("real_share"),
    ]


def assess_provenance(sets: DataFrame) -> DataFrame:
    """Whether a data set may back a certificate: every refusal and warning.

    ``sets``: ``n, real_items, model_items, program_items, generators, relabelled, decoding_budget,
    accumulating, template_space, tail_coverage, tail_share``.
    """
    c = F.col
    declared = c("real_items") + c("model_items") + c("program_items")
    share = F.when(c("n") > 0, c("model_items") / c("n")).otherwise(0.0)
    templated = F.coalesce(c("template_space"), F.lit(0)) > 0
    wrote = c("model_items") > 0
    refusals = F.array_compact(
        F.array(
            F.when(declared != c("n"), F.lit("declared origins do not add up")),
            F.when(
                (share > fixed.MAX_MODEL_GENERATED_SHARE) & ~c("accumulating"),
                F.lit("mostly model-generated and no real traffic accumulating"),
            ),
            F.when(c("real_items") < fixed.MIN_REAL_TRAFFIC_ITEMS, F.lit("no real traffic")),
            F.when(
                templated & (c("tail_coverage") < fixed.MIN_TAIL_COVERAGE),
                F.lit("template coverage below its floor"),
            ),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(~templated, F.lit("tail coverage is not measurable")),
            F.when(wrote & (c("generators") < fixed.MIN_GENERATORS), F.lit("too few generators")),
            F.when(wrote & ~c("relabelled"), F.lit("not relabelled by a frozen reference")),
            F.when(wrote & c("decoding_budget").isNull(), F.lit("no decoding budget recorded")),
            F.when(
                (c("tail_share") < 0.01) & (F.coalesce(c("template_space"), F.lit(0)) > 1),
                F.lit("few items in rare templates"),
            ),
        )
    )
    return sets.select(
        "*", *provenance_shares(), refusals.alias("refusals"), warnings.alias("warnings")
    ).withColumn("certifiable", F.size("refusals") == 0)


DETECTORS: dict[str, Callable[[], Column]] = {}


def register_detector(name: str, probability: Callable[[], Column]) -> None:
    """Add a builder of the column that says how likely an item is machine text."""
    if name in DETECTORS:
        raise ValueError(f"machine-text detector {name!r} is already registered")
    DETECTORS[name] = probability


def detector(name: str) -> Callable[[], Column]:
    """A registered machine-text detector; there is none until a caller registers one."""
    if name not in DETECTORS:
        raise ValueError(f"no machine-text detector named {name!r}; registered: {sorted(DETECTORS)}")
    return DETECTORS[name]


def importance_weights(
    items: DataFrame, probability: str, keys: list[str] | None = None,
    floor: float = fixed.MIN_RESAMPLE_WEIGHT,
) -> DataFrame:
    """Weights towards likely human-written items, summing to 1 by group.

    A value that is not a probability stops the job.
    """
    if not 0 < floor <= 1:
        raise ValueError("the weight floor must be in (0, 1]")
    keys, p = keys or [], F.col(probability)
    ok = p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
    raw = F.when(ok, F.greatest(F.lit(floor), 1 - p)).otherwise(
        F.raise_error(F.lit("a detector returned something that is not a probability")).cast("double")
    )
    staged = items.withColumn("_raw", raw)
    totals = staged.groupBy(*keys).agg(F.sum("_raw").alias("_sum"))
    joined = staged.join(broadcast_if_small(totals), keys) if keys else staged.crossJoin(F.broadcast(totals))
    return joined.withColumn("weight", F.col("_raw") / F.col("_sum")).drop("_raw", "_sum")
