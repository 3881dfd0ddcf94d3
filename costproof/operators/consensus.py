"""Labels from agreement, where there is no answer key.

All tiers' draws of one task are pooled and grouped by answer. The pool of a task holds tiers x draws
rows by construction (depth is checked), so it is an array in one row and the grouping is a fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import grading
from costproof.operators.scoring import apart, by_size, fit


@dataclass(frozen=True)
class LabelKind:
    """One way of standing in for an answer key."""

    name: str
    leave_one_out: bool
    exclude_uniform: bool
    penalize_overconfidence: bool
    weight_by_margin: bool


LABEL_KINDS = {
    "majority-vote": LabelKind("majority-vote", False, False, False, False),
    "penalized-v1": LabelKind("penalized-v1", True, True, True, True),
}


def register_label_kind(kind: LabelKind) -> None:
    """Add a way of making labels from samples."""
    if kind.name in LABEL_KINDS:
        raise ValueError(f"label kind {kind.name!r} is already registered")
    LABEL_KINDS[kind.name] = kind


def label_kind(name: str) -> LabelKind:
    if name not in LABEL_KINDS:
        raise ValueError(f"unknown label kind {name!r}; registered: {sorted(LABEL_KINDS)}")
    return LABEL_KINDS[name]


def _shape(groups: Column) -> Column:
    """``struct(margin, uniformity, support)`` of groups ordered largest first."""
    sizes = F.transform(groups, lambda g: g["size"].cast("double"))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, s: a + s)
    first, second = F.try_element_at(sizes, F.lit(1)), F.try_element_at(sizes, F.lit(2))
    nats = F.aggregate(sizes, F.lit(0.0), lambda a, s: a - (s / total) * F.log(s / total))
    return F.struct(
        ((first - F.coalesce(second, F.lit(0.0))) / total).alias("margin"),
        F.when(F.size(sizes) < 2, F.lit(0.0)).otherwise(nats / F.log(F.size(sizes).cast("double"))).alias("uniformity"),
        (first / total).alias("support"),
    )


def _ambiguous(shape: Column, margin: float) -> Column:
    return (shape["margin"] < margin) | (shape["uniformity"] >= fixed.UNIFORMITY_CUTOFF)


SHAPE = ("margin", "uniformity", "support")


def _pools(tiers: int, rules: LabelKind) -> dict[str, list[int]]:
    """Which tiers vote in which pool: all of them, all but one, and one alone."""
    pools = {"pool": list(range(tiers))}
    if rules.leave_one_out and tiers > 1:
        pools |= {f"rest{i}": [j for j in range(tiers) if j != i] for i in range(tiers)}
    if rules.penalize_overconfidence:
        pools |= {f"own{i}": [i] for i in range(tiers)}
    return pools


def _ranked(members: list[int]) -> Column:
    """An answer's place in the vote of some tiers as one number: its draws, then how early it came."""
    size, at = F.lit(0), F.lit(None).cast("bigint")
    for i in reversed(members):
        size = size + F.col(f"_n{i}")
        at = F.coalesce(F.lit(i << 32) + F.col(f"_f{i}"), at)
    place = size.cast("bigint") * F.lit(1 << 40) + (F.lit((1 << 40) - 1) - at)
    return F.when(size > 0, place).otherwise(F.lit(0).cast("bigint"))


def _size(ranked: Column) -> Column:
    return F.shiftright(ranked, 40).cast("int")


def _nats(size: Column, total: int) -> Column:
    share = size / F.lit(float(total))
    return -share * F.log(share)


def _plain_shape(pool: str, total: int) -> Column:
    """``struct(margin, uniformity, support, number, largest)`` of a pool of plain numbers."""
    ranks = F.sort_array(F.col("_ranks")[f"_r_{pool}"], asc=False)
    groups = F.size(F.filter(F.col("_ranks"), lambda r: r[f"_r_{pool}"] > 0))
    first, second = _size(F.get(ranks, F.lit(0))), F.coalesce(_size(F.get(ranks, F.lit(1))), F.lit(0))
    return F.struct(
        ((first - second) / F.lit(float(total))).alias("margin"),
        F.when(groups < 2, F.lit(0.0)).otherwise(F.col(f"_h_{pool}") / F.log(groups.cast("double"))).alias("uniformity"),
        (first / F.lit(float(total))).alias("support"),
        F.col(f"_top_{pool}").alias("number"),
        first.alias("largest"),
    )


def consensus_labels(
    samples: DataFrame,
    tiers: list[str],
    depth: int,
    kind: str = "penalized-v1",
    min_margin: float = fixed.MIN_CONSENSUS_MARGIN,
) -> DataFrame:
    """One row per task and tier: ``label, weight, excluded, penalized, reference`` and the margin.

    ``samples``: ``task_id, tier, sample_index, output``. Every tier must hold exactly ``depth`` draws
    of every task, or the job stops: the deepest tier would decide the vote.
    """
    rules = label_kind(kind)
    order = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    drawn = samples.where(F.col("tier").isin(*tiers)).select("task_id", order.alias("o"), "sample_index", "output")
    # Plain numbers are told before anything moves, and equal outputs are merged, in the exchange that
    # brings a task together, before any is read.
    number = grading.whole_number(F.col("output"))
    told = drawn.select("task_id", "o", "sample_index", number.alias("number"), F.when(number.isNull(), F.col("output")).alias("other"))
    mine = [F.col("o") == i + 1 for i in range(len(tiers))]
    merged = told.repartition("task_id").groupBy("task_id", "number", "other").agg(
        *[F.count(F.when(m, 1)).cast("int").alias(f"_n{i}") for i, m in enumerate(mine)],
        *[F.min(F.when(m, F.col("sample_index"))).alias(f"_f{i}") for i, m in enumerate(mine)],
    )
    pools = _pools(len(tiers), rules)
    ranked = merged.select("*", *[_ranked(members).alias(f"_r_{name}") for name, members in pools.items()])
    item = F.struct(
        "number", "other", F.array(*[F.col(f"_n{i}") for i in range(len(tiers))]).alias("n"),
        F.array(*[F.col(f"_f{i}") for i in range(len(tiers))]).alias("f"),
    )
    # A task of plain numbers is voted on by whole numbers alone; only others keep their replies for the folds.
    pooled = ranked.groupBy("task_id").agg(
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(tiers))],
        F.bool_and(F.col("number").isNotNull()).alias("_plain"),
        F.collect_list(item).alias("_items"),
        F.collect_list(F.struct(*[f"_r_{name}" for name in pools])).alias("_ranks"),
        *[F.max_by("number", f"_r_{name}").alias(f"_top_{name}") for name in pools],
        *[F.min_by("number", f"_f{i}").alias(f"_own_first{i}") for i in range(len(tiers))],
        *[
            F.sum(F.when(_size(F.col(f"_r_{name}")) > 0, _nats(_size(F.col(f"_r_{name}")), depth * len(members)))).alias(f"_h_{name}")
            for name, members in pools.items()
        ],
    )
    even = F.lit(True)
    for i in range(len(tiers)):
        even = even & F.coalesce(F.col(f"_n{i}") == depth, F.lit(False))
    plain = [_plain_shape(name, depth * len(members)).alias(f"_p_{name}") for name, members in pools.items()]
    slow = F.when(~F.col("_plain"), F.sort_array(F.flatten(F.array(*[
        F.transform(
            F.filter("_items", (lambda i: lambda d: d["n"][i] > 0)(i)),
            (lambda i: lambda d: F.struct(
                F.lit(i + 1).alias("o"), d["f"][i].alias("drawn"), d["n"][i].alias("size"),
                grading.answer_key(F.coalesce(d["other"], d["number"].cast("string"))).alias("rep"),
            ))(i),
        )
        for i in range(len(tiers))
    ]))))
    pooled = pooled.select("*", *plain, slow.alias("_all"))
    placed = F.transform(
        "_all", lambda r, i: F.struct(r["o"].alias("o"), i.alias("first"), r["size"].alias("size"), r["rep"].alias("rep"))
    )
    fast = ["_plain", *[f"_p_{name}" for name in pools], *[f"_own_first{i}" for i in range(len(tiers))]]
    pooled = pooled.select(
        "task_id",
        F.when(even, placed)
        .otherwise(F.raise_error(F.lit("the tiers were sampled to different depths")))
        .alias("_all"),
        *fast,
    )

    def shape_of(fold: str, pool: str) -> Column:
        """A pool's shape: of whole numbers where a task has nothing else, else of the folded groups."""
        return F.when(F.col("_plain"), F.struct(*[F.col(f"_p_{pool}")[x].alias(x) for x in SHAPE])).otherwise(_shape(F.col(fold)))

    def groups(keep) -> Column:
        return by_size(fit(apart(F.filter("_all", keep) if keep else F.col("_all"))))

    staged = pooled.select(
        "task_id",
        "_all",
        *fast,
        groups(None).alias("_pool"),
        *[
            groups((lambda i: lambda r: r["o"] != i + 1)(i)).alias(f"_rest{i}")
            for i in range(len(tiers))
            if rules.leave_one_out
        ],
        *[
            groups((lambda i: lambda r: r["o"] == i + 1)(i)).alias(f"_own{i}")
            for i in range(len(tiers))
            if rules.penalize_overconfidence
        ],
    )
    voters = lambda i: f"rest{i}" if f"rest{i}" in pools else "pool"
    reference = [
        F.when(F.size(f"_rest{i}") > 0, F.col(f"_rest{i}")).otherwise(F.col("_pool"))
        if rules.leave_one_out
        else F.col("_pool")
        for i in range(len(tiers))
    ]
    shapes = staged.select(
        "*",
        shape_of("_pool", "pool").alias("_shape"),
        *[r.alias(f"_ref{i}") for i, r in enumerate(reference)],
    ).select("*", *[shape_of(f"_ref{i}", voters(i)).alias(f"_rs{i}") for i in range(len(tiers))])
    excluded = F.lit(False)
    if rules.exclude_uniform:
        excluded = _ambiguous(F.col("_shape"), min_margin)
        for i in range(len(tiers)):
            excluded = excluded | _ambiguous(F.col(f"_rs{i}"), min_margin)
    out = []
    for i, tier in enumerate(tiers):
        top = F.element_at(f"_ref{i}", 1)
        first_own = F.element_at(F.filter("_all", (lambda i: lambda r: r["o"] == i + 1)(i)), 1)
        voted = F.col(f"_p_{voters(i)}")["number"]
        agrees = F.when(F.col("_plain"), voted == F.col(f"_own_first{i}")).otherwise(
            grading.same_answer(top["rep"], first_own["rep"])
        )
        penal = F.lit(False)
        if rules.penalize_overconfidence:
            largest = F.when(F.col("_plain"), F.col(f"_p_own{i}")["largest"]).otherwise(F.element_at(f"_own{i}", 1)["size"])
            consistency = largest / F.lit(float(depth))
            penal = ~agrees & (consistency >= fixed.OVERCONFIDENT_CONSISTENCY)
        base = (
            F.greatest(F.lit(fixed.MIN_LABEL_WEIGHT), F.col(f"_rs{i}.margin"))
            if rules.weight_by_margin
            else F.lit(1.0)
        )
        out.append(
            F.struct(
                F.lit(tier).alias("tier"),
                agrees.cast("int").alias("label"),
                (base * F.when(penal, 1.0 + fixed.OVERCONFIDENCE_PENALTY).otherwise(1.0)).alias("weight"),
                penal.alias("penalized"),
                F.when(F.col("_plain"), voted.cast("string")).otherwise(top["rep"]["answer"]).alias("reference"),
                F.col(f"_rs{i}.margin").alias("margin"),
                excluded.alias("excluded"),
                F.col("_shape.support").alias("support"),
                F.col("_shape.uniformity").alias("uniformity"),
            )
        )
    # Flags come out of the explode, so a filter on them is not copied below the folds.
    return shapes.select("task_id", F.explode(F.array(*out)).alias("_o")).select("task_id", "_o.*")


def label_agreement(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """How often a tier's label matches a real one, on kept tasks only."""
    kept = labels.where(~F.col("excluded")).select("task_id", "tier", "label")
    joined = kept.join(truth.select("task_id", "tier", F.col("correct").alias("_t")), ["task_id", "tier"])
    return joined.groupBy("tier").agg(
        F.count("*").alias("kept"), F.avg((F.col("label") == F.col("_t")).cast("double")).alias("agreement")
    )
