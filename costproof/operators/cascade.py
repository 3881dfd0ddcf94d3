"""Cascades: evaluate a threshold vector, search all of them, pick an operating point.

A cascade asks the cheapest tier first and stops at the first score that reaches the tier's
threshold; the last tier always answers, and a task pays for every tier it touches.

The search never evaluates settings task by task. A setting depends on a score only through the
number of grid values it reaches, so tasks are aggregated once into cells of those numbers; every
setting is then a difference of entries of summed-area tables over the cells. After that one shuffle
the work depends on the grid and not on the number of tasks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof import fixed


def wide_matrix(matrix: DataFrame, tiers: int, keys: list[str] | None = None) -> DataFrame:
    """One row per task with ``score_i, correct_i, cost_i`` per tier.

    A task that some tier did not answer exactly once stops the job: the matrix must be complete.
    """
    keys = keys or []
    columns = []
    for i in range(tiers):
        here = F.col("tier_index") == i
        columns += [
            F.max(F.when(here, F.col(name))).alias(f"{short}_{i}")
            for name, short in (("score", "score"), ("correct", "correct"), ("cost", "cost"))
        ]
    seen = [F.count(F.when(F.col("tier_index") == i, 1)).alias(f"_seen_{i}") for i in range(tiers)]
    wide = matrix.groupBy(*keys, "task_id").agg(F.count("*").alias("_rows"), *seen, *columns)
    complete = F.col("_rows") == tiers
    for i in range(tiers):
        complete = complete & (F.col(f"_seen_{i}") == 1)
    refusal = F.raise_error(
        F.concat(F.lit("incomplete matrix at task "), F.col("task_id").cast("string"))
    ).cast("boolean")
    # A filter, so that no reader can prune the guard away.
    return wide.where(F.when(complete, True).otherwise(refusal)).drop(
        "_rows", *[f"_seen_{i}" for i in range(tiers)]
    )


def incomplete_tasks(matrix: DataFrame, tiers: int) -> DataFrame:
    """Tasks that are not answered exactly once by every tier."""
    seen = matrix.groupBy("task_id").agg(
        F.count("*").alias("answers"), F.count_distinct("tier_index").alias("tiers")
    )
    return seen.where((F.col("answers") != tiers) | (F.col("tiers") != tiers))


def simulate(
    wide: DataFrame, thresholds: list[float], tier_names: list[str], scarce: list[bool]
) -> DataFrame:
    """The outcome of one setting for every task: answer, tier, total, scarce and per-tier cost."""
    last = len(tier_names) - 1
    answers = [
        F.col(f"score_{i}") >= F.lit(float(thresholds[i])) for i in range(last)
    ] + [F.lit(True)]
    chosen: Column | None = None
    for i, ok in enumerate(answers[:-1]):
        chosen = F.when(ok, i) if chosen is None else chosen.when(ok, i)
    resolved = F.lit(0) if chosen is None else chosen.otherwise(last)
    staged = wide.withColumn("resolved", resolved)
    zero = F.lit(0)
    paid = [
        F.when(F.col("resolved") >= i, F.col(f"cost_{i}")).otherwise(zero) for i in range(last + 1)
    ]
    total, scarce_total = paid[0], paid[0] if scarce[0] else zero
    for i in range(1, last + 1):
        total = total + paid[i]
        scarce_total = scarce_total + paid[i] if scarce[i] else scarce_total
    correct = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        correct = F.when(F.col("resolved") == i, F.col(f"correct_{i}")).otherwise(correct)
    return staged.select(
        *[c for c in wide.columns if not c.startswith(("score_", "correct_", "cost_"))],
        correct.cast("int").alias("correct"),
        "resolved",
        F.element_at(F.array(*[F.lit(t) for t in tier_names]), F.col("resolved") + 1).alias(
            "resolved_tier"
        ),
        total.alias("cost"),
        scarce_total.alias("scarce_cost"),
        *[p.alias(f"tier_cost_{i}") for i, p in enumerate(paid)],
    )


def tier_shares(outcome: DataFrame, tiers: int, keys: list[str] | None = None) -> DataFrame:
    """Per tier: share of tasks resolved there, share reaching it, share of the spend."""
    keys = keys or []
    sums = []
    for i in range(tiers):
        sums += [
            F.sum((F.col("resolved") == i).cast("int")).alias(f"_r{i}"),
            F.sum((F.col("resolved") >= i).cast("int")).alias(f"_a{i}"),
            F.sum(f"tier_cost_{i}").alias(f"_c{i}"),
        ]
    totals = outcome.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("cost").alias("_t"), *sums)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("tier_index"),
                    (F.col(f"_r{i}") / F.col("n")).alias("resolved_share"),
                    (F.col(f"_a{i}") / F.col("n")).alias("reached_share"),
                    F.when(F.col("_t") != 0, F.col(f"_c{i}") / F.col("_t"))
                    .otherwise(0.0)
                    .cast("double")
                    .alias("cost_share"),
                )
                for i in range(tiers)
            ]
        )
    ).alias("_row")
    return totals.select(*keys, rows).select(*keys, "_row.*")


def grid(step: float = fixed.THRESHOLD_STEP) -> list[float]:
    """The threshold grid, as the rounded values scores are compared with."""
    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")
    return [round(x * step, 10) for x in range(int(1 / step) + 1)]


def _bin(score: Column, values: list[float]) -> Column:
    """How many grid values a score reaches: its quotient by the step, set right against two neighbours.

    No score reaches none of them; not-a-number, as in a comparison, all.
    """
    last = len(values)
    every = F.array(*[F.lit(v) for v in values])
    near = F.least(F.greatest(F.floor(score / F.lit(values[1] if last > 1 else 1.0)), F.lit(0)), F.lit(last - 1)).cast("int")
    here = (score >= F.element_at(every, near + 1)).cast("int")
    after = ((near + 1 < last) & (score >= F.element_at(every, F.least(near + 2, F.lit(last))))).cast("int")
    return F.when(F.isnan(score), last).otherwise(F.coalesce(near + here + after, F.lit(0)))


def cells(
    wide: DataFrame, tiers: int, step: float = fixed.THRESHOLD_STEP, keys: list[str] | None = None
) -> DataFrame:
    """Tasks aggregated by how many grid values each searchable tier's score reaches."""
    values, keys = grid(step), keys or []
    bins = [_bin(F.col(f"score_{i}"), values).alias(f"b{i}") for i in range(tiers - 1)]
    sums = [F.sum(f"correct_{i}").alias(f"ok_{i}") for i in range(tiers)] + [
        F.sum(f"cost_{i}").alias(f"cost_{i}") for i in range(tiers)
    ]
    return (
        wide.select("*", *bins)
        .groupBy(*keys, *[f"b{i}" for i in range(tiers - 1)])
        .agg(F.count("*").alias("n"), *sums)
    )


def _summed(cells_: pa.Table, tiers: int, scarce: list[bool], size: int) -> dict[str, np.ndarray]:
    """Successes, cost and scarce cost of every setting from the cells of one group.

    Tasks that go on past tier j are those with bin <= t on each of the first j axes, so a measure is
    summed over the later axes and then cumulated along the first j: a summed-area table. There are at
    most ``size ** (tiers - 1)`` cells, whatever the number of tasks.
    """
    axes = tiers - 1
    at = tuple(cells_.column(f"b{i}").to_numpy() for i in range(axes))

    def laid(name: str) -> np.ndarray:
        column = cells_.column(name)
        exact = pa.types.is_decimal(column.type)
        values = np.array([v or 0 for v in column.to_pylist()], object if exact else None)
        out = np.full((size,) * axes, Decimal(0), object) if exact else np.zeros((size,) * axes, values.dtype)
        out[at] = values if axes else values.sum()
        return out

    def past(name: str, depth: int) -> np.ndarray:
        table = laid(name).sum(axis=tuple(range(depth, axes)), keepdims=True) if depth < axes else laid(name)
        for axis in range(depth):
            table = np.cumsum(table, axis=axis)
        kept = tuple(slice(0, size - 1) if axis < depth else slice(None) for axis in range(axes))
        return np.broadcast_to(table[kept], (size - 1,) * axes)

    successes, cost = past("ok_0", 0), past("cost_0", 0)
    scarce_cost = cost if scarce[0] else cost * 0
    for depth in range(1, tiers):
        # Leaving tier depth-1 unanswered: give back its successes, add the next tier's.
        successes = successes - past(f"ok_{depth - 1}", depth) + past(f"ok_{depth}", depth)
        paid = past(f"cost_{depth}", depth)
        cost = cost + paid
        scarce_cost = scarce_cost + paid if scarce[depth] else scarce_cost
    whole = {"n": past("n", 0), "_dearest": past(f"ok_{tiers - 1}", 0)}
    return whole | {"_correct": successes, "_cost": cost, "scarce_cost": scarce_cost}


def settings(
    cell_table: DataFrame,
    tiers: int,
    scarce: list[bool],
    step: float = fixed.THRESHOLD_STEP,
    keys: list[str] | None = None,
) -> DataFrame:
    """Every threshold setting with its accuracy, cost and scarce cost, by group.

    A group's cells, of a number that the grid bounds, meet in one task and become summed-area tables.
    """
    if not 1 <= tiers <= 4:
        raise ValueError("the exhaustive search covers one to four tiers")
    values, axes, anchor = grid(step), tiers - 1, keys or ["_one"]
    keyed = cell_table if keys else cell_table.withColumn("_one", F.lit(0))
    money = keyed.schema["cost_0"].dataType.simpleString()
    shape = ", ".join(f"{k} {keyed.schema[k].dataType.simpleString()}" for k in anchor)
    shape += "".join(f", b{i} int" for i in range(axes))
    shape += f", n bigint, _dearest bigint, _correct bigint, _cost {money}, scarce_cost {money}"

    def run(group: pa.Table) -> pa.Table:
        found = _summed(group, tiers, scarce, len(values) + 1)
        places = np.indices((len(values),) * axes, np.int32).reshape(axes, -1) if axes else np.zeros((0, 1), np.int32)
        rows = places.shape[1]
        kind = group.schema.field("cost_0").type
        out = {k: pa.repeat(group.column(k)[0], rows) for k in anchor}
        out |= {f"b{i}": pa.array(p) for i, p in enumerate(places)}
        for name, table in found.items():
            flat = np.broadcast_to(table, (len(values),) * axes).reshape(-1)
            out[name] = pa.array(flat.tolist(), kind) if flat.dtype == object else pa.array(flat).cast(kind if "cost" in name else pa.int64())
        return pa.table(out)

    out = keyed.groupBy(*anchor).applyInArrow(run, shape)
    correct, cost = F.col("_correct"), F.col("_cost")
    every = F.array(*[F.lit(v) for v in values])
    thresholds = [F.element_at(every, F.col(f"b{i}") + 1) for i in range(axes)]
    return out.select(
        *(keys or []),
        *[F.col(f"b{i}").alias(f"t{i}") for i in range(axes)],
        F.array(*thresholds, F.lit(0.0)).alias("thresholds"),
        "n",
        correct.alias("successes"),
        (correct / F.col("n")).alias("accuracy"),
        cost.alias("total_cost"),
        (cost / F.col("n")).cast("double").alias("cost_per_task"),
        "scarce_cost",
        F.when(cost != 0, F.col("scarce_cost") / cost).otherwise(0.0).cast("double").alias("scarce_share"),
        (F.col("_dearest") / F.col("n")).alias("dearest_accuracy"),
    )


def _order(floor: Column, objective: str) -> Column:
    """Feasible settings first, then the objective, then higher accuracy; ties keep grid order."""
    goal = F.col("scarce_cost") if objective == "scarce" else F.col("total_cost")
    exact = lambda c: c.cast("decimal(38,12)")
    return F.when(
        F.col("accuracy") >= floor,
        F.struct(F.lit(0).alias("a"), exact(goal).alias("b"), exact(-F.col("successes")).alias("c"), F.col("thresholds").alias("d")),
    ).otherwise(
        F.struct(
            F.lit(1).alias("a"), exact(-F.col("successes")).alias("b"), exact(F.col("total_cost")).alias("c"), F.col("thresholds").alias("d")
        )
    )


def choose_each(
    setting_table: DataFrame, floor: Column, objectives: list[str], keys: list[str] | None = None
) -> DataFrame:
    """The best setting by group for every objective, from one pass over the settings.

    With no feasible setting: the most accurate, then the cheapest.
    """
    keys = keys or []
    picked = F.struct(*[F.col(c) for c in setting_table.columns if c not in keys])
    best = setting_table.groupBy(*keys).agg(
        F.array(*[
            F.struct(F.lit(o).alias("objective"), F.min_by(picked, _order(floor, o)).alias("best")) for o in objectives
        ]).alias("_each"),
        F.sum((F.col("accuracy") >= floor).cast("int")).alias("feasible"),
        F.count("*").alias("evaluated"),
    )
    rows = best.select(*keys, F.inline("_each"), "feasible", "evaluated")
    return rows.where("best IS NOT NULL").select(*keys, "objective", "best.*", "feasible", "evaluated")


def choose(
    setting_table: DataFrame,
    floor: Column,
    objective: str = "cost",
    keys: list[str] | None = None,
) -> DataFrame:
    """The best setting by group for one objective."""
    return choose_each(setting_table, floor, [objective], keys).drop("objective")


def search(
    matrix: DataFrame,
    tier_names: list[str],
    scarce: list[bool],
    floor: float | None = None,
    step: float = fixed.THRESHOLD_STEP,
    objective: str = "cost",
    keys: list[str] | None = None,
) -> DataFrame:
    """Exhaustive search on the rows given, which the caller restricts to the calibration split.

    Without a floor, it is the dearest tier's own accuracy less the allowed slack.
    """
    tiers = len(tier_names)
    cell_table = cells(wide_matrix(matrix, tiers, keys), tiers, step, keys)
    table = settings(cell_table, tiers, scarce, step, keys)
    limit = (
        F.col("dearest_accuracy") - F.lit(fixed.ACCURACY_SLACK)
        if floor is None
        else F.lit(float(floor))
    )
    return choose(table, limit, objective, keys)


def pareto(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The frontier of a settings table: sorted by cost, strictly rising accuracy.

    Runs over settings, whose number is fixed by the grid, so the window is bounded.
    """
    keys = keys or []
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = base.orderBy(F.col("total_cost"), F.col("successes").desc(), F.col("thresholds"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("successes").over(before)
    return table.withColumn("_best", best).where(
        F.col("_best").isNull() | (F.col("successes") > F.col("_best"))
    ).drop("_best")


def best_configuration(configurations: DataFrame, objective: str = "cost_per_task") -> DataFrame:
    """The operating point: adoptable, feasible first, then the objective, then accuracy."""
    eligible = configurations.where(F.col("adoptable"))
    order = F.struct(
        (~F.col("feasible")).cast("int").alias("a"),
        F.col(objective).alias("b"),
        (-F.col("accuracy")).alias("c"),
        F.col("label").alias("d"),
    )
    return eligible.agg(
        F.min_by(F.struct(*[F.col(c) for c in configurations.columns]), order).alias("_best")
    ).select("_best.*")


def tiers_by_cost(prices: DataFrame) -> DataFrame:
    """Models cheapest first by input plus output price."""
    return prices.orderBy(F.col("input") + F.col("output"), F.col("model"))
