"""Configurations compared end to end: fit and search on calibration, then one look at test.

Calibration rows are the only ones the fits and the search read; their thresholds come back to the
driver (a few numbers) before the test job is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof import fixed
from costproof.operators import arms as A
from costproof.operators import cascade as C
from costproof.operators import consensus as K
from costproof.operators import scoring as S
from costproof.runtime import broadcast_if_small, cut, written


def tier_runs(prepared: DataFrame, tiers: list[str]) -> DataFrame:
    """A tier matrix from scored answers: ``task_id, tier_index, tier, score, correct, cost``.

    The cost is that of all draws the configuration pays for and the correctness is that of the answer
    it returns.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier")) - 1
    return prepared.select(
        "task_id", order.cast("int").alias("tier_index"), "tier", "score",
        F.col("correct").cast("int").alias("correct"), "cost", "split",
    )


def evaluate(
    matrix: DataFrame, tiers: list[str], scarce: list[bool], label: Column | None = None,
    step: float = fixed.THRESHOLD_STEP,
) -> tuple[list[float], float, DataFrame]:
    """Thresholds and floor from calibration rows, and the outcome of every test task."""
    cal = matrix.where(F.col("split") == "calibration")
    if label is not None:
        cal = cal.withColumn("correct", label)
    point = C.search(cal, tiers, scarce, step=step).select("thresholds", "dearest_accuracy").first()
    thresholds = [float(t) for t in point["thresholds"]]
    wide = C.wide_matrix(matrix.where(F.col("split") == "test"), len(tiers))
    floor = float(point["dearest_accuracy"]) - fixed.ACCURACY_SLACK
    return thresholds, floor, C.simulate(wide, thresholds, tiers, scarce)


def _labelled(samples: DataFrame, kind: str, k: int) -> DataFrame:
    """Features from the router's view only; the returned sample's label and split come in afterwards."""
    ready = S.scorer_kind(kind).prepare(S.router_view(samples), k)
    if "answer_index" not in ready.columns:
        ready = ready.withColumn("answer_index", F.lit(0))
    labels = samples.select(
        "task_id", "tier", F.col("sample_index").cast("bigint").alias("answer_index"), "correct", "split"
    )
    keyed = ready.withColumn("answer_index", F.col("answer_index").cast("bigint"))
    return keyed.join(labels, ["task_id", "tier", "answer_index"])


def _prepare(samples: DataFrame, kind: str, k: int) -> DataFrame:
    """One row per task and tier with what the fits, the search and the evaluation read: written once.

    Where the scorer tells quickly read tasks, labels ride along with their draws, unread by any feature, so that
    draws move once; only the other tasks are prepared in full.
    """
    scorer = S.scorer_kind(kind)
    columns = ["task_id", "tier", "split", *scorer.features, F.col("cost").cast("decimal(38,12)").alias("cost"), "correct"]
    if scorer.told is None:
        return written(_labelled(samples, kind, k).select(*columns))
    view = samples.select(*S.router_view(samples).columns, "correct", "split")
    told = written(scorer.told(view, k, ["task_id", "tier", "split"]).select(*columns, "told"))
    others = told.where(~F.col("told")).select("task_id", "tier")
    if others.isEmpty():
        return told.drop("told")
    full = samples.join(broadcast_if_small(others), ["task_id", "tier"], "left_semi")
    return told.where("told").drop("told").unionByName(written(_labelled(full, kind, k).select(*columns)))


def compare_scorers(
    samples: DataFrame, tiers: list[str], scarce: list[bool], kinds: list[tuple[str, int]],
    baseline: str, adoptable: set[str] | None = None,
) -> DataFrame:
    """One row per (scorer, k): thresholds, test accuracy, cost per success, and its paired verdict
    against the baseline tier on the same test tasks."""
    first = samples.where((F.col("sample_index") == 0) & (F.col("split") == "test"))
    base = first.where(F.col("tier") == baseline).select(
        F.lit(baseline).alias("pipeline"), "task_id", "correct", F.col("cost").cast("decimal(38,12)").alias("cost")
    )
    rows, chosen = written(base), []
    for kind, k in kinds:
        name = f"{kind}/k={k}"
        prepared = _prepare(samples, kind, k)
        scored, _ = S.score_tiers(
            prepared, list(S.scorer_kind(kind).features), F.col("split") == "calibration", tiers=tiers
        )
        thresholds, floor, outcome = evaluate(tier_runs(scored, tiers), tiers, scarce)
        chosen.append((name, kind, k, thresholds, floor, adoptable is None or name in adoptable))
        answered = outcome.select(
            F.lit(name).alias("pipeline"), "task_id", "correct", F.col("cost").cast("decimal(38,12)").alias("cost")
        )
        # Read by the summary and by every branch of the pairing.
        rows = rows.unionByName(written(answered))
    spark = samples.sparkSession
    settings = spark.createDataFrame(
        chosen,
        "pipeline string, scorer string, k int, thresholds array<double>, accuracy_floor double, adoptable boolean",
    )
    summary = A.arm_summary(rows)
    proof = A.proof(A.pair(rows, baseline)).select(
        "pipeline", "delta", "delta_low", "delta_high", "verdict", "mcnemar_p", "cost_ratio"
    )
    return settings.join(summary, "pipeline").join(proof, "pipeline")


def calibrate_with_labels(
    samples: DataFrame, tiers: list[str], scarce: list[bool], k: int,
    kinds: tuple[str, ...] = ("gold", "majority-vote", "penalized-v1"),
) -> DataFrame:
    """Thresholds and test results of one configuration under each label source."""
    prepared = _prepare(samples, "self-consistency-v1", k)
    cal_samples = samples.where(F.col("split") == "calibration")
    rows = []
    for kind in kinds:
        if kind == "gold":
            labelled = prepared.withColumn("label", F.col("correct")).withColumn("weight", F.lit(1.0))
        else:
            labels = cut(K.consensus_labels(cal_samples, tiers, k, kind).where(~F.col("excluded")))
            labelled = prepared.join(
                labels.select("task_id", "tier", "label", "weight"), ["task_id", "tier"], "left"
            )
        usable = (F.col("split") == "calibration") & F.col("label").isNotNull()
        scored, _ = S.score_tiers(
            labelled, ["sample_entropy"], usable, "label", "weight", tiers=tiers
        )
        # The search counts successes by the same labels the fit used, on tasks that kept them.
        matrix = tier_runs(scored, tiers).join(
            scored.select("task_id", "tier", "label"), ["task_id", "tier"]
        )
        held = matrix.where((F.col("split") == "test") | F.col("label").isNotNull())
        thresholds, floor, outcome = evaluate(
            held, tiers, scarce, F.coalesce("label", F.col("correct"))
        )
        result = outcome.agg(F.avg("correct"), F.sum("cost"), F.count("*")).first()
        rows.append((kind, thresholds, floor, float(result[0]), float(result[1]), int(result[2])))
    gold = rows[0][1]
    out = [
        (*r, max((abs(a - b) for a, b in zip(r[1], gold, strict=True)), default=0.0)) for r in rows
    ]
    return samples.sparkSession.createDataFrame(
        out,
        "labels string, thresholds array<double>, accuracy_floor double, test_accuracy double, "
        "test_cost double, n long, largest_threshold_gap double",
    )
