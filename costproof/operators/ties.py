"""Ties: configurations the data cannot separate on cost, the fallback among them, or a refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ORDER = ("cost_point", "accuracy", "label")


def _rank(extra: list | None = None):
    return F.struct(
        *(extra or []),
        F.col("cost_point").alias("_o1"),
        (-F.col("accuracy")).alias("_o2"),
        F.col("label").alias("_o3"),
    )


def tied_for_cheapest(configurations: DataFrame) -> DataFrame:
    """Rows whose cost interval overlaps the cheapest row's: a range join with one row.

    Overlap is wider than a paired test on purpose; it errs towards reporting more options.
    """
    cheapest = configurations.agg(
        F.min_by(F.struct("label", "cost_low", "cost_high"), _rank()).alias("_b")
    ).select(
        F.col("_b.label").alias("_label"),
        F.col("_b.cost_low").alias("_low"),
        F.col("_b.cost_high").alias("_high"),
    )
    overlaps = (F.col("cost_low") <= F.col("_high")) & (F.col("_low") <= F.col("cost_high"))
    return (
        configurations.join(F.broadcast(cheapest), overlaps)
        .withColumn("is_cheapest", F.col("label") == F.col("_label"))
        .drop("_label", "_low", "_high")
    )


def designate_fallback(tied: DataFrame, running: str | None = None) -> DataFrame:
    """One row: what runs, and the adoptable other option leaning least on scarce capacity.

    ``running`` defaults to the first adoptable row in cost order, else the cheapest.
    """
    named = F.lit(1) if running is None else (F.col("label") != F.lit(running)).cast("int")
    first = tied.agg(
        F.min_by(
            F.struct("label", "scarce_share"),
            _rank([named.alias("_n"), (~F.col("adoptable")).cast("int").alias("_a")]),
        ).alias("_r")
    ).select(
        F.col("_r.label").alias("running"), F.col("_r.scarce_share").alias("running_scarce_share")
    )
    options = tied.crossJoin(F.broadcast(first)).where(
        F.col("adoptable") & (F.col("label") != F.col("running"))
    )
    chosen = options.agg(
        F.min_by(
            F.struct("label", "scarce_share"), F.struct("scarce_share", "cost_point", "label")
        ).alias("_f")
    )
    return first.crossJoin(F.broadcast(chosen)).select(
        "running",
        "running_scarce_share",
        F.col("_f.label").alias("fallback"),
        (F.col("_f.scarce_share") < F.col("running_scarce_share")).alias("relieves_scarcity"),
    )


def tie_report(configurations: DataFrame, running: str | None = None) -> DataFrame:
    """The tied rows with flags and a uniform exploration weight."""
    tied = tied_for_cheapest(configurations)
    pick = designate_fallback(tied, running).select("running", "fallback")
    size = tied.agg(F.count("*").alias("_k"))
    return (
        tied.crossJoin(F.broadcast(pick))
        .crossJoin(F.broadcast(size))
        .withColumn("is_running", F.col("label") == F.col("running"))
        .withColumn("is_fallback", F.coalesce(F.col("label") == F.col("fallback"), F.lit(False)))
        .withColumn("exploration_weight", F.lit(1.0) / F.col("_k"))
        .drop("running", "fallback", "_k")
    )


def single_winner(configurations: DataFrame) -> DataFrame:
    """The one cheapest configuration; a tie stops the job and names the tied labels."""
    tied = tied_for_cheapest(configurations)
    listed = tied.agg(
        F.count("*").alias("_k"),
        F.sort_array(F.collect_list("label")).alias("_labels"),
        F.max(F.when(F.col("is_cheapest"), F.col("label"))).alias("label"),
    )
    return listed.select(
        F.when(F.col("_k") == 1, F.col("label"))
        .otherwise(
            F.raise_error(F.concat(F.lit("no single winner: "), F.concat_ws(", ", "_labels")))
        )
        .alias("label")
    )
