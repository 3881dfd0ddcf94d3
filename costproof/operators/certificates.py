"""Certificates and the looks taken at them: small tables, joined and appended to, never rewritten."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from costproof import fixed
from costproof.functions import stats
from costproof.operators.drift import stratified_subset


@F.pandas_udf(DoubleType())
def _late_spending(alpha: pd.Series, fraction: pd.Series) -> pd.Series:
    """O'Brien-Fleming cumulative spending; one row per planned look."""
    normal = NormalDist()

    def spent(a: float, f: float) -> float:
        if f <= 0:
            return 0.0
        return 2 * (1 - normal.cdf(normal.inv_cdf(1 - a / 2) / math.sqrt(f)))

    return pd.Series([spent(a, f) for a, f in zip(alpha, fraction, strict=True)])


def cumulative_alpha(alpha: Column, fraction: Column, spending: Column) -> Column:
    """Error budget spent by the time a fraction of the looks is in."""
    return (
        F.when(fraction == 0, F.lit(0.0))
        .when(spending == "pocock", alpha * fraction)
        .when(spending == "obrien-fleming", _late_spending(alpha, fraction))
        .otherwise(
            F.raise_error(F.concat(F.lit("unknown spending function "), spending)).cast("double")
        )
    )


def alpha_schedule(certificates: DataFrame) -> DataFrame:
    """Per-look levels whose family-wise error is exactly alpha, for independent looks.

    ``certificates``: ``certificate_id, alpha, looks_planned, spending``.
    """
    looks = certificates.select(
        "certificate_id", "alpha", "spending", "looks_planned",
        F.explode(F.sequence(F.lit(1), F.col("looks_planned"))).alias("look"),
    )
    spent = looks.withColumn(
        "spent",
        cumulative_alpha(F.col("alpha"), F.col("look") / F.col("looks_planned"), F.col("spending")),
    )
    before = F.coalesce(
        F.lag("spent").over(Window.partitionBy("certificate_id").orderBy("look")), F.lit(0.0)
    )
    level = 1 - (1 - F.col("spent")) / (1 - before)
    return spent.select(
        "certificate_id", "look", "spent",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)).alias("level"),
    )


def issue(
    proofs: DataFrame,
    today: Column,
    ttl_days: int = fixed.CERTIFICATE_TTL_DAYS,
    interval_days: int = fixed.CANARY_INTERVAL_DAYS,
    alpha: float = fixed.ALPHA,
    spending: str = "pocock",
) -> DataFrame:
    """One certificate per proof row: the verdict and interval frozen with an expiry and looks.

    ``proofs``: ``workload, pipeline, verdict, delta, delta_low, delta_high, n`` and ``snapshots``
    (role to revision).
    """
    if interval_days < 1 or ttl_days < 1:
        raise ValueError("a certificate stands for at least a day and so does an interval")
    identity = F.to_json(
        F.struct(
            "workload", "pipeline",
            F.array_sort(F.map_entries("snapshots")).alias("snapshots"),
        )
    )
    return proofs.select(
        F.substring(F.sha2(identity, 256), 1, 16).alias("certificate_id"),
        "workload", "pipeline", "verdict", "delta", "delta_low", "delta_high", "n", "snapshots",
        today.alias("issued"),
        F.date_add(today, ttl_days).alias("expires"),
        F.lit(max(1, ttl_days // interval_days)).alias("looks_planned"),
        F.lit(float(alpha)).alias("alpha"),
        F.lit(spending).alias("spending"),
    )


def expired(today: Column, expires: Column) -> Column:
    return today > expires


def identity_changes(certified: DataFrame, current: DataFrame) -> DataFrame:
    """Roles whose model revision changed, appeared or went away: a full outer comparison.

    Both sides: ``certificate_id, role, snapshot``.
    """
    a = certified.select("certificate_id", "role", F.col("snapshot").alias("was"))
    b = current.select("certificate_id", "role", F.col("snapshot").alias("now"))
    return a.join(b, ["certificate_id", "role"], "full_outer").where(
        ~F.col("was").eqNullSafe(F.col("now"))
    )


def paired_delta(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Closed-form paired delta and standard error; infinite below two tasks."""
    d = (F.col("c_correct") - F.col("b_correct")).cast("double")
    return pairs.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.avg(d).alias("delta"),
        F.when(F.count("*") > 1, F.stddev_samp(d) / F.sqrt(F.count("*")))
        .otherwise(F.lit(float("inf")))
        .alias("standard_error"),
    )


def canary_observation(
    pairs: DataFrame, fraction: float = fixed.CANARY_FRACTION, seed: int = fixed.SEED
) -> DataFrame:
    """Delta of a stratified subset of paired outcomes."""
    return paired_delta(stratified_subset(pairs, "question_type", fraction, seed))


def take_looks(
    certificates: DataFrame, looks: DataFrame, observed: DataFrame,
    changes: DataFrame | None = None, drift: DataFrame | None = None,
) -> DataFrame:
    """The looks that one or more batches of observations take, to be appended to ``looks``.

    ``observed``: ``certificate_id, batch, taken_on, delta, standard_error``, one row per certificate and
    batch; delta may be null where nothing was scored again. ``changes``: ``certificate_id, batch, role``
    from ``identity_changes``; ``drift``: ``certificate_id, batch, drifted``. ``looks``: what was taken
    before, with ``certificate_id, batch``.

    A certificate's looks are numbered by batch over both tables, and look i is tested at the level that
    the spending function leaves it. Expiry, identity, outcome and distribution are four separate
    reasons. A batch that is tried again gets the numbers it had, so writing it over its own rows
    changes nothing. A certificate with no look left stops the job.
    """
    every = looks.select("certificate_id", "batch").union(observed.select("certificate_id", "batch")).distinct()
    number = F.row_number().over(Window.partitionBy("certificate_id").orderBy("batch"))
    numbered = every.select("certificate_id", "batch", number.alias("look"))  # at most looks_planned each
    out = observed.join(numbered, ["certificate_id", "batch"]).join(certificates.withColumnRenamed("delta", "_was"), "certificate_id")
    left = F.when(F.col("look") <= F.col("looks_planned"), F.col("look")).otherwise(
        F.raise_error(F.concat(F.lit("no looks left for certificate "), F.col("certificate_id"))).cast("int")
    )
    out = out.withColumn("look", left)
    levels = alpha_schedule(certificates).select("certificate_id", "look", "level")
    out = out.join(levels, ["certificate_id", "look"])
    own = (F.col("delta_high") - F.col("delta_low")) / (2 * fixed.Z_95)
    combined = F.sqrt(own * own + F.col("standard_error") * F.col("standard_error"))
    z = F.when(combined > 0, (F.col("delta") - F.col("_was")) / combined)
    out = out.withColumn("z", z).withColumn("critical", stats.z_column(F.col("level")))
    key = ["certificate_id", "batch"]
    if changes is not None:
        moved = changes.groupBy(*key).agg(F.sort_array(F.collect_set("role")).alias("changed_roles"))  # a few roles
        out = out.join(moved, key, "left")
    else:
        out = out.withColumn("changed_roles", F.lit(None).cast("array<string>"))
    if drift is not None:
        out = out.join(drift.select(*key, F.col("drifted").alias("_drift")), key, "left")
    else:
        out = out.withColumn("_drift", F.lit(None).cast("boolean"))
    reasons = F.array_compact(
        F.array(
            F.when(expired(F.col("taken_on"), F.col("expires")), F.lit("expired")),
            F.when(F.size("changed_roles") > 0, F.lit("identity changed")),
            F.when(F.abs("z") > F.col("critical"), F.lit("outcome moved")),
            F.when(F.col("_drift"), F.lit("distribution moved")),
        )
    )
    return out.select(
        "certificate_id", "batch", "look", "taken_on", F.col("level").alias("alpha_this_look"),
        F.col("delta").alias("observed_delta"), F.col("standard_error").alias("observed_standard_error"), "z", "critical",
        F.col("delta").isNotNull().alias("outcome_tested"),
        F.col("_drift").isNotNull().alias("distribution_tested"),
        F.coalesce("changed_roles", F.array().cast("array<string>")).alias("changed_roles"),
        reasons.alias("reasons"),
    ).withColumn("raised", F.size("reasons") > 0)


# ------------------------------------------------------------------------- evidence

STANDINGS = ("blocking", "simulated", "ok")
GRADES = {"blocking": "insufficient", "simulated": "simulated", "ok": "recording"}


def evidence_links(
    verdict: Column, sufficient: Column, real_items: Column, n: Column, simulated: Column,
    judged: Column, prices_verified: Column, exact_counter: Column,
) -> Column:
    """The eight links of a result's evidence as ``array<struct<name, standing>>``."""

    def link(name: str, good: Column, otherwise: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.when(F.coalesce(good, F.lit(False)), "ok").otherwise(otherwise).alias("standing"),
        )

    return F.array(
        link("verdict", verdict == "non_inferior", "blocking"),
        link("split size", sufficient, "blocking"),
        link("discordance", F.lit(True), "blocking"),
        link("traffic", (real_items == n) & (n > 0), "simulated"),
        link("answers", ~simulated, "simulated"),
        link("grader", judged, "simulated"),
        link("prices", prices_verified, "blocking"),
        link("token counts", exact_counter, "simulated"),
    )


def evidence_grade(results: DataFrame, links: Column) -> DataFrame:
    """The grade is the worst standing any link forces; blocking links are listed."""
    staged = results.withColumn("links", links)
    worst = F.array_min(
        F.transform(
            "links",
            lambda e: F.array_position(F.array(*[F.lit(s) for s in STANDINGS]), e["standing"]),
        )
    )
    grade = F.lit(None).cast("string")
    for i, s in enumerate(STANDINGS):
        grade = F.when(worst == i + 1, F.lit(GRADES[s])).otherwise(grade)
    return staged.select(
        "*",
        grade.alias("grade"),
        F.transform(
            F.filter("links", lambda e: e["standing"] == "blocking"), lambda e: e["name"]
        ).alias("blocking"),
    )
