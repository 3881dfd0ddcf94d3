"""Statistics as column expressions over grouped aggregates.

Each function takes aggregated columns (counts, sums) and returns a column, so one job handles any
number of (workload, pipeline, day) groups. "Undefined" is null, never 0 or infinity.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from costproof import fixed

LOW_HIGH = StructType([StructField("low", DoubleType()), StructField("high", DoubleType())])


def z_value(alpha: float = fixed.ALPHA) -> float:
    """Two-sided normal critical value for a constant alpha."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be strictly between 0 and 1")
    return fixed.Z_95 if alpha == fixed.ALPHA else NormalDist().inv_cdf(1 - alpha / 2)


@F.pandas_udf(DoubleType())
def z_column(alpha: pd.Series) -> pd.Series:
    """Two-sided normal critical value where alpha is a column."""
    return alpha.map(lambda a: NormalDist().inv_cdf(1 - a / 2) if 0 < a < 1 else None)


def _z_for_level(level: float) -> float:
    return fixed.Z_95 if level == 0.95 else NormalDist().inv_cdf(0.5 + level / 2)


def wilson(successes: Column, n: Column, level: float = 0.95) -> Column:
    """``struct(point, low, high)`` of a binomial share, inside [0, 1]; null when n is 0."""
    z = _z_for_level(level)
    k, m = successes.cast("double"), n.cast("double")
    p = k / m
    denom = 1 + F.lit(z * z) / m
    centre = (p + F.lit(z * z) / (2 * m)) / denom
    half = (F.lit(z) / denom) * F.sqrt(p * (1 - p) / m + F.lit(z * z) / (4 * m * m))
    return F.when(
        n > 0,
        F.struct(
            p.alias("point"),
            F.greatest(F.lit(0.0), centre - half).alias("low"),
            F.least(F.lit(1.0), centre + half).alias("high"),
        ),
    )


def cost_per_success(total_cost: Column, successes: Column) -> Column:
    """Total cost over successes, null when nothing succeeded."""
    return F.when(successes > 0, total_cost / successes)


def require_binary(value: Column, name: str) -> Column:
    """The value itself, or a stop when it is not 0 or 1."""
    return F.when(value.isin(0, 1), value).otherwise(
        F.raise_error(F.lit(f"{name} must contain only 0/1 outcomes"))
    )


@F.pandas_udf(DoubleType())
def mcnemar_p(baseline_only: pd.Series, candidate_only: pd.Series) -> pd.Series:
    """Exact two-sided binomial p at one half from the discordant counts; 1 when there are none.

    One row per group, so the work is bounded by the number of groups. The tail is summed by the
    ratio of neighbouring terms, which is exact to rounding and needs no big integers.
    """

    def p_value(b: int, c: int) -> float:
        n, k = b + c, min(b, c)
        if n == 0:
            return 1.0
        if 2 * k == n:
            return 1.0
        # log of the largest term in the tail, then terms below it by ratios
        log_top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        total, term, i = 1.0, 1.0, k
        while i > 0 and term > 1e-18 * total:
            term *= i / (n - i + 1)
            total += term
            i -= 1
        return min(1.0, 2.0 * math.exp(log_top) * total)

    return pd.Series(
        [p_value(int(b), int(c)) for b, c in zip(baseline_only, candidate_only, strict=True)]
    )


def discordance_variance(p10: Column, p01: Column) -> Column:
    """Variance of the per-task paired difference."""
    return p10 + p01 - (p10 - p01) * (p10 - p01)


def required_n(
    p10: Column, p01: Column, delta: Column, margin: float = fixed.MARGIN, alpha: float = fixed.ALPHA
) -> Column:
    """Tasks needed for a conclusive verdict; null at or past the margin."""
    z = z_value(alpha)
    slack = delta + F.lit(margin)
    v = discordance_variance(p10, p01)
    return (
        F.when(slack <= 0, F.lit(None).cast("bigint"))
        .when(v <= 0, F.lit(1).cast("bigint"))
        .otherwise(F.ceil(F.lit(z * z) * v / (slack * slack)).cast("bigint"))
    )


def verdict_label(low: Column, high: Column, margin: float = fixed.MARGIN) -> Column:
    """Where an interval sits relative to -margin. Bounds are strict."""
    if margin <= 0:
        raise ValueError("margin must be positive")
    return (
        F.when(low > F.lit(-margin), "non_inferior")
        .when(high < F.lit(-margin), "worse")
        .otherwise("inconclusive")
    )


def more_tasks(label: Column, needed: Column, n: Column) -> Column:
    """How many more tasks would settle an inconclusive verdict; null otherwise."""
    return F.when(
        (label == "inconclusive") & needed.isNotNull(), F.greatest(F.lit(0), needed - n)
    )


def optimal_rate(mse: Column, variance: Column, cheap: Column, strong: Column) -> Column:
    """Cost-optimal fixed sampling rate; 1 past the boundary where sampling everything is cheapest."""
    boundary = strong / (strong + cheap) * variance
    return (
        F.when((variance == 0) | (mse >= boundary), F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.sqrt((cheap / strong) * mse / (variance - mse))))
    )


def strong_only_items(variance: Column, standard_error: Column) -> Column:
    """Items strong-only grading needs for the same standard error; null when undefined."""
    return F.when(
        (standard_error > 0) & (variance > 0),
        F.ceil(variance / (standard_error * standard_error)).cast("bigint"),
    )


def rate_for_standard_error(mse: Column, n: Column, target: float) -> Column:
    """Uniform sampling rate that buys a standard error, clamped to [floor, 1]."""
    floor = F.lit(fixed.MIN_SAMPLING_RATE)
    raw = mse / (mse + n * F.lit(target * target))
    return F.when(mse <= 0, floor).otherwise(F.least(F.lit(1.0), F.greatest(floor, raw)))


def annotation_budget(
    mse: Column, n: Column, target: float, cheap_item: Column, strong_item: Column
) -> Column:
    """``struct(rate, budget)``: the cheap judge on every item plus the strong one on a share."""
    rate = rate_for_standard_error(mse, n, target)
    return F.struct(rate.alias("rate"), ((cheap_item + strong_item * rate) * n).alias("budget"))


def discrete_entropy(sizes: Column) -> Column:
    """Entropy of group sizes over the most their total could carry; 0 for one group."""
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, s: acc + s)
    nats = F.aggregate(
        sizes,
        F.lit(0.0),
        lambda acc, s: acc - F.when(s > 0, (s / total) * F.log(s / total)).otherwise(0.0),
    )
    return F.when((total <= 1) | (F.size(sizes) <= 1), F.lit(0.0)).otherwise(nats / F.log(total))


def normal_interval(estimate: Column, standard_error: Column, level: float = 0.95) -> Column:
    """``struct(point, low, high)`` around an estimate."""
    half = F.lit(_z_for_level(level)) * standard_error
    return F.struct(
        estimate.alias("point"), (estimate - half).alias("low"), (estimate + half).alias("high")
    )


def uniform_draw(task: Column, seed: int) -> Column:
    """A fixed uniform draw per task: first 12 hex digits of SHA-256 of ``seed|task``.

    A property of the task, so a smaller budget always selects a subset.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), task.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(0xFFFFFFFFFFFF))


def row_number_of(text: Column) -> Column:
    """The first 60 bits of a text's digest as a whole number, for order-free checksums."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def multinomial_delta(seed: int = fixed.SEED, resamples: int = fixed.RESAMPLES, level: float = 0.95):
    """UDF (worse, same, better) -> struct(low, high): exact multinomial bootstrap of three counts.

    The paired difference only takes -1, 0 and +1, so resampling n tasks is drawing three counts:
    the cost is the number of replicates whatever n is.
    """

    @F.pandas_udf(LOW_HIGH)
    def interval(worse: pd.Series, same: pd.Series, better: pd.Series) -> pd.DataFrame:
        tail = (1 - level) / 2
        rows = []
        for w, s, b in zip(worse, same, better, strict=True):
            n = int(w + s + b)
            if n == 0:
                rows.append((None, None))
                continue
            rng = np.random.default_rng(seed)
            counts = rng.multinomial(n, [w / n, s / n, b / n], size=resamples)
            delta = (counts[:, 2] - counts[:, 0]) / n
            low, high = np.quantile(delta, [tail, 1 - tail])
            rows.append((float(low), float(high)))
        return pd.DataFrame(rows, columns=["low", "high"])

    return interval
