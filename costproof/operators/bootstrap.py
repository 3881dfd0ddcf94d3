"""Bootstrap intervals as one Spark aggregation.

Each task gets a Poisson(1) weight per replicate. A weight is a function of (seed, task key,
replicate) and never of the partition layout, so a retried or repartitioned job gives the same
interval. A task of the job draws the weights of a block of keys once for all groups, multiplies them with
their rows' values and adds the products up; what leaves it is one row per group and replicate, however
many rows it has read.

Weights are a public 32-bit integer mixer applied to both halves of the key: plain arithmetic, so that any
engine can check them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from costproof import fixed

# The mixer's shifts and odd factors, and the step between replicates.
SHIFTS, FACTORS = (16, 15, 15), (0x21F0AAAD, 0x735A2D97)
STEP = 0x61C88647
# Weights are resolved to this many bits of a draw.
DRAW_BITS = 16
# Draws of so many keys stay in a core's cache.
KEYS_AT_ONCE = 64
GROUPS_HELD = 64


def _poisson_cuts() -> list[int]:
    """Cumulative Poisson(1) probabilities as thresholds on draws, as far as they differ."""
    size, total, term, cuts = 1 << DRAW_BITS, 0.0, math.exp(-1), []
    while not cuts or cuts[-1] < size:
        total += term
        cuts.append(round(total * size))
        term /= len(cuts)
    return cuts[:-1]


CUTS = _poisson_cuts()
_WEIGHT_OF = np.searchsorted(CUTS, np.arange(1 << DRAW_BITS), side="right").astype(np.int8)


def mixed(x: np.ndarray) -> np.ndarray:
    """The mixer on unsigned 32-bit integers, in place."""
    moved = np.empty_like(x)
    for shift, factor in zip(SHIFTS, FACTORS, strict=False):
        np.bitwise_xor(x, np.right_shift(x, np.uint32(shift), out=moved), out=x)
        np.multiply(x, np.uint32(factor), out=x)
    return np.bitwise_xor(x, np.right_shift(x, np.uint32(SHIFTS[-1]), out=moved), out=x)


def key_halves(keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit states of 64-bit keys; distinct keys have distinct pairs."""
    bits = keys.astype(np.int64).view(np.uint64)
    low, high = (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32)
    first = mixed(low ^ np.uint32(seed & 0xFFFFFFFF))
    return first, mixed(high ^ first)


def weights(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Poisson(1) weights: a row per key, a column per replicate."""
    first, second = key_halves(keys, seed)
    steps = np.arange(1, resamples + 1, dtype=np.uint32) * np.uint32(STEP)
    draws = mixed(first[:, None] + steps[None, :])
    draws = mixed(np.bitwise_xor(draws, second[:, None], out=draws))
    return np.take(_WEIGHT_OF, np.right_shift(draws, np.uint32(32 - DRAW_BITS), out=draws), mode="clip")


def task_key(task: Column) -> Column:
    """A whole-number task id as a key."""
    return task.cast("bigint")


def text_key(task: Column) -> Column:
    """A non-numeric task id as a key."""
    return F.xxhash64(task)


def _summed(keys: int, sums: int, resamples: int, seed: int, schema: pa.Schema):
    """Partial weighted sums per group and replicate of the rows a task reads."""

    def emit(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        turns = pa.array(np.arange(-1, resamples, dtype=np.int32))
        for group, totals in held.items():
            own = [pa.array([v] * (resamples + 1), f.type) for v, f in zip(group, schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*own, turns, *map(pa.array, totals)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:keys]]
            groups = list(zip(*columns, strict=True)) if columns else [()] * len(batch)
            ids = batch.column(keys).to_numpy(zero_copy_only=False)
            values = np.ones((sums + 1, len(batch)))
            for n in range(sums):
                values[n + 1] = np.nan_to_num(batch.column(keys + 1 + n).to_numpy(zero_copy_only=False))
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            firsts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
            ends = np.append(firsts[1:], len(ids))
            for at in range(0, len(firsts), KEYS_AT_ONCE):
                own = slice(at, at + KEYS_AT_ONCE)
                rows = order[firsts[at] : ends[own][-1]]
                place = np.repeat(np.arange(len(firsts[own])), ends[own] - firsts[own])
                members: dict[tuple, list[int]] = {}
                for i, row in enumerate(rows.tolist()):
                    members.setdefault(groups[row], []).append(i)
                drawn = weights(ids[firsts[own]], resamples, seed).astype(np.float64)
                for group, among in members.items():
                    totals = held.setdefault(group, np.zeros((sums + 1, resamples + 1)))
                    at_keys = [np.bincount(place[among], v[rows[among]], len(drawn)) for v in values]
                    totals[:, 0] += values[:, rows[among]].sum(axis=1)
                    totals[:, 1:] += np.stack(at_keys) @ drawn
                if len(held) > GROUPS_HELD:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    return run


def replicate_sums(
    df: DataFrame,
    keys: list[str],
    key: Column,
    sums: dict[str, Column],
    resamples: int = fixed.RESAMPLES,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Weighted sums per (group, replicate); replicate -1 holds the observed sums.

    Sums are doubles; those of whole numbers are exact up to 2^53. Null values add nothing, and rows
    without a key have the key 0.
    """
    rows = df.select(*keys, F.coalesce(key, F.lit(0)).alias("_key"), *[v.cast("double").alias(n) for n, v in sums.items()])
    out = StructType(
        [*rows.schema.fields[: len(keys)], StructField("replicate", IntegerType())]
        + [StructField(n, DoubleType()) for n in ("weight", *sums)]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # The work is rows x replicates, so few bytes must still reach every worker.
    # Rows of a key come one after another: its weights are drawn once for all its groups.
    spread = rows.repartition(tasks, "_key").sortWithinPartitions("_key")
    partial = spread.mapInArrow(_summed(len(keys), len(sums), resamples, seed, to_arrow_schema(out)), out)
    return partial.groupBy(*keys, "replicate").agg(
        F.sum("weight").cast("bigint").alias("weight"), *[F.sum(n).alias(n) for n in sums]
    )


def intervals(
    replicates: DataFrame, keys: list[str], statistic: Column, level: float = 0.95
) -> DataFrame:
    """Percentile interval of a statistic of the replicate sums.

    Replicates where the statistic is undefined are dropped and counted; with under a tenth of them
    defined, or an undefined observed value, the interval is null.
    """
    tail = (1 - level) / 2
    valued = replicates.withColumn("_v", statistic.cast("double"))
    drawn = F.col("replicate") >= 0
    ends = F.percentile(F.when(drawn, F.col("_v")), F.array(F.lit(tail), F.lit(1 - tail)))
    out = valued.groupBy(*keys).agg(
        F.max(F.when(~drawn, F.col("_v"))).alias("point"),
        ends.alias("_ends"),
        F.count(F.when(drawn, F.col("_v"))).alias("_defined"),
        F.count(F.when(drawn, F.lit(1))).alias("_all"),
    )
    usable = F.col("point").isNotNull() & (F.col("_defined") >= F.floor(F.col("_all") / 10))
    return out.select(
        *keys,
        F.when(usable, F.col("point")).alias("point"),
        F.when(usable, F.col("_ends")[0]).alias("low"),
        F.when(usable, F.col("_ends")[1]).alias("high"),
        (F.col("_all") - F.col("_defined")).alias("dropped"),
    )


def bootstrap(
    df: DataFrame,
    keys: list[str],
    key: Column,
    sums: dict[str, Column],
    statistic: Callable[[dict[str, Column]], Column],
    resamples: int = fixed.RESAMPLES,
    seed: int = fixed.SEED,
    level: float = 0.95,
) -> DataFrame:
    """Interval by group. ``statistic`` maps named sums (and ``weight``) to a column: any statistic
    that is a function of sums can be plugged in."""
    replicates = replicate_sums(df, keys, key, sums, resamples, seed)
    named = {n: F.col(n) for n in [*sums, "weight"]}
    return intervals(replicates, keys, statistic(named), level)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def delta_accuracy(s: dict[str, Column]) -> Column:
    """Mean paired difference."""
    return _ratio(s["c_correct"] - s["b_correct"], s["weight"])


def cost_per_success(s: dict[str, Column]) -> Column:
    """Cost and outcome resampled together."""
    return _ratio(s["cost"], s["correct"])


def cost_ratio(s: dict[str, Column]) -> Column:
    """Candidate over baseline cost per success, both from the same draw."""
    return _ratio(_ratio(s["c_cost"], s["c_correct"]), _ratio(s["b_cost"], s["b_correct"]))


def pair_sums() -> dict[str, Column]:
    """The four sums of a paired comparison."""
    return {n: F.col(n) for n in ("b_correct", "c_correct", "b_cost", "c_cost")}


def session_cost_ratio(
    sessions: DataFrame, keys: list[str], key: Column, **options
) -> DataFrame:
    """Cost ratio resampling whole sessions.

    ``sessions`` has one row per session with ``b_cost, b_correct, c_cost, c_correct`` already summed
    over its turns, because turns of one session share a cache entry and are not independent.
    """
    return bootstrap(sessions, keys, key, pair_sums(), cost_ratio, **options)
