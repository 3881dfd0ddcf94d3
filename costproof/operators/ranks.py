"""Ordered sums and ranks that do not put a whole group into one task.

A plain ``Window.partitionBy(group)`` sorts each group in one task, and one group may hold a third of
all rows. These helpers split a group into buckets that follow the order, sum inside each bucket and
add the totals of the buckets before it. The second window only sees one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof.runtime import broadcast_if_small, cut


def running_before(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], measures: dict[str, Column]
) -> DataFrame:
    """Add, per measure, its sum over all earlier rows of the group.

    ``bucket`` must not decrease along ``order`` within a group.
    """
    staged = df.withColumn("_bucket", bucket)
    for name, value in measures.items():
        staged = staged.withColumn(f"_m_{name}", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    for name in measures:
        staged = staged.withColumn(
            f"_in_{name}", F.coalesce(F.sum(f"_m_{name}").over(before), F.lit(0))
        )
    totals = (
        df.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(*[F.sum(v).alias(f"_t_{n}") for n, v in measures.items()])
    )
    ahead = (
        Window.partitionBy(*keys).orderBy("_bucket") if keys else Window.orderBy("_bucket")
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        *[
            F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_off_{n}")
            for n in measures
        ],
    )
    condition = F.col("_bucket").eqNullSafe(F.col("_k_bucket"))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = staged.join(offsets, condition, "left")
    for name in measures:
        out = out.withColumn(name, F.col(f"_in_{name}") + F.col(f"_off_{name}"))
    return out.select(*df.columns, *measures)


def hash_rank(
    df: DataFrame, keys: list[str], task: str, seed: int, name: str = "rank"
) -> DataFrame:
    """1-based rank of each row in its group by a seeded hash of the task id.

    Replaces a seeded shuffle: deterministic, and the same whatever the partitioning.
    """
    hashed = df.withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(task).cast("string")))
    )
    ranked = running_before(
        hashed,
        keys,
        F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"),
        [F.col("_hash"), F.col(task)],
        {name: F.lit(1).cast("bigint")},
    )
    return ranked.withColumn(name, F.col(name) + 1).drop("_hash")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: tuple[float, ...],
    prefix: str = "p",
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles by group, for any group size; a row counts ``weight`` times.

    Equal values are counted before the shuffle; ranks come from bucketed running counts, so a hot
    group with many distinct values is spread over its buckets.
    """
    times = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("_c"))
    spread = F.floor(F.log2(F.abs(F.col(value)) + 1) * 64)
    bucket = F.when(F.col(value) < 0, -spread).otherwise(spread).cast("int")
    ranked = running_before(counts, keys, bucket, [F.col(value)], {"_below": F.col("_c")})
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = (
        ranked.join(broadcast_if_small(totals), keys) if keys else ranked.crossJoin(F.broadcast(totals))
    )
    out = []
    for q in quantiles:
        position = F.lit(q) * (F.col("_n") - 1)
        low, high = F.floor(position), F.ceil(position)
        covers_low = (F.col("_below") <= low) & (low < F.col("_below") + F.col("_c"))
        covers_high = (F.col("_below") <= high) & (high < F.col("_below") + F.col("_c"))
        at_low = F.max(F.when(covers_low, F.col(value).cast("double")))
        at_high = F.max(F.when(covers_high, F.col(value).cast("double")))
        share = F.max(position - low)
        out.append((at_low + (at_high - at_low) * share).alias(f"{prefix}{round(q * 100)}"))
    return joined.groupBy(*keys).agg(*out)


def previous_row(
    df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: int = 4096
) -> DataFrame:
    """Add ``prev_<column>`` from the row before in the group, for groups of any size.

    ``order`` is a whole-number position. The lag runs inside chunks of it; the first row of a chunk
    takes the last row of the chunk before, from a table with one row per chunk.
    """
    part, row = "_prev_part", F.struct(*[F.col(c) for c in columns])
    staged = df.withColumn(part, F.floor(F.col(order) / chunk)).withColumn("_prev_row", row)
    inside = Window.partitionBy(*keys, part).orderBy(order)
    staged = staged.withColumn("_prev_lag", F.lag("_prev_row").over(inside))
    tails = staged.groupBy(*keys, part).agg(F.max_by("_prev_row", order).alias("_prev_tail"))
    chain = Window.partitionBy(*keys).orderBy(part)
    heads = tails.select(*keys, part, F.lag("_prev_tail").over(chain).alias("_prev_head"))
    joined = staged.join(heads, [*keys, part], "left")
    previous = F.coalesce(F.col("_prev_lag"), F.col("_prev_head"))
    return joined.select(*df.columns, *[previous[c].alias(f"prev_{c}") for c in columns])


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_part``: ranges of (keys, order) of about equal size, numbered in that order.

    A group of any size is spread over as many parts as its rows fill. Written to the checkpoint
    folder, so that rows keep their part whatever is computed again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))


def running_sums(df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column]) -> DataFrame:
    """Add, per measure, its sum over all earlier rows of the group (of the table, without ``keys``).

    Sums run inside the parts; what lies before a part comes from one total per part. Without keys those
    totals, one per shuffle partition, are added up by the driver, so no plan has a single-task exchange.
    """
    parts = dealt(df.select("*", *[v.alias(f"_m_{n}") for n, v in measures.items()]), keys, order)
    behind = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(*behind)
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
    if keys:
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*behind)
        offsets = totals.select(*keys, "_part", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in measures])
    else:
        rows, so_far = [], [0] * len(measures)
        for row in sorted(totals.collect(), key=lambda r: r["_part"]):  # one per shuffle partition
            rows.append((row["_part"], *(type(v)(x) if v is not None else None for x, v in zip(so_far, row[1:]))))
            so_far = [x + (v or 0) for x, v in zip(so_far, row[1:])]
        kinds = ", ".join(f"_o_{n} {totals.schema[f'_t_{n}'].dataType.simpleString()}" for n in measures)
        offsets = F.broadcast(df.sparkSession.createDataFrame(rows, f"_part int, {kinds}"))
    sums = parts.select("*", *[F.sum(f"_m_{n}").over(inside).alias(f"_h_{n}") for n in measures]).join(offsets, [*keys, "_part"])
    added = [F.coalesce(f"_h_{n}", F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0)) for n in measures]
    return sums.select(*df.columns, *[x.alias(n) for x, n in zip(added, measures)])


def positions(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """0-based position of every row by ``order``, without a global sort in one task."""
    return running_sums(df, [], [order], {name: F.lit(1).cast("bigint")})


def next_marked(df: DataFrame, keys: list[str], order: list[str], marks: dict[str, Column]) -> DataFrame:
    """Add, per mark, its least value over all later rows of the group; null where none is left.

    A hot group is spread over parts; a second window sees one row per part.
    """
    parts = dealt(df.select("*", *[value.alias(f"_m_{name}") for name, value in marks.items()]), keys, order)
    behind = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_part").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*behind)
    later = Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(*behind)
    firsts = parts.groupBy(*keys, "_part").agg(*[F.min(f"_m_{name}").alias(f"_f_{name}") for name in marks])
    firsts = firsts.select(*keys, "_part", *[F.min(f"_f_{name}").over(later).alias(f"_l_{name}") for name in marks])
    here = parts.select("*", *[F.min(f"_m_{name}").over(inside).alias(f"_h_{name}") for name in marks])
    joined = here.join(firsts, [*keys, "_part"])
    return joined.select(*df.columns, *[F.coalesce(f"_h_{name}", f"_l_{name}").alias(name) for name in marks])
