"""Session pricing over the given conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof.bindings import bind, ctes
from costproof.operators import bootstrap as B
from costproof.operators import sessions as S
from costproof.plans.proofs import boot_sql, interval_sql
from costproof.plans.registry import query, r6

MINIMUM = 5
RATES = {"input": 5000, "output": 25000, "cache_write_5m": 6250, "cache_write_1h": 10000, "cache_read": 500}


def turns(spark: SparkSession, sf_dir: str, policy: str = "immutable") -> DataFrame:
    """Conversations as turns. The compact policy also moves the prefix after every compaction."""
    t = bind(spark, sf_dir, "turns")
    if policy == "compact":
        t = t.withColumn(
            "prefix",
            F.concat_ws("#", "prefix", F.floor(F.col("turn_index") / 6).cast("string")),
        )
    t = t.withColumn("prefix_tokens", F.floor(F.length("prefix") / 4).cast("bigint"))
    history = F.when(F.lit(policy == "compact"), F.col("turn_index") % 6).otherwise(
        F.col("turn_index")
    )
    return t.select(
        "session_id",
        "turn_index",
        "role",
        F.concat("prefix", F.lit("\n\n"), "text").alias("text"),
        "prefix",
        "prefix_tokens",
        (F.col("prefix_tokens") + F.col("text_tokens") * (history + 1)).alias("total_tokens"),
        (F.col("text_tokens") % 200).alias("output_tokens"),
        F.when(F.col("session_id") % 7 == 3, "1h").otherwise("5m").alias("ttl"),
        "at_seconds",
        "label",
        (F.col("text_tokens") * 3).alias("dropped_tokens"),
        *[F.lit(v).cast("bigint").alias(f"p_{k}") for k, v in RATES.items()],
    )


def turns_sql(policy: str = "immutable", name: str = "tt") -> str:
    prefix = "prefix || '#' || CAST(turn_index // 6 AS VARCHAR)" if policy == "compact" else "prefix"
    history = "turn_index % 6" if policy == "compact" else "turn_index"
    return f"""{name}0 AS (SELECT session_id, turn_index, text, label, text_tokens, at_seconds, {prefix} AS prefix FROM turns),
{name} AS (SELECT session_id, turn_index, label, prefix, at_seconds, prefix || chr(10) || chr(10) || text AS text,
  length(prefix)//4 AS prefix_tokens, length(prefix)//4 + text_tokens*({history} + 1) AS total_tokens,
  text_tokens % 200 AS output_tokens, CASE WHEN session_id % 7 = 3 THEN 3600 ELSE 300 END AS ttl,
  text_tokens*3 AS dropped_tokens, length(prefix)//4 >= {MINIMUM} AS cacheable FROM {name}0)"""


def fold_sql(name: str = "tt", out: str = "priced") -> str:
    return f"""{out}_f AS (
  SELECT t.session_id, t.turn_index, CASE WHEN cacheable THEN 'write' ELSE 'uncacheable' END AS event,
    CASE WHEN cacheable THEN prefix END AS k, CASE WHEN cacheable THEN at_seconds END AS w,
    CASE WHEN cacheable THEN ttl END AS l, prefix AS prev, FALSE AS same_prefix
  FROM {name} t WHERE turn_index = 0
  UNION ALL
  SELECT t.session_id, t.turn_index,
    CASE WHEN NOT cacheable THEN 'uncacheable' WHEN f.k = t.prefix AND NOT (t.at_seconds - f.w > f.l) THEN 'read'
      WHEN f.k = t.prefix THEN 'expired' WHEN f.k IS NOT NULL THEN 'changed' ELSE 'write' END,
    CASE WHEN cacheable AND NOT coalesce(f.k = t.prefix AND NOT (t.at_seconds - f.w > f.l), FALSE) THEN t.prefix ELSE f.k END,
    CASE WHEN cacheable AND NOT coalesce(f.k = t.prefix AND NOT (t.at_seconds - f.w > f.l), FALSE) THEN t.at_seconds ELSE f.w END,
    CASE WHEN cacheable AND NOT coalesce(f.k = t.prefix AND NOT (t.at_seconds - f.w > f.l), FALSE) THEN t.ttl ELSE f.l END,
    t.prefix, f.prev = t.prefix
  FROM {out}_f f JOIN {name} t ON t.session_id = f.session_id AND t.turn_index = f.turn_index + 1),
{out}_b AS (SELECT t.*, f.event, f.same_prefix,
  CASE WHEN event = 'uncacheable' THEN total_tokens ELSE greatest(0, total_tokens - prefix_tokens) END AS uncached_input,
  CASE WHEN event IN ('write', 'changed', 'expired') AND ttl = 300 THEN prefix_tokens ELSE 0 END AS write_5m,
  CASE WHEN event IN ('write', 'changed', 'expired') AND ttl = 3600 THEN prefix_tokens ELSE 0 END AS write_1h,
  CASE WHEN event = 'read' THEN prefix_tokens ELSE 0 END AS read
  FROM {name} t JOIN {out}_f f USING (session_id, turn_index)),
{out} AS (SELECT *, uncached_input*5000 + write_5m*6250 + write_1h*10000 + read*500 + output_tokens*25000 AS cost FROM {out}_b)"""


RECURSIVE = ctes("turns").replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "session_turn_costs",
    f"""{RECURSIVE}, {turns_sql()}, {fold_sql()}
SELECT session_id, turn_index, event, same_prefix, uncached_input, write_5m, write_1h, read, output_tokens, cost FROM priced""",
)
def session_turn_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn priced with an entry that expires at its lifetime."""
    return S.price_turns(turns(spark, sf_dir), minimum=MINIMUM).select(
        "session_id", "turn_index", "event", "same_prefix", "uncached_input", "write_5m",
        "write_1h", "read", "output_tokens", "cost",
    )


@query(
    "session_totals",
    f"""{RECURSIVE}, {turns_sql('compact')}, {fold_sql()}
SELECT session_id, count(*) AS turns, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(read) AS BIGINT) AS read,
  CAST(sum(write_5m + write_1h) AS BIGINT) AS written,
  CAST(sum(CASE WHEN event IN ('write','changed','expired') THEN 1 ELSE 0 END) AS BIGINT) AS misses,
  CAST(sum(CASE WHEN event = 'expired' THEN 1 ELSE 0 END) AS BIGINT) AS expired_entries,
  round(CASE WHEN count(*) > 1 THEN CAST(sum(CASE WHEN event = 'read' THEN 1 ELSE 0 END) AS DOUBLE)/(count(*) - 1) ELSE 1.0 END, 6) AS prefix_stability_read,
  round(CASE WHEN count(*) > 1 THEN CAST(sum(CASE WHEN same_prefix THEN 1 ELSE 0 END) AS DOUBLE)/(count(*) - 1) ELSE 1.0 END, 6) AS prefix_identical_share,
  CAST(sum(CASE WHEN label = 'compaction' THEN cost ELSE 0 END) AS BIGINT) AS compaction_cost,
  CAST(sum(CASE WHEN label = 'compaction' THEN dropped_tokens ELSE 0 END) AS BIGINT) AS dropped_tokens,
  CAST(sum(CASE WHEN event = 'changed' THEN write_5m + write_1h ELSE 0 END) AS BIGINT) AS rewritten_tokens
FROM priced GROUP BY session_id""",
)
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation under the compacting policy, with its compaction bill."""
    t = S.session_totals(S.price_turns(turns(spark, sf_dir, "compact"), minimum=MINIMUM), ["session_id"])
    return t.select(
        "session_id", "turns", "cost", "read", (F.col("write_5m") + F.col("write_1h")).alias("written"),
        "misses", "expired_entries", r6("prefix_stability_read").alias("prefix_stability_read"),
        r6("prefix_identical_share").alias("prefix_identical_share"), "compaction_cost",
        "dropped_tokens", "rewritten_tokens",
    )


def both_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: cost under both policies, as measured and at the declared summary size."""
    sides = []
    for policy in ("immutable", "compact"):
        p = S.price_turns(turns(spark, sf_dir, policy), minimum=MINIMUM)
        carried = F.lit(0) if policy == "immutable" else F.when(
            F.col("label") == "compaction", 0
        ).otherwise(F.col("prefix_tokens"))
        sides.append(
            p.withColumn("_gap", S.budget_gap(carried, 40))
            .groupBy("session_id")
            .agg(
                F.sum("cost").alias(f"{policy[0]}_cost"),
                F.sum(F.col("cost") + F.col("_gap")).alias(f"{policy[0]}_budget"),
                F.sum(F.when(F.col("output_tokens") % 10 < 8, 1).otherwise(0)).alias(f"{policy[0]}_ok"),
            )
        )
    return sides[0].join(sides[1], "session_id")


BOTH_SQL = f"""{turns_sql('immutable', 'ti')}, {fold_sql('ti', 'pi')}, {turns_sql('compact', 'tc')}, {fold_sql('tc', 'pc')},
ii AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS b_cost, CAST(sum(CASE WHEN output_tokens % 10 < 8 THEN 1 ELSE 0 END) AS BIGINT) AS b_correct FROM pi GROUP BY 1),
cc AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS c_cost,
  CAST(sum(cost + CASE WHEN label <> 'compaction' AND prefix_tokens > 0 AND prefix_tokens < 40 THEN (40 - prefix_tokens) *
    CASE WHEN write_1h > 0 THEN 10000 WHEN write_5m > 0 THEN 6250 WHEN read > 0 THEN 500 ELSE 5000 END ELSE 0 END) AS BIGINT) AS c_budget FROM pc GROUP BY 1),
both_s AS (SELECT session_id AS task_id, b_cost, b_correct, c_cost, b_correct AS c_correct, c_budget FROM ii JOIN cc USING (session_id))"""


@query(
    "session_policy_costs",
    f"""{RECURSIVE}, {BOTH_SQL}
SELECT CAST(sum(b_cost) AS BIGINT) AS immutable_cost, CAST(sum(c_cost) AS BIGINT) AS compact_cost,
  CAST(sum(c_budget) AS BIGINT) AS compact_cost_at_budget, CAST(sum(b_correct) AS BIGINT) AS successes,
  round(CAST(sum(c_cost) AS DOUBLE)/sum(b_cost), 6) AS cost_ratio FROM both_s""",
)
def session_policy_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = both_policies(spark, sf_dir)
    return b.agg(
        F.sum("i_cost").alias("immutable_cost"),
        F.sum("c_cost").alias("compact_cost"),
        F.sum("c_budget").alias("compact_cost_at_budget"),
        F.sum("i_ok").alias("successes"),
        r6(F.sum("c_cost") / F.sum("i_cost")).alias("cost_ratio"),
    )


@query(
    "session_policy_interval",
    f"{RECURSIVE}, {BOTH_SQL}, one AS (SELECT 1 AS g, * FROM both_s),"
    + boot_sql("one", "g", ["b_correct", "c_correct", "b_cost", "c_cost"])
    + interval_sql(
        "g",
        "(CAST(c_cost AS DOUBLE)/nullif(c_correct, 0))/nullif(CAST(b_cost AS DOUBLE)/nullif(b_correct, 0), 0)",
    ),
)
def session_policy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost ratio of the two policies, resampling whole conversations."""
    b = both_policies(spark, sf_dir).select(
        F.lit(1).alias("g"), "session_id", F.col("i_cost").alias("b_cost"),
        F.col("i_ok").alias("b_correct"), "c_cost", F.col("i_ok").alias("c_correct"),
    )
    out = B.session_cost_ratio(b, ["g"], B.task_key(F.col("session_id")))
    return out.select("g", *[r6(c).alias(c) for c in ("point", "low", "high")], "dropped")


@query("session_policy_winner")
def session_policy_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which policy wins at each pace, on both pricings or on neither."""
    out = None
    for gap in (30, 70, 400):
        sides = {}
        for policy in ("immutable", "compact"):
            t = S.paced(turns(spark, sf_dir, policy), float(gap))
            p = S.price_turns(t, minimum=MINIMUM)
            carried = F.lit(0) if policy == "immutable" else F.col("prefix_tokens")
            sides[policy] = (
                p.withColumn("_gap", S.budget_gap(carried, 40))
                .groupBy("session_id")
                .agg(
                    F.sum("cost").alias("cost"),
                    F.sum(F.col("cost") + F.col("_gap")).alias("budget"),
                    F.sum((F.col("output_tokens") % 10 < 8).cast("int")).alias("ok"),
                )
            )
        i, c = sides["immutable"].alias("i"), sides["compact"].alias("c")
        pairs = i.join(c, "session_id")
        bounds = []
        for cost in ("cost", "budget"):
            rows = pairs.select(
                F.lit(gap).alias("gap_seconds"), "session_id", F.col("i.ok").alias("b_correct"),
                F.col("i.ok").alias("c_correct"), F.col(f"i.{cost}").alias("b_cost"),
                F.col(f"c.{cost}").alias("c_cost"),
            )
            bounds.append(
                B.session_cost_ratio(
                    rows, ["gap_seconds"], B.task_key(F.col("session_id"))
                ).select("gap_seconds", F.col("low").alias(f"{cost}_low"), F.col("high").alias(f"{cost}_high"))
            )
        one = bounds[0].join(bounds[1], "gap_seconds")
        out = one if out is None else out.unionByName(one)
    return out.withColumn(
        "winner",
        S.policy_winner(
            F.col("cost_low"), F.col("cost_high"), F.col("budget_low"), F.col("budget_high")
        ),
    )


@query(
    "session_prefix_findings",
    f"""{ctes('turns')}, {turns_sql()},
w AS (SELECT *, CASE WHEN prefix <> '' AND starts_with(text, prefix) THEN substr(text, length(prefix) + 1) ELSE text END AS tail FROM tt WHERE label <> 'compaction'),
l AS (SELECT *, lag(prefix) OVER s AS pp, lag(length(tail)) OVER s AS pl FROM w WINDOW s AS (PARTITION BY session_id ORDER BY turn_index)),
g AS (SELECT session_id, count(*) AS n, arg_min(prefix_tokens, turn_index) AS ft,
  CAST(sum(CASE WHEN pp IS NOT NULL AND pp <> prefix THEN 1 ELSE 0 END) AS BIGINT) AS rw,
  CAST(sum(CASE WHEN pp IS NOT NULL AND pp <> prefix AND length(tail) < pl THEN 1 ELSE 0 END) AS BIGINT) AS comp,
  CAST(sum(CASE WHEN pp IS NOT NULL AND pp <> prefix AND length(tail) < pl THEN prefix_tokens ELSE 0 END) AS BIGINT) AS re
  FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT session_id, n AS turns, 'PL15' AS rule, round(CAST(ft*5750*rw*1000 AS DOUBLE)/n, 3) AS per_1k FROM g WHERE rw >= n - 1
UNION ALL
SELECT session_id, n AS turns, 'PL17' AS rule, round(CAST(re*5750*1000 AS DOUBLE)/n, 3) AS per_1k FROM g WHERE comp > 0""",
)
def session_prefix_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose prefix moves every turn, or is rewritten by a compaction.

    Stranded text (the third rule) needs the token counter; no turn here strands enough of it.
    """
    out = S.session_findings(turns(spark, sf_dir))
    return out.select(
        "session_id", "turns", "rule", F.round("per_1k", 3).alias("per_1k")
    )


@query(
    "consecutive_sessions",
    f"""{ctes('tasks')},
r AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS p, count(*) OVER () AS n FROM tasks),
g AS (SELECT task_id, p, CASE WHEN n > 7 AND n % 7 = 1 AND p = n - 1 THEN p//7 - 1 ELSE p//7 END AS session_id FROM r)
SELECT task_id, session_id, p - session_id*7 AS turn_index FROM g""",
)
def consecutive_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive tasks grouped into conversations of seven."""
    t = bind(spark, sf_dir, "tasks").select("task_id")
    return S.group_consecutive(t, "task_id", 7)
