"""Paired proofs, intervals and their bills over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof import fixed
from costproof.bindings import ansi, bind, ctes
from costproof.functions import stats
from costproof.operators import arms as A
from costproof.operators import bootstrap as B
from costproof.operators import spend as S
from costproof.plans.registry import query, r6

BASELINE = "frontier"
Z = fixed.Z_95

ARMS_SQL = (
    "arms AS (SELECT tier AS pipeline, task_id, question_type, correct, cost_nano AS cost, "
    "CASE WHEN scarce THEN cost_nano ELSE 0 END AS scarce_cost, tier AS resolved_tier "
    "FROM matrix WHERE split = 'test')"
)
PAIRS_SQL = (
    "pairs AS (SELECT c.pipeline, c.task_id, c.question_type, c.resolved_tier, "
    "b.correct AS b_correct, b.cost AS b_cost, c.correct AS c_correct, c.cost AS c_cost "
    "FROM arms c JOIN arms b ON b.task_id = c.task_id "
    f"WHERE b.pipeline = '{BASELINE}' AND c.pipeline <> '{BASELINE}')"
)
COUNTS_SQL = (
    "counts AS (SELECT pipeline, count(*) AS n, "
    "CAST(sum(CASE WHEN b_correct = 1 AND c_correct = 0 THEN 1 ELSE 0 END) AS BIGINT) AS baseline_only, "
    "CAST(sum(CASE WHEN b_correct = 0 AND c_correct = 1 THEN 1 ELSE 0 END) AS BIGINT) AS candidate_only, "
    "CAST(sum(b_correct) AS BIGINT) AS b_successes, CAST(sum(c_correct) AS BIGINT) AS c_successes, "
    "CAST(sum(b_cost) AS BIGINT) AS b_total, CAST(sum(c_cost) AS BIGINT) AS c_total "
    "FROM pairs GROUP BY pipeline)"
)
PROOF_CTES = f"{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL}, {COUNTS_SQL}"


def arms(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    """Each tier as a pipeline of its own, one row per task."""
    m = bind(spark, sf_dir, "matrix").where(F.col("split") == split)
    return m.select(
        F.col("tier").alias("pipeline"),
        "task_id",
        "question_type",
        "correct",
        F.col("cost_nano").alias("cost"),
        F.when(F.col("scarce"), F.col("cost_nano")).otherwise(0).alias("scarce_cost"),
        F.col("tier").alias("resolved_tier"),
    )


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """Low and high Wilson bounds as SQL text."""
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    p = f"({k}/{n})"
    denom = f"(1 + {Z * Z}/{n})"
    centre = f"(({p} + {Z * Z}/(2*{n}))/{denom})"
    half = f"(({Z}/{denom})*sqrt({p}*(1-{p})/{n} + {Z * Z}/(4*{n}*{n})))"
    return f"greatest(0.0, {centre}-{half})", f"least(1.0, {centre}+{half})"


LOW, HIGH = wilson_sql("successes", "n")


@query(
    "arm_summary",
    f"""{ctes('matrix')}, {ARMS_SQL},
s AS (SELECT pipeline, count(*) AS n, CAST(sum(correct) AS BIGINT) AS successes,
  CAST(sum(cost) AS BIGINT) AS total_cost, CAST(sum(scarce_cost) AS BIGINT) AS scarce_cost
  FROM arms GROUP BY pipeline)
SELECT pipeline, n, successes, total_cost, scarce_cost,
  round(CAST(successes AS DOUBLE)/n, 6) AS accuracy, round({LOW}, 6) AS accuracy_low,
  round({HIGH}, 6) AS accuracy_high, round(CAST(total_cost AS DOUBLE)/n, 6) AS cost_per_task,
  round(CAST(total_cost AS DOUBLE)/nullif(successes, 0), 6) AS cost_per_success,
  round(CAST(scarce_cost AS DOUBLE)/total_cost, 6) AS scarce_share FROM s""",
)
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.arm_summary(arms(spark, sf_dir))
    return out.select(
        "pipeline", "n", "successes", "total_cost", "scarce_cost",
        *[
            r6(c).alias(c)
            for c in (
                "accuracy", "accuracy_low", "accuracy_high", "cost_per_task", "cost_per_success",
                "scarce_share",
            )
        ],
    )


@query(
    "call_cost_per_success",
    f"""{ctes('calls', 'prices')},
priced AS (SELECT c.*, c.input_uncached*p.input + c.cache_write_5m*p.cache_write_5m
    + c.cache_write_1h*p.cache_write_1h + c.cache_read*p.cache_read
    + (c.output_visible + c.output_reasoning)*p.output AS cost FROM calls c JOIN prices p USING (model)),
per_task AS (SELECT model AS pipeline, task_id, CAST(sum(cost) AS BIGINT) AS cost,
    CASE WHEN bool_or(failed) THEN 0 ELSE 1 END AS correct FROM priced WHERE NOT prewarm GROUP BY 1, 2),
s AS (SELECT pipeline, count(*) AS n, CAST(sum(correct) AS BIGINT) AS successes,
    CAST(sum(cost) AS BIGINT) AS total_cost FROM per_task GROUP BY 1)
SELECT pipeline, n, successes, total_cost, round(CAST(successes AS DOUBLE)/n, 6) AS accuracy,
  round({LOW}, 6) AS accuracy_low, round({HIGH}, 6) AS accuracy_high,
  round(CAST(total_cost AS DOUBLE)/nullif(successes, 0), 6) AS cost_per_success FROM s""",
)
def call_cost_per_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded calls to cost per successful task by model: price, fold by task, summarise."""
    calls = S.real_calls(bind(spark, sf_dir, "calls"))
    priced = S.price_calls(calls, bind(spark, sf_dir, "prices"), unit="nano")
    tasks = priced.groupBy(F.col("model").alias("pipeline"), "task_id").agg(
        F.sum("cost").alias("cost"),
        F.when(F.bool_or("failed"), 0).otherwise(1).alias("correct"),
    )
    out = A.arm_summary(tasks)
    return out.select(
        "pipeline", "n", "successes", "total_cost",
        *[r6(c).alias(c) for c in ("accuracy", "accuracy_low", "accuracy_high", "cost_per_success")],
    )


MCNEMAR_SQL = (
    "(CASE WHEN baseline_only + candidate_only = 0 OR baseline_only = candidate_only THEN 1.0 ELSE "
    "least(1.0, 2 * (SELECT sum(exp(lgamma(CAST(baseline_only + candidate_only + 1 AS DOUBLE)) "
    "- lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(baseline_only + candidate_only - i + 1 AS DOUBLE)) "
    "- (baseline_only + candidate_only) * ln(2.0))) "
    "FROM (SELECT unnest(range(0, least(baseline_only, candidate_only) + 1)) AS i) q)) END)"
)


@query(
    "paired_counts_and_power",
    f"""{PROOF_CTES},
p AS (SELECT *, CAST(baseline_only AS DOUBLE)/n AS p10, CAST(candidate_only AS DOUBLE)/n AS p01 FROM counts),
q AS (SELECT *, p01 - p10 AS delta, p10 + p01 - (p10-p01)*(p10-p01) AS v FROM p),
r AS (SELECT *, CASE WHEN delta + 0.03 <= 0 THEN NULL WHEN v <= 0 THEN 1
   ELSE CAST(ceil({Z * Z}*v/((delta+0.03)*(delta+0.03))) AS BIGINT) END AS required_n FROM q)
SELECT pipeline, n, baseline_only, candidate_only, round(delta, 6) AS delta, required_n,
  coalesce(n >= required_n, FALSE) AS sufficient,
  CAST(coalesce(greatest(0, required_n - n), 0) AS BIGINT) AS shortfall,
  round({MCNEMAR_SQL}, 6) AS mcnemar_p FROM r""",
)
def paired_counts_and_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = A.power(A.paired_counts(A.pair(arms(spark, sf_dir), BASELINE)))
    return sized.select(
        "pipeline", "n", "baseline_only", "candidate_only", r6("delta").alias("delta"),
        "required_n", "sufficient", F.col("shortfall").cast("bigint").alias("shortfall"),
        r6(stats.mcnemar_p(F.col("baseline_only"), F.col("candidate_only"))).alias("mcnemar_p"),
    )


# ------------------------------------------------------------------ bootstrap, as SQL text


def _mixed_sql(x: str, out: str) -> str:
    """Columns that carry ``x`` through the mixer, the last named ``out``."""
    (s1, s2, s3), (f1, f2) = B.SHIFTS, B.FACTORS
    return (
        f"xor({x}, {x} >> {s1}) * {f1} & 4294967295 AS {out}_1, "
        f"xor({out}_1, {out}_1 >> {s2}) * {f2} & 4294967295 AS {out}_2, xor({out}_2, {out}_2 >> {s3}) AS {out}"
    )


def boot_sql(source: str, keys: str, sums: list[str], replicates: int = fixed.RESAMPLES) -> str:
    """CTEs computing replicate sums over ``source`` (which has a ``task_id`` that is not negative)."""
    cuts = " ".join(f"WHEN d >> {32 - B.DRAW_BITS} < {c} THEN {k}" for k, c in enumerate(B.CUTS))
    cols = ", ".join(sums)
    weighted = ", ".join(f"CAST(sum(w*{s}) AS BIGINT) AS {s}" for s in sums)
    return f"""
b0 AS (SELECT {keys}, {cols}, CAST(task_id AS BIGINT) AS id,
  xor(id & 4294967295, CAST({fixed.SEED & 0xFFFFFFFF} AS BIGINT)) AS x, {_mixed_sql('x', 'k1')},
  xor(id >> 32, k1) AS y, {_mixed_sql('y', 'k2')} FROM {source}),
b1 AS (SELECT {keys}, {cols}, k1, k2, unnest(range(-1, {replicates})) AS replicate FROM b0),
b2 AS (SELECT *, (k1 + (replicate + 1) * {B.STEP}) & 4294967295 AS u, {_mixed_sql('u', 'v')},
  xor(v, k2) AS t, {_mixed_sql('t', 'd')} FROM b1),
b3 AS (SELECT *, CASE WHEN replicate < 0 THEN 1 {cuts} ELSE {len(B.CUTS)} END AS w FROM b2),
reps AS (SELECT {keys}, replicate, CAST(sum(w) AS BIGINT) AS weight, {weighted} FROM b3 GROUP BY ALL)"""


def interval_sql(keys: str, statistic: str) -> str:
    return f"""
SELECT {keys}, round(max(CASE WHEN replicate < 0 THEN v END), 6) AS point,
  round(quantile_cont(CASE WHEN replicate >= 0 THEN v END, 0.025), 6) AS low,
  round(quantile_cont(CASE WHEN replicate >= 0 THEN v END, 0.975), 6) AS high,
  count(CASE WHEN replicate >= 0 AND v IS NULL THEN 1 END) AS dropped
FROM (SELECT *, {statistic} AS v FROM reps) t GROUP BY {keys}"""


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in ("point", "low", "high")], "dropped")


@query(
    "delta_accuracy_interval",
    f"{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL},"
    + boot_sql("pairs", "pipeline", ["b_correct", "c_correct"])
    + interval_sql("pipeline", "CAST(c_correct - b_correct AS DOUBLE)/nullif(weight, 0)"),
)
def delta_accuracy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.pair(arms(spark, sf_dir), BASELINE)
    sums = {n: F.col(n) for n in ("b_correct", "c_correct")}
    out = B.bootstrap(
        pairs, ["pipeline"], B.task_key(F.col("task_id")), sums, B.delta_accuracy
    )
    return _rounded(out, ["pipeline"])


@query(
    "cost_per_success_interval",
    f"{ctes('matrix')}, {ARMS_SQL},"
    + boot_sql("arms", "pipeline", ["cost", "correct"])
    + interval_sql("pipeline", "CAST(cost AS DOUBLE)/nullif(correct, 0)"),
)
def cost_per_success_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {n: F.col(n) for n in ("cost", "correct")}
    out = B.bootstrap(
        arms(spark, sf_dir), ["pipeline"], B.task_key(F.col("task_id")), sums, B.cost_per_success
    )
    return _rounded(out, ["pipeline"])


@query(
    "cost_ratio_interval",
    f"{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL},"
    + boot_sql("pairs", "pipeline", ["b_correct", "c_correct", "b_cost", "c_cost"])
    + interval_sql(
        "pipeline",
        "(CAST(c_cost AS DOUBLE)/nullif(c_correct, 0))/nullif(CAST(b_cost AS DOUBLE)/nullif(b_correct, 0), 0)",
    ),
)
def cost_ratio_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.pair(arms(spark, sf_dir), BASELINE)
    out = B.bootstrap(
        pairs, ["pipeline"], B.task_key(F.col("task_id")), B.pair_sums(), B.cost_ratio
    )
    return _rounded(out, ["pipeline"])


@query(
    "proof_verdict",
    f"{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL}, {COUNTS_SQL},"
    + boot_sql("pairs", "pipeline", ["b_correct", "c_correct"])
    + ", iv AS ("
    + interval_sql("pipeline", "CAST(c_correct - b_correct AS DOUBLE)/nullif(weight, 0)")
    + f"""),
p AS (SELECT c.*, iv.low, iv.high, CAST(baseline_only AS DOUBLE)/n AS p10,
   CAST(candidate_only AS DOUBLE)/n AS p01 FROM counts c JOIN iv USING (pipeline)),
q AS (SELECT *, p01-p10 AS delta, p10+p01-(p10-p01)*(p10-p01) AS v,
  CASE WHEN low > -0.03 THEN 'non_inferior' WHEN high < -0.03 THEN 'worse' ELSE 'inconclusive' END AS verdict FROM p),
r AS (SELECT *, CASE WHEN delta + 0.03 <= 0 THEN NULL WHEN v <= 0 THEN 1
   ELSE CAST(ceil({Z * Z}*v/((delta+0.03)*(delta+0.03))) AS BIGINT) END AS required_n FROM q)
SELECT pipeline, n, round(delta, 6) AS delta, low, high, verdict,
  CASE WHEN verdict = 'inconclusive' AND required_n IS NOT NULL THEN greatest(0, required_n - n) END AS additional_tasks,
  round((CAST(c_total AS DOUBLE)/c_successes)/(CAST(b_total AS DOUBLE)/b_successes), 6) AS cost_ratio FROM r""",
)
def proof_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cheaper pipeline against the dearest: interval, verdict, tasks still needed."""
    pairs = A.pair(arms(spark, sf_dir), BASELINE)
    ends = delta_accuracy_interval(spark, sf_dir).select("pipeline", "low", "high")
    judged = A.verdicts(
        A.paired_counts(pairs).join(ends, "pipeline"), F.col("low"), F.col("high")
    )
    ratio = (F.col("c_total") / F.col("c_successes")) / (F.col("b_total") / F.col("b_successes"))
    return judged.select(
        "pipeline", "n", r6("delta").alias("delta"), "low", "high", "verdict",
        F.col("additional_tasks").cast("bigint").alias("additional_tasks"),
        r6(ratio).alias("cost_ratio"),
    )


@query("proof_multinomial")
def proof_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same proof with the exact multinomial interval of three counts."""
    return A.proof(A.pair(arms(spark, sf_dir), BASELINE))


@query(
    "savings_waterfall",
    f"{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL}, {COUNTS_SQL},"
    + boot_sql("pairs", "pipeline", ["b_correct", "c_correct"])
    + ", iv AS ("
    + interval_sql("pipeline", "CAST(c_correct - b_correct AS DOUBLE)/nullif(weight, 0)")
    + f"""),
q AS (SELECT c.pipeline, c.n, low, high, CAST(candidate_only - baseline_only AS DOUBLE)/n AS delta,
  CAST(baseline_only + candidate_only AS DOUBLE)/n - (CAST(candidate_only - baseline_only AS DOUBLE)/n)*(CAST(candidate_only - baseline_only AS DOUBLE)/n) AS v,
  CASE WHEN low > -0.03 THEN 'non_inferior' WHEN high < -0.03 THEN 'worse' ELSE 'inconclusive' END AS verdict FROM counts c JOIN iv USING (pipeline)),
r AS (SELECT *, CASE WHEN delta + 0.03 <= 0 THEN NULL WHEN v <= 0 THEN 1 ELSE CAST(ceil({Z * Z}*v/((delta+0.03)*(delta+0.03))) AS BIGINT) END AS required_n FROM q),
s AS (SELECT pipeline, count(*) AS n, CAST(sum(correct) AS BIGINT) AS successes, CAST(sum(cost) AS BIGINT) AS total_cost,
  CAST(sum(scarce_cost) AS BIGINT) AS scarce_cost FROM arms GROUP BY pipeline)
SELECT s.pipeline, s.n, s.successes, s.total_cost, round(CAST(s.total_cost AS DOUBLE)/s.successes, 6) AS cost_per_success,
  round(CAST(scarce_cost AS DOUBLE)/total_cost, 6) AS scarce_share, round(delta, 6) AS delta, verdict,
  CASE WHEN verdict = 'inconclusive' AND required_n IS NOT NULL THEN greatest(0, required_n - r.n) END AS additional_tasks
FROM s LEFT JOIN r USING (pipeline)""",
)
def savings_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pipeline with its own summary and its verdict against the dearest.

    The interval behind a verdict is drawn by counts here and by tasks in the SQL: its ends differ in
    the fourth place, the verdicts do not.
    """
    out = A.waterfall(arms(spark, sf_dir), BASELINE)
    return out.select(
        "pipeline", "n", "successes", "total_cost", "verdict", F.col("additional_tasks").cast("bigint").alias("additional_tasks"),
        *[r6(c).alias(c) for c in ("cost_per_success", "scarce_share", "delta")],
    )


@query(
    "breakdown_by_question_type",
    f"""{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL}
SELECT pipeline, question_type, count(*) AS n,
  round(CAST(sum(b_correct) AS DOUBLE)/count(*), 6) AS baseline_accuracy,
  round(CAST(sum(c_correct) AS DOUBLE)/count(*), 6) AS candidate_accuracy,
  round(CAST(sum(CASE WHEN resolved_tier = 'mid' THEN 1 ELSE 0 END) AS DOUBLE)/count(*), 6) AS mid_share,
  round(CAST(sum(b_cost) AS DOUBLE)/nullif(sum(b_correct), 0), 6) AS baseline_cost_per_success,
  round(CAST(sum(c_cost) AS DOUBLE)/nullif(sum(c_correct), 0), 6) AS candidate_cost_per_success
FROM pairs GROUP BY 1, 2""",
)
def breakdown_by_question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.pair(arms(spark, sf_dir), BASELINE, ["question_type", "resolved_tier"])
    out = A.by_question_type(pairs)
    return out.select(
        "pipeline", "question_type", "n",
        r6("baseline_accuracy").alias("baseline_accuracy"),
        r6("candidate_accuracy").alias("candidate_accuracy"),
        r6(F.coalesce(F.col("tier_shares")["mid"], F.lit(0.0))).alias("mid_share"),
        r6("baseline_cost_per_success").alias("baseline_cost_per_success"),
        r6("candidate_cost_per_success").alias("candidate_cost_per_success"),
    )


@query(
    "disagreements",
    f"""{ctes('matrix', 'tasks')}, {ARMS_SQL}, {PAIRS_SQL}
SELECT p.pipeline, p.task_id, t.question_type, p.b_correct, p.c_correct, p.b_cost, p.c_cost
FROM pairs p JOIN tasks t ON t.task_id = p.task_id WHERE b_correct <> c_correct""",
)
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.disagreements(A.pair(arms(spark, sf_dir), BASELINE))
    tasks = bind(spark, sf_dir, "tasks").select("task_id", "question_type")
    return pairs.join(tasks, "task_id", "left").select(
        "pipeline", "task_id", "question_type", "b_correct", "c_correct", "b_cost", "c_cost"
    )


@query(
    "same_task_guard",
    f"""{ctes('matrix')}, {ARMS_SQL},
base AS (SELECT task_id FROM arms WHERE pipeline = 'frontier' AND task_id % 1000 <> 7),
rest AS (SELECT pipeline, task_id FROM arms WHERE pipeline <> 'frontier' AND (pipeline <> 'cheap' OR task_id % 500 <> 3))
SELECT pipeline, count(*) - count(base.task_id) AS missing_in_baseline,
  (SELECT count(*) FROM base) - count(base.task_id) AS missing_in_candidate
FROM rest LEFT JOIN base USING (task_id) GROUP BY pipeline""",
)
def same_task_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms with tasks missing on either side, as the guard of a paired comparison reports them."""
    a = arms(spark, sf_dir)
    torn = a.where(
        ~((F.col("pipeline") == "frontier") & (F.col("task_id") % 1000 == 7))
        & ~((F.col("pipeline") == "cheap") & (F.col("task_id") % 500 == 3))
    )
    return A.check_same_tasks(torn, BASELINE)


@query(
    "cheaper_tier_already_right",
    f"""{ctes('matrix')},
cal AS (SELECT tier, task_id, correct, cost_nano FROM matrix WHERE split = 'calibration'),
both_right AS (SELECT task_id FROM cal WHERE tier = 'frontier' AND correct = 1
  INTERSECT SELECT task_id FROM cal WHERE tier = 'cheap' AND correct = 1),
s AS (SELECT count(*) FILTER (tier = 'frontier') AS n,
  CAST(sum(cost_nano) FILTER (tier = 'frontier') AS BIGINT) AS dear,
  CAST(sum(cost_nano) FILTER (tier = 'cheap') AS BIGINT) AS low,
  count(*) FILTER (tier = 'cheap') AS m FROM cal)
SELECT (SELECT count(*) FROM both_right) AS both_right, n,
  round(CAST((SELECT count(*) FROM both_right) AS DOUBLE)/n, 6) AS share,
  round((CAST(dear AS DOUBLE)/n - CAST(low AS DOUBLE)/m)
    * ((SELECT count(*) FROM both_right)/CAST(n AS DOUBLE)) * 1000, 3) AS nano_per_1k FROM s""",
)
def cheaper_tier_already_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of calibration tasks a cheap tier already gets right, and what routing them saves."""
    from costproof.operators.findings import cheaper_tier

    out = cheaper_tier(arms(spark, sf_dir, "calibration"), "frontier", "cheap")
    return out.select(
        "both_right", "n", r6("share").alias("share"),
        F.round("per_1k", 3).alias("nano_per_1k"),
    )


@query(
    "proof_bill",
    f"""{ctes('samples')},
led AS (SELECT *, CASE WHEN task_id % 3 = 0 THEN 'calibration' ELSE 'test' END AS split,
  task_id % 101 = 0 AS prewarm FROM samples),
lines AS (SELECT cost_nano AS cost, CASE WHEN prewarm THEN 'prewarm' WHEN sample_index > 0 THEN 'sampling'
  WHEN split = 'calibration' THEN 'calibration' WHEN tier = 'frontier' THEN 'baseline'
  WHEN tier = 'cheap' THEN 'candidate' ELSE 'other' END AS line FROM led)
SELECT CAST(sum(CASE WHEN line = 'baseline' THEN cost ELSE 0 END) AS BIGINT) AS baseline_cost,
  CAST(sum(CASE WHEN line = 'calibration' THEN cost ELSE 0 END) AS BIGINT) AS calibration_cost,
  CAST(sum(CASE WHEN line = 'candidate' THEN cost ELSE 0 END) AS BIGINT) AS candidate_cost,
  CAST(sum(CASE WHEN line = 'other' THEN cost ELSE 0 END) AS BIGINT) AS other_cost,
  CAST(sum(CASE WHEN line = 'sampling' THEN cost ELSE 0 END) AS BIGINT) AS sampling_cost,
  CAST(sum(CASE WHEN line = 'prewarm' THEN cost ELSE 0 END) AS BIGINT) AS prewarm_cost,
  CAST(sum(cost) AS BIGINT) AS proof_cost,
  CASE WHEN avg(cost) FILTER (line = 'baseline') > avg(cost) FILTER (line = 'candidate') THEN CAST(ceil(CAST(sum(cost) AS DOUBLE)
    / (avg(cost) FILTER (line = 'baseline') - avg(cost) FILTER (line = 'candidate'))) AS BIGINT) END AS repayment_tasks FROM lines""",
)
def proof_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What producing the proof cost, line by line, and the tasks that repay it."""
    s = bind(spark, sf_dir, "samples")
    line = A.spend_line(
        F.when(F.col("task_id") % 3 == 0, "calibration").otherwise("test"),
        F.col("tier"),
        F.col("task_id") % 101 == 0,
        F.col("sample_index"),
        "frontier",
        "cheap",
    )
    lines = s.select(F.col("cost_nano").alias("cost"), line.alias("line"))
    mean = lambda name: F.avg(F.when(F.col("line") == name, F.col("cost")))
    saving = lines.agg((mean("baseline") - mean("candidate")).alias("saving"))
    return A.proof_cost(lines).crossJoin(F.broadcast(saving)).withColumn(
        "repayment_tasks", A.repayment(F.col("saving"), F.col("proof_cost"))
    ).drop("saving")


@query(
    "recording_sanity_gate",
    f"""{ctes('matrix')},
a AS (SELECT tier, CAST(sum(correct) AS DOUBLE)/count(*) AS accuracy FROM matrix
  WHERE split = 'calibration' GROUP BY tier),
s AS (SELECT max(accuracy) FILTER (tier = 'frontier') AS d, max(accuracy) FILTER (tier = 'cheap') AS c FROM a)
SELECT round(d, 6) AS dearest_accuracy, round(c, 6) AS cheap_accuracy,
  NOT (d < 0.9) AND NOT (d - c < 0.03) AS passes FROM s""",
)
def recording_sanity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = A.arm_summary(arms(spark, sf_dir, "calibration"))
    return A.sanity_gate(acc, "frontier", "cheap").select(
        r6("dearest_accuracy").alias("dearest_accuracy"),
        r6("cheap_accuracy").alias("cheap_accuracy"),
        "passes",
    )


@query(
    "task_trace",
    f"""{ctes('matrix', 'calls', 'prices')}
SELECT c.task_id, c.attempt, c.model, c.prewarm, c.failed,
  c.input_uncached*p.input + c.cache_write_5m*p.cache_write_5m + c.cache_write_1h*p.cache_write_1h
  + c.cache_read*p.cache_read + (c.output_visible + c.output_reasoning)*p.output AS cost,
  m.correct FROM calls c JOIN prices p USING (model)
  LEFT JOIN matrix m ON m.task_id = c.task_id AND m.tier = c.model
WHERE c.task_id = (SELECT max(l_orderkey) FROM lineitem)""",
)
def task_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of one task across pipelines, with their grades."""
    calls = bind(spark, sf_dir, "calls")
    wanted = calls.agg(F.max("task_id").alias("task_id"))
    one = calls.join(F.broadcast(wanted), "task_id", "left_semi")
    grades = bind(spark, sf_dir, "matrix").select(
        "task_id", F.col("tier").alias("model"), "correct"
    )
    priced = S.price_calls(one, bind(spark, sf_dir, "prices"), unit="nano")
    return priced.join(grades, ["task_id", "model"], "left").select(
        "task_id", "attempt", "model", "prewarm", "failed", "cost", "correct"
    )
