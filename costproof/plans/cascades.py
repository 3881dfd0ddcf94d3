"""Cascade evaluation and search over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof import fixed
from costproof.bindings import bind, ctes
from costproof.operators import cascade as C
from costproof.operators import ties as T
from costproof.operators.scoring import auroc
from costproof.plans.registry import query, r6

TIERS = ["cheap", "mid", "frontier"]
SCARCE = [False, False, True]


def matrix(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    m = bind(spark, sf_dir, "matrix").where(F.col("split") == split)
    return m.withColumnRenamed("cost_nano", "cost")


def wide_sql(split: str) -> str:
    parts = ", ".join(
        f"max(CASE WHEN tier_index = {i} THEN {c} END) AS {a}_{i}"
        for i in range(3)
        for c, a in (("score", "score"), ("correct", "correct"), ("cost_nano", "cost"))
    )
    return f"wide AS (SELECT task_id, {parts} FROM matrix WHERE split = '{split}' GROUP BY task_id)"


OUTCOME_SQL = (
    "resolved AS (SELECT *, CASE WHEN score_0 >= 0.5 THEN 0 WHEN score_1 >= 0.6 THEN 1 ELSE 2 END AS resolved FROM wide), "
    "outcome AS (SELECT *, CASE resolved WHEN 0 THEN correct_0 WHEN 1 THEN correct_1 ELSE correct_2 END AS correct, "
    "cost_0 + CASE WHEN resolved >= 1 THEN cost_1 ELSE 0 END + CASE WHEN resolved >= 2 THEN cost_2 ELSE 0 END AS cost, "
    "CASE WHEN resolved >= 2 THEN cost_2 ELSE 0 END AS scarce_cost FROM resolved)"
)


@query(
    "cascade_outcome",
    f"""{ctes('matrix')}, {wide_sql('test')}, {OUTCOME_SQL}
SELECT count(*) AS n, CAST(sum(correct) AS BIGINT) AS successes, CAST(sum(cost) AS BIGINT) AS total_cost,
  CAST(sum(scarce_cost) AS BIGINT) AS scarce_cost FROM outcome""",
)
def cascade_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = C.wide_matrix(matrix(spark, sf_dir, "test"), 3)
    out = C.simulate(wide, [0.5, 0.6, 0.0], TIERS, SCARCE)
    return out.agg(
        F.count("*").alias("n"),
        F.sum("correct").alias("successes"),
        F.sum("cost").alias("total_cost"),
        F.sum("scarce_cost").alias("scarce_cost"),
    )


@query(
    "cascade_tier_shares",
    f"""{ctes('matrix')}, {wide_sql('test')}, {OUTCOME_SQL}
SELECT t.i AS tier_index,
  round(CAST(sum(CASE WHEN resolved = t.i THEN 1 ELSE 0 END) AS DOUBLE)/count(*), 6) AS resolved_share,
  round(CAST(sum(CASE WHEN resolved >= t.i THEN 1 ELSE 0 END) AS DOUBLE)/count(*), 6) AS reached_share,
  round(CAST(sum(CASE WHEN resolved >= t.i THEN CASE t.i WHEN 0 THEN cost_0 WHEN 1 THEN cost_1 ELSE cost_2 END ELSE 0 END) AS DOUBLE)/sum(cost), 6) AS cost_share
FROM outcome, (VALUES (0), (1), (2)) t(i) GROUP BY t.i""",
)
def cascade_tier_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = C.wide_matrix(matrix(spark, sf_dir, "test"), 3)
    out = C.tier_shares(C.simulate(wide, [0.5, 0.6, 0.0], TIERS, SCARCE), 3)
    return out.select(
        "tier_index", *[r6(c).alias(c) for c in ("resolved_share", "reached_share", "cost_share")]
    )


GRID_SQL = "grid AS (SELECT round(i * 0.02, 10) AS g, i FROM (SELECT unnest(range(0, 51)) AS i) q)"


def settings_sql(split: str) -> str:
    """Settings by brute force over tasks: what the cell sums must equal."""
    return f"""{wide_sql(split)}, {GRID_SQL},
settings AS (SELECT a.i AS t0, b.i AS t1, count(*) AS n,
  CAST(sum(CASE WHEN score_0 >= a.g THEN correct_0 WHEN score_1 >= b.g THEN correct_1 ELSE correct_2 END) AS BIGINT) AS successes,
  CAST(sum(cost_0 + CASE WHEN score_0 >= a.g THEN 0 ELSE cost_1 + CASE WHEN score_1 >= b.g THEN 0 ELSE cost_2 END END) AS BIGINT) AS total_cost,
  CAST(sum(CASE WHEN score_0 >= a.g OR score_1 >= b.g THEN 0 ELSE cost_2 END) AS BIGINT) AS scarce_cost
  FROM wide, grid a, grid b GROUP BY a.i, b.i)"""


@query(
    "threshold_settings",
    f"""{ctes('matrix')}, {settings_sql('test')}
SELECT t0, t1, n, successes, total_cost, scarce_cost FROM settings""",
)
def threshold_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and accuracy of every grid setting on the test split."""
    wide = C.wide_matrix(matrix(spark, sf_dir, "test"), 3)
    table = C.settings(C.cells(wide, 3), 3, SCARCE)
    return table.select(
        F.col("t0").cast("bigint").alias("t0"), F.col("t1").cast("bigint").alias("t1"),
        "n", "successes", "total_cost", "scarce_cost",
    )


@query(
    "threshold_search",
    f"""{ctes('matrix')}, {settings_sql('calibration')},
lim AS (SELECT CAST(sum(correct_2) AS DOUBLE)/count(*) - 0.01 AS floor FROM wide),
f AS (SELECT s.*, CAST(successes AS DOUBLE)/n >= floor AS ok FROM settings s, lim)
SELECT 'cost' AS objective, t0, t1, n, successes, total_cost, scarce_cost,
  (SELECT count(*) FROM f WHERE ok) AS feasible, (SELECT count(*) FROM f) AS evaluated
FROM (SELECT * FROM f ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN total_cost ELSE -successes END,
  CASE WHEN ok THEN -successes ELSE total_cost END, t0, t1 LIMIT 1) x
UNION ALL
SELECT 'scarce' AS objective, t0, t1, n, successes, total_cost, scarce_cost,
  (SELECT count(*) FROM f WHERE ok) AS feasible, (SELECT count(*) FROM f) AS evaluated
FROM (SELECT * FROM f ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN scarce_cost ELSE -successes END,
  CASE WHEN ok THEN -successes ELSE total_cost END, t0, t1 LIMIT 1) y""",
)
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operating point chosen on the calibration split, for both objectives."""
    wide = C.wide_matrix(matrix(spark, sf_dir, "calibration"), 3)
    table = C.settings(C.cells(wide, 3), 3, SCARCE)
    floor = F.col("dearest_accuracy") - fixed.ACCURACY_SLACK
    return C.choose_each(table, floor, ["cost", "scarce"]).select(
        "objective", F.col("t0").cast("bigint").alias("t0"), F.col("t1").cast("bigint").alias("t1"),
        "n", "successes", "total_cost", "scarce_cost", "feasible", "evaluated",
    )


def _cumulated(name: str, measure: str, depth: int) -> str:
    """Common tables that end in ``name``: a measure of the tasks that go on past ``depth`` tiers."""
    front = [f"b{i}" for i in range(depth)]
    steps = [f"""{name}_0 AS (SELECT {', '.join(f'g{i}.i AS {b}' for i, b in enumerate(front))}, CAST(coalesce(x, 0) AS BIGINT) AS x
  FROM {' CROSS JOIN '.join(f'line AS g{i}' for i in range(depth))}
  LEFT JOIN (SELECT {', '.join(front)}, sum({measure}) AS x FROM cells GROUP BY ALL) q
    ON {' AND '.join(f'q.{b} = g{i}.i' for i, b in enumerate(front))})"""]
    for i, b in enumerate(front):
        rest = ", ".join(x for x in front if x != b) or "1"
        steps.append(f"{name}_{i + 1} AS (SELECT {', '.join(front)}, sum(x) OVER (PARTITION BY {rest} ORDER BY {b}) AS x FROM {name}_{i})")
    return ",\n".join(steps)


def _past(name: str, depth: int) -> str:
    on = " AND ".join(f"{name}_{depth}.b{i} = t{i}" for i in range(depth))
    return f"JOIN {name}_{depth} ON {on}"


@query(
    "threshold_settings_four_tiers",
    f"""{ctes('matrix4')}, line AS (SELECT unnest(range(0, 52)) AS i),
w AS (SELECT task_id, {', '.join(f'max(CASE WHEN tier_index = {i} THEN {c} END) AS {a}_{i}' for i in range(4) for c, a in (('score', 'score'), ('correct', 'ok'), ('cost_nano', 'cost')))}
  FROM matrix4 WHERE split = 'calibration' GROUP BY task_id),
cells AS (SELECT {', '.join(f'CAST((SELECT count(*) FROM line WHERE i <= 50 AND score_{j} >= round(i*0.02, 10)) AS INTEGER) AS b{j}' for j in range(3))},
  ok_0, ok_1, ok_2, ok_3, cost_0, cost_1, cost_2, cost_3 FROM w),
{', '.join(_cumulated(f'{m}{j}d{d}', f'{m}_{j}', d) for d in (1, 2, 3) for m, j in (('ok', d - 1), ('ok', d), ('cost', d)))},
whole AS (SELECT count(*) AS n, sum(ok_0) AS ok, sum(cost_0) AS cost FROM cells)
SELECT CAST(t0 AS BIGINT) AS t0, CAST(t1 AS BIGINT) AS t1, CAST(t2 AS BIGINT) AS t2, n,
  CAST(ok - ok0d1_1.x + ok1d1_1.x - ok1d2_2.x + ok2d2_2.x - ok2d3_3.x + ok3d3_3.x AS BIGINT) AS successes,
  CAST(cost + cost1d1_1.x + cost2d2_2.x + cost3d3_3.x AS BIGINT) AS total_cost, CAST(cost2d2_2.x AS BIGINT) AS scarce_cost
FROM whole CROSS JOIN (SELECT a.i AS t0, b.i AS t1, c.i AS t2 FROM line a, line b, line c WHERE a.i < 51 AND b.i < 51 AND c.i < 51) AS s
{' '.join(_past(f'{m}{j}d{d}', d) for d in (1, 2, 3) for m, j in (('ok', d - 1), ('ok', d), ('cost', d)))}""",
)
def threshold_settings_four_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 132,651 settings of a cascade of four tiers on the calibration split."""
    m = bind(spark, sf_dir, "matrix4").where("split = 'calibration'").withColumnRenamed("cost_nano", "cost")
    table = C.settings(C.cells(C.wide_matrix(m, 4), 4), 4, [*SCARCE, False])
    return table.select(
        *[F.col(t).cast("bigint").alias(t) for t in ("t0", "t1", "t2")], "n", "successes", "total_cost", "scarce_cost"
    )


@query(
    "threshold_search_by_type",
    f"""{ctes('matrix')},
wide AS (SELECT question_type, task_id,
  max(CASE WHEN tier_index = 0 THEN score END) AS score_0, max(CASE WHEN tier_index = 1 THEN score END) AS score_1,
  max(CASE WHEN tier_index = 0 THEN correct END) AS correct_0, max(CASE WHEN tier_index = 1 THEN correct END) AS correct_1,
  max(CASE WHEN tier_index = 2 THEN correct END) AS correct_2,
  max(CASE WHEN tier_index = 0 THEN cost_nano END) AS cost_0, max(CASE WHEN tier_index = 1 THEN cost_nano END) AS cost_1,
  max(CASE WHEN tier_index = 2 THEN cost_nano END) AS cost_2
  FROM matrix WHERE split = 'calibration' GROUP BY 1, 2), {GRID_SQL},
settings AS (SELECT question_type, a.i AS t0, b.i AS t1, count(*) AS n,
  CAST(sum(CASE WHEN score_0 >= a.g THEN correct_0 WHEN score_1 >= b.g THEN correct_1 ELSE correct_2 END) AS BIGINT) AS successes,
  CAST(sum(cost_0 + CASE WHEN score_0 >= a.g THEN 0 ELSE cost_1 + CASE WHEN score_1 >= b.g THEN 0 ELSE cost_2 END END) AS BIGINT) AS total_cost
  FROM wide, grid a, grid b GROUP BY 1, 2, 3),
f AS (SELECT *, CAST(successes AS DOUBLE)/n >= 0.95 AS ok FROM settings),
o AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY CASE WHEN ok THEN 0 ELSE 1 END,
  CASE WHEN ok THEN total_cost ELSE -successes END, CASE WHEN ok THEN -successes ELSE total_cost END, t0, t1) AS rn FROM f)
SELECT question_type, t0, t1, n, successes, total_cost FROM o WHERE rn = 1""",
)
def threshold_search_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per workload slice, all slices in the same job."""
    out = C.search(
        matrix(spark, sf_dir, "calibration"), TIERS, SCARCE, floor=0.95, keys=["question_type"]
    )
    return out.select(
        "question_type", F.col("t0").cast("bigint").alias("t0"),
        F.col("t1").cast("bigint").alias("t1"), "n", "successes", "total_cost",
    )


@query(
    "cost_accuracy_frontier",
    f"""{ctes('matrix')}, {settings_sql('test')},
w AS (SELECT *, max(successes) OVER (ORDER BY total_cost, successes DESC, t0, t1
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM settings)
SELECT t0, t1, successes, total_cost FROM w WHERE best IS NULL OR successes > best""",
)
def cost_accuracy_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = C.wide_matrix(matrix(spark, sf_dir, "test"), 3)
    front = C.pareto(C.settings(C.cells(wide, 3), 3, SCARCE))
    return front.select(
        F.col("t0").cast("bigint").alias("t0"), F.col("t1").cast("bigint").alias("t1"),
        "successes", "total_cost",
    )


@query(
    "matrix_completeness",
    f"""{ctes('matrix')},
torn AS (SELECT * FROM matrix WHERE NOT (tier_index = 1 AND task_id % 250 = 9))
SELECT task_id, count(*) AS answers, count(DISTINCT tier_index) AS tiers FROM torn
GROUP BY task_id HAVING count(*) <> 3 OR count(DISTINCT tier_index) <> 3""",
)
def matrix_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks some tier did not answer, which a cascade refuses."""
    m = bind(spark, sf_dir, "matrix")
    return C.incomplete_tasks(
        m.where(~((F.col("tier_index") == 1) & (F.col("task_id") % 250 == 9))), 3
    )


@query(
    "score_auroc_by_tier",
    f"""{ctes('matrix')},
s AS (SELECT tier, score, sum(correct) AS pos, count(*) - sum(correct) AS neg FROM matrix
  WHERE split = 'test' GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY tier ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT tier, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
  round(CAST(sum(pos*(2*below + neg)) AS DOUBLE)/(2.0*sum(pos)*sum(neg)), 6) AS auroc FROM w GROUP BY tier""",
)
def score_auroc_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = auroc(matrix(spark, sf_dir, "test"), ["tier"], "score", "correct")
    return out.select("tier", "positives", "negatives", r6("auroc").alias("auroc"))


TIE_SQL = f"""{ctes('matrix')},
c AS (SELECT tier || '/' || question_type AS label, count(*) AS n, CAST(sum(correct) AS BIGINT) AS k,
  CAST(sum(cost_nano) AS BIGINT) AS cost, min(tier_index) AS ti FROM matrix WHERE split = 'test' GROUP BY 1),
d AS (SELECT label, ti, CAST(cost AS DOUBLE)/k AS cost_point, CAST(k AS DOUBLE)/n AS accuracy,
  CAST(cost AS DOUBLE)/k * 0.9 AS cost_low, CAST(cost AS DOUBLE)/k * 1.2 AS cost_high,
  CASE WHEN ti = 2 THEN 1.0 ELSE 0.0 END AS scarce_share, ti <> 0 OR label LIKE '%LOW' AS adoptable FROM c),
b AS (SELECT * FROM d ORDER BY cost_point, -accuracy, label LIMIT 1),
tied AS (SELECT d.* FROM d, b WHERE d.cost_low <= b.cost_high AND b.cost_low <= d.cost_high)"""


@query(
    "ties_for_cheapest",
    TIE_SQL
    + """, run AS (SELECT label, scarce_share FROM tied ORDER BY CASE WHEN adoptable THEN 0 ELSE 1 END, cost_point, -accuracy, label LIMIT 1),
alt AS (SELECT t.label FROM tied t, run WHERE t.label <> run.label AND t.adoptable ORDER BY t.scarce_share, t.cost_point, t.label LIMIT 1)
SELECT t.label, round(t.cost_point, 6) AS cost_point, t.adoptable, t.label = (SELECT label FROM b) AS is_cheapest,
  coalesce(t.label = (SELECT label FROM alt), FALSE) AS is_fallback,
  round(1.0/(SELECT count(*) FROM tied), 6) AS exploration_weight FROM tied t""",
)
def ties_for_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations whose cost interval overlaps the cheapest one's, with the fallback."""
    m = matrix(spark, sf_dir, "test")
    c = m.groupBy(F.concat_ws("/", "tier", "question_type").alias("label")).agg(
        F.count("*").alias("n"),
        F.sum("correct").alias("k"),
        F.sum("cost").alias("cost"),
        F.min("tier_index").alias("ti"),
    )
    point = F.col("cost") / F.col("k")
    configurations = c.select(
        "label",
        point.alias("cost_point"),
        (point * 0.9).alias("cost_low"),
        (point * 1.2).alias("cost_high"),
        (F.col("k") / F.col("n")).alias("accuracy"),
        F.when(F.col("ti") == 2, 1.0).otherwise(0.0).alias("scarce_share"),
        ((F.col("ti") != 0) | F.col("label").endswith("LOW")).alias("adoptable"),
    )
    return T.tie_report(configurations).select(
        "label", r6("cost_point").alias("cost_point"), "adoptable", "is_cheapest", "is_fallback",
        r6("exploration_weight").alias("exploration_weight"),
    )
