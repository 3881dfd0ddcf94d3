"""Fingerprints, drift, splits, provenance and certificates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof import fixed
from costproof.bindings import bind, ctes
from costproof.operators import arms as A
from costproof.operators import certificates as CE
from costproof.operators import drift as D
from costproof.plans.proofs import ARMS_SQL, PAIRS_SQL, arms
from costproof.plans.registry import query, r6
from costproof.runtime import cut

Z = fixed.Z_95


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks: a type and a length, certified in the first weeks and recent after."""
    t = bind(spark, sf_dir, "traffic")
    skew = (F.col("call_id") % 4 == 0) & (F.dayofmonth("day") > 15)
    return t.select(
        F.when(F.dayofmonth("day") <= 15, "certified").otherwise("recent").alias("era"),
        F.when(skew, "override").otherwise(F.col("question_type")).alias("question_type"),
        (F.col("cost_cents") % 997).alias("tokens"),
    )


TRAFFIC_SQL = f"""{ctes('traffic')},
tr AS (SELECT CASE WHEN day(day) <= 15 THEN 'certified' ELSE 'recent' END AS era,
  CASE WHEN call_id % 4 = 0 AND day(day) > 15 THEN 'override' ELSE question_type END AS question_type, cost_cents % 997 AS tokens FROM traffic),
mix AS (SELECT era, question_type, count(*) AS n, round(CAST(count(*) AS DOUBLE)/sum(count(*)) OVER (PARTITION BY era), 6) AS share,
  CAST(count(*) AS DOUBLE)/sum(count(*)) OVER (PARTITION BY era) AS ex FROM tr GROUP BY 1, 2),
len AS (SELECT era, round(quantile_cont(tokens, 0.1), 4) AS p10, round(quantile_cont(tokens, 0.5), 4) AS p50,
  round(quantile_cont(tokens, 0.9), 4) AS p90, round(quantile_cont(tokens, 0.99), 4) AS p99, round(avg(tokens), 4) AS mean_question_tokens FROM tr GROUP BY 1)"""


@query(
    "type_mix",
    f"""{TRAFFIC_SQL} SELECT era, question_type, n, share FROM mix""",
)
def type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.type_mix(traffic(spark, sf_dir), ["era"]).select("era", "question_type", "n", "share")


@query(
    "workload_fingerprint",
    f"""{TRAFFIC_SQL}, s AS (SELECT era, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds, sum(ex*ex) AS h, min(ex) AS rare FROM mix GROUP BY 1)
SELECT era, n, round(CASE WHEN kinds > 1 THEN (h - 1.0/kinds)/(1 - 1.0/kinds) ELSE 1.0 END, 6) AS type_concentration,
  round(rare, 6) AS rarest_type_share, p10, p50, p90, p99, mean_question_tokens FROM s JOIN len USING (era)""",
)
def workload_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of certified and recent traffic: concentration, rarest share, length quantiles."""
    return D.fingerprint(traffic(spark, sf_dir), ["era"]).select(
        "era", "n", "type_concentration", "rarest_type_share", "p10", "p50", "p90", "p99",
        "mean_question_tokens",
    )


@query(
    "traffic_divergence",
    f"""{TRAFFIC_SQL},
al AS (SELECT coalesce(c.question_type, r.question_type) AS question_type, coalesce(c.share, 0) AS cs, coalesce(r.share, 0) AS rs
  FROM (SELECT * FROM mix WHERE era = 'certified') c FULL OUTER JOIN (SELECT * FROM mix WHERE era = 'recent') r ON c.question_type = r.question_type),
t AS (SELECT sum(abs(rs - cs))/2 AS tvd, string_agg(CASE WHEN rs >= 0.1 AND cs < 0.02 THEN question_type END, ',' ORDER BY question_type) AS uncovered FROM al)
SELECT round(tvd, 6) AS total_variation, coalesce(uncovered, '') AS uncovered,
  tvd >= 0.2 OR uncovered IS NOT NULL OR EXISTS (SELECT 1 FROM len a, len b WHERE a.era = 'certified' AND b.era = 'recent'
    AND (b.p10/a.p10 NOT BETWEEN 1/1.5 AND 1.5 OR b.p50/a.p50 NOT BETWEEN 1/1.5 AND 1.5 OR b.p90/a.p90 NOT BETWEEN 1/1.5 AND 1.5 OR b.p99/a.p99 NOT BETWEEN 1/1.5 AND 1.5)) AS drifted FROM t""",
)
def traffic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far recent traffic moved from what was certified."""
    t = traffic(spark, sf_dir)
    sides = [t.where(F.col("era") == e) for e in ("certified", "recent")]
    mixes, lengths = [D.type_mix(s) for s in sides], [D.length_quantiles(s) for s in sides]
    out = D.divergence(mixes[0], mixes[1], lengths[0], lengths[1])
    return out.select(
        "total_variation", F.concat_ws(",", "uncovered").alias("uncovered"), "drifted"
    )


HASH_SQL = "md5('{seed}|' || CAST(task_id AS VARCHAR))"


@query(
    "split_assignment",
    f"""{ctes('tasks')},
r AS (SELECT task_id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY {HASH_SQL.format(seed=7)}, task_id) AS rk,
  count(*) OVER (PARTITION BY question_type) AS size, count(*) OVER () AS n FROM tasks),
q AS (SELECT question_type, max(size) AS size, least(max(size), CAST(round_even(max(size)*(5003/CAST(max(n) AS DOUBLE)), 0) AS BIGINT)) AS take FROM r GROUP BY 1),
b AS (SELECT question_type, take, coalesce(sum(size - take) OVER (ORDER BY question_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(take) OVER () AS taken FROM q)
SELECT task_id, r.question_type, CASE WHEN rk <= take OR before + rk - take <= 5003 - taken THEN 'calibration' ELSE 'test' END AS split
FROM r JOIN b USING (question_type)""",
)
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified calibration and test splits with a fixed-order top-up."""
    t = bind(spark, sf_dir, "tasks").select("task_id", "question_type")
    return D.split_tasks(t, 5003, 7)


@query(
    "stratified_subset",
    f"""{ctes('tasks')},
r AS (SELECT task_id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY {HASH_SQL.format(seed=fixed.SEED)}, task_id) AS rk,
  count(*) OVER (PARTITION BY question_type) AS size FROM tasks)
SELECT task_id, question_type FROM r WHERE rk <= greatest(1, round_even(size*0.25::DOUBLE, 0))""",
)
def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bind(spark, sf_dir, "tasks").select("task_id", "question_type")
    return D.stratified_subset(t, "question_type")


@query(
    "split_digest",
    f"""{ctes('tasks')}, r AS (SELECT split, CAST('0x' || substr(md5(CAST(task_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM tasks)
SELECT split, count(*) AS n, substr(sha256(concat_ws('|', count(*), sum(h), bit_xor(h))), 1, 16) AS digest FROM r GROUP BY split""",
)
def split_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_digest(bind(spark, sf_dir, "tasks"))


@query(
    "template_tail",
    """WITH items AS (SELECT o_custkey % 7 AS g, 't' || CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS VARCHAR) AS template_id FROM orders),
space AS (SELECT c_custkey % 7 AS g, 't' || CAST(c_custkey AS VARCHAR) AS template_id FROM customer),
c AS (SELECT g, template_id, count(*) AS c FROM items GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c, template_id) AS rk FROM c),
s AS (SELECT g, CAST(sum(c) AS BIGINT) AS items, count(*) AS templates, sum(CASE WHEN c <= 2 THEN c ELSE 0 END)/CAST(sum(c) AS DOUBLE) AS tail,
  CASE WHEN count(*) > 1 THEN 2.0*sum(rk*c)/(count(*)*sum(c)) - (count(*) + 1.0)/count(*) ELSE 0.0 END AS gini FROM r GROUP BY 1),
k AS (SELECT space.g, count(*) AS sp, count(c.template_id) AS pr FROM space LEFT JOIN c ON c.g = space.g AND c.template_id = space.template_id GROUP BY 1)
SELECT s.g, items, templates, round(tail, 6) AS tail_share, round(gini, 6) AS gini, sp AS template_space, pr AS templates_present,
  round(CAST(pr AS DOUBLE)/sp, 6) AS tail_coverage FROM s JOIN k ON k.g = s.g""",
)
def template_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and concentration of items over a template space, one template holding a third."""
    from costproof.bindings import table

    o = table(spark, sf_dir, "orders")
    items = o.select(
        (F.col("o_custkey") % 7).alias("g"),
        F.concat(
            F.lit("t"),
            F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).cast("string"),
        ).alias("template_id"),
    )
    space = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 7).alias("g"),
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("template_id"),
    )
    out = D.tail_shape(items, space, ["g"])
    return out.select(
        "g", "items", "templates", r6("tail_share").alias("tail_share"), r6("gini").alias("gini"),
        "template_space", "templates_present", r6("tail_coverage").alias("tail_coverage"),
    )


@query(
    "missing_templates",
    """SELECT c_custkey AS template_id FROM customer EXCEPT SELECT s_suppkey FROM supplier""",
)
def missing_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costproof.bindings import table

    used = table(spark, sf_dir, "supplier")
    return D.missing_templates(
        used.select(F.col("s_suppkey").alias("template_id")),
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("template_id")),
    )


@query(
    "provenance_assessment",
    """WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 2 = 0 AND source <> 'code') AS real_items,
  count(*) FILTER (doc_id % 2 = 1) AS model_items, count(DISTINCT lang) AS generators FROM documents GROUP BY 1)
SELECT source, n, round(CAST(model_items AS DOUBLE)/n, 6) AS model_share, round(CAST(real_items AS DOUBLE)/n, 6) AS real_share,
  (CASE WHEN real_items + model_items <> n THEN 1 ELSE 0 END) + (CASE WHEN CAST(model_items AS DOUBLE)/n > 0.5 THEN 1 ELSE 0 END)
    + (CASE WHEN real_items < 1 THEN 1 ELSE 0 END) AS refusals FROM s""",
)
def provenance_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's set may back a certificate."""
    from costproof.bindings import table

    d = table(spark, sf_dir, "documents")
    sets = d.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count(F.when((F.col("doc_id") % 2 == 0) & (F.col("source") != "code"), 1)).alias("real_items"),
        F.count(F.when(F.col("doc_id") % 2 == 1, 1)).alias("model_items"),
        F.lit(0).alias("program_items"),
        F.count_distinct("lang").alias("generators"),
        F.lit(True).alias("relabelled"),
        F.lit("wide").alias("decoding_budget"),
        F.lit(False).alias("accumulating"),
        F.lit(0).alias("template_space"),
        F.lit(None).cast("double").alias("tail_coverage"),
        F.lit(0.0).alias("tail_share"),
    )
    out = D.assess_provenance(sets)
    return out.select(
        "source", "n", r6("model_share").alias("model_share"), r6("real_share").alias("real_share"),
        F.size("refusals").alias("refusals"),
    )


@query(
    "importance_weights",
    """WITH p AS (SELECT doc_id, lang, greatest(0.05, 1 - CAST(n_chars % 101 AS DOUBLE)/100) AS raw FROM documents)
SELECT doc_id, round(raw/sum(raw) OVER (PARTITION BY lang)*1000, 6) AS weight_per_mille FROM p""",
)
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling weights towards likely human-written items, summing to 1 in each language."""
    from costproof.bindings import table

    d = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", (F.col("n_chars") % 101 / F.lit(100.0)).alias("probability")
    )
    out = D.importance_weights(d, "probability", ["lang"])
    return out.select("doc_id", r6(F.col("weight") * 1000).alias("weight_per_mille"))


@query(
    "canary_observation",
    f"""{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY {HASH_SQL.format(seed=fixed.SEED)}, task_id) AS rk,
  count(*) OVER (PARTITION BY question_type) AS size FROM pairs WHERE pipeline = 'mid')
SELECT count(*) AS n, round(avg(c_correct - b_correct), 6) AS delta, round(stddev_samp(c_correct - b_correct)/sqrt(count(*)), 6) AS standard_error
FROM r WHERE rk <= greatest(1, round_even(size*0.25::DOUBLE, 0))""",
)
def canary_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta of a stratified quarter of the paired outcomes."""
    pairs = A.pair(arms(spark, sf_dir), "frontier", ["question_type"])
    out = CE.canary_observation(pairs.where(F.col("pipeline") == "mid"))
    return out.select("n", r6("delta").alias("delta"), r6("standard_error").alias("standard_error"))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate per question type and cheaper pipeline, from the paired counts."""
    pairs = A.pair(arms(spark, sf_dir), "frontier", ["question_type"])
    d = (F.col("c_correct") - F.col("b_correct")).cast("double")
    se = F.stddev_samp(d) / F.sqrt(F.count("*"))
    proofs = pairs.groupBy(F.col("question_type").alias("workload"), "pipeline").agg(
        F.avg(d).alias("delta"), (F.avg(d) - Z * se).alias("delta_low"),
        (F.avg(d) + Z * se).alias("delta_high"), F.count("*").alias("n"),
    )
    proofs = proofs.withColumn("verdict", F.lit("recorded")).withColumn(
        "snapshots", F.create_map(F.lit("frontier"), F.lit("r1"), F.col("pipeline"), F.lit("r1"))
    )
    return CE.issue(proofs, F.lit("2026-01-01").cast("date"))


def certificate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates, those of the cheap pipeline with late spending."""
    late = F.when(F.col("pipeline") == "cheap", "obrien-fleming").otherwise("pocock")
    return certificates(spark, sf_dir).withColumn("spending", late)


def _level_rows(looks: int = 4, alpha: float = fixed.ALPHA) -> str:
    """Level and critical value of every look under both spendings, computed on their own."""
    from statistics import NormalDist

    phi = NormalDist()
    spent = {
        "mid": lambda f: alpha * f,
        "cheap": lambda f: 2 * (1 - phi.cdf(phi.inv_cdf(1 - alpha / 2) / f**0.5)) if f else 0.0,
    }
    rows = []
    for pipeline, cumulative in spent.items():
        for i in range(1, looks + 1):
            level = 1 - (1 - cumulative(i / looks)) / (1 - cumulative((i - 1) / looks))
            rows.append(f"('{pipeline}', {i}, {level!r}::DOUBLE, {phi.inv_cdf(1 - level / 2)!r}::DOUBLE)")
    return ", ".join(rows)


@query(
    "certificate_looks",
    f"""{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL},
c AS (SELECT question_type AS workload, pipeline, avg(c_correct - b_correct) AS delta, stddev_samp(c_correct - b_correct)/sqrt(count(*)) AS se FROM pairs GROUP BY 1, 2),
o AS (SELECT question_type AS workload, pipeline, task_id//4 % 4 AS batch, count(*) AS n,
  avg(c_correct - b_correct) - CASE WHEN pipeline = 'cheap' THEN 0.06*(task_id//4 % 4) ELSE 0 END AS delta, stddev_samp(c_correct - b_correct)/sqrt(count(*)) AS se
  FROM pairs GROUP BY 1, 2, 3),
l(pipeline, look, level, critical) AS (VALUES {_level_rows()}),
z AS (SELECT c.workload, c.pipeline, CAST(o.batch + 1 AS INTEGER) AS look, o.n, (o.delta - c.delta)/sqrt(c.se*c.se + o.se*o.se) AS z
  FROM c JOIN o USING (workload, pipeline)),
s AS (SELECT pipeline, question_type, count(*) FILTER (WHERE task_id//4 % 4 = 1) AS fresh, count(*) AS whole FROM pairs GROUP BY 1, 2),
a AS (SELECT z.*, level, critical, look = 4 AS gone, pipeline = 'mid' AND look = 3 AS renamed, abs(z.z) > critical AS moved,
  look = 2 AND fresh*4 > whole AS shifted
  FROM z JOIN l USING (pipeline, look) JOIN s ON s.pipeline = z.pipeline AND s.question_type = z.workload)
SELECT workload, pipeline, look, round(level, 6) AS alpha_this_look, round(z, 6) AS z, round(critical, 6) AS critical,
  concat_ws(', ', CASE WHEN gone THEN 'expired' END, CASE WHEN renamed THEN 'identity changed' END,
    CASE WHEN moved THEN 'outcome moved' END, CASE WHEN shifted THEN 'distribution moved' END) AS reasons,
  gone OR renamed OR moved OR shifted AS raised FROM a""",
)
def certificate_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four looks at every certificate under either spending, from outcomes that arrive in four batches.

    The last look comes after the expiry; in the third a model was renamed; the second sees whether its
    share of the tasks is above a quarter; the cheap pipeline loses six points more with every batch.
    """
    c = cut(certificate_rows(spark, sf_dir))  # a few rows each, read by every look
    ids = c.select("certificate_id", "workload", "pipeline")
    pairs = A.pair(arms(spark, sf_dir), "frontier", ["question_type"])
    pairs = pairs.join(ids.withColumnRenamed("workload", "question_type"), ["question_type", "pipeline"])
    batch = (F.floor(F.col("task_id") / 4) % 4).cast("bigint")
    observed = CE.paired_delta(pairs.withColumn("batch", batch), ["certificate_id", "pipeline", "batch"])
    lost = F.when(F.col("pipeline") == "cheap", F.lit(0.06) * F.col("batch")).otherwise(0.0)
    observed = cut(observed.withColumn("delta", F.col("delta") - lost).withColumn(
        "taken_on", F.expr("date_add(date'2026-01-08', CAST(batch * 8 AS INT))")
    ))
    renamed = c.where(F.col("pipeline") == "mid").select("certificate_id", F.explode("snapshots").alias("role", "snapshot"))
    now = renamed.withColumn("snapshot", F.when(F.col("role") == "mid", "r2").otherwise(F.col("snapshot")))
    changes = CE.identity_changes(renamed, now).withColumn("batch", F.lit(2).cast("bigint"))
    fresh = F.count(F.when(batch == 1, 1))
    drift = pairs.groupBy("certificate_id").agg((fresh * 4 > F.count("*")).alias("drifted")).withColumn("batch", F.lit(1).cast("bigint"))
    # Looks one and two are on file when the batches of three and four come.
    first = cut(CE.take_looks(c, observed.limit(0), observed.where("batch < 2"), changes, drift))
    later = CE.take_looks(c, first, observed.where("batch >= 2"), changes, drift)
    return first.unionByName(later).join(ids, "certificate_id").select(
        "workload", "pipeline", F.col("look").cast("int").alias("look"),
        r6("alpha_this_look").alias("alpha_this_look"), r6("z").alias("z"), r6("critical").alias("critical"),
        F.array_join("reasons", ", ").alias("reasons"), "raised",
    )


@query(
    "evidence_grade",
    f"""{ctes('matrix')}, {ARMS_SQL}, {PAIRS_SQL},
c AS (SELECT pipeline, count(*) AS n, avg(c_correct - b_correct) AS delta, stddev_samp(c_correct - b_correct)/sqrt(count(*)) AS se FROM pairs GROUP BY 1)
SELECT pipeline, CASE WHEN delta - {Z}*se > -0.03 THEN 'simulated' ELSE 'insufficient' END AS grade FROM c""",
)
def evidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst standing any link of a result's evidence forces."""
    pairs = A.pair(arms(spark, sf_dir), "frontier")
    d = CE.paired_delta(pairs, ["pipeline"])
    low = F.col("delta") - Z * F.col("standard_error")
    verdict = F.when(low > -0.03, "non_inferior").otherwise("inconclusive")
    yes = F.lit(True)
    links = CE.evidence_links(verdict, yes, F.lit(0), F.col("n"), yes, yes, yes, F.lit(False))
    return CE.evidence_grade(d, links).select("pipeline", "grade")
