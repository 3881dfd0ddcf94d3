"""Usage, pricing, spend, run findings, answers, graphs and sources over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof import fixed
from costproof.bindings import bind, ctes, table
from costproof.functions import grading, pricing, usage
from costproof.operators import findings as FI
from costproof.operators import graphs as G
from costproof.operators import spend as S
from costproof.plans.registry import query, r6
from costproof.runtime import spread
from costproof.sources import recorded as R
from costproof.sources import tasks as TK

COST_SQL = (
    "c.input_uncached*p.input + c.cache_write_5m*p.cache_write_5m + c.cache_write_1h*p.cache_write_1h "
    "+ c.cache_read*p.cache_read + (c.output_visible + c.output_reasoning)*p.output"
)
PRICED_SQL = f"{ctes('calls', 'prices')}, priced AS (SELECT c.*, p.provider, p.scarce, {COST_SQL} AS cost FROM calls c JOIN prices p USING (model))"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.price_calls(
        bind(spark, sf_dir, "calls"), bind(spark, sf_dir, "prices"), unit="nano",
        keep=["provider", "scarce"],
    )


@query(
    "spend_rollup",
    f"""{PRICED_SQL},
d AS (SELECT 'model' AS dimension, model AS member, cost, scarce FROM priced UNION ALL SELECT 'provider', provider, cost, scarce FROM priced
  UNION ALL SELECT 'day', CAST(day AS VARCHAR), cost, scarce FROM priced UNION ALL SELECT 'total', 'all', cost, scarce FROM priced)
SELECT dimension, member, count(*) AS calls, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(CASE WHEN scarce THEN cost ELSE 0 END) AS BIGINT) AS scarce_cost,
  round(CAST(sum(cost) AS DOUBLE)/(SELECT sum(cost) FROM priced), 6) AS share FROM d GROUP BY 1, 2""",
)
def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by model, provider, day and in total, from one scan."""
    out = S.spend_rollup(priced(spark, sf_dir), ["model", "provider", "day"])
    return out.withColumn("share", r6("share"))


@query(
    "run_ledger",
    f"""{PRICED_SQL}, q AS (SELECT *, (attempt - 1) % 3 AS sample_index FROM priced)
SELECT model, count(*) FILTER (NOT prewarm) AS calls, count(*) FILTER (prewarm) AS prewarm_calls,
  CAST(sum(cost) AS BIGINT) AS recorded_cost, CAST(sum(CASE WHEN sample_index = 0 THEN cost ELSE 0 END) AS BIGINT) AS cost,
  CAST(sum(CASE WHEN prewarm THEN cost ELSE 0 END) AS BIGINT) AS prewarm_cost, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write_5m + cache_write_1h) AS BIGINT) AS cache_write,
  CAST(sum(input_uncached + cache_write_5m + cache_write_1h + cache_read) AS BIGINT) AS input_tokens,
  CAST(sum(output_visible + output_reasoning) AS BIGINT) AS output_tokens,
  round(quantile_cont(CASE WHEN NOT prewarm AND latency_ms > 0 THEN latency_ms END, 0.5), 6) AS p50_latency_all,
  round(quantile_cont(CASE WHEN NOT prewarm AND latency_ms > 0 AND NOT reused THEN latency_ms END, 0.5), 6) AS p50_latency
FROM q GROUP BY 1""",
)
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced(spark, sf_dir).withColumn("sample_index", (F.col("attempt") - 1) % 3)
    out = S.run_ledger(rows, ["model"])
    return out.withColumns({c: r6(c) for c in ("p50_latency", "p50_latency_all")})


@query(
    "daily_budget",
    f"""{PRICED_SQL}, d AS (SELECT day, CAST(sum(cost) AS BIGINT) AS spent FROM priced GROUP BY 1)
SELECT day, spent, CAST(spent AS DOUBLE)/CAST(500000000 AS DOUBLE) AS fraction, CASE WHEN CAST(spent AS DOUBLE)/500000000 >= 1 THEN 'stopped' WHEN CAST(spent AS DOUBLE)/500000000 >= 0.8 THEN 'warning' ELSE 'ok' END AS state,
  greatest(0, 500000000 - spent) AS remaining FROM d""",
)
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.lit(500000000).cast("bigint")
    return S.daily_budget(priced(spark, sf_dir), cap)


LISTS_SQL = """(SELECT * FROM (VALUES ('frontier', DATE '1990-01-01', 5000), ('frontier', DATE '1997-06-01', 4000), ('frontier', DATE '2000-01-01', 3000),
  ('mid', DATE '1990-01-01', 2000), ('mid', DATE '1999-01-01', 1500), ('cheap', DATE '1996-01-01', 1000)) AS t(model, taken, input))"""


@query(
    "prices_as_of",
    f"""{ctes('calls')}, l AS {LISTS_SQL},
j AS (SELECT c.task_id, c.model, c.day, c.input_uncached, (SELECT max(taken) FROM l WHERE l.model = c.model AND l.taken <= c.day) AS taken FROM calls c)
SELECT j.model, j.taken AS price_taken, count(*) AS calls, CAST(sum(input_uncached*l.input) AS BIGINT) AS cost FROM j LEFT JOIN l ON l.model = j.model AND l.taken = j.taken GROUP BY 1, 2""",
)
def prices_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call priced from the list valid on its day."""
    lists = spark.sql("SELECT * FROM " + LISTS_SQL)
    for c in ("output", "cache_write_5m", "cache_write_1h", "cache_read"):
        lists = lists.withColumn(c, F.lit(0))
    out = S.prices_as_of(bind(spark, sf_dir, "calls"), lists)
    return out.groupBy("model", "price_taken").agg(
        F.count("*").alias("calls"),
        F.sum(F.col("input_uncached") * F.col("_p_input")).alias("cost"),
    )


@query(
    "token_ratio_fit",
    f"""{ctes('calls')}, b AS (SELECT model, input_uncached AS base, input_uncached + cache_read//7 AS prov FROM calls)
SELECT model, round(CAST(sum(base*prov) FILTER (base > 0 AND prov > 0) AS DOUBLE)/CAST(sum(base*base) FILTER (base > 0 AND prov > 0) AS DOUBLE), 6) AS ratio,
  count(*) FILTER (base > 0 AND prov > 0) AS fitted_on FROM b GROUP BY 1""",
)
def token_ratio_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bind(spark, sf_dir, "calls").select(
        "model", F.col("input_uncached").alias("base_tokens"),
        (F.col("input_uncached") + F.floor(F.col("cache_read") / 7)).alias("provider_tokens"),
    )
    return S.fit_ratios(c).select("model", r6("ratio").alias("ratio"), "fitted_on")


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider payloads in four shapes rebuilt from the calls, some of them inconsistent."""
    c = spread(bind(spark, sf_dir, "calls"))
    n = lambda name: F.col(name).cast("string")
    one = F.concat(
        F.lit('{"input_tokens": '), n("input_uncached"), F.lit(', "cache_read_input_tokens": '), n("cache_read"),
        F.lit(', "cache_creation_input_tokens": '), n("cache_write_5m"), F.lit(', "output_tokens": '), n("output_visible"), F.lit("}"),
    )
    bad = F.when(F.col("task_id") % 10 == 0, F.col("input_uncached") - 1).otherwise(
        F.col("input_uncached") + F.col("cache_read")
    )
    two = F.concat(
        F.lit('{"prompt_tokens": '), (F.col("input_uncached") + F.col("cache_read")).cast("string"),
        F.lit(', "prompt_tokens_details": {"cached_tokens": '), n("cache_read"),
        F.lit('}, "completion_tokens": '), n("output_visible"), F.lit(', "cost": "0.25"}'),
    )
    three = F.concat(
        F.lit('{"prompt_cache_hit_tokens": '), n("cache_read"), F.lit(', "prompt_cache_miss_tokens": '), n("input_uncached"),
        F.lit(', "prompt_tokens": '), bad.cast("string"), F.lit(', "completion_tokens": '), n("output_visible"), F.lit("}"),
    )
    shape = F.col("attempt") % 4
    return c.select(
        "task_id", "attempt",
        F.when(shape == 0, "anthropic").when(shape == 1, "openai").when(shape == 2, "openrouter").otherwise("deepseek").alias("mapping"),
        F.when(shape == 0, one).when(shape == 3, three).otherwise(two).alias("raw"),
    )


@query(
    "usage_normalization",
    f"""{ctes('calls')},
u AS (SELECT CASE attempt % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'openrouter' ELSE 'deepseek' END AS mapping, *,
  attempt % 4 = 3 AND task_id % 10 = 0 AND input_uncached <> 1 AND input_uncached + cache_read <> input_uncached - 1 AS bad FROM calls)
SELECT mapping, count(*) AS calls, count(*) FILTER (bad) AS rejected,
  CAST(coalesce(sum(input_uncached) FILTER (NOT bad), 0) AS BIGINT) AS input_uncached, CAST(coalesce(sum(cache_read) FILTER (NOT bad), 0) AS BIGINT) AS cache_read,
  CAST(coalesce(sum(CASE WHEN mapping = 'anthropic' THEN cache_write_5m ELSE 0 END) FILTER (NOT bad), 0) AS BIGINT) AS cache_write_5m,
  CAST(coalesce(sum(output_visible) FILTER (NOT bad), 0) AS BIGINT) AS output_visible,
  count(*) FILTER (mapping = 'anthropic' AND cache_write_5m > 0) AS estimated
FROM u GROUP BY 1""",
)
def usage_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four payload shapes to one set of buckets, inconsistent payloads rejected."""
    u = usage.normalize_usage(raw_usage(spark, sf_dir))
    return u.groupBy("mapping").agg(
        F.count("*").alias("calls"),
        F.count("usage_error").alias("rejected"),
        *[F.coalesce(F.sum(b), F.lit(0)).alias(b) for b in ("input_uncached", "cache_read", "cache_write_5m", "output_visible")],
        F.count(F.when(F.col("usage_sources")["cache_write_5m"] == "estimated", 1)).alias("estimated"),
    )


@query(
    "run_findings",
    f"""{PRICED_SQL},
g AS (SELECT model, CAST(count(DISTINCT task_id) AS BIGINT) AS tasks, avg(output_visible) AS mo, CAST(sum(cost) AS BIGINT) AS total,
  count(*) FILTER (attempt > 1) AS retries, count(*) FILTER (failed) AS failures, CAST(sum(CASE WHEN attempt > 1 THEN cost ELSE 0 END) AS BIGINT) AS rc FROM priced WHERE NOT prewarm GROUP BY 1)
SELECT g.model, 'W03' AS rule, round(round_even(mo - 40, 0)*p.output*1000, 3) AS per_1k FROM g JOIN prices p USING (model) WHERE mo > 80
UNION ALL SELECT model, 'W05', round(total*0.5*1000.0/tasks, 3) FROM g
UNION ALL SELECT model, 'W06', round(rc*1000.0/tasks, 3) FROM g WHERE retries > 0 OR failures > 0""",
)
def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that the priced calls break; they read their caches, so only ``prefix_findings`` breaks the others."""
    return run_rules(spark, sf_dir).select("model", "rule", F.round("per_1k", 3).alias("per_1k"))


def run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over priced calls, by model."""
    calls = S.real_calls(priced(spark, sf_dir)).select(
        "*",
        F.lit("Rules.").alias("system_text"),
        F.col("task_id").cast("string").alias("user_text"),
        F.lit("").alias("static_prefix"),
        F.when(F.col("failed"), "failed").alias("error"),
        F.struct("task_id", "attempt").alias("order"),
    )
    runs = calls.groupBy("model").agg(
        F.count_distinct("task_id").alias("task_count"), F.sum("cost").alias("total_cost")
    )
    rates = bind(spark, sf_dir, "prices").select(
        "model", "input", "output", F.col("cache_read").alias("cache_read_rate"),
        F.col("cache_write_5m").alias("cache_write_5m_rate"), F.lit(0.5).alias("batch_discount"),
        F.lit(40).alias("needed_output_tokens"), F.lit(False).alias("latency_sensitive"),
    )
    return FI.workload_findings(calls, runs.join(F.broadcast(rates), "model"), ["model"])


RULES = "Shared rules. " * 40


@query(
    "prefix_findings",
    f"""WITH d AS (SELECT doc_id, source, n_chars, coalesce(text, '') AS text, CAST(substr(source, 4) AS INTEGER) % 4 AS kind FROM documents),
c AS (SELECT source, kind, doc_id, doc_id % 50 = 7 AS again, doc_id % 90 = 4 AS failed, n_chars % 3000 AS fresh,
  CASE WHEN kind < 2 THEN 500 ELSE 0 END AS written,
  CASE kind WHEN 2 THEN '{RULES}' ELSE text END AS system_text,
  CASE kind WHEN 2 THEN text WHEN 3 THEN '{RULES}' ELSE CAST(doc_id AS VARCHAR) || '?' END AS user_text,
  CASE kind WHEN 0 THEN text WHEN 1 THEN '{RULES}' ELSE '' END AS prefix FROM d),
t AS (SELECT *, system_text || chr(10) || user_text AS whole FROM c),
e AS (SELECT source, min(whole) AS a, max(whole) AS b FROM t GROUP BY 1),
l AS (SELECT source, coalesce((SELECT min(i) FROM (SELECT unnest(range(1, least(length(a), length(b)) + 1)) AS i) q WHERE substr(a, i, 1) <> substr(b, i, 1)) - 1, least(length(a), length(b))) AS lcp FROM e),
g AS (SELECT source, kind, count(*) AS n, CAST(sum(written) AS BIGINT) AS writes, floor(avg(fresh + written)) AS mi,
  avg(length(system_text) + length(user_text) + 1) AS chars, count(DISTINCT CASE WHEN prefix <> '' THEN prefix END) AS prefixes,
  CAST(sum(fresh) AS BIGINT) AS cost, CAST(sum(CASE WHEN again THEN fresh ELSE 0 END) AS BIGINT) AS rc, count(*) FILTER (again) AS retries,
  count(*) FILTER (failed) AS failures, arg_min(prefix, doc_id) <> '' AS has FROM t GROUP BY 1, 2),
s AS (SELECT *, greatest(0, mi - floor(mi*lcp/chars)) AS stranded, floor(mi*lcp/chars) AS shared FROM g JOIN l USING (source)),
w AS (SELECT *, has AND prefixes > greatest(1, n//10) AS moving, has AND prefixes = 1 AND writes > 0 AS unread,
  stranded > shared AND stranded > 500 AS early FROM s)
SELECT source AS pipeline, 'W01' AS rule, round(mi*4500*1000, 3) AS per_1k, 'repeated' AS branch FROM w WHERE kind >= 2
UNION ALL SELECT source, 'W02', round(CASE WHEN moving OR unread THEN writes*6250.0*(1000.0/n) ELSE stranded*4500*1000 END, 3),
  CASE WHEN moving THEN 'moving' WHEN unread THEN 'unread' ELSE 'early' END FROM w WHERE moving OR unread OR early
UNION ALL SELECT source, 'W03', round(20*25000.0*1000, 3), 'long' FROM w
UNION ALL SELECT source, 'W05', round(cost*0.5*(1000.0/n), 3), 'batch' FROM w
UNION ALL SELECT source, 'W06', round(rc*(1000.0/n), 3), 'retry' FROM w WHERE retries > 0 OR failures > 0""",
)
def prefix_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run rule over the documents' sources: prefixes that move, are never read, or come too late,
    and rules repeated in every call in front of or behind the document."""
    d = bind(spark, sf_dir, "prompts").withColumn("text", F.coalesce("text", F.lit("")))
    kind, rules = F.substr(F.col("pipeline"), F.lit(4)).cast("int") % 4, F.lit(RULES)
    asked = F.concat(F.col("request_id").cast("string"), F.lit("?"))
    calls = d.select(
        "pipeline", F.col("request_id").alias("task_id"),
        F.when(F.col("request_id") % 50 == 7, 2).otherwise(1).alias("attempt"),
        F.when(F.col("request_id") % 90 == 4, "failed").alias("error"),
        F.when(kind == 2, rules).otherwise(F.col("text")).alias("system_text"),
        F.when(kind == 2, F.col("text")).when(kind == 3, rules).otherwise(asked).alias("user_text"),
        F.when(kind == 0, F.col("text")).when(kind == 1, rules).otherwise("").alias("static_prefix"),
        (F.col("n_chars") % 3000).alias("input_uncached"),
        F.when(kind < 2, 500).otherwise(0).alias("cache_write_5m"),
        F.lit(0).alias("cache_write_1h"), F.lit(0).alias("cache_read"),
        F.lit(30).alias("output_visible"), F.lit(0).alias("output_reasoning"),
        (F.col("n_chars") % 3000).alias("cost"), F.col("request_id").alias("order"),
    )
    runs = calls.groupBy("pipeline").agg(
        F.count("*").alias("task_count"), F.sum("cost").alias("total_cost")
    ).select(
        "*", *[F.lit(v).alias(k) for k, v in (("input", 5000), ("output", 25000), ("cache_read_rate", 500), ("cache_write_5m_rate", 6250), ("batch_discount", 0.5), ("needed_output_tokens", 10))],
        F.lit(False).alias("latency_sensitive"),
    )
    said = {"changes": "moving", "never read": "unread", "diverge": "early", "shared": "repeated", "mean output": "long", "no latency": "batch"}
    branch = F.lit("retry")
    for words, name in said.items():
        branch = F.when(F.col("evidence").contains(words), name).otherwise(branch)
    return FI.workload_findings(calls, runs, ["pipeline"]).select(
        "pipeline", "rule", F.round("per_1k", 3).alias("per_1k"), branch.alias("branch")
    )


@query(
    "top_findings",
    f"""{PRICED_SQL},
g AS (SELECT model, CAST(count(DISTINCT task_id) AS BIGINT) AS tasks, avg(output_visible) AS mo, CAST(sum(cost) AS BIGINT) AS total,
  count(*) FILTER (attempt > 1) AS retries, count(*) FILTER (failed) AS failures, CAST(sum(CASE WHEN attempt > 1 THEN cost ELSE 0 END) AS BIGINT) AS rc FROM priced WHERE NOT prewarm GROUP BY 1),
f AS (SELECT g.model, 'W03' AS rule, round_even(mo - 40, 0)*p.output*1000 AS per_1k, 1.0 AS w FROM g JOIN prices p USING (model) WHERE mo > 80
UNION ALL SELECT model, 'W05', total*0.5*1000.0/tasks, 0.7 FROM g
UNION ALL SELECT model, 'W06', rc*1000.0/tasks, 1.0 FROM g WHERE retries > 0 OR failures > 0)
SELECT model, rule, round(per_1k*w, 3) AS weighted FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY per_1k*w DESC, rule) <= 2""",
)
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two findings of each run that weigh most."""
    out = FI.rank(run_rules(spark, sf_dir), ["model"], top=2)
    return out.select("model", "rule", F.round("weighted", 3).alias("weighted"))


@query(
    "shared_run_text",
    """WITH e AS (SELECT doc_id % 9 AS g, 'Rules for group ' || CAST(doc_id % 9 AS VARCHAR) || ': ' || text AS t FROM documents),
m AS (SELECT g, min(t) AS a, max(t) AS b, min(reverse(t)) AS ra, max(reverse(t)) AS rb FROM e GROUP BY 1)
SELECT g, (SELECT max(i) FROM (SELECT unnest(range(0, least(length(a), length(b)) + 1)) AS i) q WHERE left(a, i) = left(b, i)) AS prefix_chars,
  (SELECT max(i) FROM (SELECT unnest(range(0, least(length(ra), length(rb)) + 1)) AS i) q WHERE left(ra, i) = left(rb, i)) AS suffix_chars FROM m""",
)
def shared_run_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest prefix and suffix every text of a group shares."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 9).alias("g"), F.col("doc_id").alias("order"), "text")
    t = F.concat(F.lit("Rules for group "), F.col("g").cast("string"), F.lit(": "), F.col("text"))
    out = FI.shared_text(d.withColumn("text", t), ["g"], "text")
    return out.select("g", *[F.col(c).cast("bigint").alias(c) for c in ("prefix_chars", "suffix_chars")])


@query(
    "answer_grading",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS f, o_orderkey % 4 = 1 AS wrong, o_orderkey % 100 AS g FROM orders)
SELECT f AS shape, count(*) AS n, CAST(sum(CASE WHEN f = 5 THEN 0 WHEN f = 4 THEN CASE WHEN wrong THEN 0 ELSE 1 END WHEN wrong THEN 0 ELSE 1 END) AS BIGINT) AS correct FROM o GROUP BY 1""",
)
def answer_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in six shapes graded against their gold values; an unreadable one is wrong."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    wrong, shape = F.col("o_orderkey") % 4 == 1, F.col("o_orderkey") % 6
    gold = F.col("o_orderkey") % 100
    said = F.when(wrong, gold + 1).otherwise(gold).cast("string")
    output = (
        F.when(shape == 0, F.concat(F.lit('{"answer": '), said, F.lit(', "evidence": "x"}')))
        .when(shape == 1, F.concat(F.lit("Let me see.\nFinal answer: $"), said, F.lit(".00.")))
        .when(shape == 2, F.concat(F.lit("```json\n{\"answer\": \""), said, F.lit("\"}\n```")))
        .when(shape == 3, F.when(wrong, "No, it is refused").otherwise("Yes."))
        .when(shape == 4, F.concat(F.lit("the Café number "), said, F.lit(" it is")))
        .otherwise(F.concat(F.lit('{"result": '), said, F.lit("}")))
    )
    kind = F.when(shape == 3, "yes_no").when(shape == 4, "string").otherwise("number")
    want = F.when(shape == 3, F.lit("yes")).when(
        shape == 4, F.concat(F.lit("CAFE number "), gold.cast("string"))
    ).otherwise(gold.cast("string"))
    graded = o.select(
        shape.alias("shape"), output.alias("output"), want.alias("gold"), kind.alias("kind")
    ).select("shape", grading.grade(F.col("output"), F.col("gold"), F.col("kind")).alias("g"))
    return graded.groupBy("shape").agg(
        F.count("*").alias("n"), F.sum("g.correct").alias("correct")
    )


@query(
    "verdict_parsing",
    """WITH d AS (SELECT doc_id AS k, doc_id % 4 AS f, n_chars % 2 AS v, n_chars % 100 AS c FROM documents)
SELECT f AS shape, count(*) AS n, CAST(sum(CASE WHEN f IN (0, 1) THEN v WHEN f = 2 THEN v ELSE 0 END) AS BIGINT) AS correct,
  count(*) FILTER (f <> 3) AS parsed, round(sum(CASE WHEN f = 0 THEN c/100.0::DOUBLE ELSE 0.5 END), 6) AS confidence FROM d GROUP BY 1""",
)
def verdict_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies as JSON, JSON without confidence, a verdict line, and prose."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "n_chars"))
    v, c = F.col("n_chars") % 2, F.col("n_chars") % 100
    f = F.col("doc_id") % 4
    word = F.when(v == 1, "true").otherwise("false")
    reply = (
        F.when(f == 0, F.concat(F.lit('{"correct": '), word, F.lit(', "confidence": '), (c / 100).cast("string"), F.lit(', "why": "x"}')))
        .when(f == 1, F.concat(F.lit('{"correct": "'), F.when(v == 1, "Yes").otherwise("No"), F.lit('", "confidence": 7}')))
        .when(f == 2, F.concat(F.lit("I think.\nVerdict: "), F.when(v == 1, "PASS").otherwise("fail")))
        .otherwise(F.lit("hard to say"))
    )
    p = d.select(f.alias("shape"), grading.parse_verdict(reply).alias("p"))
    return p.groupBy("shape").agg(
        F.count("*").alias("n"), F.sum("p.correct").cast("bigint").alias("correct"),
        F.count(F.when(F.col("p.parsed"), 1)).alias("parsed"), r6(F.sum("p.confidence")).alias("confidence"),
    )


# ---------------------------------------------------------------------------- graphs


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Step graphs and traces from order lines: one graph per return flag, one step per line number."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("pipeline"), F.col("l_orderkey").alias("task_id"),
        F.col("l_linenumber").cast("int").alias("position"), "l_partkey",
    ).dropDuplicates(["pipeline", "task_id", "position"])
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    steps = li.groupBy("pipeline", "position").agg(F.count("*").alias("_n")).select(
        "pipeline", name(F.col("position")).alias("step_id"), "position",
        F.when(F.col("position") == 3, "verify").when(F.col("position") == 4, "retry").when(F.col("position") == 1, "tool").otherwise("generate").alias("kind"),
        F.when(F.col("position").isin(1, 6), "lookup").alias("tool"), (~F.col("position").isin(1, 6)).alias("called"),
    )
    edges = steps.select("pipeline", F.col("step_id").alias("src"), name(F.col("position") + 1).alias("dst")).where(
        ~F.col("src").isin("s3", "s7")
    )
    outputs = steps.select("pipeline").distinct().withColumn("output_step", F.lit("s7"))
    body = F.concat(F.lit("answer "), (F.col("task_id") % 5).cast("string"))
    traces = li.select(
        "pipeline", "task_id", name(F.col("position")).alias("step_id"),
        F.when(F.col("position").isin(1, 6), F.concat(F.lit("order "), F.col("task_id").cast("string"))).alias("arguments"),
        body.alias("output"),
        F.when(~F.col("position").isin(1, 6), F.concat(F.lit("Given "), body, F.lit(" say more"))).alias("request_text"),
    )
    return steps, edges, outputs, traces


@query(
    "graph_reachability",
    """WITH RECURSIVE p AS (SELECT DISTINCT l_returnflag AS pipeline, l_linenumber AS n FROM lineitem),
e AS (SELECT pipeline, n AS src, n + 1 AS dst FROM p WHERE n NOT IN (3, 7)),
r AS (SELECT pipeline, src, dst FROM e UNION SELECT r.pipeline, r.src, e.dst FROM r JOIN e ON e.pipeline = r.pipeline AND e.src = r.dst)
SELECT pipeline, 's' || CAST(n AS VARCHAR) AS step_id, n = 7 OR EXISTS (SELECT 1 FROM r WHERE r.pipeline = p.pipeline AND r.src = p.n AND r.dst = 7) AS reaches FROM p""",
)
def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each step's output can reach the step its graph answers with."""
    steps, edges, outputs, _ = graph_tables(spark, sf_dir)
    return G.reaches_output(steps, edges, outputs).select("pipeline", "step_id", "reaches")


# Steps of the dense graphs: id, kind and tool.
DENSE = (
    ("s1", "tool", "lookup"), ("s2", "generate", ""), ("s3", "verify", ""), ("s4", "retry", ""), ("s5", "verify", ""),
    ("s6", "tool", "lookup"), ("s7", "generate", ""),
)
DENSE_EDGES = (("s1", "s2"), ("s1", "s4"), ("s2", "s3"), ("s2", "s4"), ("s4", "s5"), ("s4", "s6"), ("s6", "s7"), ("s2", "s7"))
NOTE = "kept for the whole of the graph " * 7


def dense_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One graph of seven steps per order priority, every order traced through all of it.

    The first step's long note is sent to three steps; both look-ups ask the same; the retry returns the
    draft except on every nineteenth order; one verifier leads nowhere; the last step carries what it reads.
    """
    o = spread(table(spark, sf_dir, "orders")).select(F.col("o_orderpriority").alias("pipeline"), F.col("o_orderkey").alias("task_id"))
    names = o.select("pipeline").distinct()
    named = lambda **parts: F.struct(*[F.lit(v).alias(c) for c, v in parts.items()])
    steps = names.select("pipeline", F.inline(F.array(*[
        named(step_id=s, position=i + 1, kind=kind, tool=tool, called=kind != "tool") for i, (s, kind, tool) in enumerate(DENSE)
    ])))
    edges = names.select("pipeline", F.inline(F.array(*[named(src=a, dst=b) for a, b in DENSE_EDGES])))
    outputs = names.withColumn("output_step", F.lit("s7"))
    k = F.col("task_id").cast("string")
    note = F.concat(F.lit("Note "), k, F.lit(f": {NOTE}end"))
    draft = F.concat(F.lit("draft "), k)
    text = {"s1": note, "s2": draft, "s3": F.lit("fine"), "s4": F.when(F.col("task_id") % 19 == 0, F.concat(F.lit("new "), k)).otherwise(draft),
            "s5": F.lit("fine too"), "s6": F.concat(F.lit("fact "), k), "s7": F.concat(F.lit("done "), k)}
    asked = {"s2": note, "s3": draft, "s4": F.concat(note, F.lit(" again "), draft), "s5": F.lit("check"), "s7": F.concat(note, F.lit(" and "), F.concat(F.lit("fact "), k))}
    nothing = F.lit(None).cast("string")
    made = F.inline(F.array(*[
        F.struct(F.lit(s).alias("step_id"), (F.concat(F.lit("order "), k) if kind == "tool" else nothing).alias("arguments"),
                 text[s].alias("output"), (F.concat(F.lit("Given "), asked[s]) if s in asked else nothing).alias("request_text"))
        for s, kind, _ in DENSE
    ]))
    return steps, edges, outputs, o.select("pipeline", "task_id", made)


GRAPH_SQL = f"""WITH o AS (SELECT o_orderpriority AS p, o_orderkey AS task, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
l AS (SELECT *, length(k) AS n, 7 + length(k) + {len(NOTE) + 3} AS note, 6 + length(k) AS draft, 5 + length(k) AS fact FROM o),
g AS (SELECT p, count(*) AS tasks, sum(note + 6) AS c2, sum(draft + 6) AS c3, sum(note + 7 + draft + 6) AS c4, sum(11) AS c5, sum(note + 5 + fact + 6) AS c7,
  arg_min(note, task) AS first_note, arg_min(fact, task) AS first_fact, sum(CASE WHEN task % 19 = 0 THEN 0 ELSE 1 END) AS same FROM l GROUP BY p)"""


@query(
    "graph_waste",
    f"""{GRAPH_SQL}
SELECT p AS pipeline, 'G01' AS rule, 's1' AS step_id, round(CAST(first_note AS DOUBLE)*(3*5000.0 - 5000.0)*1000, 3) AS per_1k, 'measured' AS confidence FROM g WHERE first_note >= {fixed.SHARED_BLOCK_MIN_CHARS}
UNION ALL SELECT p, 'G02', 's6', 0.0, 'measured' FROM g
UNION ALL SELECT p, 'G03', 's3', round((c3*5000.0 + tasks*20*25000.0)*1000/tasks, 3), 'measured' FROM g
UNION ALL SELECT p, 'G03', 's5', round((c5*5000.0 + tasks*20*25000.0)*1000/tasks, 3), 'measured' FROM g
UNION ALL SELECT p, 'G04', 's4', round((c4*5000.0 + tasks*20*25000.0)*(CAST(same AS DOUBLE)/tasks)*1000/tasks, 3), 'measured' FROM g WHERE same >= {fixed.PREVALENCE}*tasks
UNION ALL SELECT p, 'G05', 's7', round(CAST(first_fact AS DOUBLE)*5000*1000, 3), 'projected' FROM g""",
)
def graph_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph rule over every step graph."""
    steps, edges, outputs, traces = dense_graphs(spark, sf_dir)
    calls = traces.where(F.col("request_text").isNotNull()).select(
        "pipeline", "step_id", "request_text", F.lit("frontier").alias("model"),
        F.length("request_text").cast("bigint").alias("input_uncached"),
        *[F.lit(0).cast("bigint").alias(b) for b in fixed.BILLED_BUCKETS if b not in ("input_uncached", "output_visible")],
        F.lit(20).cast("bigint").alias("output_visible"),
        *[F.lit(v).cast("bigint").alias(f"p_{k}") for k, v in (("input", 5000), ("output", 25000), ("cache_write_5m", 6250), ("cache_write_1h", 10000), ("cache_read", 500))],
    )
    out = G.graph_findings(steps, edges, outputs, traces, G.step_stats(calls))
    return out.select("pipeline", "rule", "step_id", F.round("per_1k", 3).alias("per_1k"), "confidence")


# --------------------------------------------------------------------------- sources


@query(
    "span_tasks",
    """SELECT event_type AS question_type, count(*) AS tasks, CAST(sum(length(props)) AS BIGINT) AS question_chars FROM events WHERE event_id % 7 <> 0 GROUP BY 1""",
)
def span_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with object or listed attributes to tasks; spans without a prompt are dropped."""
    e = table(spark, sf_dir, "events")
    kv = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    prompt = F.when(F.col("event_id") % 7 != 0, F.col("props"))
    listed = F.array_compact(
        F.array(
            F.when(prompt.isNotNull(), kv("gen_ai.input.messages", F.col("props"))),
            kv("gen_ai.operation.name", F.col("event_type")),
        )
    )
    as_list = F.to_json(F.struct(F.col("event_id").cast("string").alias("spanId"), listed.alias("attributes")))
    as_object = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("span_id"),
            F.struct(
                prompt.alias("gen_ai.prompt"), F.col("event_type").alias("gen_ai.operation.name")
            ).alias("attributes"),
        )
    )
    spans = e.select(
        F.col("event_id").alias("row_no"), F.lit(0).alias("at"),
        F.when(F.col("event_id") % 2 == 0, as_list).otherwise(as_object).alias("span"),
    )
    return TK.spans_to_tasks(spans).groupBy("question_type").agg(
        F.count("*").alias("tasks"), F.sum(F.length("question")).alias("question_chars")
    )


@query(
    "blob_store",
    """SELECT count(DISTINCT text) AS blobs, count(*) AS refs, CAST((SELECT sum(n) FROM (SELECT max(length(text)) AS n FROM documents WHERE length(text) > 512 GROUP BY text) q) AS BIGINT) AS stored_chars,
  CAST(sum(length(text)) AS BIGINT) AS referenced_chars FROM documents WHERE length(text) > 512""",
)
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over the threshold stored once per content, and put back."""
    from costproof.functions import blocks as B

    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.array(B.block(F.col("text")), B.block(F.col("lang"))).alias("blocks")
    )
    slim, blobs = R.dehydrate(d, "doc_id")
    back = R.rehydrate(slim, blobs, "doc_id")
    sizes = blobs.agg(F.count("*").alias("blobs"), F.sum(F.length("body")).alias("stored_chars"))
    refs = back.select(F.length(F.col("blocks")[0]["text"]).alias("n")).where("n > 512").agg(
        F.count("*").alias("refs"), F.sum("n").alias("referenced_chars")
    )
    return sizes.crossJoin(F.broadcast(refs))


@query(
    "first_seen_tasks",
    """WITH r AS (SELECT o_orderkey AS row_no, o_custkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT task_id, row_no FROM r WHERE rn = 1""",
)
def first_seen_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids dropped, the first row kept."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("row_no")
    )
    return TK.first_seen(o)[0]


@query(
    "store_digest",
    """WITH r AS (SELECT CAST('0x' || substr(md5(concat_ws('|', coalesce('=' || CAST(doc_id AS VARCHAR), '!'),
  coalesce('=' || text, '!'), coalesce('=' || lang, '!'), coalesce('=' || source, '!'),
  coalesce('=' || CAST(n_chars AS VARCHAR), '!'))), 1, 15) AS BIGINT) AS h FROM documents)
SELECT count(*) AS calls, bit_xor(h) AS digest_xor, CAST(sum(h) AS VARCHAR) AS digest_sum FROM r""",
)
def store_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return R.store_digest(table(spark, sf_dir, "documents"), columns)


@query(
    "cost_disagreements",
    f"""{PRICED_SQL}, g AS (SELECT task_id, attempt, cost, cost*(100 + (task_id % 7) - 3)//100 AS provider_cost FROM priced)
SELECT task_id, attempt, round((cost - provider_cost)/CAST(provider_cost AS DOUBLE), 6) AS gap FROM g WHERE provider_cost <> 0 AND abs((cost - provider_cost)/CAST(provider_cost AS DOUBLE)) > 0.02""",
)
def cost_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose gateway cost is over 2 % away from the priced one."""
    p = priced(spark, sf_dir).withColumn(
        "provider_cost", F.floor(F.col("cost") * (100 + F.col("task_id") % 7 - 3) / 100)
    )
    gap = pricing.cost_disagreement(F.col("cost"), F.col("provider_cost"))
    return p.select("task_id", "attempt", r6(gap).alias("gap")).where(F.col("gap").isNotNull())


@query(
    "model_cost_sheet",
    f"""{ctes('calls', 'prices', 'prompts')}, b AS (SELECT model, input_uncached AS base, input_uncached + cache_read//7 AS prov FROM calls),
f AS (SELECT model, CAST(sum(base*prov) FILTER (base > 0 AND prov > 0) AS DOUBLE)/CAST(sum(base*base) FILTER (base > 0 AND prov > 0) AS DOUBLE) AS ratio FROM b GROUP BY 1),
r AS (SELECT request_id, n_chars//4 AS base_tokens, n_chars//8 AS prefix_tokens, request_id % 10 = 0 AS has_tools FROM prompts),
m AS (SELECT r.request_id, p.model, CAST(round_even(r.base_tokens*f.ratio, 0) AS BIGINT) + CASE WHEN has_tools THEN 300 ELSE 0 END AS input_tokens,
  CAST(round_even(r.prefix_tokens*f.ratio, 0) AS BIGINT) AS prefix_tokens, p.input, p.output FROM r CROSS JOIN prices p JOIN f ON f.model = p.model)
SELECT request_id, model, input_tokens, prefix_tokens, prefix_tokens > 0 AND prefix_tokens >= 1024 AS clears_minimum, input_tokens*input + 512*output AS cost_per_call FROM m""",
)
def model_cost_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request priced at every model, in that model's own tokens."""
    c = bind(spark, sf_dir, "calls").select(
        "model", F.col("input_uncached").alias("base_tokens"),
        (F.col("input_uncached") + F.floor(F.col("cache_read") / 7)).alias("provider_tokens"),
    )
    requests = bind(spark, sf_dir, "prompts").select(
        "request_id", F.floor(F.col("n_chars") / 4).alias("base_tokens"),
        F.floor(F.col("n_chars") / 8).alias("prefix_tokens"), F.lit(512).alias("max_tokens"),
        (F.col("request_id") % 10 == 0).alias("has_tools"),
    )
    prices = bind(spark, sf_dir, "prices").withColumn("min_cacheable_tokens", F.lit(1024))
    return S.model_costs(requests, prices, S.fit_ratios(c), 300).drop("cost_per_1k")
