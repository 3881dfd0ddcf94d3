"""Bindings of the given tables to the trace schemas.

Each binding is one SQL statement that runs unchanged in Spark and in an ANSI engine, so an operator
can be checked on real files. Money is in whole nano-dollars, the arithmetic is integer, and braces
name the source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from costproof.runtime import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

TASKS = """
SELECT o_orderkey AS task_id, o_orderpriority AS question_type,
       CASE WHEN o_orderkey % 3 = 0 THEN 'calibration' ELSE 'test' END AS split,
       o_orderdate AS created_at
FROM {orders}
"""

CALLS = """
SELECT l_orderkey AS task_id, l_linenumber AS attempt,
       CASE l_suppkey % 3 WHEN 0 THEN 'frontier' WHEN 1 THEN 'mid' ELSE 'cheap' END AS model,
       CAST(floor(l_extendedprice) AS BIGINT) % 4000 AS input_uncached,
       CASE WHEN l_partkey % 5 = 0 THEN (l_partkey * 37) % 900 ELSE 0 END AS cache_write_5m,
       CAST(0 AS BIGINT) AS cache_write_1h,
       CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE (l_suppkey * 911) % 3000 END AS cache_read,
       CAST(floor(l_quantity) AS BIGINT) * 6 AS output_visible,
       CAST(0 AS BIGINT) AS output_reasoning,
       l_partkey % 97 = 0 AS prewarm,
       l_returnflag = 'R' AS failed,
       CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE (l_partkey * 13 + l_suppkey * 7) % 5000 END AS latency_ms,
       l_partkey % 11 = 0 AS reused,
       CAST(l_shipdate AS DATE) AS day
FROM {lineitem}
"""

PRICES = """
SELECT * FROM (VALUES
  ('frontier', 'north', 5000, 25000, 6250, 10000, 500, TRUE),
  ('mid',      'north', 2000, 10000, 2500,  4000, 200, FALSE),
  ('cheap',    'south', 1000,  5000, 1250,  2000, 100, FALSE))
AS p(model, provider, input, output, cache_write_5m, cache_write_1h, cache_read, scarce)
"""

MATRIX = """
SELECT task_id, question_type, split, tier_index, tier, scarce, correct, cost_nano,
       CAST(400 * correct + (task_id * 613 + tier_index * 271) % 601 AS DOUBLE)
           / CAST(1001 AS DOUBLE) AS score
FROM (
  SELECT o_orderkey AS task_id, o_orderpriority AS question_type,
         CASE WHEN o_orderkey % 3 = 0 THEN 'calibration' ELSE 'test' END AS split,
         t.tier_index, t.tier, t.tier_index = 2 AS scarce,
         CASE WHEN (o_orderkey * (7919 + 1044 * t.tier_index) + 12997 * (t.tier_index + 1)) % 1000
                   < 820 + 70 * t.tier_index THEN 1 ELSE 0 END AS correct,
         (500 + o_orderkey % 1500) * t.input_nano + 40 * t.output_nano AS cost_nano
  FROM {orders} CROSS JOIN (VALUES (0, 'cheap', 1000, 5000), (1, 'mid', 2000, 10000),
       (2, 'frontier', 5000, 25000)) AS t(tier_index, tier, input_nano, output_nano)) m
"""

# The same matrix with a fourth tier that always answers.
MATRIX4 = MATRIX.replace("(2, 'frontier', 5000, 25000))", "(2, 'frontier', 5000, 25000), (3, 'apex', 15000, 75000))")

TURNS = """
SELECT conv_id AS session_id, turn AS turn_index, role, text, turn * 70 AS at_seconds,
       CASE WHEN conv_id % 4 = 0 THEN text ELSE concat('Assistant rules for topic ',
            CAST(conv_id % 5 AS VARCHAR(9))) END AS prefix,
       CASE WHEN turn % 6 = 5 THEN 'compaction' ELSE '' END AS label,
       CAST(floor(length(text) / CAST(4 AS DOUBLE)) AS BIGINT) AS text_tokens
FROM {conversations}
"""

JUDGED = """
SELECT d.doc_id AS task_id, d.lang AS question_type,
       CASE WHEN d.n_chars % 10 < 8 THEN 1 ELSE 0 END AS judge_baseline,
       CASE WHEN d.n_chars % 10 < 7 OR d.n_chars % 10 = 9 THEN 1 ELSE 0 END AS judge_candidate,
       CAST((d.n_chars * 7) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence_baseline,
       CAST((d.n_chars * 13) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence_candidate,
       l.quality AS strong_baseline,
       CASE WHEN l.toxic = 1 THEN 1 - l.quality ELSE l.quality END AS strong_candidate
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

PROMPTS = """
SELECT doc_id AS request_id, source AS pipeline, lang, text, n_chars FROM {documents}
"""

TRAFFIC = """
SELECT event_id AS call_id, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS day,
       user_id AS session_id, event_type AS question_type,
       CASE user_id % 3 WHEN 0 THEN 'frontier' WHEN 1 THEN 'mid' ELSE 'cheap' END AS model,
       CAST(floor(value * 100) AS BIGINT) AS cost_cents, props
FROM {events}
"""

SAMPLES = """
SELECT o.o_orderkey AS task_id, t.tier_index, t.tier, k.sample_index,
       concat('Final answer: ', CAST(CASE
         WHEN (o.o_orderkey * 31 + t.tier_index * 17 + k.sample_index * 7919) % 100
              < 60 + 15 * t.tier_index
         THEN o.o_orderkey % 50
         ELSE (o.o_orderkey + k.sample_index * (3 + t.tier_index)) % 53 END AS VARCHAR(9))) AS output,
       o.o_orderkey % 50 AS gold,
       (500 + o.o_orderkey % 1500) * t.input_nano AS cost_nano
FROM {orders} o
CROSS JOIN (VALUES (0, 'cheap', 1000), (1, 'mid', 2000), (2, 'frontier', 5000))
  AS t(tier_index, tier, input_nano)
CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS k(sample_index)
"""

ALL = {
    "tasks": TASKS,
    "calls": CALLS,
    "prices": PRICES,
    "matrix": MATRIX,
    "matrix4": MATRIX4,
    "turns": TURNS,
    "judged": JUDGED,
    "prompts": PROMPTS,
    "traffic": TRAFFIC,
    "samples": SAMPLES,
}


MULTIPLYING = {"matrix", "matrix4", "samples"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A trace-shaped view of the given tables."""
    text = ALL[name]
    sources = {t: table(spark, sf_dir, t) for t in sorted(set(re.findall(r"\{(\w+)\}", text)))}
    if name in MULTIPLYING:  # many rows from one: a table of a few splits is spread before, not after
        sources = {t: spread(df) for t, df in sources.items()}
    return spark.sql(text.replace("VARCHAR(9)", "STRING"), **sources)


def ansi(name: str) -> str:
    """The same view as text for an ANSI engine, as a parenthesised sub-query."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", ALL[name]).strip() + ")"


def ctes(*names: str) -> str:
    """``WITH`` clause binding the named views for an ANSI engine."""
    return "WITH " + ",\n".join(f"{n} AS {ansi(n)}" for n in names)
