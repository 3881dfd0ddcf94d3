"""Prompt rules and rewrites over the given documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof import fixed
from costproof.bindings import bind, ctes
from costproof.functions import blocks as B
from costproof.functions import tokens as T
from costproof.operators import findings as FI
from costproof.operators import lint as L
from costproof.operators import rewrite as R
from costproof.plans.registry import query, r6
from costproof.runtime import spread

# The same pieces in RE2 syntax: its classes are ASCII unless spelled out.
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{No}\p{Pc}"
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
PRETOKEN_RE2 = (
    r"'(?:[sdmt]|ll|ve|re)|[ ]?[\p{L}\p{M}\p{Nl}\p{No}\p{Pc}]+|[ ]?\p{Nd}{1,3}"
    rf"|[ ]?[^{SPACE}{WORD}]+|[{SPACE}]+"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens_sql(source: str, key: str, text: str, out: str) -> str:
    """CTE counting tokens of a text column by key."""
    return f"""{out}_p AS (SELECT {key}, unnest(regexp_extract_all({text}, {quoted(PRETOKEN_RE2)})) AS p FROM {source}),
{out}_b AS (SELECT {key}, p, regexp_replace(p, '^[{SPACE}]+', '') AS b FROM {out}_p),
{out} AS (SELECT {key}, CAST(sum(CASE WHEN b = '' THEN greatest(1, round_even(length(p)/4.0::DOUBLE, 0))
  WHEN regexp_full_match(b, '\\p{{Nd}}+') THEN 1
  WHEN regexp_matches(b, '^[\\p{{L}}'']') THEN greatest(1, round_even(length(b)/4.2::DOUBLE, 0)) ELSE length(b) END) AS BIGINT) AS tokens
  FROM {out}_b GROUP BY ALL)"""


RATES = {"input": 5000, "output": 25000, "cache_read": 500, "minimum": 1024}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests: a header, the document, and a question after it."""
    d = spread(bind(spark, sf_dir, "prompts"))
    header = F.concat(
        F.lit("You are an assistant for "), "lang", F.lit(" requests. Date: 2024-01-"),
        F.lpad((F.col("request_id") % 28 + 1).cast("string"), 2, "0"),
    )
    cached = F.when(F.col("request_id") % 3 == 0, F.lit("5m"))
    return d.select(
        "request_id",
        "pipeline",
        F.array(
            B.block(F.when(F.col("request_id") % 2 == 0, header).otherwise(F.lit("You are an assistant."))),
            B.block(F.col("text"), cached),
        ).alias("system"),
        F.array(
            B.block(F.concat(F.lit("Please answer question "), F.col("request_id").cast("string"), F.lit(".")))
        ).alias("user"),
        F.when(F.col("request_id") % 10 == 0, F.lit('[{"name": "lookup"}]')).alias("tools"),
        F.lit(1024).alias("max_tokens"),
        F.when(F.col("request_id") % 5 == 0, F.lit(300.0)).alias("observed_output_tokens"),
        F.when(F.col("request_id") % 5 == 0, F.lit(40)).alias("needed_output_tokens"),
        *[F.lit(v).cast("bigint").alias(f"p_{k}") for k, v in RATES.items()],
    )


REQUESTS_SQL = f"""{ctes('prompts')},
r AS (SELECT request_id, pipeline, text AS b1,
  CASE WHEN request_id % 2 = 0 THEN 'You are an assistant for ' || lang || ' requests. Date: 2024-01-' || lpad(CAST(request_id % 28 + 1 AS VARCHAR), 2, '0')
    ELSE 'You are an assistant.' END AS b0,
  'Please answer question ' || CAST(request_id AS VARCHAR) || '.' AS b2, request_id % 3 = 0 AS cached FROM prompts)"""


@query(
    "prompt_token_counts",
    f"""{ctes('prompts')}, {tokens_sql('prompts', 'request_id', 'text', 'tok')}
SELECT p.request_id, coalesce(tokens, 0) AS tokens FROM prompts p LEFT JOIN tok USING (request_id)""",
)
def prompt_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(bind(spark, sf_dir, "prompts")).select(
        "request_id", T.approx_tokens(F.col("text")).alias("tokens")
    )


@query("prompt_lint")
def prompt_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single-request rule over every request, ranked by weighted dollars."""
    return FI.rank(L.lint(requests(spark, sf_dir)).drop("spans"), ["request_id"])


@query(
    "prompt_cache_findings",
    f"""{REQUESTS_SQL},
strs AS (SELECT request_id, 'b0' AS kind, b0 AS s FROM r UNION ALL SELECT request_id, 'b1', b1 FROM r
  UNION ALL SELECT request_id, 'pre', b0 || chr(10) || chr(10) || b1 FROM r
  UNION ALL SELECT request_id, 'tool', '[{{"name": "lookup"}}]' FROM r WHERE request_id % 10 = 0),
{tokens_sql('strs', 'request_id, kind', 's', 'tk')},
t AS (SELECT r.*, coalesce(max(CASE WHEN kind = 'b0' THEN tokens END), 0) AS t0, coalesce(max(CASE WHEN kind = 'b1' THEN tokens END), 0) AS t1,
  coalesce(max(CASE WHEN kind = 'pre' THEN tokens END), 0) AS tp, coalesce(max(CASE WHEN kind = 'tool' THEN tokens END), 0) AS tt
  FROM r LEFT JOIN tk USING (request_id) GROUP BY ALL),
big AS (SELECT *, CASE WHEN length(b0) >= length(b1) AND length(b0) >= length(b2) THEN t0 WHEN length(b1) >= length(b2) THEN t1 ELSE 6 END AS tl FROM t)
SELECT request_id, 'PL02' AS rule, CAST(tl*4500000 AS DOUBLE) AS per_1k FROM big WHERE t1 > 500
UNION ALL SELECT request_id, 'PL03', CAST(tp*4500000 AS DOUBLE) FROM big WHERE cached AND tp < 1024
UNION ALL SELECT request_id, 'PL05', CAST((tp + tt)*4500000 AS DOUBLE) FROM big WHERE NOT cached AND tp + tt > 400""",
)
def prompt_cache_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static text behind dynamic text, prefixes below the minimum, fixed overhead paid every call."""
    out = L.row_findings(requests(spark, sf_dir)).where(F.col("rule").isin("PL02", "PL03", "PL05"))
    return out.select("request_id", "rule", "per_1k")


@query(
    "prompt_wording_findings",
    f"""{REQUESTS_SQL},
f AS (SELECT request_id, b0 || chr(10) || chr(10) || b1 AS sys, b0 || chr(10) || chr(10) || b1 || chr(10) || chr(10) || b2 AS full_text FROM r)
SELECT request_id, 'PL06' AS rule, CASE WHEN request_id % 5 = 0 THEN 260.0 ELSE 256.0 END*25000000.0::DOUBLE AS per_1k FROM f
  WHERE NOT (regexp_matches(full_text, {quoted(fixed.OUTPUT_CONTRACT_PATTERN)}) AND regexp_matches(full_text, {quoted(fixed.LENGTH_CAP)}))
UNION ALL SELECT request_id, 'PL10', 0.0 FROM f
  WHERE NOT (regexp_matches(sys, {quoted(fixed.ROLE)}) AND regexp_matches(sys, {quoted(fixed.TASK_LINE)}) AND regexp_matches(sys, {quoted(fixed.SUCCESS)}))
    OR regexp_matches(sys, {quoted(fixed.VAGUE_VERBS)})
UNION ALL SELECT request_id, 'PL11', 0.0 FROM f WHERE {' OR '.join(f"(regexp_matches(full_text, {quoted(a)}) AND regexp_matches(full_text, {quoted(b)}))" for a, b, _ in fixed.CONFLICT_PAIRS)}""",
)
def prompt_wording_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing output contract, missing role or task, conflicting instructions."""
    out = L.row_findings(requests(spark, sf_dir)).where(F.col("rule").isin("PL06", "PL10", "PL11"))
    return out.select("request_id", "rule", "per_1k")


JOBS = "Summarize the text.\nClassify it.\nExtract every name.\n" + "keep going with care " * 130
ASK = ". Thank you, perhaps. See https://example.org/notes or write to desk@example.org about the whole of it."
VOLATILE = [fixed.VOLATILE_PHRASE, *fixed.STAMP_PATTERNS]


def rich_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests of five blocks, in which every rule of a single request finds something."""
    d = spread(bind(spark, sf_dir, "prompts")).withColumn("text", F.coalesce("text", F.lit("")))
    k = F.col("request_id")
    header = F.when(k % 2 == 0, F.concat(F.lit("Notes of 2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))
    examples = F.concat(F.lit("Example 1: "), "text", F.lit("\nExample 2: "), "text")
    return d.select(
        "request_id",
        F.array(
            B.block(F.coalesce(header, F.lit("You are a clerk. Be concise.")), F.when(k % 4 == 0, "5m")),
            B.block(F.when(k % 6 == 1, F.lit(JOBS)).otherwise(F.lit("Task: answer."))),
            B.block(F.col("text"), F.when(k % 3 == 0, "5m")),
        ).alias("system"),
        F.array(
            B.block(F.concat(F.lit("Please answer question "), k.cast("string"), F.when(k % 7 == 2, " at length").otherwise(""), F.lit(ASK * 2))),
            B.block(F.when(k % 5 == 0, examples).otherwise(F.lit("Input: none"))),
        ).alias("user"),
        F.when(k % 10 == 0, F.lit('[{"name": "lookup"}]')).alias("tools"),
        F.lit(1024).alias("max_tokens"),
        F.when(k % 5 == 0, F.lit(300.0)).alias("observed_output_tokens"),
        F.when(k % 5 == 0, F.lit(40)).alias("needed_output_tokens"),
        *[F.lit(v).cast("bigint").alias(f"p_{name}") for name, v in RATES.items()],
    )


def any_sql(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(p)})" for p in patterns) + ")"


RICH_SQL = f"""{ctes('prompts')},
q AS (SELECT request_id AS k, coalesce(text, '') AS b2,
  CASE WHEN request_id % 2 = 0 THEN 'Notes of 2024-01-' || lpad(CAST(request_id % 28 + 1 AS VARCHAR), 2, '0') ELSE 'You are a clerk. Be concise.' END AS b0,
  CASE WHEN request_id % 6 = 1 THEN {quoted(JOBS)} ELSE 'Task: answer.' END AS b1,
  'Please answer question ' || CAST(request_id AS VARCHAR) || CASE WHEN request_id % 7 = 2 THEN ' at length' ELSE '' END || {quoted(ASK * 2)} AS b3,
  CASE WHEN request_id % 5 = 0 THEN 'Example 1: ' || coalesce(text, '') || chr(10) || 'Example 2: ' || coalesce(text, '') ELSE 'Input: none' END AS b4 FROM prompts),
n AS (SELECT *, b0 || chr(10) || chr(10) || b1 || chr(10) || chr(10) || b2 AS sys,
  b0 || chr(10) || chr(10) || b1 || chr(10) || chr(10) || b2 || chr(10) || chr(10) || b3 || chr(10) || chr(10) || b4 AS whole FROM q),
x AS (SELECT *, CASE WHEN k % 3 = 0 THEN sys WHEN k % 4 = 0 THEN b0 ELSE '' END AS prefix FROM n),
blk AS ({' UNION ALL '.join(f"SELECT k, {i} AS i, b{i} AS s, {'k % 4 = 0' if i == 0 else 'k % 3 = 0' if i == 2 else 'FALSE'} AS cached, prefix FROM x" for i in range(5))}),
{tokens_sql('blk', 'k, i', 's', 'bt')},
tb AS (SELECT k, coalesce(max(tokens) FILTER (i = 2), 0) AS t2 FROM bt GROUP BY k),
other AS (SELECT k, 10 AS i, prefix AS s FROM x UNION ALL SELECT k, 11, sys FROM x UNION ALL SELECT k, 12, '[{{"name": "lookup"}}]' FROM x WHERE k % 10 = 0
  UNION ALL SELECT k, 13, CASE WHEN coalesce(t2, 0) <= 1000 THEN sys ELSE b0 || chr(10) || chr(10) || b1 END FROM x LEFT JOIN tb USING (k)),
filler AS (SELECT k, 100 + row_number() OVER (PARTITION BY k) AS i, s FROM (SELECT k, unnest(regexp_extract_all(s, {quoted(fixed.COURTESY)})) AS s FROM blk) f),
{tokens_sql('other', 'k, i', 's', 'ot')}, {tokens_sql('filler', 'k, i', 's', 'ft')},
b AS (SELECT blk.*, coalesce(tokens, 0) AS t, {any_sql('s', VOLATILE[:1])} OR (coalesce(tokens, 0) <= 120 AND {any_sql('s', VOLATILE[1:])}) AS vol FROM blk LEFT JOIN bt USING (k, i)),
g AS (SELECT k, coalesce(max(tokens) FILTER (i = 10), 0) AS pt, coalesce(max(tokens) FILTER (i = 11), 0) + coalesce(max(tokens) FILTER (i = 12), 0) AS oh,
  coalesce(max(tokens) FILTER (i = 13), 0) AS it FROM ot GROUP BY k),
a AS (SELECT x.*, coalesce(pt, 0) AS pt, coalesce(oh, 0) AS oh, coalesce(it, 0) AS it FROM x LEFT JOIN g USING (k)),
m AS (SELECT k, arg_max(t, length(s)*10 - i) AS lt, coalesce(min(i) FILTER (t > 500), 99) AS stable FROM b GROUP BY k),
job AS (SELECT k, count(DISTINCT lower(trim(j))) AS n FROM (SELECT k, unnest(regexp_extract_all(
  array_to_string([y FOR y IN [CASE WHEN t0 <= 1000 THEN b0 END, CASE WHEN t1 <= 1000 THEN b1 END, CASE WHEN t2 <= 1000 THEN b2 END] IF y IS NOT NULL], chr(10) || chr(10)),
  {quoted(fixed.IMPERATIVE_CLAUSE)}, 1)) AS j FROM x JOIN (SELECT k, max(t) FILTER (i = 0) AS t0, max(t) FILTER (i = 1) AS t1, max(t) FILTER (i = 2) AS t2 FROM b GROUP BY k) USING (k)) GROUP BY k)"""


RULE_ROWS = f"""SELECT k AS request_id, 'PL01' AS rule, CAST(CASE WHEN pt > 0 THEN pt ELSE lt END*4500000 AS DOUBLE) AS per_1k FROM a JOIN m USING (k)
  WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.vol AND (b.prefix = '' OR contains(b.prefix, b.s)))
UNION ALL SELECT m.k, 'PL02', CAST(lt*4500000 AS DOUBLE) FROM m WHERE stable BETWEEN 1 AND 98 AND EXISTS (SELECT 1 FROM b WHERE b.k = m.k AND b.i < stable AND (b.vol OR b.t < 60))
UNION ALL SELECT k, 'PL03', CAST(pt*4500000 AS DOUBLE) FROM a WHERE prefix <> '' AND pt < 1024
UNION ALL SELECT k, 'PL04', CAST(t*4500000 AS DOUBLE) FROM b WHERE cached AND vol
UNION ALL SELECT k, 'PL05', CAST(oh*4500000 AS DOUBLE) FROM a WHERE prefix = '' AND oh > 400
UNION ALL SELECT k, 'PL06', CASE WHEN k % 5 = 0 THEN 260.0 ELSE 256.0 END*25000000.0::DOUBLE FROM a
  WHERE NOT (regexp_matches(whole, {quoted(fixed.OUTPUT_CONTRACT_PATTERN)}) AND regexp_matches(whole, {quoted(fixed.LENGTH_CAP)}))
UNION ALL SELECT k, 'PL08', CAST(sum(tokens)*CASE WHEN max(prefix) <> '' THEN 500 ELSE 5000 END*1000 AS DOUBLE) FROM ft JOIN a USING (k) GROUP BY k
UNION ALL SELECT k, 'PL09', CAST(round_even(sum(t)*0.4::DOUBLE, 0)*5000000 AS DOUBLE) FROM b WHERE t > 150 AND len(regexp_extract_all(s, {quoted(fixed.EXAMPLE_MARKER)})) >= 2 GROUP BY k
UNION ALL SELECT k, 'PL10', 0.0 FROM a WHERE NOT (regexp_matches(sys, {quoted(fixed.ROLE)}) AND regexp_matches(sys, {quoted(fixed.TASK_LINE)}) AND regexp_matches(sys, {quoted(fixed.SUCCESS)}))
    OR regexp_matches(sys, {quoted(fixed.VAGUE_VERBS)})
UNION ALL SELECT k, 'PL11', 0.0 FROM a WHERE {' OR '.join(f"(regexp_matches(whole, {quoted(c[0])}) AND regexp_matches(whole, {quoted(c[1])}))" for c in fixed.CONFLICT_PAIRS)}
UNION ALL SELECT DISTINCT k, 'PL12', 0.0 FROM b WHERE t >= 250 AND NOT contains(s, '|') AND NOT regexp_matches(s, {quoted(fixed.STRUCTURE)})
UNION ALL SELECT DISTINCT k, 'PL13', 0.0 FROM b WHERE t BETWEEN 40 AND 1000 AND {any_sql('s', list(fixed.HARDCODED))}
UNION ALL SELECT k, 'PL14', 0.0 FROM a JOIN job USING (k) WHERE it > 500 AND n >= 3"""


@query("prompt_rules", RICH_SQL + "\n" + RULE_ROWS)
def prompt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every rule but the duplicate lines, which have their own query."""
    out = L.row_findings(rich_requests(spark, sf_dir))
    return out.select("request_id", "rule", "per_1k")


DUP_SQL = r"""
lines0 AS (SELECT request_id, unnest(list_zip(range(0, len(l)), l)) AS e FROM (
  SELECT request_id, list_concat(regexp_split_to_array(b0, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'),
   list_concat(regexp_split_to_array(b1, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'),
     regexp_split_to_array(b2, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'))) AS l FROM r)),
lines1 AS (SELECT request_id, e[1] AS pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(e[2], '^\s+', ''), '\s+$', ''), '^[-*]+', ''), '^\s+', ''), '\s+$', '') AS line FROM lines0),
lines2 AS (SELECT *, regexp_extract_all(lower(line), '[a-z0-9'']+') AS w FROM lines1 WHERE length(line) BETWEEN 20 AND 300),
lines3 AS (SELECT request_id, pos, line, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM lines2 WHERE len(w) >= 3),
dup AS (SELECT a.request_id, b.line FROM lines3 a JOIN lines3 b ON a.request_id = b.request_id AND a.pos < b.pos
  WHERE CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.8)"""


@query(
    "prompt_duplicate_instructions",
    f"""{REQUESTS_SQL},{DUP_SQL},
dl AS (SELECT DISTINCT line FROM dup), {tokens_sql('dl', 'line', 'line', 'dt')}
SELECT d.request_id, count(*) AS pairs, CAST(sum(dt.tokens) AS BIGINT) AS duplicate_tokens,
  bool_and(r.cached AND contains(r.b0 || chr(10) || chr(10) || r.b1, d.line)) AS all_in_prefix
FROM dup d JOIN dt USING (line) JOIN r USING (request_id) GROUP BY d.request_id""",
)
def prompt_duplicate_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-equal lines inside each request, from an exact set-similarity join."""
    return L.duplicate_instructions(requests(spark, sf_dir))


def _letter_sql(letter: str) -> str:
    rules = ", ".join(f"'{r}'" for r, x in fixed.RULE_LETTER.items() if x == letter)
    fired = f"count(*) FILTER (rule IN ({rules}))"
    return f"CAST(CASE WHEN {fired} = 0 THEN 5 ELSE greatest(1, 4 - {fired}) END AS INTEGER) AS {letter}"


@query(
    "prompt_clear_scores",
    f"""{RICH_SQL},
r AS (SELECT k AS request_id, b0 || chr(10) || b1 AS b0, b2 AS b1, b3 || chr(10) || b4 AS b2 FROM x), {DUP_SQL},
found AS ({RULE_ROWS} UNION ALL SELECT DISTINCT request_id, 'PL07', 0.0 FROM dup UNION ALL SELECT k, NULL, 0.0 FROM x)
SELECT request_id, {', '.join(_letter_sql(letter) for letter in fixed.CLEAR_LETTERS)} FROM found GROUP BY request_id""",
)
def prompt_clear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score from one to five per letter for every request, from all rules."""
    asked = rich_requests(spark, sf_dir)
    return L.clear_scores(L.lint(asked), requests=asked)


@query("prompt_safe_fixes")
def prompt_safe_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every safe fix applied in order, with what it is worth per 1,000 calls."""
    fixed_rows = R.apply_safe_fixes(requests(spark, sf_dir))
    worth = R.savings_per_1k(F.col("p_input"), F.col("p_output"), F.col("p_cache_read"))
    return fixed_rows.select(
        "request_id", F.concat_ws(",", "applied").alias("applied"), "input_before", "input_after",
        "cacheable_before", "cacheable_after", "max_after", r6(worth["net"]).alias("net_per_1k"),
    )
