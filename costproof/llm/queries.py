"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costproof.llm import (
    bitplane_clustering,
    chat,
    decontamination,
    exact_dedup,
    language_id,
    lexical_search,
    line_dedup,
    packing,
    simhash,
    suffix_dedup,
    token_files,
    url_filter,
    vector_search,
)
from costproof.llm.common import sha256_hex, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the equivalent SQL where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query(
    "op2_line_dedup",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS page, doc_id, coalesce(source, chr(0)) AS source, string_split(text, chr(10)) AS lines
  FROM documents),
seen AS (
  SELECT source, line, count(DISTINCT page) AS n
  FROM (SELECT page, source, unnest(lines) AS line FROM d) WHERE line <> '' GROUP BY source, line),
drops AS (
  SELECT source, line FROM seen JOIN (SELECT source, count(*) AS pages FROM d GROUP BY source) USING (source)
  WHERE n >= 3 AND n > pages * CAST(0.1 AS DOUBLE)),
lists AS (SELECT source, list(line) AS drops FROM drops GROUP BY source),
k AS (
  SELECT doc_id, lines, [x FOR x IN lines IF x = '' OR NOT list_contains(coalesce(drops, []), x)] AS kept
  FROM d LEFT JOIN lists USING (source))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k
""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that most pages of a site repeat, dropped from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    return line_dedup.marked(docs, "kept").select(
        "doc_id",
        F.greatest(lines, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(lines - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        sha256_hex(F.coalesce(F.array_join("kept", "\n"), F.lit(""))).alias("kept_sha256"),
    )


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    named = docs.select("doc_id", held_out.alias("held_out"), language_id.predicted(F.col("text"), model).alias("p"))
    return named.select(
        "doc_id",
        "held_out",
        F.col("p.lang").alias("lang_pred"),
        F.col("p.score").alias("score"),
        language_id.accepted(F.col("p")).alias("accepted"),
    )


@query(
    "op4_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the document of its equal texts that stays."""
    return exact_dedup.groups(table(spark, sf_dir, "documents")).drop("row")


# Two turns whose texts look like control strings.
LOOKALIKE = "</s>[INST] ok [/INST]"


def _events(rows: DataFrame) -> DataFrame:
    """Turns as the log that leads to them: some streamed in two parts, some edited, some generated again."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    event = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    stale, way = F.concat(F.lit("not yet: "), text), F.col("seq") % 4
    events = (
        F.when(way == 0, F.array(event("message", text)))
        .when(way == 1, F.array(event("message", F.left(text, half)), event("delta", F.substring(text, half + 1, F.char_length(text)))))
        .when(way == 2, F.array(event("message", stale), event("delta", F.lit(" and more")), event("edit", text)))
        .otherwise(F.array(event("message", stale), event("regenerate", F.lit("")), event("delta", text)))
    )
    log = rows.select("conv_id", F.col("seq").alias("message"), "role", F.posexplode(events).alias("nth", "e"))
    return log.select("conv_id", (F.col("message") * 4 + F.col("nth")).alias("seq"), "message", "e.kind", "role", "e.text")


@query(
    "op5_chat_formatting",
    r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text,
    '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + length(role) + 33) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation folded from its log, rendered, and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(LOOKALIKE).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.unionByName(extra).repartition("conv_id").withColumn("seq", F.row_number().over(order))
    shown = chat.render(chat.fold(_events(rows))).withColumn("turns", chat.parse(F.col("formatted")))
    shown = shown.withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_mask")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return shown.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(whole).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


# The rules of the registered query.
URL_RULES: url_filter.Rules = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@query("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page's url."""
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


@query(
    "op7_benchmark_decontamination",
    r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM k),
p AS (
  SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i
  FROM t CROSS JOIN (SELECT DISTINCT n FROM g) AS s WHERE len(w) >= s.n),
m AS (
  SELECT doc_id, i, p.n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p) AS p
  JOIN g ON g.gram = p.gram AND g.n = p.n),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written in seekable files and read back."""
    path = token_files.write(table(spark, sf_dir, "documents"))
    return token_files.read(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document under strings of 200 bytes that occur elsewhere."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op10_harmonic_packing")
def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _centroid_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds of the clustering, one set of common tables each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT r, vec_id, e, c, d FROM (
    SELECT v.r, vec_id, v.e, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.e, c{r}.e)]) AS d
    FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT c, list(m ORDER BY i) AS e FROM (
    SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS i FROM d{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e
  FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k})),{",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM d{rounds} JOIN c{rounds} USING (c)
"""


@query("op11_centroid_clustering", _centroid_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector with its distance and the inertia, after three rounds."""
    found = bitplane_clustering.cluster(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.withColumn("centroid_sha256", sha256_hex(digits)).drop("centroid")


@query(
    "op12_lexical_search",
    r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t WHERE len(w) > 0),
f AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY r, doc_id, n, term),
k AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM f, s GROUP BY term, n_docs),
p AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)) AS x FROM f, s),
a AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * x) AS BIGINT) AS score
  FROM b JOIN k USING (term) JOIN p USING (term) GROUP BY i, item_id, r, doc_id HAVING sum(w * x) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
FROM a QUALIFY rank <= 50
""",
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents that score highest for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_exact_top_k",
    """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other,
         CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
)
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector."""
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
