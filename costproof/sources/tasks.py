"""Task files to one task schema: JSON lines, CSV, and OpenTelemetry GenAI spans.

Readers never stop on a bad line by themselves: they return rows with an ``error`` so that the caller
chooses between quarantine and ``require_clean``. A text scan has no global line number, so ``row_no``
is the order in which Spark reads the files (blank lines counted); it is stable for one set of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof import fixed
from costproof.operators.ranks import positions

FIELDS = ("id", "question", "gold", "answer_type", "question_type")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One map of column to text per line; bad JSON and non-objects carry an error."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("row_no"), "value")
    filled = lines.where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    parsed = F.from_json("value", "map<string,string>")
    error = F.when(keys.isNull(), F.concat(F.lit("not a JSON object at row "), F.col("row_no").cast("string")))
    return filled.select("row_no", F.when(keys.isNotNull(), parsed).alias("row"), error.alias("error"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One map per CSV row, every value a text; a file without rows is an error."""
    table = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    if table.limit(1).count() == 0:
        raise ValueError(f"{path} has no rows")
    pairs = [x for c in table.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return table.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.create_map(*pairs).alias("row"),
        F.lit(None).cast("string").alias("error"),
    )


def resolve_columns(rows: DataFrame, mapping: dict[str, str] | None = None) -> dict[str, str]:
    """Which column carries each field: the first row with a non-empty candidate decides for the file,
    candidates in preference order. One aggregation over all fields."""
    given = dict(mapping or {})
    wanted = [f for f in FIELDS if f not in given]

    def first_name(field: str) -> Column:
        return F.coalesce(
            *[
                F.when(F.try_element_at("row", F.lit(n)) != "", F.lit(n))
                for n in fixed.FIELD_NAMES[field]
            ]
        )

    if wanted:
        head = rows.where(F.col("error").isNull()).agg(
            *[
                F.min_by(first_name(f), F.when(first_name(f).isNotNull(), F.col("row_no"))).alias(f)
                for f in wanted
            ]
        ).first()
        given.update({f: head[f] for f in wanted if head[f] is not None})
    return given


def to_tasks(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Task rows: defaults filled, unmapped columns kept in ``extra``, missing questions an error."""
    names = resolve_columns(rows, mapping)

    def field(name: str) -> Column:
        if name not in names:
            return F.lit(None).cast("string")
        return F.try_element_at("row", F.lit(names[name]))

    used = list(names.values())
    numbered = positions(rows, "row_no", "_n")
    filled = lambda c: F.when(c != "", c)
    return numbered.select(
        "row_no",
        F.coalesce(filled(field("id")), F.format_string("task-%05d", F.col("_n") + 1)).alias("task_id"),
        field("question").alias("question"),
        F.coalesce(field("gold"), F.lit("")).alias("gold"),
        F.coalesce(filled(field("answer_type")), F.lit("string")).alias("answer_type"),
        F.coalesce(filled(field("question_type")), F.lit("unclassified")).alias("question_type"),
        F.map_filter("row", lambda k, _: ~k.isin(*used) if used else F.lit(True)).alias("extra"),
        F.coalesce(
            F.col("error"), F.when(filled(field("question")).isNull(), F.lit("row has no question"))
        ).alias("error"),
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from GenAI spans; spans without a prompt are dropped and no answer key is invented."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    as_list = F.when(
        F.ltrim("value").startswith("["), F.from_json("value", "array<string>")
    ).otherwise(F.array("value"))
    spans = lines.select(
        F.monotonically_increasing_id().alias("row_no"), F.posexplode(as_list).alias("at", "span")
    )
    return spans_to_tasks(spans)


def span_attributes(span: Column) -> Column:
    """Attributes as one map, from the object encoding or the list of typed values."""
    raw = F.get_json_object(span, "$.attributes")
    listed = F.from_json(raw, "array<struct<key:string,value:string>>")
    inner = lambda v: F.coalesce(
        F.try_element_at(F.map_values(F.from_json(v, "map<string,string>")), F.lit(1)), v
    )
    flat = F.map_from_entries(
        F.transform(
            F.filter(listed, lambda e: e["key"].isNotNull()),
            lambda e: F.struct(e["key"].alias("key"), inner(e["value"]).alias("value")),
        )
    )
    return F.when(F.ltrim(raw).startswith("["), flat).otherwise(F.from_json(raw, "map<string,string>"))


def spans_to_tasks(spans: DataFrame) -> DataFrame:
    """``row_no, at, span`` (JSON text) to task rows."""
    staged = spans.withColumn("_a", span_attributes(F.col("span")))
    pick = lambda name: F.try_element_at("_a", F.lit(name))
    prompt = F.coalesce(*[F.when(pick(k) != "", pick(k)) for k in fixed.SPAN_PROMPT_KEYS])
    ident = F.coalesce(
        F.get_json_object("span", "$.spanId"), F.get_json_object("span", "$.span_id"),
        F.concat(F.lit("span-"), F.col("row_no").cast("string"), F.lit("-"), F.col("at").cast("string")),
    )
    return staged.where(prompt.isNotNull()).select(
        "row_no",
        ident.alias("task_id"),
        prompt.alias("question"),
        F.lit("").alias("gold"),
        F.lit("string").alias("answer_type"),
        F.coalesce(pick("gen_ai.operation.name"), F.lit("unclassified")).alias("question_type"),
        F.map_filter("_a", lambda k, _: k.startswith("gen_ai.") & (k != "gen_ai.prompt")).alias("extra"),
        F.lit(None).cast("string").alias("error"),
    )


def first_seen(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with a repeated id dropped (first row wins) and a one-row count of what was dropped.

    ``min_by`` keeps one row per id in the map-side combine, so a hot id never fills one task.
    """
    row = F.struct(*[F.col(c) for c in tasks.columns if c != "task_id"])
    kept = tasks.groupBy("task_id").agg(
        F.min_by(row, "row_no").alias("_r"), F.count("*").alias("_n")
    )
    return kept.select("task_id", "_r.*"), kept.agg(
        F.sum(F.col("_n") - 1).alias("duplicates")
    )


def require_clean(tasks: DataFrame) -> DataFrame:
    """Stop the job at the first row with an error."""
    return tasks.withColumn(
        "error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("error"))
    )
