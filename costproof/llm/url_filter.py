"""URL filtering: host and path rules first, boosted trees on lexical features for the rest.

The trees learn from labelled URLs. Where a caller has none of its own, the URLs that a rule decides are the labelled
ones. Features and verdicts are built-in columns and the trees of Spark's own library.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof.llm.common import stored

# Bound of the fit: labelled rows that the trees and the suffix statistics are learned from.
SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, SEED = 20, 4, 7
PRIOR_ROWS = 20.0
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "marks",
    "top_rate", "top_share", "end_rate", "end_share",
)
Rules = tuple[tuple[str, str], ...]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def ruled(host: Column, path: Column, rules: Rules) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null.

    A rule ``name/prefix`` fits the host ``name`` and its subdomains where the path starts with ``/prefix``.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.greatest(F.char_length(text), F.lit(1)).cast("double")

    def bits(total: Column, letter: Column) -> Column:
        share = (F.char_length(text) - F.char_length(F.replace(text, letter))) / size
        return total - share * F.log2(share)

    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), bits)


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with lexical features; a null url counts as an empty one."""
    whole, host, path = F.coalesce(F.col(url), F.lit("")), host_of(F.col(url)), path_of(F.col(url))
    size = F.greatest(F.char_length(whole), F.lit(1))
    count = lambda text, letters: F.regexp_count(text, F.lit(letters)).cast("double")
    return pages.withColumns(
        {
            "url_length": F.char_length(whole).cast("double"),
            "host_length": F.char_length(host).cast("double"),
            "path_length": F.char_length(path).cast("double"),
            "depth": count(path, "/"),
            "labels": count(host, r"\."),
            "digit_ratio": count(whole, "[0-9]") / size,
            "entropy": _entropy(whole),
            "parameters": count(whole, "[?&]"),
            "marks": count(whole, "[-_.%=+]"),
            "top": F.substring_index(host, ".", -1),
            "end": F.regexp_extract(path, r"(\.[^./]*|/)$", 1),
        }
    )


def _statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """Block rate, drawn to one half where a suffix is rare, and share of rows of each suffix.

    At most as many rows as the sample has, which bounds the broadcast.
    """
    counts = labelled.groupBy(suffix).agg(F.count("*").alias("n"), F.sum("label").alias("blocks"))
    rate = (F.col("blocks") + PRIOR_ROWS / 2) / (F.col("n") + PRIOR_ROWS)
    return counts.select(suffix, rate.alias(f"{suffix}_rate"), F.log2(F.col("n") + 1.0).alias(f"{suffix}_share"))


class UrlModel:
    """Trees and suffix statistics; ``constant`` is the verdict where labels name only one."""

    def __init__(self, trees: PipelineModel | None, statistics: list[DataFrame], constant: float):
        self.trees, self.statistics, self.constant = trees, statistics, constant

    def features(self, pages: DataFrame) -> DataFrame:
        out = pages
        for stats in self.statistics:
            out = out.join(F.broadcast(stats), stats.columns[0], "left")
        return out.fillna({"top_rate": 0.5, "end_rate": 0.5, "top_share": 0.0, "end_share": 0.0})

    def scored(self, pages: DataFrame, score: str) -> DataFrame:
        """``pages``, with lexical features, and the chance ``score`` that a row is to be blocked."""
        if self.trees is None:
            return pages.withColumn(score, F.lit(self.constant))
        out = self.trees.transform(self.features(pages))
        return out.withColumn(score, vector_to_array("probability")[1])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Boosted trees from rows with lexical features and ``label`` (1.0: block), and a text ``url``.

    Learned from the ``sample_rows`` rows that come first by a hash of the url. With labels of one kind only
    every url gets that verdict; without labels every url is allowed.
    """
    sample = stored(labelled.orderBy(F.xxhash64("url"), "url", "label").limit(sample_rows), "labelled-urls")
    kinds = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if len(kinds) < 2:
        return UrlModel(None, [], kinds[0] if kinds else 0.0)
    model = UrlModel(None, [stored(_statistics(sample, s), s) for s in ("top", "end")], 0.0)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED)
    learned = trees.fit(rows.transform(model.features(sample)).select("features", "label"))
    model.trees = PipelineModel(stages=[rows, learned])
    return model


def judged(pages: DataFrame, rules: Rules, url: str = "url", key: str = "page_id") -> DataFrame:
    """``key, host, path, rule, verdict, score`` of every row.

    ``verdict`` is ``allow`` or ``block``: the longest fitting rule's, else the trees', which block above a score
    of one half. ``score`` is the trees' for every url. A null url, or one without ``://``, has an empty host and path
    and goes to the trees. Repeated rows are judged alike; an empty table gives no rows.
    """
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    rows = lexical(own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    label = (F.col("found.verdict") == "block").cast("double")
    model = fit(rows.where("found is not null").withColumn("label", label).select("url", "label", "top", "end", *_plain()))
    scored = model.scored(rows, "score")
    method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("key").alias(key), "host", "path", "found.rule", F.coalesce("found.verdict", method).alias("verdict"), "score"
    )


def _plain() -> list[str]:
    return [f for f in FEATURES if not f.startswith(("top_", "end_"))]
