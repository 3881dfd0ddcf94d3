"""Language identification by compression.

For each language the labelled rows give a raw-content dictionary: its words by the number of texts they
occur in, the commonest last, where zstandard finds them cheapest. A text belongs to the language whose dictionary
encodes it smallest; a narrow margin over the second is reported, so that a caller can reject it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof.llm.texts import chunks, utf8

# Bounds of the fit: labelled rows and dictionary bytes of a language, and languages.
SAMPLE_ROWS = 1000
DICTIONARY_BYTES = 1 << 15
LANGUAGES = 200
# A level that looks for the short matches which tell languages apart.
LEVEL, MIN_MATCH = 6, 3
PART_BYTES = 2048
MIN_MARGIN = 0.002
UNDETERMINED = "und"

Model = dict[str, bytes]


def fit(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> Model:
    """A dictionary per language from a bounded sample of labelled rows.

    Of each language the ``sample_rows`` rows that come first by a hash of ``key`` are read, equal texts
    once. Rows without a label or text teach nothing. What reaches the driver is at most
    ``dictionary_bytes`` for each of at most 200 languages; more languages are refused.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("key").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return {}
    found = list(sizes)
    # Hashes under a bound that leaves a few times the sample, so that no language is ranked whole.
    draw = F.shiftrightunsigned(F.xxhash64("key"), 32)
    bound = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, float(sample_rows * 4 << 32) / n)])
    drawn = rows.select("key", "lang", draw.alias("draw")).where(F.col("draw") < bound[F.col("lang")])
    turn = Window.partitionBy("lang").orderBy("draw", "key")
    chosen = drawn.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= sample_rows)
    texts = rows.join(F.broadcast(chosen.select("key", "lang").distinct()), ["key", "lang"]).select("lang", "text").distinct()
    words = texts.select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
    counts = words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("texts"))
    best = Window.partitionBy("lang").orderBy(F.desc("texts"), "word")
    used = F.sum(F.octet_length("word") + 1).over(best.rowsBetween(Window.unboundedPreceding, 0))
    kept = counts.select("lang", "word", F.row_number().over(best).alias("turn"), used.alias("used"))
    model: dict[str, list[str]] = {name: [] for name in sorted(found)}
    for r in kept.where(F.col("used") <= dictionary_bytes).orderBy("lang", F.desc("turn")).collect():
        model[r["lang"]].append(r["word"])
    return {name: " ".join(words).encode() for name, words in model.items() if words}


class Classifier:
    """Sizes of a text under every language's dictionary."""

    def __init__(self, model: Model):
        self.packers = {}
        for name, words in model.items():
            learned = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            way = zstandard.ZstdCompressionParameters.from_level(
                LEVEL,
                source_size=PART_BYTES,
                dict_size=len(words),
                min_match=MIN_MATCH,
                write_content_size=False,
                write_dict_id=False,
            )
            learned.precompute_compress(compression_params=way)
            self.packers[name] = zstandard.ZstdCompressor(compression_params=way, dict_data=learned)

    def sizes(self, text: bytes) -> dict[str, int]:
        """Bytes of the whole text, encoded in parts so that the dictionary counts in each of them."""
        total = dict.fromkeys(self.packers, 0)
        for chunk in chunks(text):
            lowered = chunk.decode("utf-8", "replace").lower().encode()
            for at in range(0, len(lowered), PART_BYTES):
                part = lowered[at : at + PART_BYTES]
                for name, packer in self.packers.items():
                    total[name] += len(packer.compress(part))
        return total

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The language and its margin: what it saves over the second, from 0 to 1."""
        if not self.packers or not text or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return UNDETERMINED, 0.0
        ranked = sorted((size, name) for name, size in self.sizes(text).items())
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        return ranked[0][1], (ranked[1][0] - ranked[0][0]) / ranked[1][0]


def predicted(text: Column, model: Model) -> Column:
    """``struct<lang, score>`` of each whole text.

    ``und`` and 0 for a null or empty text, one without any letter, and all texts when nothing was learned.
    Equal sizes go to the language that comes first by name, with score 0.
    """

    @F.arrow_udf("lang string, score double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(model)
        for batch in batches:
            found = [classifier.predict(t) for t in utf8(batch)]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.StructArray.from_arrays([langs, scores], ["lang", "score"])

    return of(text)


def accepted(prediction: Column, min_margin: float = MIN_MARGIN) -> Column:
    """Whether a prediction names a language by at least ``min_margin``."""
    return (prediction["lang"] != UNDETERMINED) & (prediction["score"] >= min_margin)
