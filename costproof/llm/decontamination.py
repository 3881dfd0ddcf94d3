"""Benchmark decontamination with a broadcast hash set of test n-grams.

Every window of ten consecutive words of a benchmark item (the whole item where it is shorter) goes into a hash
set that every executor holds. Training texts are scanned window by window; a hit is an equal string, so the
look-up verifies itself. Only columns of built-in functions are used.

A text is brought to spaced words once and stored so. Each window of the set names its longest pair of words; a text
that holds none of these pairs can hold no window, and only the others are taken apart into whole windows. Both scans
make arrays of the size of a text times the words of a run, so a single text must fit an executor ten times over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof.llm.common import broadcast_below, stored, unused

WINDOW = 10
# The hash set is broadcast up to this size; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
# What separates words, before and after lower-casing A-Z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; the short way where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, " "))


def windows(words: Column, length: int) -> Column:
    """All runs of ``length`` words of a spaced text, the first at its first word."""
    pattern = rf"(?=([^ ]++(?: [^ ]++){{{length - 1}}}))[^ ]++ ?"
    return F.regexp_extract_all(words, F.lit(pattern), F.lit(1))


def word_count(text: Column) -> Column:
    """Words of a text; none where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def grams(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, length, gram``: every window of every item; items without words have none."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    items = items.withColumn("words", spaced(F.col("text"))).withColumn("n", word_count(F.col("text")))
    long = items.where(F.col("n") >= window).select(
        "item_id", F.lit(window).alias("length"), F.explode(windows(F.col("words"), window)).alias("gram")
    )
    short = items.where((F.col("n") > 0) & (F.col("n") < window))
    short = short.select("item_id", F.col("n").cast("int").alias("length"), F.col("words").alias("gram"))
    return long.unionByName(short).distinct()


def _key(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h")


def _sized(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a broadcast hint where its strings are known to be small."""
    return broadcast_below(df, F.octet_length(column) + 64, BROADCAST_BYTES)


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, words, n_words``: every row's key, its spaced words and their number, stored."""
    rows = docs.select(*_key(doc_id, text), spaced(F.col(text)).alias("words"))
    gaps = F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit("")))
    return stored(rows.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(gaps + 1).cast("long")), "words")


def _anchor(gram: Column, length: Column) -> Column:
    """The longest pair of words of a window; of a single word, the word."""
    longest = F.array_max(F.transform(windows(gram, 2), lambda w: F.struct(F.octet_length(w).alias("n"), w.alias("w"))))
    return F.when(length < 2, gram).otherwise(longest["w"])


def _suspects(words: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of the texts that hold the anchor of some window; every text with a window is among them."""
    anchors = keys.select(F.least("length", F.lit(2)).alias("run"), _anchor(F.col("gram"), F.col("length")).alias("anchor"))
    anchors = _sized(stored(anchors.distinct(), "anchors"), "anchor")
    runs = [r["run"] for r in anchors.select("run").distinct().orderBy("run").collect()]  # one and two at most
    found = [
        words.select("doc_id", "h", F.explode(windows(F.col("words"), n)).alias("anchor"))
        .join(anchors.where(F.col("run") == n), "anchor", "left_semi")
        .select("doc_id", "h")
        for n in runs
    ]
    return stored(reduce(DataFrame.unionByName, found, words.select("doc_id", "h").limit(0)).distinct(), "suspects")


def hits(words: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, h, pos, length, gram``: where windows of ``items`` (of :func:`grams`) occur in :func:`prepared` texts."""
    lengths = [r["length"] for r in items.select("length").distinct().orderBy("length").collect()]
    distinct = items.select("gram", "length").distinct()
    suspects = broadcast_below(_suspects(words, distinct).toDF("d2", "h2"), F.lit(32))
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))
    texts = words.join(suspects, same, "left_semi")
    keys = _sized(distinct, "gram")
    found = [
        texts.select("doc_id", "h", windows(F.col("words"), n).alias("all"))
        .select("doc_id", "h", F.posexplode("all").alias("pos", "gram"))
        .join(keys.where(F.col("length") == n), "gram")
        for n in lengths
    ] or [words.select("doc_id", "h", F.lit(0).alias("pos"), F.lit("").alias("gram"), F.lit(0).alias("length")).limit(0)]
    return reduce(DataFrame.unionByName, found).distinct()


def _spans(found: DataFrame) -> DataFrame:
    """Per document the spans of hit words, in order."""
    spans = F.sort_array(F.collect_set(F.struct("pos", "length")))
    return found.groupBy("doc_id", "h").agg(spans.alias("spans"))


def _covered(spans: Column) -> Column:
    """Words under sorted spans, each once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["pos"] + span["length"])
        new = end - F.greatest(so_far["end"], span["pos"])
        return F.struct(end.alias("end"), (so_far["n"] + new).alias("n"))

    return F.aggregate(spans, start, step, lambda x: x["n"])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` of every row of ``docs``.

    ``items`` are the ids, as strings in order, of the items with an occurring window. Null and empty texts have no
    words and no hits, on either side; repeated rows get equal reports; an empty benchmark hits nothing.
    """
    items = stored(grams(benchmark, item_id, item_text, window), "grams")
    words = prepared(docs, doc_id, text)
    found = stored(hits(words, items), "hits")
    covered = _spans(found).select("doc_id", "h", _covered(F.col("spans")).alias("n_hit"))
    named = found.select("doc_id", "h", "gram", "length").distinct()
    named = named.join(_sized(items, "gram"), ["gram", "length"])
    names = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    listed = named.groupBy("doc_id", "h").agg(names.alias("items"))
    judged = covered.join(listed.withColumnsRenamed({"doc_id": "d2", "h": "h2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
    judged = stored(judged.select("doc_id", "h", "n_hit", "items"), "judged")
    all_docs = words.select("doc_id", "h", "n_words")
    return all_docs.join(judged, _same(all_docs, judged), "left").select(
        all_docs["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _contaminated(docs: DataFrame, benchmark: DataFrame, names: tuple[str, ...], window: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with its key, and the spans of contaminated rows."""
    doc_id, text, item_id, item_text = names
    items = stored(grams(benchmark, item_id, item_text, window), "grams")
    spans = stored(_spans(hits(prepared(docs, doc_id, text), items)), "spans")
    i, h = unused(docs, "id", "h")
    return docs.select("*", F.col(doc_id).alias(i), F.xxhash64(F.col(text)).alias(h)), spans.toDF(i, h, "spans")


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark; all columns as they were."""
    keyed, spans = _contaminated(docs, benchmark, (doc_id, text, item_id, item_text), window)
    i, h = keyed.columns[-2:]
    return keyed.join(spans, keyed[i].eqNullSafe(spans[i]) & (keyed[h] == spans[h]), "left_anti").select(*docs.columns)


def clean_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with the hit words, and what follows each up to the next word, cut out of their texts."""
    keyed, spans = _contaminated(docs, benchmark, (doc_id, text, item_id, item_text), window)
    i, h = keyed.columns[-2:]
    joined = keyed.join(spans, keyed[i].eqNullSafe(spans[i]) & (keyed[h] == spans[h]), "left")
    lead = F.regexp_extract(F.col(text), f"^{GAP}*", 0)
    parts = F.regexp_extract_all(F.col(text), F.lit(f"({WORD}{GAP}*)"), F.lit(1))
    kept = F.concat(lead, F.array_join(_outside(parts, spans["spans"]), ""))
    cleaned = F.when(spans["spans"].isNull(), F.col(text)).otherwise(kept)
    return joined.select(*[cleaned.alias(c) if c == text else keyed[c] for c in docs.columns])


def _outside(parts: Column, spans: Column) -> Column:
    """The parts that no span covers: the slices between merged spans."""
    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int>>").alias("gaps"))

    def step(so_far: Column, span: Column) -> Column:
        gap = F.struct((so_far["end"] + 1).alias("at"), F.greatest(F.lit(0), span["pos"] - so_far["end"]).alias("n"))
        end = F.greatest(so_far["end"], span["pos"] + span["length"])
        gaps = F.when(gap["n"] > 0, F.array_append(so_far["gaps"], gap)).otherwise(so_far["gaps"])
        return F.struct(end.alias("end"), gaps.alias("gaps"))

    def rest(so_far: Column) -> Column:
        last = F.struct((so_far["end"] + 1).alias("at"), (F.size(parts) - so_far["end"]).alias("n"))
        return F.filter(F.array_append(so_far["gaps"], last), lambda g: g["n"] > 0)

    return F.flatten(F.transform(F.aggregate(spans, begin, step, rest), lambda g: F.slice(parts, g["at"], g["n"])))
