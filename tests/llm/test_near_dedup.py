"""The pipeline's near-duplicate stage against all pairs."""

from __future__ import annotations

import random
import re

from costproof.llm import simhash

DOCS = "doc_id long, text string"


def jaccard(a, b, words=5):
    sets = []
    for text in (a, b):
        w = [x.encode().lower() for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_texts(seed, families=20):
    """Families of copies with more and more changed words, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice((40, 150, 400)))]
        for share in (0, 0.005, 0.01, 0.02, 0.04, 0.06):
            changed = list(base)
            for at in rng.sample(range(len(base)), round(len(base) * share)):
                changed[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    return texts


def groups_of(texts, low):
    """The smallest index that each text reaches over pairs of at least ``low``."""
    near = {(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= low}
    out = list(range(len(texts)))
    while True:
        least = list(out)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if least == out:
            return out
        out = least


def kept_ids(spark, texts):
    return {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}


def test_near_dedup_removes_only_what_similar_texts_link(spark):
    texts = near_texts(11)
    group = groups_of(texts, 0.8)
    gone = set(range(len(texts))) - kept_ids(spark, texts)
    assert gone and all(group[i] != i for i in gone)


def test_similarity_of_pairs_is_exact_and_never_ruled_out_before(spark):
    texts = [None, "", " ", "one", "One", "one two", "a b c d e", "a b c d e f", *near_texts(3, 4)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    docs = docs.withColumn("p", simhash.profiles(docs["text"], 5)).select("id", "text", "p.*")
    both = spark.createDataFrame(pairs, "a long, b long").join(docs.alias("x").withColumnRenamed("id", "a"), "a")
    both = both.join(docs.alias("y").withColumnRenamed("id", "b"), "b")
    told = both.select("a", "b", simhash._similar(both["x.text"], both["y.text"], 5).alias("s"), simhash._may_be_similar("x", "y").alias("m"))
    rows = told.collect()
    assert len(rows) == len(pairs) and {r["m"] for r in rows} == {True, False}
    for r in rows:
        want = jaccard(texts[r["a"]], texts[r["b"]]) >= 0.8
        assert r["s"] == want and (r["m"] or not want)


def test_near_dedup_groups_match_all_pairs(spark):
    texts = near_texts(12, 30)
    group = groups_of(texts, 0.8)
    assert kept_ids(spark, texts) == set(group) and len(set(group)) < len(texts)


def test_linked_fingerprints_are_candidates_without_any_band(spark):
    base = [f"w{i}" for i in range(3000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(reversed(base)), "a b c", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert {r["doc_id"] for r in simhash.near_dedup(rows, bands=0).collect()} == {0, 2, 3, 4}
