"""Shards of the suffix removal hold no anchor with more contexts than they may sort."""

from __future__ import annotations

import random
from collections import Counter

from costproof.llm import suffix_dedup

LENGTH = 80
MOST = 20


def spans_of(texts):
    """``text -> covered bytes`` by brute force over all strings of ``LENGTH`` bytes."""
    seen = Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    return {
        (d, p) for d, t in enumerate(texts) for i in range(len(t) - LENGTH + 1) if seen[t[i : i + LENGTH]] > 1 for p in range(i, i + LENGTH)
    }


def guarded(length):
    """The resolver, stopping the job when an anchor has more contexts than a shard may hold."""
    inner, most = resolve(length), MOST

    def run(batches):
        seen = {}

        def watched():
            for batch in batches:
                for row in zip(*(batch[c].to_pylist() for c in ("h", "c1", "c2")), strict=True):
                    seen.setdefault(row[0], set()).add(row[1:])
                    if len(seen[row[0]]) > most:
                        raise ValueError("an anchor with too many contexts reached a shard")
                yield batch

        yield from inner(watched())

    return run


resolve = suffix_dedup._resolve


def test_anchors_with_many_contexts_stay_out_of_the_shards_when_the_filter_is_full(spark, monkeypatch):
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common, rare = draw(120), [draw(120) for _ in range(12)]
    texts = [draw(100) + common + draw(100) for _ in range(3 * MOST)]
    texts += [draw(90) + passage + draw(90) for passage in rare for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "_resolve", guarded)
    found = suffix_dedup.covered(docs, LENGTH, filter_bits=3, shard_contexts=MOST).collect()
    assert {(r["uid"], p) for r in found for p in range(r["lo"], r["hi"])} == spans_of(texts)
