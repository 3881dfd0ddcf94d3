"""Removal of long byte strings that occur more than once, with suffix arrays over shards of the corpus.

Every string of ``length`` bytes has an anchor: of its 64-byte grams the one with the smallest hash, the leftmost
of equals. Equal strings have equal anchors at equal offsets, so they meet where anchors are dealt out by
their hash. The strings that have an anchor in common follow each other; what they cover is its context.

1. Anchors are dealt out by hash with a digest of their context, copies counted before the shuffle. A context
   that occurs twice is covered as a whole. An anchor hash with several contexts needs their bytes.
2. The texts are read again and only the contexts of such anchors (told by a bit filter of fixed size, whose false
   hits cost time and nothing else; anchors of step 3 among them are dropped by an exact join) are dealt out to
   shards. Each shard sorts its suffixes by induction and
   compares neighbours over their first ``length`` bytes: strings equal over ``length`` bytes from different places
   are covered.
3. Anchors with more contexts than a shard should hold are resolved by digests of their single strings, which
   spread over all workers.

Coverage is judged on the input; then the covered bytes are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from costproof.llm.common import broadcast_below, stored
from costproof.llm.suffix_arrays import agrees, suffix_array
from costproof.llm.texts import utf8

LENGTH = 200
GRAM = 64
# Texts are scanned in parts of at most this many bytes; positions in a part fit in so many bits.
PART_BITS = 20
# Bits of the filter, and contexts of one anchor hash that a shard sorts itself.
FILTER_BITS = 27
SHARD_CONTEXTS = 20_000
SHARD_BYTES = 1 << 20
TEXT_BYTES = 1 << 22
# Odd multipliers that double a gram's hash from 1 to 64 bytes, and the last mix.
DOUBLINGS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
MIX = 0x9FB21C651E98DF25

ANCHORS = pa.schema(
    [("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]
)
CONTEXTS = pa.schema(
    [("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("data", pa.binary())]
)
SPANS = pa.schema([("uid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
STRINGS = pa.schema(
    [("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64())]
)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = data.astype(np.uint64) + np.uint64(1)
    for level, factor in enumerate(DOUBLINGS):
        half = 1 << level
        h = h[:-half] * np.uint64(factor) + h[half:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(32)
    return h


def _window_minima(keys: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size`` consecutive keys."""
    n = len(keys)
    rows = -(-n // size)
    padded = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(rows, size)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - size + 1], behind[size - 1 : n])


def _anchors(parts: list[tuple[int, int, int, bytes]], length: int) -> np.ndarray:
    """Rows of documents, places, begins and ends of contexts, and hashes of all anchors in parts ``(document, begin, strings, bytes)``.

    ``strings`` tells how many strings start in the part. A context runs from the first string of its anchor to the last one's end.
    """
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    sizes = np.array([len(p[3]) for p in parts])
    starts = np.cumsum(sizes) - sizes
    hashes = _gram_hashes(data)
    low = np.uint64((1 << PART_BITS) - 1)
    minima = _window_minima((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1)
    strings = np.array([p[2] for p in parts])
    total = int(strings.sum())
    own = np.repeat(np.arange(len(parts)), strings)
    at = np.arange(total) - np.repeat(np.cumsum(strings) - strings, strings) + np.repeat(starts, strings)
    found = (minima[at] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    last = np.append(first[1:], total) - 1
    part = own[first]
    docs = np.array([p[0] for p in parts])[part]
    shift = np.array([p[1] for p in parts])[part] - starts[part]
    return np.stack([docs, found[first] + shift, at[first] + shift, at[last] + length + shift, hashes[found[first]].view(np.int64)])


def _joined(texts: list[bytes], length: int) -> Iterator[np.ndarray]:
    """The anchors of texts, in order; a context that two parts of a text share is whole again."""
    held = np.empty((5, 0), np.int64)
    for group in _parts(texts, length):
        found = np.concatenate([held, _anchors(group, length)], axis=1)
        first = np.flatnonzero(np.append(True, (found[:2, 1:] != found[:2, :-1]).any(axis=0)))
        whole = found[:, first]
        whole[3] = found[3, np.append(first[1:], found.shape[1]) - 1]
        held = whole[:, -1:]
        yield whole[:, :-1]
    yield held


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Texts in groups of parts that are scanned together; long ones are cut with overlap."""
    most = 1 << PART_BITS
    step = most - length
    group, size = [], 0
    for doc, text in enumerate(texts):
        for begin in range(0, len(text) - length + 1, step):
            part = text[begin : begin + step + length - 1]
            if size + len(part) > most:
                yield group
                group, size = [], 0
            group.append((doc, begin, len(part) - length + 1, part))
            size += len(part)
    if group:
        yield group


def _contexts(texts: list[bytes], length: int, wanted=None) -> Iterator[tuple]:
    """``(document, lo, hi, hash, digest)`` of the anchors of texts, or of those whose hash is wanted."""
    for found in _joined(texts, length):
        if wanted is not None:
            found = found[:, wanted(found[4])]
        for doc, at, lo, hi, h in zip(*found.tolist(), strict=True):
            yield doc, lo, hi, h, xxhash.xxh3_128_digest(texts[doc][lo:hi], seed=at - lo)


def _counted(rows: Iterator[tuple]) -> tuple[tuple[np.ndarray, ...], list[tuple]]:
    """``h, c1, c2, n, document, lo, hi``, once per hash and context, with its number of occurrences; and all of the contexts seen twice."""
    columns = list(zip(*rows, strict=True)) or [()] * 5
    doc, lo, hi, h = (np.array(c, np.int64) for c in columns[:4])
    c1, c2 = np.frombuffer(b"".join(columns[4]), np.int64).reshape(-1, 2).T
    order = np.lexsort((c2, c1, h))
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in (h, c1, c2)], axis=0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    one, twice = order[first], order[np.repeat(n > 1, n)]
    spans = list(zip(doc[twice].tolist(), lo[twice].tolist(), hi[twice].tolist(), strict=True))
    return (h[one], c1[one], c2[one], n, doc[one], lo[one], hi[one]), spans


def _merged(spans: list[tuple]) -> list[tuple]:
    """Spans ``(uid, lo, hi)`` that touch or overlap as one."""
    out: list[list] = []
    for uid, lo, hi in sorted(spans):
        if out and out[-1][0] == uid and lo <= out[-1][2]:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([uid, lo, hi])
    return [tuple(x) for x in out]


def _columns(columns: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return _columns(tuple(zip(*rows, strict=True)) if rows else tuple([] for _ in schema), schema)


def _texts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and bytes of a batch's texts that hold any string, some megabytes at a time."""
    uids, texts, size = [], [], 0
    for uid, text in zip(batch["uid"].to_pylist(), utf8(batch["text"]), strict=True):
        if text and len(text) >= length:
            uids.append(uid)
            texts.append(text)
            size += len(text)
        if size >= TEXT_BYTES:
            yield uids, texts
            uids, texts, size = [], [], 0
    if texts:
        yield uids, texts


def _scan(length: int):
    """Anchors with counted contexts; rows without a hash are spans that are already covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, texts in _texts(batch, length):
                (h, c1, c2, n, doc, lo, hi), spans = _counted(_contexts(texts, length))
                yield _columns((h, c1, c2, n, np.array(uids)[doc], lo, hi), ANCHORS)
                rows = [(uids[doc], None, None, None, uids[doc], lo, hi) for doc, lo, hi in _merged(spans)]
                yield _batch(rows, ANCHORS)

    return run


def _filter_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit per possible leading ``bits`` bits of a hash: of fixed size, whatever the corpus."""
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    packed = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
    found = packed.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in found.toLocalIterator():
        begin = (row["b"] - 1) * 4096
        piece = np.frombuffer(bytes(row["m"]), np.uint8)[: len(out) - begin]
        out[begin : begin + len(piece)] = piece
    return out


def _in_filter(packed: np.ndarray, bits: int):
    def wanted(hashes: np.ndarray) -> np.ndarray:
        place = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        return (packed[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    return wanted


def _fetch(length: int, packed, bits: int):
    """Contexts of the anchors in the filter, with their bytes, once per hash and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _in_filter(packed.value, bits)
        for batch in batches:
            for uids, texts in _texts(batch, length):
                (h, c1, c2, n, doc, lo, hi), _ = _counted(_contexts(texts, length, wanted))
                data = [texts[d][a:b] for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                yield _columns((h, c1, c2, n, np.array(uids)[doc], lo, data), CONTEXTS)

    return run


def _fetch_strings(length: int, packed, bits: int):
    """Digests of all strings around the anchors in the filter: for hashes with very many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _in_filter(packed.value, bits)
        for batch in batches:
            for uids, texts in _texts(batch, length):
                rows = []
                counted, _ = _counted(_contexts(texts, length, wanted))
                for n, doc, lo, hi in zip(*(c.tolist() for c in counted[3:]), strict=True):
                    for at in range(lo, hi - length + 1):
                        digest = xxhash.xxh3_128_digest(texts[doc][at : at + length])
                        rows.append((*np.frombuffer(digest, np.int64).tolist(), n, uids[doc], at))
                    if len(rows) >= 1 << 16:
                        yield _batch(rows, STRINGS)
                        rows = []
                yield _batch(rows, STRINGS)

    return run


def repeated(data: tuple, uids: tuple, begins: tuple, many: tuple, length: int) -> list[tuple]:
    """Spans ``(uid, lo, hi)`` of the strings in ``data`` that start at two places or in a context of ``many``.

    ``data[i]`` stands at ``begins[i]`` in the text ``uids[i]``; parts of one text may overlap.
    """
    sizes = np.array([len(d) for d in data])
    starts = np.cumsum(sizes) - sizes
    whole = b"".join(data)
    order = suffix_array(whole)
    part = np.repeat(np.arange(len(data)), sizes)
    fits = np.arange(len(whole)) + length <= (starts + sizes)[part]
    order = order[fits[order]]
    if not len(order):
        return []
    runs = np.flatnonzero(~agrees(whole, order, length))
    _, text = np.unique(np.array(uids), return_inverse=True)
    places = np.array(begins)[part] + np.arange(len(whole)) - starts[part]
    origin = (text[part].astype(np.int64) << 40 | places)[order]
    twice = np.minimum.reduceat(origin, runs) != np.maximum.reduceat(origin, runs)
    twice |= np.maximum.reduceat(np.array(many)[part][order].astype(np.int8), runs) > 0
    hit = order[np.repeat(twice, np.diff([*runs, len(order)]))]
    hit = hit[np.lexsort((places[hit], text[part[hit]]))]
    if not len(hit):
        return []
    at, of = places[hit], text[part[hit]]
    new = np.ones(len(hit), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] > at[:-1] + length)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(hit)) - 1
    owner = np.array(uids)[part[hit[firsts]]]
    return list(zip(owner.tolist(), at[firsts].tolist(), (at[lasts] + length).tolist(), strict=True))


def _resolve(length: int):
    """Spans that suffix arrays find, whole groups of equal anchor hashes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        group: list[list] = []
        size = 0

        def close() -> None:
            nonlocal size
            if len(group) > 1:
                held.extend(group)
                size += sum(len(x[0]) for x in group)
            group.clear()

        last = None
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("h", "c1", "c2", "uid", "lo", "n"))
            for h, c1, c2, uid, lo, n, data in zip(*columns, utf8(batch["data"]), strict=True):
                if last and last[0] != h:
                    close()
                    if size >= SHARD_BYTES:
                        yield _batch(repeated(*zip(*held, strict=True), length), SPANS)
                        held, size = [], 0
                if last == (h, c1, c2) and group:
                    group[-1][3] = True
                else:
                    group.append([data, uid, lo, n > 1])
                last = (h, c1, c2)
        close()
        if held:
            yield _batch(repeated(*zip(*held, strict=True), length), SPANS)

    return run


def _by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def _by_digest(texts: DataFrame, hashes: DataFrame, length: int, filter_bits: int) -> DataFrame:
    """Spans of the strings around the anchors ``hashes`` that occur in two contexts or more."""
    packed = texts.sparkSession.sparkContext.broadcast(_filter_bits(hashes, filter_bits))
    kinds = "w1 long, w2 long, n long, uid long, lo long"
    strings = stored(texts.mapInArrow(_fetch_strings(length, packed, filter_bits), kinds), "strings")
    place = F.struct("uid", "lo")
    counts = strings.groupBy("w1", "w2").agg(F.max("n").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    twice = stored(counts.where("n > 1 or a <> b").select("w1", "w2"), "repeated-strings")
    return strings.join(twice, ["w1", "w2"]).select("uid", "lo", (F.col("lo") + length).alias("hi"))


def covered(texts: DataFrame, length: int = LENGTH, filter_bits: int = FILTER_BITS, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``uid, lo, hi``: spans of bytes under strings that start at two places or more; spans may overlap.

    ``texts`` has ``uid``, unique and fixed, and ``text``.
    """
    spark = texts.sparkSession
    anchors = texts.mapInArrow(_scan(length), "h long, c1 long, c2 long, n long, uid long, lo long, hi long")
    same = F.sum("n").over(_by("h", "c1", "c2"))
    lone = F.when(F.col("n").isNotNull(), same == 1)
    dealt = anchors.repartition("h").withColumn("lone", lone)
    for end, pick in (("least", F.min), ("most", F.max)):
        dealt = dealt.withColumn(end, pick(F.when(F.col("n").isNotNull(), F.struct("c1", "c2"))).over(_by("h")))
    dealt = dealt.withColumn("several", F.coalesce(F.col("least") != F.col("most"), F.lit(False)))
    dealt = dealt.withColumn("contexts", F.count("n").over(_by("h")))
    known = stored(
        dealt.where("several or lone = false or n is null").select("h", "several", "contexts", "lone", "uid", "lo", "hi"),
        "anchors",
    )
    spans = known.where("lone = false or lone is null").select("uid", "lo", "hi")
    open_anchors = known.where("several")
    small = open_anchors.where(F.col("contexts") <= shard_contexts).select("h").distinct()
    large = stored(open_anchors.where(F.col("contexts") > shard_contexts).select("h").distinct(), "large-anchors")
    any_large = not large.isEmpty()
    packed = spark.sparkContext.broadcast(_filter_bits(small, filter_bits))
    kinds = "h long, c1 long, c2 long, n long, uid long, lo long, data binary"
    contexts = texts.mapInArrow(_fetch(length, packed, filter_bits), kinds)
    if any_large:  # the filter may let them through, and a shard would hold all their contexts
        contexts = contexts.join(broadcast_below(large, F.lit(8)), "h", "left_anti")
    shards = contexts.repartition("h").sortWithinPartitions("h", "c1", "c2")
    spans = spans.unionByName(shards.mapInArrow(_resolve(length), "uid long, lo long, hi long"))
    if not any_large:
        return spans
    return spans.unionByName(_by_digest(texts, large, length, filter_bits))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    filter_bits: int = FILTER_BITS,
    shard_contexts: int = SHARD_CONTEXTS,
) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row of ``docs``.

    ``spans`` are the maximal removed runs ``<lo, hi>`` of bytes, ``kept`` the bytes that remain. A null text is an
    empty one; texts shorter than ``length`` keep everything; repeated rows are copies, so all their bytes go
    when they are long enough; ids, null ones too, play no part. An empty table gives no rows.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    texts = stored(source, "texts")
    found = covered(texts.select("uid", "text"), length, filter_bits, shard_contexts)
    runs = stored(found.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "covered")
    out = texts.join(runs, "uid", "left").withColumn("cut", _cut(F.col("text"), F.col("spans")))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "cut.spans", "cut.kept")


def _cut(text: Column, spans: Column) -> Column:
    """``struct<spans, kept>``: sorted spans as maximal runs, and the bytes outside them."""

    @F.arrow_udf("spans array<struct<lo:bigint,hi:bigint>>, kept binary")
    def of(data: pa.Array, found: pa.Array) -> pa.Array:
        runs, kept = [], []
        for whole, row in zip(utf8(data), found.to_pylist(), strict=True):
            whole = whole or b""
            merged = _merged([(0, x["lo"], x["hi"]) for x in row or []])
            ends = [0, *(hi for _, _, hi in merged)]
            starts = [*(lo for _, lo, _ in merged), len(whole)]
            kept.append(b"".join(whole[a:b] for a, b in zip(ends, starts, strict=True)))
            runs.append([{"lo": lo, "hi": hi} for _, lo, hi in merged])
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(runs, kind), pa.array(kept, pa.binary())], ["spans", "kept"])

    return of(text, spans)
