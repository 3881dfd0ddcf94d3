"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints. The embedding is kept in unary
(the bits of each segment sorted), so that distance is the bit count of an exclusive or.

The range join within distance ``bits`` runs over grids: the segments are dealt into ``bits + 2`` groups, and
two points within the range agree in at least two whole groups. A grid cell is the point's place in two of
the groups; points of a cell are compared by Manhattan distance first, then by the exact Hamming distance.

Dense groups don't give all their pairs: each cell first links its members to one of them; afterwards only
members of different components are compared, the largest component of a cell against the rest.

Removal of near-duplicates links by the share of common shingles, counted on the texts. Its candidates are the groups of
linked fingerprints and, as 64 bits miss most pairs at that share, bands of least hashes of the shingles beside them. What
shares a group or a band is linked in the same two steps, by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from costproof.llm.common import key_of, only, stored
from costproof.llm.components import components
from costproof.llm.texts import chunks, utf8

# The seed of the shingle hashes.
SEED = 42
WORDS = 4
BITS = 4
# For removing near-duplicates: longer shingles, and bands of least hashes that make further candidates.
DEDUP_WORDS = 5
BANDS, ROWS = 30, 5
# Near-duplicates have ALIKE of OF shingles in common or more; places of the parity masks.
ALIKE, OF = 4, 5
SKETCH = 512
_LOW = 0x5555555555555555


def _word_runs(text: bytes, words: int):
    """Runs of lower-cased words that overlap by ``words - 1``, so that a long text is never split whole."""
    tail: list[bytes] = []
    for part in chunks(text):
        tail += part.lower().split()
        yield tail
        tail = tail[max(0, len(tail) - words + 1) :]


def _shingle_hashes(run: list[bytes], words: int) -> np.ndarray:
    joined = b" ".join(run)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)], np.uint64
    )


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Hashes of the same shingles for a further fingerprint; the first takes them as they are."""
    if turn:
        hashes = hashes ^ (hashes >> np.uint64(31)) ^ np.uint64(turn)
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
    return hashes


def _set_bits(hashes: np.ndarray, turns: int = 1) -> np.ndarray:
    """How many of the hashes have each bit set, a row per turn."""
    ones = np.zeros((turns, 64), np.int64)
    for i in range(0, len(hashes), 1 << 15):
        for turn in range(turns):
            part = _mixed(hashes[i : i + (1 << 15)], turn).view(np.uint8).reshape(-1, 8)
            ones[turn] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _majority(ones: np.ndarray, total: int) -> list[int]:
    """The bits that are set in over half of ``total`` hashes, as signed numbers."""
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprint(text: bytes | None, words: int = WORDS, turns: int = 1) -> list[int]:
    """Signed 64-bit SimHashes of a text: a bit is set if it is set in over half the shingle hashes."""
    total, ones, short = 0, np.zeros((turns, 64), np.int64), []

    def count(hashes: np.ndarray) -> None:
        nonlocal total, ones
        total += len(hashes)
        ones += _set_bits(hashes, turns)

    for run in _word_runs(text or b"", words):
        if len(run) < words:
            short = run
        else:
            count(_shingle_hashes(run, words))
    if not total and short:
        count(_shingle_hashes(short, len(short)))
    return _majority(ones, total)


def fingerprints(text: Column, words: int = WORDS, turns: int = 1) -> Column:
    """Fingerprints of a text column, as an array; a text without words, or null, has zeros."""

    @F.arrow_udf(ArrayType(LongType()))
    def of(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words, turns) for t in utf8(column)], pa.list_(pa.int64()))

    return of(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def embedding(fp: Column) -> Column:
    """Counts of the two-bit segments in unary: each segment's bits sorted."""
    low, half = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def distance(a: Column, b: Column) -> Column:
    """Differing bits: Hamming of fingerprints, Manhattan of embeddings."""
    return F.bit_count(a.bitwiseXOR(b))


def _groups(bits: int) -> list[int]:
    """Masks of ``bits + 2`` groups of whole segments."""
    edges = [round(32 * i / (bits + 2)) * 2 for i in range(bits + 3)]
    return [_signed((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def _cells(points: DataFrame, bits: int) -> DataFrame:
    """A row per point and grid: the pair of groups and the point's place in them."""
    masks = _groups(bits)
    grids = [
        F.struct(F.lit(1 << i | 1 << j).alias("grid"), F.col("u").bitwiseAND(F.lit(masks[i] | masks[j])).alias("cell"))
        for i, j in combinations(range(len(masks)), 2)
    ]
    return points.withColumn("u", embedding(F.col("fp"))).withColumn("g", F.explode(F.array(*grids))).select("*", "g.*").drop("g")


def _near(a: str, b: str, bits: int) -> Column:
    """Manhattan distance in range, then the exact distance."""
    close = distance(F.col(f"{a}.u"), F.col(f"{b}.u")) <= bits
    return close & (distance(F.col(f"{a}.fp"), F.col(f"{b}.fp")) <= bits)


def linked(points: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp, root`` of every distinct fingerprint that is within ``bits`` of another one."""
    cells = _cells(points.select("fp"), bits)
    hubs = cells.groupBy("grid", "cell").agg(F.min("fp").alias("fp"), F.max("fp").alias("last")).where("fp <> last")
    hubs = hubs.withColumn("u", embedding(F.col("fp"))).drop("last")
    stars = (
        cells.alias("x")
        .join(hubs.alias("y"), ["grid", "cell"])
        .where((F.col("x.fp") > F.col("y.fp")) & _near("x", "y", bits))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    first = components(stars)
    named = stored(
        points.select("fp")
        .join(first.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root")),
        "star-roots",
    )
    cells = _cells(named, bits)
    mixed = (
        cells.groupBy("grid", "cell", "root").count().groupBy("grid", "cell")
        .agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots"))
        .where("roots > 1").drop("roots")
    )
    fewer = cells.join(mixed, ["grid", "cell"]).where("root <> most")
    bridges = (
        fewer.alias("x")
        .join(cells.alias("y"), ["grid", "cell"])
        .where((F.col("x.root") != F.col("y.root")) & _near("x", "y", bits))
        .where((F.col("x.fp") < F.col("y.fp")) | (F.col("y.root") == F.col("x.most")))
        .select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    )
    second = components(bridges)
    ends = second.select(F.col("node").alias("root"), F.col("root").alias("final"))
    return named.join(ends, "root", "left").select("fp", F.coalesce("final", "root").alias("root"))


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Fingerprints link at ``bits`` or fewer differing bits; ``component_id`` is the smallest id reachable.
    Null, empty and word-free texts have fingerprint zero, which links like any other. Rows with a null
    id take part in links; a component without any id has a null ``component_id``. Repeated rows
    have equal fingerprints, hence one component. An empty table gives no rows.
    """
    prints = stored(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words)[0].alias("fp")), "fingerprints"
    )
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = stored(linked(points, bits), "fingerprint-roots")
    named = points.join(roots, "fp")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _profile(text: bytes | None, words: int, factors: np.ndarray) -> tuple[int, list[int], list[int], int]:
    """Number of different shingles, the parity of how many fall to each of 512 places, a cell per band, the SimHash.

    Two parity masks never differ in more bits than the sets of shingles have shingles of their own. A band's cell is
    ``ROWS`` least hashes, each under a factor of its own, so two texts share it with the power ``ROWS`` of their similarity.
    """
    hashes = _hashes(text, words)
    own = np.unique(hashes)
    odd = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    least = np.full(factors.shape[1], np.iinfo(np.uint64).max, np.uint64)
    mixed = own ^ (own >> np.uint64(31))
    for i in range(0, len(own), 1 << 12):
        part = mixed[i : i + (1 << 12), None] * factors[0] + factors[1]
        least = np.minimum(least, part.min(axis=0))
    digest = xxhash.xxh64_intdigest
    cells = np.array([digest(band.tobytes(), i) for i, band in enumerate(least.reshape(-1, ROWS))], np.uint64)
    sketch = np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()
    return len(own), sketch, cells.view(np.int64).tolist(), _majority(_set_bits(hashes), len(hashes))[0]


def _hashes(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of a text's shingles; a shorter text is one shingle, and one without words the empty one."""
    found, short = [], []
    for run in _word_runs(text or b"", words):
        if len(run) < words:
            short = run
        else:
            found.append(_shingle_hashes(run, words))
    return np.concatenate(found) if found else _shingle_hashes(short, max(1, len(short)))


def shingles(text: bytes | None, words: int) -> set[bytes]:
    """The set of a text's shingles themselves, as ``_hashes`` has their hashes."""
    found, short = set(), []
    for run in _word_runs(text or b"", words):
        if len(run) < words:
            short = run
        else:
            found.update(b" ".join(run[i : i + words]) for i in range(len(run) - words + 1))
    return found or {b" ".join(short)}


def profiles(text: Column, words: int, bands: int = BANDS) -> Column:
    """``struct<n, sketch, cells, fp>`` of a text column: what chooses the pairs that are compared."""

    @F.arrow_udf("n long, sketch array<bigint>, cells array<bigint>, fp long")
    def of(column: pa.Array) -> pa.Array:
        factors = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (2, bands * ROWS), np.uint64)
        factors[0] |= np.uint64(1)
        rows = [_profile(t, words, factors) for t in utf8(column)]
        longs = pa.list_(pa.int64())
        kinds = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), longs, longs, pa.int64()))]
        return pa.StructArray.from_arrays(kinds, ["n", "sketch", "cells", "fp"])

    return of(text)


def _may_be_similar(a: str, b: str) -> Column:
    """False only for pairs whose similarity is certainly below ``ALIKE`` of ``OF``: by sizes, then by parities."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = F.least(n, m) * OF >= F.greatest(n, m) * ALIKE
    apart = reduce(Column.__add__, [distance(F.col(f"{a}.sketch")[i], F.col(f"{b}.sketch")[i]) for i in range(SKETCH // 64)])
    return sizes & (apart * (OF + ALIKE) <= (n + m) * (OF - ALIKE))


def _similar(a: Column, b: Column, words: int) -> Column:
    """Whether the sets of shingles of two texts have Jaccard similarity ``ALIKE`` of ``OF`` or more, exactly."""

    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, theirs = [], None, set()
        for x, y in zip(utf8(left), utf8(right), strict=True):
            if y != last or not theirs:
                last, theirs = y, shingles(y, words)
            own = shingles(x, words)
            both = len(own & theirs)
            out.append(both * OF >= (len(own) + len(theirs) - both) * ALIKE)
        return pa.array(out, pa.bool_())

    return of(a, b)


def _edges(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar."""
    own = texts.select(F.col("uid").alias("a"), F.col("text").alias("own"))
    theirs = texts.select(F.col("uid").alias("b"), F.col("text").alias("theirs"))
    both = pairs.distinct().join(own, "a").join(theirs, "b")
    return stored(both.where(_similar(F.col("own"), F.col("theirs"), words)).select("a", "b"), "similar")


def similar_groups(points: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, bits: int = BITS) -> DataFrame:
    """``node, root`` of every point that is similar to another one, over similar pairs that share a cell.

    ``points`` has ``uid, n, sketch, cells, fp``; ``texts_of`` gives ``uid, text`` of given points. A group of fingerprints
    linked within ``bits`` is a cell, beside the bands. Every cell first links its points to one of them; then only points
    of different components are compared, the largest of a cell against the rest. Cells and sketches choose what is
    compared; the texts decide.
    """
    prints = points.select("uid", "fp")
    linked_prints = stored(linked(prints.select("fp").distinct(), bits), "fingerprint-roots")
    groups = prints.join(linked_prints, "fp").select("uid", F.xxhash64(F.lit("fingerprints"), "root").alias("cell"))
    cells = points.select("uid", F.explode("cells").alias("cell")).unionByName(groups)
    hubs = cells.groupBy("cell").agg(F.min("uid").alias("hub"), F.max("uid").alias("last")).where("hub <> last").drop("last")
    live = stored(cells.join(hubs, "cell"), "shared-cells")
    marks = stored(points.drop("cells", "fp").join(live.select("uid"), "uid", "left_semi"), "shared-points")
    texts = stored(texts_of(marks), "shared-texts")
    marks = marks.select("uid", "n", "sketch")
    pairs = live.where("uid <> hub").select("uid", "hub").distinct()
    pairs = pairs.join(marks.alias("x"), "uid").join(marks.withColumnRenamed("uid", "hub").alias("y"), "hub")
    stars = _edges(pairs.where(_may_be_similar("x", "y")).select(F.col("uid").alias("a"), F.col("hub").alias("b")), texts, words)
    first = components(stars).withColumnRenamed("node", "uid")
    named = live.select("cell", "uid").join(marks.join(first, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "uid")
    named = stored(named, "star-roots")
    mixed = (
        named.groupBy("cell", "root").count().groupBy("cell")
        .agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots"))
        .where("roots > 1").drop("roots")
    )
    fewer = named.join(mixed, "cell").where("root <> most")
    bridges = (
        fewer.alias("x")
        .join(named.alias("y"), "cell")
        .where((F.col("x.root") != F.col("y.root")) & _may_be_similar("x", "y"))
        .where((F.col("x.uid") < F.col("y.uid")) | (F.col("y.root") == F.col("x.most")))
        .select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b"))
    )
    return components(stars.unionByName(_edges(bridges, texts, words)))


def near_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = DEDUP_WORDS,
    bands: int = BANDS,
    bits: int = BITS,
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; every column stays as it was.

    Rows link when their sets of ``words``-word shingles have Jaccard similarity 0.8 or more, which is counted on the
    texts of candidates: rows whose SimHashes are linked within ``bits`` differing bits, and rows that share one of ``bands``
    cells of least hashes. Of a group the smallest id stays (null ids come last; of repeated ids the first row read). Null,
    empty and word-free texts are one group. An empty table stays empty.
    """
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            key_of(doc_id, text).alias("key"),
            profiles(F.col(text), words, bands).alias("p"),
        ),
        "profiles",
    )
    points = rows.select("uid", "key", "p.*")

    def texts_of(wanted: DataFrame) -> DataFrame:
        texts = docs.select(key_of(doc_id, text).alias("key"), F.col(text).alias("text"))
        return wanted.select("uid", "key").join(texts.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "key").select("uid", "text")

    groups = similar_groups(points, texts_of, words, bits)
    grouped = rows.select("uid", "key").join(groups.withColumnRenamed("node", "uid"), "uid", "left")
    first = F.min(F.struct(F.col("key.id").isNull().alias("none"), F.col("key.id"), "uid", "key"))
    stay = grouped.groupBy(F.coalesce("root", "uid").alias("group")).agg(first.alias("f")).select("f.key")
    return only(docs, stay, doc_id, text)
