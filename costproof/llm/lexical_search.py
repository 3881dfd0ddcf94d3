"""Ranked lexical search: branch and bound over trees of documents that share frequent terms.

One scan turns each document into its length and the counts of those terms that some item asks for; the
same rows give the number of documents and terms and each term's document frequency. A task then takes its
documents in blocks. In a block, every document is the list of its terms, the most frequent term first, and
lists that begin alike share a path of a tree. A subtree knows the largest count of each term and the
smallest length norm below it, so its documents' scores have an exact whole-number bound; per item the tree
is walked depth first, the better branch first, and a branch goes when its bound is below the k-th score
found so far in the task. Subtrees of a few documents are scored at once. Every task sends at most ``k`` rows
per item.

Items go to the tasks in shards of a proven size (``ITEM_BYTES`` of distinct terms and one item at most);
each shard reads the documents once, and inside a task items whose terms exceed ``GROUP_TERMS`` get a tree of
their own, so memory is bounded by a block whatever the numbers of items and documents.

Defined results: null and empty texts have no terms; a document without terms counts nowhere, an item
without terms has no rows. Every row is a document and every row of ``items`` an item, repeated ids or not.
Equal scores go by ascending id, null ids last. Texts are read whole, a megabyte at a time. No documents give
an empty result. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costproof.llm.common import stored
from costproof.llm.texts import CHUNK, utf8

# Bytes of distinct item terms that one scan looks for.
ITEM_BYTES = 1 << 20
# Distinct terms that one tree holds, counts in a block (documents times terms), documents of a leaf.
GROUP_TERMS = 8192
CELLS = 8 << 20
LEAF = 32
# Documents scored in one go, and buckets of the first of two rankings.
TOGETHER = 256
SALTS = 64
LAST = np.iinfo(np.int64).max

# Bytes that are in a term, lower-cased; all others become spaces.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    spaced = text.translate(_LETTERS)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + CHUNK)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, terms``: the distinct terms of each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w for part in words(t or b"") for w in part}) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    rows = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(run, f"item {kind}, terms array<binary>").where(F.size("terms") > 0)


def term_counts(documents: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``doc, n, terms, tf`` of every document with a term: its length, and counts of terms of the vocabulary."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # ITEM_BYTES and one item at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            lengths, ends, terms, tf = [], [0], [], []
            for text in utf8(batch.column("text")):
                n, seen = 0, Counter()
                for part in words(text or b""):
                    n += len(part)
                    seen.update(map(get, part))
                seen.pop(None, None)
                lengths.append(n)
                terms.extend(seen.keys())
                tf.extend(seen.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(lengths, pa.int64()), *lists], ["doc", "n", "terms", "tf"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tf array<int>").where("n > 0")


def document_frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; counted by every task before rows move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in vectors.mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def grouped(items: list[tuple[int, np.ndarray]], limit: int) -> list[list[int]]:
    """Positions of items in groups of at most ``limit`` distinct terms; an item with more is alone."""
    groups, seen = [], set()
    for at, (_, terms) in enumerate(items):
        more = seen.union(terms.tolist())
        if not groups or len(more) > limit:
            groups.append([])
            more = set(terms.tolist())
        groups[-1].append(at)
        seen = more
    return groups


class Best:
    """The ``k`` best documents of an item so far and the least score that can still matter."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores = self.ids = np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        near = scores >= self.least
        if not near.any():
            return
        scores = np.concatenate([self.scores, scores[near]])
        ids = np.concatenate([self.ids, ids[near]])
        unnamed = np.concatenate([self.unnamed, unnamed[near]])
        first = np.lexsort((unnamed, ids, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[first], ids[first], unnamed[first]
        if len(first) == self.k:
            self.least = max(1, int(self.scores[-1]))


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The factor of each count in a score; grows with the count and falls with the norm."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None])


class Tree:
    """Documents of a block by their terms in order of frequency, with bounds for every subtree.

    Column c of ``tf`` is the c-th most frequent term. Rows are sorted so that documents with a common
    beginning are neighbours; ``apart`` says at which column two neighbours part. A node is a range of
    rows that agree before some column; it splits where its rows part first, those with that term and
    those that go on without it.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, leaf: int = LEAF):
        held = np.packbits(tf > 0, axis=1)
        keys = [row.tobytes() for row in ~held]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        self.tf, self.m, self.ids, self.unnamed = tf[order], m[order], ids[order], unnamed[order]
        held = held[order]
        change = held[1:] ^ held[:-1]
        octet = (change != 0).argmax(axis=1)
        first = np.unpackbits(change[np.arange(len(change)), octet][:, None], axis=1).argmax(axis=1)
        apart = np.where(change.any(axis=1), octet * 8 + first, tf.shape[1])
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self._split(apart, leaf)
        self.most = np.zeros((len(self.spans), tf.shape[1]), tf.dtype)
        self.least_m = np.zeros(len(self.spans), np.int64)
        for node in range(len(self.spans) - 1, -1, -1):  # children come after their parent
            lo, hi = self.spans[node]
            if self.children[node] is None:
                self.most[node], self.least_m[node] = self.tf[lo:hi].max(axis=0), self.m[lo:hi].min()
            else:
                a, b = self.children[node]
                np.maximum(self.most[a], self.most[b], out=self.most[node])
                self.least_m[node] = min(self.least_m[a], self.least_m[b])

    def _split(self, apart: np.ndarray, leaf: int) -> None:
        todo = [(0, len(self.m), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            at = int(apart[lo : hi - 1].argmin()) if hi - lo > leaf else 0
            if hi - lo > leaf and apart[lo + at] < self.tf.shape[1]:  # else few, or copies of each other
                cut = lo + at + 1
                todo += [(cut, hi, node, 1), (lo, cut, node, 0)]

    def search(self, columns: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer every document that can be among the best of an item with these terms."""
        bounds = (parts(self.most[:, columns], self.least_m) @ weights).tolist()
        stack, waiting, rows = [0], [], 0
        while stack:
            node = stack.pop()
            if bounds[node] < best.least:
                continue
            if self.children[node] is not None:
                a, b = self.children[node]
                stack += [a, b] if bounds[b] > bounds[a] else [b, a]
                continue
            lo, hi = self.spans[node]
            waiting.append(np.arange(lo, hi))
            rows += hi - lo
            if rows >= TOGETHER:
                self._score(np.concatenate(waiting), columns, weights, best)
                waiting, rows = [], 0
        if waiting:
            self._score(np.concatenate(waiting), columns, weights, best)

    def _score(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, best: Best) -> None:
        scores = parts(self.tf[rows[:, None], columns], self.m[rows]) @ weights
        best.add(scores, self.ids[rows], self.unnamed[rows])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple]:
    """``ids, unnamed, n, row, term, tf`` of about ``rows`` documents at a time, counts as coordinates."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            lengths = np.diff(part.column("terms").offsets.to_numpy())
            yield (
                part.column("doc").fill_null(LAST).to_numpy(),
                part.column("doc").is_null().to_numpy(zero_copy_only=False),
                part.column("n").to_numpy(),
                np.repeat(np.arange(part.num_rows), lengths),
                part.column("terms").flatten().to_numpy(),
                part.column("tf").flatten().to_numpy(),
            )


def _searched(vectors: DataFrame, items: list[tuple[int, np.ndarray]], df: np.ndarray, docs: int, terms: int, k: int) -> DataFrame:
    """``item, doc, score``: every task's best documents of each item."""
    weight = np.array([math.floor(1000 * math.log((2.0 * docs + 2.0) / (2.0 * d + 1.0))) for d in df.tolist()], np.int64)
    groups = []
    for group in grouped(items, GROUP_TERMS):
        of_group = np.unique(np.concatenate([items[i][1] for i in group]))
        of_group = of_group[np.lexsort((of_group, -df[of_group]))]
        place = np.full(len(df), -1, np.int64)
        place[of_group] = np.arange(len(of_group))
        groups.append((place, len(of_group), [(i, np.sort(place[items[i][1]])) for i in group], weight[of_group]))
    shared = vectors.sparkSession.sparkContext.broadcast(groups)
    rows = max(LEAF, CELLS // max((g[1] for g in groups), default=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for ids, unnamed, n, row, term, tf in _blocks(batches, rows):
            m = 50 + (50 * n * docs) // terms
            for place, width, wanted, weights in shared.value:
                column = place[term]
                mine = column >= 0
                used, dense = np.unique(row[mine], return_inverse=True)
                if not len(used):
                    continue
                counts = np.zeros((len(used), width), np.int32)
                counts[dense, column[mine]] = tf[mine]
                tree = Tree(counts, m[used], ids[used], unnamed[used])
                for i, columns in wanted:
                    tree.search(columns, weights[columns], best[i])
        for (ordinal, _), found in zip(items, best):
            doc = pa.array(found.ids, mask=found.unnamed)
            arrays = [pa.array(np.full(len(doc), ordinal, np.int64)), doc, pa.array(found.scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "doc", "score"])

    return vectors.mapInArrow(run, "item long, doc long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item, ranked; first within salted parts, so that no group is large."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).orderBy(*order)
    kept = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents that score highest for each item."""
    spark = documents.sparkSession
    wanted = item_terms(items, item_id, item_text)
    kind = wanted.schema["item"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = None
    for shard in _shards(wanted):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in shard))))}
        vectors = stored(term_counts(documents, vocabulary, doc_id, text), "terms")
        if whole is None:  # the same for every shard
            whole = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not whole[0]:
            break
        asked = [(i, np.array([vocabulary[t] for t in terms], np.int64)) for i, (_, terms) in enumerate(shard)]
        top = _top(_searched(vectors, asked, document_frequencies(vectors, len(vocabulary)), *whole, k), k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(shard)], f"item long, item_id {kind}")
        top = top.join(F.broadcast(names), "item")  # one shard
        top = top.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
        found = found.unionByName(stored(top, "found"))
    return found


def _shards(wanted: DataFrame) -> Iterator[list[tuple]]:
    """Items with their terms, as many at a time as ``ITEM_BYTES`` allow; the driver holds one shard."""
    shard, size = [], 0
    for row in wanted.toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        shard.append((row["item"], terms))
        size += sum(map(len, terms))
        if size >= ITEM_BYTES:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard
