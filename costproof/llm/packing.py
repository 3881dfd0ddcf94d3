"""Harmonic packing of token ids into sequences of a fixed capacity.

Pieces fall into reciprocal-capacity classes 1, 1/2, 1/4, ... of the capacity. Documents may be cut, so each is
cut into pieces that fill their class exactly: as many whole sequences as it holds, then at most one piece
of each smaller class when the capacity is a power of two. A bin of class 1/k takes k pieces, whatever
documents they come from, so workers number their pieces on their own and only the counts meet. The pieces left over
at a class's end are split by powers of two, which need no padding either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof.llm.common import stored
from costproof.llm.texts import utf8
from costproof.llm.tokens import ID_BYTES, vocabulary, word_ids
from costproof.runtime import broadcast_if_small

CAPACITY = 4096
BATCH_BYTES = 1 << 22


def class_sizes(capacity: int) -> list[int]:
    """Piece lengths of the classes: the capacity halved until one token is left."""
    sizes = [capacity]
    while sizes[-1] > 1:
        sizes.append(sizes[-1] // 2)
    return sizes


def cuts(tokens: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How many pieces of each class documents of so many tokens are cut into, largest first."""
    counts = np.zeros((len(tokens), len(sizes)), np.int64)
    left = tokens.copy()
    for number, size in enumerate(sizes):
        counts[:, number], left = left // size, left % size
    return counts


def _lists(table: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(table.reshape(-1)))


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end: int = 2,
) -> DataFrame:
    """Every document's ids, ``end`` after them, in pieces; each worker counts its pieces of a class.

    A worker sends one row a document, with the number of its pieces of each class, where they start and
    how many the worker had before; Spark cuts the ids.
    """
    vocab, sizes = tokenizer or vocabulary(), class_sizes(capacity)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, before = TaskContext.get().partitionId(), np.zeros(len(sizes), np.int64)
        encode = word_ids(vocab).encode

        def rows(keys: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal before
            tokens = np.array([len(i) // ID_BYTES for i in ids], np.int64)
            counts = cuts(tokens, sizes)
            upto = np.cumsum(counts, axis=0)
            earlier, before = before + upto - counts, before + upto[-1]
            starts = np.cumsum(counts * np.array(sizes), axis=1) - counts * np.array(sizes)
            arrays = [
                pa.array(np.full(len(keys), worker, np.int32)), pa.array(keys, pa.int64()), pa.array(tokens),
                pa.array(ids, pa.binary()), _lists(counts), _lists(earlier), _lists(starts),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["worker", "doc_id", "doc_tokens", "ids", "counts", "earlier", "starts"])

        keys, held, size = [], [], 0
        for batch in batches:
            for key, whole in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                keys.append(key)
                held.append(encode(whole, end))
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield rows(keys, held)
                    keys, held, size = [], [], 0
        if keys:
            yield rows(keys, held)

    kinds = "worker int, doc_id long, doc_tokens long, ids binary, counts array<long>, earlier array<long>, starts array<long>"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = source.mapInArrow(encoded, kinds)
    length = F.array(*[F.lit(size) for size in sizes])

    def of_class(row: Column, number: Column) -> Column:
        size = F.get(length, number).cast("long")
        return F.transform(
            F.sequence(F.lit(0).cast("long"), row["counts"] - 1),
            lambda j: F.struct(
                number.alias("class"), (row["earlier"] + j).alias("nth"), (row["starts"] + j * size).alias("start"), size.alias("length")
            ),
        )

    rows = F.arrays_zip("counts", "earlier", "starts")
    none = F.array().cast("array<struct<class:int,nth:bigint,start:bigint,length:bigint>>")
    each = F.flatten(F.transform(rows, lambda row, number: F.when(row["counts"] > 0, of_class(row, number)).otherwise(none)))
    part = F.substring(F.col("ids"), (F.col("start") * ID_BYTES + 1).cast("int"), (F.col("length") * ID_BYTES).cast("int"))
    return whole.select("worker", "doc_id", "doc_tokens", "ids", F.inline(each)).select(
        "worker", "class", "nth", "doc_id", "start", "length", "doc_tokens", part.alias("ids")
    )


def _bins(total: int, size: int, capacity: int) -> list[tuple[int, int]]:
    """``(first rank, pieces a sequence)`` of a class's runs of sequences: full ones, then powers of two."""
    fill = capacity // size
    runs, at = [], total - total % fill
    if at:
        runs.append((0, fill))
    left = total - at
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            runs.append((at, 1 << bit))
            at += 1 << bit
    return runs


def _places(totals: dict[int, int], sizes: list[int], capacity: int) -> tuple[Column, Column]:
    """Sequence number and offset of a piece from its class and its rank in the class."""
    sequence = offset = F.lit(None).cast("long")
    used, rank = 0, F.col("rank")
    for number, total in sorted(totals.items()):
        runs = _bins(total, sizes[number], capacity)
        ends = [first for first, _ in runs[1:]] + [total]
        for (first, fill), end in zip(runs, ends, strict=True):
            here = (F.col("class") == number) & (rank >= first) & (rank < end)
            along = rank - F.lit(first)
            sequence = F.when(here, F.lit(used) + F.floor(along / fill)).otherwise(sequence)
            offset = F.when(here, along % fill * sizes[number]).otherwise(offset)
            used += (end - first) // fill
    return sequence, offset


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end: int = 2,
) -> DataFrame:
    """A row per piece: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``.

    Every id of every document lies in exactly one piece and each sequence is filled from offset 0
    without gaps. A null text is an empty one: a single end id. Repeated rows are packed as often as they
    occur; null ids stay null; an empty table gives no pieces. With a capacity that is no power of two a
    sequence may be padded by the rest of ``capacity // size`` pieces.
    """
    sizes = class_sizes(capacity)
    cut = stored(pieces(docs, doc_id, text, capacity, tokenizer, end), "pieces")
    counts = cut.groupBy("class", "worker").count()
    earlier = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "worker", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    # One row per class: never more than the capacity has halves.
    totals = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}
    # A row per class and worker: few, so the ids need not move.
    ranked = cut.join(broadcast_if_small(counts), ["class", "worker"]).withColumn("rank", F.col("base") + F.col("nth"))
    sequence, offset = _places(totals, sizes, capacity)
    return ranked.select(
        "doc_id", "start", "length", "doc_tokens", "ids", sequence.alias("sequence_id"), offset.alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed sequences themselves; a group is one capacity at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )
