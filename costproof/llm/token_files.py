"""Token ids in seekable binary files.

A shard holds documents in ascending id order as independent zstandard frames, each a whole number of
documents and with its own content checksum; then a skippable frame with the document directory; then
a trailing seek table in the seekable layout of the zstandard project, a skippable frame as well: per
frame its compressed size, its size and the low 32 bits of the XXH64 of its content. A reader opens the
end of the file, finds a document's frame and decompresses that frame only.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costproof.llm.common import scratch
from costproof.llm.texts import utf8
from costproof.llm.tokens import ID_BYTES, vocabulary, word_ids

FRAME_BYTES = 1 << 18
LEVEL = 3
# Fixed values of the seekable layout.
DIRECTORY_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
PLACE = np.dtype([("doc_id", "<i8"), ("none", "u1"), ("frame", "<u4"), ("tokens", "<u8")])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _sum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def write_shard(out, docs: Iterable[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES) -> tuple[int, int]:
    """Write documents (id, ids) in the given order to a binary stream; the numbers of documents and ids."""
    pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
    entries, places, held, size, tokens = [], [], [], 0, 0

    def flush() -> None:
        nonlocal held, size
        if held:
            data = b"".join(held)
            packed = pack.compress(data)
            out.write(packed)
            entries.append((len(packed), len(data), _sum(data)))
            held, size = [], 0

    for doc_id, ids in docs:
        places.append((doc_id or 0, doc_id is None, len(entries), len(ids) // ID_BYTES))
        held.append(ids)
        size += len(ids)
        tokens += len(ids) // ID_BYTES
        if size >= frame_bytes:
            flush()
    flush()
    directory = _skippable(DIRECTORY_MAGIC, np.array(places, PLACE).tobytes())
    out.write(directory)
    entries.append((len(directory), 0, _sum(b"")))
    footer = struct.pack("<IBI", len(entries), CHECKSUMS, FOOTER_MAGIC)
    out.write(_skippable(TABLE_MAGIC, np.array(entries, ENTRY).tobytes() + footer))
    return len(places), tokens


def read_index(file, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The seek table and the document directory, from the end of a file of ``size`` bytes."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
        raise ValueError("not a token file: its seek table is missing")
    begin = size - 9 - count * ENTRY.itemsize
    file.seek(begin)
    table = np.frombuffer(file.read(count * ENTRY.itemsize), ENTRY)
    length = int(table[-1]["packed"])
    file.seek(begin - 8 - length)
    return table, np.frombuffer(file.read(length)[8:], PLACE)


def read_shard(file, size: int, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """``(id, start, ids)`` of the documents, or of those ``wanted``; only their frames are decompressed."""
    table, places = read_index(file, size)
    begins = np.concatenate([[0], np.cumsum(table["packed"], dtype=np.int64)])
    starts = np.concatenate([[0], np.cumsum(places["tokens"], dtype=np.int64)])
    unpack, held, data, first = zstandard.ZstdDecompressor(), -1, b"", 0
    for i, place in enumerate(places):
        frame = int(place["frame"])
        doc_id = None if place["none"] else int(place["doc_id"])
        if wanted is not None and doc_id not in wanted:
            continue
        if frame != held:
            file.seek(int(begins[frame]))
            data = unpack.decompress(file.read(int(table[frame]["packed"])))
            if _sum(data) != table[frame]["sum"]:
                raise ValueError(f"frame {frame} of a token file is damaged")
            held, first = frame, int(starts[np.searchsorted(places["frame"], frame)])
        at = (int(starts[i]) - first) * ID_BYTES
        yield doc_id, int(starts[i]), data[at : at + int(place["tokens"]) * ID_BYTES]


def write(
    docs: DataFrame,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end: int = 1,
    frame_bytes: int = FRAME_BYTES,
) -> str:
    """Write the token ids of every whole text, each with ``end`` after it, and return the folder.

    Documents lie in ascending id order over shards 0, 1, ...; null ids come first, repeated rows are
    written as often as they occur, a null text is an empty one. A task writes under a name of its own
    and then renames: a repeated attempt replaces the shard by the same bytes. The folder's
    ``manifest`` tells how many documents and ids each shard holds.
    """
    spark = docs.sparkSession
    path = (path or scratch(spark, "tokens")).rstrip("/")
    vocab = tokenizer or vocabulary()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        encode = word_ids(vocab).encode
        rows = (
            (i, encode(t, end)) for b in batches for i, t in zip(b["doc_id"].to_pylist(), utf8(b["text"]), strict=True)
        )
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        draft, name = f"{folder}/.draft-{number}-{attempt}", f"{folder}/shard-{number:06d}.ids"
        with store.open_output_stream(draft) as out:
            count, tokens = write_shard(out, rows, frame_bytes)
        store.move(draft, name)
        kinds = pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])
        yield pa.RecordBatch.from_pylist([{"shard": number, "docs": count, "tokens": tokens}], kinds)

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    sorted_docs = ordered.sortWithinPartitions("doc_id", "tie").drop("tie")
    shards = sorted_docs.mapInArrow(shard, "shard int, docs long, tokens long")
    shards.write.parquet(f"{path}/manifest")
    return path


def read(spark: SparkSession, path: str, wanted: set[int] | None = None) -> DataFrame:
    """``doc_id, start, ids`` of the documents of a folder, or of those ``wanted``, in their own order.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit.
    """
    shards = spark.read.parquet(f"{path}/manifest").where("docs > 0")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    based = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/shard-{row['shard']:06d}.ids"
                with store.open_input_file(name) as file:
                    yield from _batches(read_shard(file, store.get_file_info(name).size, wanted), row["base"])

    tasks = max(1, shards.count())
    return based.repartitionByRange(tasks, "shard").mapInArrow(documents, "doc_id long, start long, ids binary")


def _batches(docs: Iterator[tuple[int | None, int, bytes]], base: int) -> Iterator[pa.RecordBatch]:
    """Documents as batches of about four megabytes."""
    held, size = [], 0
    for doc_id, start, ids in docs:
        held.append({"doc_id": doc_id, "start": base + start, "ids": ids})
        size += len(ids)
        if size >= 1 << 22:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, kinds)
