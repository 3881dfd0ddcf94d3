"""Reading text columns inside tasks without copying whole batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value of a string or binary column, one at a time; null stays null."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset :]
    view = memoryview(data) if data is not None else memoryview(b"")
    nulls = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield None if nulls and nulls[i] else bytes(view[ends[i] : ends[i + 1]])


CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def chunks(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about a megabyte, cut at white space only."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
