"""Words of whole texts in UTF-8 bytes, a bounded piece at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split into words at once.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def texts(column: pa.Array) -> Iterator[bytes]:
    """The rows of a string column as bytes; a null is empty."""
    for x in pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()):
        yield x.as_py()


def word_lists(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text (split at ASCII white space), in lists from pieces of about ``piece`` bytes."""
    i = 0
    while i < len(data):
        j = min(len(data), i + piece)
        if j < len(data):
            gap = _SPACE.search(data, j)
            j = gap.start() if gap else len(data)
        if words := data[i:j].split():
            yield words
        i = j
