"""Words of a slice of texts as an Arrow dictionary.

Each different word of the slice stands once in ``distinct``; ``code`` says which one
stands at each position. Equality is that of the bytes, not of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .blocks import Words, flat

SLICE_BYTES = 4_000_000


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    """The strings that lie between ``offsets`` in the UTF-8 bytes ``data``."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(texts: pa.Array) -> pa.LargeStringArray:
    """The texts with A-Z in lower case; null texts are empty."""
    data, offsets = flat(texts)
    return strings(_LOWER[data], offsets)


class Coded:
    """Words of a slice between bytes of ``separators``."""

    def __init__(self, texts: pa.Array, separators: np.ndarray):
        self.words = words = Words(texts, separators)
        ends = np.zeros(len(words) + 1, np.int64)
        np.cumsum(words.end - words.start, out=ends[1:])
        coded = strings(words.data[~separators[words.data]], ends).dictionary_encode()
        self.distinct = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.doc = words.doc

    def __len__(self) -> int:
        return len(self.code)


def frequent(counted, rows: int, most_bytes: int, text: str = "word"):
    """The ``rows`` most frequent rows of ``counted`` (``text``, n) whose text has at most
    ``most_bytes`` bytes, ties by text. Their number and size are bounded, whatever
    the input, so they may be broadcast."""
    from pyspark.sql import functions as F

    return counted.where(F.octet_length(text) <= most_bytes).orderBy(F.desc("n"), text).limit(rows)
