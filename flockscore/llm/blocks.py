"""Words of many texts at once, as arrays.

A batch of texts is one byte array with document offsets. Words are found from
byte classes, and hashed from one running polynomial sum (modulo 2^64, an odd
base has an inverse), so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def space_bytes() -> np.ndarray:
    """The bytes 0x20 and 0x09-0x0D."""
    out = np.zeros(256, bool)
    out[[0x20, 9, 10, 11, 12, 13]] = True
    return out


def other_bytes() -> np.ndarray:
    """Bytes that are neither ASCII letters nor digits nor above ASCII."""
    out = np.ones(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        out[a:b] = False
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(texts) else (data[:0], np.zeros(1, np.int64))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    _, offsets = flat(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a slice: ``start`` and ``end`` in bytes, ``doc`` by row."""

    def __init__(self, texts: pa.Array, separators: np.ndarray):
        self.data, self.offsets = flat(texts)
        n = len(self.data)
        inside = ~separators[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.n_docs = len(self.offsets) - 1
        #: words of row i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self._sums = None

    def __len__(self) -> int:
        return len(self.start)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, wherever it stands."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], out=self._sums[1:])
            self._inverse = powers(BASE_INVERSE, n)
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` word hashes, by its first position."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(BASE, n)[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(BASE_INVERSE, n)[: n - k + 1])
