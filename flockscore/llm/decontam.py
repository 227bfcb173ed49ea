"""Benchmark decontamination by SimHash windows.

A document is compared with a benchmark item in windows of the item's word count,
one for each word; a document of fewer words is one window. A window's fingerprint is the SimHash of its five-word shingles.
Fingerprints are found by a multi-index: cut into ``BLOCKS`` blocks of 16 bits, a
fingerprint within ``RADIUS`` differs by at most ``RADIUS // BLOCKS`` bits in one
block at least, so looking up each block within that many bits finds all of them.
Candidates are verified by the exact weighted similarity of their shingles, sum of
smaller counts over sum of larger counts, at ``SIMILARITY`` or more.

A window without any shingle of an item of its size has similarity 0 and is not
fingerprinted: shingle hashes of all positions are looked up in those of the items.

``RADIUS`` 23 of 64 is more than four standard deviations above the distance to be expected
at a similarity of 0.8.

The items are held by every task, in blocks of at most ``BLOCK_WORDS`` words; a
larger benchmark takes one pass over the documents for each block, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, other_bytes, shingle_hashes, slices
from .tables import without

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 4
RADIUS = 23
BLOCK_WORDS = 500_000  # of the benchmark, in a task at once


def _words(texts: pa.Array) -> Words:
    """Lower-cased runs of letters and digits."""
    return Words(pc.utf8_lower(texts.fill_null("").cast(pa.string())), other_bytes())


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    bytes_ = shingles.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bytes_, axis=1, bitorder="little").astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums."""
    packed = np.packbits(sums > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags of shingles: sum of smaller over sum of larger counts."""
    keys, slot = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(slot[: len(a)], minlength=len(keys)), np.bincount(slot[len(a) :], minlength=len(keys))
    return np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1)


def block_items(rows: list[tuple[int, str | None]]) -> dict[str, Any]:
    """What tasks need of a block of items: (item_id, text)."""
    words = _words(pa.array([t for _, t in rows], pa.string()))
    hashes = words.hashes()
    items, keys, owners = [], [], []
    for i, (item, _) in enumerate(rows):
        own = hashes[words.first[i] : words.first[i + 1]]
        if not len(own):
            continue
        k = min(SHINGLE, len(own))
        shingles = shingle_hashes(own, k)
        print_ = simhash(_bits(shingles).sum(0, keepdims=True))[0]
        keys.append(np.unique(shingles))
        owners.append(np.full(len(keys[-1]), len(items)))
        items.append((item, len(own), k, shingles, print_))
    keys, owners = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *owners])
    order = np.argsort(keys, kind="stable")
    sizes: dict[int, list[int]] = {}
    for n, item in enumerate(items):
        sizes.setdefault(item[1], []).append(n)
    return {"items": items, "keys": keys[order], "owners": owners[order], "sizes": sizes, "short": sorted({i[2] for i in items})}


class MultiIndex:
    """Fingerprints by blocks; ``near`` finds all within the radius."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        value = np.arange(1 << 16, dtype=np.uint16)
        self.tables = []
        for b in range(BLOCKS):
            own = self._block(prints, b)
            # for each value of the block: which fingerprints are near it there
            self.tables.append(np.bitwise_count(value[:, None] ^ own[None, :]) <= RADIUS // BLOCKS)

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) numbers of all pairs within the radius."""
        found = np.zeros((len(prints), len(self.prints)), bool)
        for b, table in enumerate(self.tables):
            found |= table[self._block(prints, b)]
        q, k = np.nonzero(found)
        close = popcount(prints[q] ^ self.prints[k]) <= RADIUS
        return q[close], k[close]


class Matcher:
    def __init__(self, block: dict[str, Any]):
        self.items, self.keys, self.owners = block["items"], block["keys"], block["owners"]
        self.sizes, self.short = block["sizes"], block["short"]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.index: dict[int, MultiIndex] = {}

    def _hits(self, shingles: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.seen[(shingles >> np.uint64(44)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.keys, shingles[at]), max(len(self.keys) - 1, 0))
        return at[self.keys[pos] == shingles[at]] if len(self.keys) else at[:0]

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity) of every matching window."""
        words = _words(texts)
        hashes, out = words.hashes(), []
        for k in self.short:
            shingles = shingle_hashes(hashes, k)
            hits = self._hits(shingles)
            hits = hits[words.doc[hits] == words.doc[hits + k - 1]]
            for row in np.unique(words.doc[hits]):
                first, end = words.first[row], words.first[row + 1]
                own = shingles[first : end - k + 1]
                out += self._windows(int(row), own, hits[words.doc[hits] == row] - first, k)
        return out

    def _windows(self, row: int, shingles: np.ndarray, hits: np.ndarray, k: int) -> list[tuple[int, int, int, int, float]]:
        out = []
        # sizes of the items that have a shingle here, and the windows that cover it
        lows, highs = (np.searchsorted(self.keys, shingles[hits], side) for side in ("left", "right"))
        starts: dict[int, list[np.ndarray]] = {}
        for hit, low, high in zip(hits, lows, highs, strict=True):
            for size in {self.items[o][1] for o in self.owners[low:high] if self.items[o][2] == k}:
                starts.setdefault(size, []).append(np.arange(hit - (size - k), hit + 1))
        for size, ranges in starts.items():
            at = np.unique(np.concatenate(ranges))
            wide = min(size - k + 1, len(shingles))  # shingles of a window; a shorter text is one
            at = at[(at >= 0) & (at + wide <= len(shingles))]
            for part in np.array_split(at, len(at) // 4096 + 1):
                if not len(part):
                    continue
                low, n = part[0], part[-1] + wide - part[0]
                sums = np.zeros((n + 1, 64), np.int32)
                np.cumsum(_bits(shingles[low : low + n]), axis=0, out=sums[1:])
                prints = simhash(sums[part - low + wide] - sums[part - low])
                if size not in self.index:
                    own = self.sizes[size]
                    self.index[size] = MultiIndex(np.array([self.items[o][4] for o in own], np.uint64))
                for q, which in zip(*self.index[size].near(prints), strict=True):
                    item = self.items[self.sizes[size][which]]
                    s = part[q]
                    likeness = weighted_similarity(shingles[s : s + wide], item[3])
                    if likeness >= SIMILARITY - 1e-12:
                        out.append((row, int(item[0]), int(s), int(wide + k - 1), float(likeness)))
        return out


_WINDOW = "item_id bigint, first_word bigint, n_words bigint, similarity double"


def _finder(block: dict[str, Any]):
    fields = [("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]
    kind = pa.list_(pa.struct(fields))

    @F.arrow_udf(f"array<struct<{_WINDOW.replace(' ', ':').replace(',:', ',')}>>")
    def find(texts: pa.Array) -> pa.Array:
        matcher, out = Matcher(block), []
        for i, j in slices(texts):
            rows: list[list[dict]] = [[] for _ in range(j - i)]
            best: dict[tuple[int, int], dict] = {}
            for row, item, first, size, likeness in matcher.find(texts.slice(i, j - i)):
                rows[row].append({"item_id": item, "first_word": first, "n_words": size, "similarity": likeness})
            for row in rows:
                best = {}
                for w in row:
                    now = best.get((w["item_id"], w["first_word"] // w["n_words"]))
                    if now is None or (-w["similarity"], w["first_word"]) < (-now["similarity"], now["first_word"]):
                        best[(w["item_id"], w["first_word"] // w["n_words"])] = w
                out.append(sorted(best.values(), key=lambda w: (w["first_word"], w["item_id"])))
        return pa.array(out, kind)

    return find


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items with an id, in blocks of about ``BLOCK_WORDS`` words, by id."""
    rows: list[tuple[int, str | None]] = []
    size = 0
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    for row in items.orderBy("item_id", "text").toLocalIterator():
        rows.append((row["item_id"], row["text"]))
        size += len(row["text"]) // 4 + 1
        if size >= BLOCK_WORDS:
            yield rows
            rows, size = [], 0
    yield rows


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with ``leaks``: the matching windows, as (item_id, first_word,
    n_words, similarity) by position, the best one for each item and each stretch of the
    item's length.

    Words are lower-cased runs of letters and digits. Items of fewer than five words
    are one shingle of all their words; null and wordless items, and null and
    wordless texts, match nothing. Repeated items are each reported. A column named
    ``leaks`` is replaced. An empty table gives no rows, an empty benchmark no leaks.
    """
    kept = without(documents, "leaks")
    found = None
    for rows in item_blocks(benchmark):
        own = _finder(block_items(rows))("text")
        found = own if found is None else F.concat(found, own)
    return kept.withColumn("leaks", found)
