"""Line dedup by sharded minimal perfect hashing.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
in lower case. Keys of at least ``min_chars`` code points that stand in two or
more documents lose all their lines but those in the smallest ``doc_id``.

1. The distinct keys, as 128-bit hashes, are counted with map-side sums. A key is
   repeated if its smallest and largest ``doc_id`` differ.
2. The repeated keys are dealt into shards of about ``SHARD_KEYS``. Each shard
   becomes one row: a minimal perfect hash over its keys and, by its index, arrays
   of fingerprints, document counts and smallest ids.
3. Documents probe the arrays: their line hashes are sent to the shard, which is
   held once, as arrays, while any number of probes stream past it. No line is
   joined. Keys with more than a ``HOT``-th of all lines, hence at most ``HOT``
   keys, are one more shard that every document task holds, so that no task gets
   the probes of a very common line.
4. Each document drops the hits that came back.

All shards in every task would need no probe traffic but as many copies of the
arrays as there are tasks; both grow with the input, the traffic does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix
from .tables import without, written

MIN_CHARS = 10
SHARD_KEYS = 8192
HOT = 1000
NO_ID = 2**63 - 1  # null ids, taken as one document after all others
SPACE = " \t\n\v\f\r"
_SHARD = "slots binary, sizes array<long>, prints binary, counts binary, firsts binary"


def line_keys(text: str | None, min_chars: int) -> Iterator[bytes | None]:
    """The key of each line, None for keys that are too short."""
    for line in (text or "").split("\n"):
        line = line.strip(SPACE)
        yield line.encode().lower() if len(line) >= min_chars else None


def line_hashes(text: str | None, min_chars: int) -> list[int | None]:
    return [None if k is None else xxhash.xxh3_128_intdigest(k) for k in line_keys(text, min_chars)]


def halves(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit numbers as two arrays of 64 bits."""
    raw = np.frombuffer(b"".join(v.to_bytes(16, "little") for v in values), np.uint64)
    return raw[0::2].copy(), raw[1::2].copy()


def _slot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + np.uint64(2 * level + 1) * b) % np.uint64(size)).astype(np.int64)


def perfect_hash(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Slots of a minimal perfect hash over distinct keys (a, b).

    Each level has two slots for each key that is left; keys alone in their slot
    stay, the others go to the next level. A key's index is the number of used
    slots before its own.
    """
    levels, sizes, level = [], [], 0
    while len(a):
        size = 2 * len(a) + 1
        at = _slot(a, b, level, size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        left = ~alone[at]
        a, b, level = a[left], b[left], level + 1
    return np.concatenate([*levels, np.zeros(0, bool)]), sizes


def index_of(slots: np.ndarray, sizes: list[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The index of each key; any index or -1 for keys that are not in it."""
    rank = np.cumsum(slots) - 1
    out = np.full(len(a), -1)
    open_, base = np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        at = base + _slot(a[open_], b[open_], level, size)
        hit = slots[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def build_shard(a: np.ndarray, b: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> dict:
    slots, sizes = perfect_hash(a, b)
    order = np.argsort(index_of(slots, sizes, a, b))
    return {
        "slots": np.packbits(slots).tobytes(),
        "sizes": [int(s) for s in sizes],
        "prints": b[order].tobytes(),
        "counts": counts[order].astype(np.int64).tobytes(),
        "firsts": firsts[order].astype(np.int64).tobytes(),
    }


class Shard:
    """The arrays of a shard, ready to be probed."""

    def __init__(self, slots: bytes, sizes: list[int], prints: bytes, counts: bytes, firsts: bytes):
        self.sizes = list(sizes)
        self.slots = np.unpackbits(np.frombuffer(slots, np.uint8), count=sum(self.sizes)).astype(bool)
        self.prints = np.frombuffer(prints, np.uint64)
        self.counts = np.frombuffer(counts, np.int64)
        self.firsts = np.frombuffer(firsts, np.int64)

    def first_doc(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest id that holds each key; -1 where the key isn't repeated."""
        if not len(self.prints):
            return np.full(len(a), -1)
        at = index_of(self.slots, self.sizes, a, b)
        known = (at >= 0) & (self.prints[at] == b)
        return np.where(known, self.firsts[at], -1)

    def repeated(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = index_of(self.slots, self.sizes, a, b) if len(self.prints) else np.full(len(a), -1)
        return (at >= 0) & (self.prints[at] == b) if len(self.prints) else at >= 0


def _shard_of(row: dict) -> Shard:
    return Shard(row["slots"], row["sizes"], row["prints"], row["counts"], row["firsts"])


def _lines(min_chars: int, hot: dict | None):
    """Distinct (a, b) of each document; without those the hot shard has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _shard_of(hot) if hot else None
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {h for h in line_hashes(text.as_py(), min_chars) if h is not None}
                ids += [doc] * len(own)
                found += own
            a, b = halves(found)
            docs = np.array(ids, np.int64)
            if known is not None and len(a):
                rest = ~known.repeated(a, b)
                a, b, docs = a[rest], b[rest], docs[rest]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc", "a", "b"]
            )

    return run


def _to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard from rows in shard order."""
    names = ["shard", *[x.split()[0] for x in _SHARD.split(", ")]]

    def row(shard: int, parts: list[pa.RecordBatch]) -> dict:
        got = pa.Table.from_batches(parts)
        a, b, n, first = (got.column(i).to_numpy() for i in range(1, 5))
        return {"shard": shard, **build_shard(a.view(np.uint64), b.view(np.uint64), n, first)}

    schema = pa.schema(
        [("shard", pa.int64()), ("slots", pa.binary()), ("sizes", pa.list_(pa.int64())), ("prints", pa.binary()),
         ("counts", pa.binary()), ("firsts", pa.binary())]
    )
    now, parts = None, []
    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if now is not None and shards[i] != now:
                yield pa.RecordBatch.from_pylist([row(now, parts)], schema).select(names)
                parts = []
            now = int(shards[i])
            parts.append(batch.slice(i, j - i))
    if parts:
        yield pa.RecordBatch.from_pylist([row(now, parts)], schema).select(names)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in shard order, the arrays of a shard before its probes."""
    shard = None
    for batch in batches:
        has = batch.column("slots").is_valid().to_numpy(zero_copy_only=False)
        numbers = batch.column("shard").to_numpy()
        docs = batch.column("doc").fill_null(0).to_numpy()
        a = batch.column("a").fill_null(0).to_numpy().view(np.uint64)
        b = batch.column("b").fill_null(0).to_numpy().view(np.uint64)
        drop = np.zeros(len(docs), bool)
        cuts = sorted({0, *np.flatnonzero(has), *(np.flatnonzero(has) + 1), *(np.flatnonzero(np.diff(numbers)) + 1), len(docs)})
        for i, j in zip(cuts, cuts[1:], strict=False):
            if has[i]:
                shard = (int(numbers[i]), _shard_of(batch.slice(i, 1).to_pylist()[0]))
            elif shard and shard[0] == numbers[i]:
                first = shard[1].first_doc(a[i:j], b[i:j])
                drop[i:j] = (first >= 0) & (first != docs[i:j])
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[drop]), pa.array(a[drop].view(np.int64))], ["doc", "a"]
        )


def _cutter(min_chars: int, hot: dict):
    schema = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pa.Array, docs: pa.Array, drops: pa.Array) -> pa.Array:
        known, out = _shard_of(hot), []
        for text, doc, drop in zip(texts, docs.to_pylist(), drops, strict=True):
            text = text.as_py()
            hashes = line_hashes(text, min_chars)
            own = sorted({h for h in hashes if h is not None})
            gone = set(drop.as_py() or ())
            if own:
                a, b = halves(own)
                first = known.first_doc(a, b)
                hit = (first >= 0) & (first != doc)
                hit |= np.array([x in gone for x in a.view(np.int64).tolist()])
                gone = {h for h, x in zip(own, hit, strict=True) if x}
            lines = (text or "").split("\n")
            kept = [x for x, h in zip(lines, hashes, strict=True) if h not in gone]
            out.append(
                {
                    "text": None if text is None else "\n".join(kept),
                    "n_lines": len(lines),
                    "n_dropped": len(lines) - len(kept),
                }
            )
        return pa.array(out, schema)

    return cut


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with repeated lines taken out of ``text``, and ``n_lines``
    (before) and ``n_dropped``.

    Null and empty texts are one empty line; a null text stays null. Rows with a
    null id count as one document that comes after all others. Rows with equal
    ids are one document. Other columns stay; columns named like an added one are
    replaced. An empty table gives no rows.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    texts = documents.select(ids.alias("doc"), "text")
    lines = texts.mapInArrow(_lines(min_chars, None), "doc long, a long, b long")
    counted = written(
        lines.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("_last"))
        .where("first < _last")
        .drop("_last"),
        "line-counts",
    )
    total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_shards, limit = total[0] // SHARD_KEYS + 1, (total[1] or 0) // HOT
    hot_rows = counted.where(F.col("n") > limit).collect()  # fewer than HOT rows by their share
    a, b = halves([((r["b"] % 2**64) << 64) + r["a"] % 2**64 for r in hot_rows])
    hot = build_shard(a, b, np.array([r["n"] for r in hot_rows]), np.array([r["first"] for r in hot_rows], np.int64))

    shard = F.pmod(F.col("a"), F.lit(n_shards)).alias("shard")
    arrays = (
        counted.where(F.col("n") <= limit)
        .select(shard, "a", "b", "n", "first")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_to_shards, f"shard long, {_SHARD}")
    )
    arrays = written(arrays, "line-shards")
    probes = texts.mapInArrow(_lines(min_chars, hot), "doc long, a long, b long").select("doc", "a", "b", shard)
    drops = (
        arrays.withColumn("_kind", F.lit(0))
        .unionByName(probes.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
        .repartition("shard")
        .sortWithinPartitions("shard", "_kind")
        .mapInArrow(_probe, "doc long, a long")
        .groupBy("doc")
        .agg(F.collect_list("a").alias("_drops"))
        .withColumnRenamed("doc", "_doc")
    )
    kept = without(documents, "n_lines", "n_dropped", "_doc", "_key", "_drops", "_cut").withColumn("_key", ids)
    return (
        kept.join(drops, F.col("_key") == F.col("_doc"), "left")
        .withColumn("_cut", _cutter(min_chars, hot)("text", "_key", "_drops"))
        .select(
            *[F.col("_cut.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept.columns if c != "_key"],
            "_cut.n_lines",
            "_cut.n_dropped",
        )
    )
