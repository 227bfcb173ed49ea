"""Near-duplicate documents by Order MinHash.

A document is its sequence of five-word k-mers, each labelled by its occurrence
(the second "a b c d e" differs from the first). One of ``SKETCHES`` hash orders
picks the ``PICKED`` smallest labelled k-mers, and their hash in text order is a
key: documents share a key if they share those k-mers in that order. A key of
twice as many k-mers splits the buckets that a common passage fills.

Candidates come in two rounds. First each member of a bucket meets the bucket's
smallest one. Then the buckets that still hold several classes are compared within:
a pair of different classes is a candidate if the bounds below allow it the
threshold. Buckets of up to ``PART`` members are compared whole; larger ones are
dealt into parts of about ``PART``, other ones under each key, which joins most of
what belongs together. A part holds its members' sequences and verifies its own
pairs, each in the first part that both are in; it returns links that join its
classes, fewer than its members. Large buckets that then still hold several classes
are dealt into cells, and cell is compared with cell, but for two of one class and
two whose lengths are too far apart. No pair is left out; the work grows with the
square of the members that no class has taken up.

The bounds drop no pair that could be linked: the chain is no longer than the
shorter text, and each k-mer outside the chain changes one of ``BINS`` counts by
one, so the distance of two texts' counts can't exceed their unmatched k-mers.

Candidates are verified by alignment: the longest chain of k-mers that both
documents have in the same order, within the band that the threshold allows, over
all k-mers of both less the chain. ``SIMILARITY`` or more links them. It equals the
Jaccard similarity of the k-mers where the order is kept.

Documents with equal words are one node. Nodes that earlier alignments have
joined are not compared again: it could not change the classes.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Words, mix, other_bytes, powers, shingle_hashes, slices
from .components import components
from .tables import arrow_rows, without, written

KMER = 5
SIMILARITY = 0.8
SKETCHES = 12
PICKED = 3
PART = 256
CELL = 2048
BINS = 128
LEVEL = 1.01 * math.log(1 / SIMILARITY)  # of the logarithm of lengths: more than linked texts differ
BATCH_ROWS = 1000  # texts or pairs sent to Python at a time
HELD_BYTES = 64 << 20  # of a part's sequences, before they go to a file of the task
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts.fill_null("").cast(pa.string())), other_bytes())


def content_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's word sequence."""
    hashes, at = words.hashes(), np.arange(len(words)) - words.first[words.doc]
    out = []
    for base in (_A, _B):
        rise = powers(base, int(at.max(initial=0)) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(hashes ^ base) * rise[at], out=sums[1:])
        out.append(mix(sums[words.first[1:]] - sums[words.first[:-1]] + base))
    return out[0], out[1]


def labelled_kmers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash with occurrence number, row) of all k-mers; a row of fewer than five
    words has none."""
    kmers = shingle_hashes(words.hashes(), KMER)
    use = np.flatnonzero(words.doc[: len(kmers)] == words.doc[KMER - 1 :][: len(kmers)])
    kmers, row = kmers[use], words.doc[use]
    order = np.lexsort((kmers, row))
    k, r = kmers[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    nth = np.empty(len(k), np.int64)
    nth[order] = np.arange(len(k)) - first[np.cumsum(new) - 1] if len(k) else 0
    return mix(kmers + nth.astype(np.uint64) * _A), row


def _seeds() -> np.ndarray:
    return mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _B) | np.uint64(1)


def sketch(kmers: np.ndarray) -> np.ndarray:
    """Keys of a document: ``SKETCHES`` of ``PICKED`` k-mers, then as many of twice
    as many; of all k-mers where there are fewer."""
    seeds, out = _seeds(), []
    step = max(1, 400_000 // max(len(kmers), 1))
    for s in range(0, SKETCHES, step):
        own = seeds[s : s + step, None]
        value = kmers[None, :] * own
        value ^= value >> np.uint64(29)
        value *= _A
        most = min(2 * PICKED, len(kmers))
        at = np.argpartition(value, most - 1, axis=1)[:, :most]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(value, at, 1), 1), 1)
        for n in (PICKED, 2 * PICKED):
            picked = np.sort(at[:, :n], 1)  # text order
            key = np.zeros(len(picked), np.uint64)
            for column in picked.T:
                key = mix(key * _B + kmers[column])
            out.append(mix(key + own[:, 0] + np.uint64(n)))
    return np.concatenate(out)


_KEY = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_KEY_FIELDS = [pa.field("a", pa.int64()), pa.field("b", pa.int64())]


@F.arrow_udf(_KEY)
def content_key(texts: pa.Array) -> pa.Array:
    parts = [content_keys(_words(texts.slice(i, j - i))) for i, j in slices(texts)]
    a = np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in parts]]).view(np.int64)
    b = np.concatenate([np.zeros(0, np.uint64), *[p[1] for p in parts]]).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _documents(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, labelled k-mers in text order) of each text."""
    for i, j in slices(texts):
        words = _words(texts.slice(i, j - i))
        a, b = (x.view(np.int64).tolist() for x in content_keys(words))
        kmers, row = labelled_kmers(words)
        first = np.searchsorted(row, np.arange(j - i + 1))
        for d in range(j - i):
            yield a[d], b[d], kmers[first[d] : first[d + 1]]


def _rows(found: list[tuple], fields: list[pa.Field]) -> pa.Array:
    columns = list(zip(*found, strict=True)) or [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)


_SKETCH = [T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]


@F.arrow_udf(T.StructType([*_KEY.fields, *_SKETCH]))
def sketches(texts: pa.Array) -> pa.Array:
    """The content key, the number of k-mers and the sketch's keys, each once."""
    none = np.zeros(0, np.int64)
    found = [(a, b, len(k), np.unique(sketch(k).view(np.int64)) if len(k) else none) for a, b, k in _documents(texts)]
    return _rows(found, [*_KEY_FIELDS, pa.field("size", pa.int64()), pa.field("keys", pa.list_(pa.int64()))])


@F.arrow_udf(T.StructType([*_KEY.fields, T.StructField("seq", T.BinaryType())]))
def sequences(texts: pa.Array) -> pa.Array:
    """The content key and the labelled k-mers in text order, 32 bits each."""
    found = [(a, b, (k >> np.uint64(32)).astype(np.uint32).tobytes()) for a, b, k in _documents(texts)]
    return _rows(found, [*_KEY_FIELDS, pa.field("seq", pa.binary())])


def bins(codes: np.ndarray) -> np.ndarray:
    """How many k-mers fall into each of ``BINS``, at most 255 of each."""
    return np.minimum(np.bincount(codes % BINS, minlength=BINS), 255).astype(np.uint8)


def least_chain(total: np.ndarray, least: float) -> np.ndarray:
    """The shortest chain that gives two sequences of ``total`` k-mers ``least``."""
    return np.ceil(least / (1 + least) * total - 1e-9).astype(np.int64)


def possible_pairs(
    lengths: np.ndarray, counts: np.ndarray, classes: np.ndarray, least: float, sides: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different classes, and of different sides if there are any, that
    lengths and bins allow ``least``."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    counts = counts.astype(np.int16)
    for i in range(len(lengths) - 1):
        n, m = lengths[i], lengths[i + 1 :]
        needed = least_chain(n + m, least)
        use = (classes[i + 1 :] != classes[i]) & (np.minimum(n, m) >= needed)
        if sides is not None:
            use &= sides[i + 1 :] != sides[i]
        j = np.flatnonzero(use)
        apart = np.abs(counts[i + 1 + j] - counts[i]).sum(1, dtype=np.int64)
        j = j[apart <= (n + m - 2 * needed)[j]]
        left.append(np.full(len(j), i))
        right.append(i + 1 + j)
    return np.concatenate(left), np.concatenate(right)


def alignment(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """The ordered similarity of two k-mer sequences, 0 if it can't reach ``least``.

    A chain of c k-mers gives c / (n + m - c), so ``least`` allows n + m - 2 c
    unmatched ones, and a matched pair further off the diagonal than that is in no
    such chain. k-mers are unique by their labels, hence the chain is the longest
    rising run of matched positions.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    needed = int(least_chain(np.array(n + m), least))
    band = n + m - 2 * needed
    if min(n, m) < needed:
        return 0.0
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), m - 1)
    to = order[at]
    where = np.flatnonzero(b[to] == a)
    to = to[where]
    inside = np.abs(where - to) <= band
    if inside.sum() < needed:
        return 0.0
    tails: list[int] = []
    for x in to[inside].tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails) / (n + m - len(tails))


class _Part:
    """The members of one part; their sequences lie in a file once they are many."""

    def __init__(self, place: int) -> None:
        self.place = place
        self.members: list[tuple[int, int, int, frozenset[int]]] = []
        self.sides: list[int] = []
        self.counts: list[np.ndarray] = []
        self.starts = [0]
        self.file = SpooledTemporaryFile(max_size=HELD_BYTES)

    def add(self, c: int, component: int, places: list[int], seq: bytes, side: int = 0) -> None:
        self.sides.append(side)
        self.members.append((c, component, len(seq) // 4, frozenset(places)))
        self.counts.append(bins(np.frombuffer(seq, np.uint32)))
        self.file.write(seq)
        self.starts.append(self.starts[-1] + len(seq))

    def sequence(self, i: int) -> np.ndarray:
        self.file.seek(self.starts[i])
        return np.frombuffer(self.file.read(self.starts[i + 1] - self.starts[i]), np.uint32)

    def links(self) -> list[tuple[int, int]]:
        """(c, hub) of aligned pairs whose classes no link before has joined."""
        if len({m[1] for m in self.members}) < 2:
            return []
        classes, lengths = (np.array([m[k] for m in self.members], np.int64) for k in (1, 2))
        top = {x: x for x in classes.tolist()}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        found, sides = [], np.array(self.sides) if len(set(self.sides)) > 1 else None
        pairs = possible_pairs(lengths, np.stack(self.counts), classes, SIMILARITY, sides)
        for i, j in zip(*(x.tolist() for x in pairs), strict=True):
            (c, own, _, here), (d, other, _, there) = self.members[i], self.members[j]
            own, other = root(own), root(other)
            if own == other or min(here & there) != self.place:
                continue
            if alignment(self.sequence(i), self.sequence(j), SIMILARITY) >= SIMILARITY - 1e-12:
                top[max(own, other)] = min(own, other)
                found.append((max(c, d), min(c, d)))
        return found


def links_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of all parts; rows (place, c, component, places, seq) come in the
    order of places. Rows of two cells of a place also have (block, side) and come in
    the order of blocks; only pairs of different sides are compared there."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            names = ["place", "block", "c", "component", "places", "seq", "side"]
            yield from zip(*(batch.column(x) for x in names if x in batch.schema.names), strict=True)

    def group(row: tuple) -> tuple:
        return tuple(x.as_py() for x in row[: 1 if len(row) == 5 else 2])

    for place, members in groupby(rows(), key=group):
        part = _Part(place[0])
        for row in members:
            part.add(*(x.as_py() for x in row[len(place) :]))
        if found := part.links():
            c, hub = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(hub, pa.int64())], ["c", "hub"])
        part.file.close()


@F.arrow_udf(T.BooleanType())
def aligned(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.frombuffer(z.as_py(), np.uint32) for z in (x, y))
        out.append(alignment(x, y, SIMILARITY) >= SIMILARITY - 1e-12)
    return pa.array(out, pa.bool_())


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (c, hub) that align; ``texts`` has (c, seq)."""
    own = pairs.select("c", "hub").join(texts.select("c", "seq"), "c")
    other = texts.select(F.col("c").alias("hub"), F.col("seq").alias("hub_seq"))
    return own.join(other, "hub").where(aligned("seq", "hub_seq")).select("c", "hub")


def _placed(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """(c, keys, component, level); texts of which one could be linked to the other
    have the same or adjoining levels of length."""
    placed = nodes.select("c", "keys", "size").join(member.withColumnRenamed("node", "c"), "c", "left")
    level = F.floor(F.log(F.greatest("size", F.lit(1))) / LEVEL)
    return written(placed.select("c", "keys", F.coalesce("component", "c").alias("component"), level.alias("level")), "near-placed")


def _open(placed: DataFrame, over: int) -> DataFrame:
    """(key, size) of the buckets of more than ``over`` members that still hold
    several components."""
    open_ = (
        placed.select(F.explode("keys").alias("key"), "component")
        .groupBy("key")
        .agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("size"))
        .where((F.col("_lo") != F.col("_hi")) & (F.col("size") > over))
        .select("key", "size")
    )
    return written(open_, "near-open")  # a plain table, as the hubs


def _strays(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (c, hub) that the buckets of more than two members still leave
    open, between different components; larger ones than ``PART`` only in parts."""
    open_ = _open(placed, 2)
    part = F.pmod(F.xxhash64("c", "key"), F.ceil(F.col("size") / PART))
    dealt = placed.select("c", "component", F.explode("keys").alias("key")).join(open_, "key")
    dealt = dealt.groupBy("c", "component").agg(F.collect_set(F.xxhash64("key", part)).alias("places"))
    return (
        dealt.join(texts, "c")  # at most one place for each key of a sketch
        .select(F.explode("places").alias("place"), "c", "component", "places", "seq")
        .repartition("place")
        .sortWithinPartitions("place", "c")
        .mapInArrow(links_within, "c long, hub long")
    )


def _across(placed: DataFrame, texts: DataFrame) -> DataFrame | None:
    """The links (c, hub) that the buckets of more than ``PART`` members still leave
    open, between any two of their cells; None if there is no such bucket.

    A component of more than ``CELL`` members of a bucket and level has cells of its
    own, which are not compared with each other. A sequence is sent once for each cell
    that its own is compared with, so the cells are larger than the parts.
    """
    open_ = _open(placed, PART).select(F.col("key").alias("place"))
    if open_.isEmpty():
        return None
    members = placed.select("c", "component", "level", F.explode("keys").alias("place")).join(open_, "place")
    members = written(members.select("place", "level", "component", "c"), "near-open")
    groups = written(members.groupBy("place", "level", "component").count(), "near-groups")
    large = groups.where(F.col("count") > CELL).withColumnRenamed("count", "_large")
    small = groups.where(F.col("count") <= CELL).groupBy("place", "level").agg(F.sum("count").alias("_small"))
    large, small = written(large, "near-groups"), written(small.where(F.col("_small") > CELL), "near-groups")
    own = F.xxhash64("component", F.pmod(F.xxhash64("c", "place"), F.ceil(F.col("_large") / CELL)))
    shared = F.pmod(F.xxhash64("component", "place"), F.ceil(F.coalesce("_small", F.lit(1)) / CELL))
    members = (
        members.join(large, ["place", "level", "component"], "left")
        .join(small, ["place", "level"], "left")
        .withColumn("cell", F.xxhash64("level", F.when(F.col("_large").isNull(), shared).otherwise(own)))
        .select("place", "level", "cell", "component", "c")
    )
    members = written(members, "near-cells")
    cells = members.groupBy("place", "level", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    cells = written(cells, "near-cells")
    first = cells.withColumn("level", F.explode(F.array("level", F.col("level") + 1))).select(
        "place", "level", F.col("cell").alias("a"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")
    )
    blocks = (
        cells.join(first, ["place", "level"])
        .where("least(lo, _lo) != greatest(hi, _hi)")
        .select("place", F.least("a", "cell").alias("a"), F.greatest("a", "cell").alias("b"))
        .distinct()  # two cells of a level meet in both orders
        .withColumn("block", F.xxhash64("a", "b"))
    )
    sides = F.array(
        F.struct(F.col("a").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cell"), F.lit(1).alias("side"))
    )
    sides = F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)
    blocks = written(blocks.select("place", "block", F.inline(sides)), "near-blocks")
    places = members.groupBy("c").agg(F.collect_set("place").alias("places"))
    return (
        members.join(places, "c")
        .join(texts, "c")
        .join(blocks, ["place", "cell"])
        .select("place", "block", "side", "c", "component", "places", "seq")
        .repartition("place", "block")
        .sortWithinPartitions("place", "block", "c")
        .mapInArrow(links_within, "c long, hub long")
    )


def duplicate_classes(documents: DataFrame) -> DataFrame:
    """(a, b, class_id): the word-sequence key of every text and the smallest
    ``doc_id`` of its class of near duplicates."""
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        return _duplicate_classes(documents)


def _joined(member: DataFrame, links: DataFrame) -> DataFrame:
    """``member`` (node, component) after more links (c, hub); only components that a
    link joins are looked at again."""
    of = {s: member.select(F.col("node").alias(s), F.col("component").alias(f"_{s}")) for s in ("c", "hub")}
    edges = links.join(of["c"], "c", "left").join(of["hub"], "hub", "left")
    edges = edges.select(F.coalesce("_c", "c").alias("a"), F.coalesce("_hub", "hub").alias("b"))
    edges = written(edges.where("a != b").distinct(), "near-joined")
    if edges.isEmpty():
        return member
    moved = written(components(edges), "near-moved").toDF("component", "_to")
    new = moved.select(F.col("component").alias("node"), "component").join(member, "node", "left_anti")
    after = member.union(new).join(moved, "component", "left")
    return written(after.select("node", F.coalesce("_to", "component").alias("component")), "near-members")


def _duplicate_classes(documents: DataFrame) -> DataFrame:
    keyed = documents.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc"), sketches("text").alias("k")
    )
    keyed = written(keyed.select("doc", "k.a", "k.b", "k.keys", "k.size"), "near-keys")
    # keys hold their order's number; equal texts fall together before anything else
    nodes = keyed.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max(F.struct("size", "keys")).alias("_k"))
    nodes = nodes.select("a", "b", "first", "_k.size", "_k.keys", F.monotonically_increasing_id().alias("c"))
    nodes = written(nodes, "near-nodes")

    buckets = nodes.select(F.explode("keys").alias("key"), "c")
    hubs = buckets.groupBy("key").agg(F.min("c").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = written(hubs, "near-hubs")  # a plain table, so that a hot bucket is split
    pairs = buckets.join(hubs, "key").where("c != hub").groupBy("c", "hub").count()
    pairs = written(pairs, "near-pairs")

    needed = pairs.select("c").union(pairs.select(F.col("hub").alias("c"))).distinct()
    needed = nodes.join(needed, "c").select("a", "b", "c", F.col("first").alias("_first"))
    texts = (
        documents.where(F.col("text").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc"), "text")
        .join(needed, F.col("doc").eqNullSafe(F.col("_first")))
        .select("c", "a", "b", sequences("text").alias("k"))
        .where("k.a = a and k.b = b")
        .select("c", "k.seq")
        .dropDuplicates(["c"])
    )
    texts = written(texts, "near-texts")

    best = pairs.groupBy("c").agg(F.max(F.struct("count", (-F.col("hub")).alias("_hub"))).alias("_b"))
    best = best.select("c", (-F.col("_b._hub")).alias("hub"))
    first = written(_verified(best, texts), "near-links")
    member = written(components(first.select(F.col("c").alias("a"), F.col("hub").alias("b"))), "near-members")
    rest = pairs.join(best, ["c", "hub"], "left_anti")
    of_c, of_hub = (
        member.select(F.col("node").alias(f"_{s}"), F.col("component").alias(f"_in_{s}")) for s in ("c", "hub")
    )
    rest = (
        rest.join(of_c, F.col("c") == F.col("_c"), "left")
        .join(of_hub, F.col("hub") == F.col("_hub"), "left")
        .where(F.coalesce("_in_c", "c") != F.coalesce("_in_hub", "hub"))
        .select("c", "hub")
    )
    member = _joined(member, written(_verified(rest, texts), "near-links"))
    member = _joined(member, written(_strays(_placed(nodes, member), texts), "near-links"))
    last = _across(_placed(nodes, member), texts)
    if last is not None:
        member = _joined(member, written(last, "near-links"))
    labelled = nodes.select("a", "b", "c", "first").join(member.withColumnRenamed("node", "c"), "c", "left")
    labelled = written(labelled.withColumn("component", F.coalesce("component", "c")), "near-labels")
    least = labelled.groupBy("component").agg(F.min("first").alias("class_id"))
    return written(labelled.join(least, "component").select("a", "b", "class_id"), "near-classes")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents with ``class_id``, the smallest id of their near duplicates
    (their own if they have none), and ``kept``, whether it is theirs.

    Texts with equal words are copies, also those without a word; texts of fewer
    than five words have no other near duplicates. Null texts are alone. Rows with a
    null id are kept only if no row of their class has one. Rows that repeat an id
    and a text are one document and share its fate. Columns named like an added one
    are replaced. An empty table gives no rows.
    """
    kept = without(documents, "class_id", "kept", "_k", "_a", "_b", "_class")
    classes = duplicate_classes(documents).withColumnsRenamed({"a": "_a", "b": "_b", "class_id": "_class"})
    keyed = kept.withColumn("_k", content_key("text"))
    found = keyed.join(
        classes, F.col("text").isNotNull() & (F.col("_k.a") == F.col("_a")) & (F.col("_k.b") == F.col("_b")), "left"
    )
    own = F.col("doc_id").cast("long")
    class_id = F.when(F.col("text").isNull(), own).otherwise(F.col("_class"))
    return found.withColumn("class_id", class_id).withColumn(
        "kept", own.eqNullSafe(F.col("class_id"))
    ).drop("_k", "_a", "_b", "_class")
