"""Substring dedup by suffix automata.

A window is ``WINDOW`` consecutive words. Words covered by a window that starts
anywhere else too are removed, in every place.

1. Each window belongs to an anchor: the leftmost of its six-word grams with the
   smallest hash. Equal windows have equal anchors. The consecutive windows of one
   anchor are a passage; its windows occur again only in passages of that anchor.
2. Anchors are counted. One that occurs once has no repeated window. One whose
   passages are all equal and occur twice or more is repeated throughout.
3. The other anchors' passages are the reference. It is sharded by anchor: a shard's
   passages, each different one once with its number of places, become a suffix automaton, and
   the passages stream through it. The matching statistics at each word, and the
   number of places of the matched window, tell the repeated windows.
4. Each document removes the spans that its repeated windows cover.

One automaton of all repeated text, held by every task, would grow with the corpus,
and every document would be streamed through all of it. By anchor, an automaton sees
only what can match, and holds at most ``MOST_PASSAGES`` passages. Anchors that
occur more often are cut into single windows, whose places are counted directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BASE, BASE_INVERSE, Words, mix, powers, shingle_hashes, slices, space_bytes
from .orderhash import content_keys
from .tables import arrow_rows, without, written

WINDOW = 35
GRAM = 6
MOST_PASSAGES = 1000
SLICE_BYTES = 500_000  # of text whose words a task holds as arrays at a time
BATCH_ROWS = 1000  # texts sent to Python at a time


def _words(texts: pa.Array) -> Words:
    return Words(texts, space_bytes())


def _least_gram(grams: np.ndarray, width: int) -> np.ndarray:
    """For each position the leftmost of the smallest of the next ``width`` grams."""
    place = np.arange(len(grams), dtype=np.uint64)
    low = (grams >> np.uint64(26) << np.uint64(26)) | place
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return (low & np.uint64((1 << 26) - 1)).astype(np.int64)


class Passages:
    """The passages of a slice of texts, in text order: ``row``, ``pos`` (first word
    in its text), ``windows`` (their number), ``anchor`` and ``content`` hashes."""

    def __init__(self, words: Words):
        self.words, self.hashes = words, words.hashes()
        n = len(words)
        empty = np.zeros(0, np.int64)
        if n < WINDOW:
            self.start = self.row = self.pos = self.windows = empty
            self.anchor = self.content = empty.view(np.uint64)
            return
        grams = shingle_hashes(self.hashes, GRAM)
        least = _least_gram(grams, WINDOW - GRAM + 1)
        start = np.flatnonzero(words.doc[: n - WINDOW + 1] == words.doc[WINDOW - 1 :])
        least = least[start]
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (words.doc[start[1:]] != words.doc[start[:-1]])
        first = np.flatnonzero(new)
        self.windows = np.diff(np.append(first, len(start)))
        self.start, at = start[first], least[first]
        self.row = words.doc[self.start]
        self.pos = self.start - words.first[self.row]
        self.anchor = grams[at]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * powers(BASE, n)[:n], out=sums[1:])
        end = self.start + self.windows + WINDOW - 1
        inverse = powers(BASE_INVERSE, n)
        span = (sums[end] - sums[self.start]) * inverse[self.start]
        self.content = mix(span + ((at - self.start) * 64 + self.windows).astype(np.uint64))


_KEY = T.LongType()


@F.arrow_udf(_KEY)
def text_key(texts: pa.Array) -> pa.Array:
    """64 bits of the text's word sequence."""
    parts = [content_keys(_words(texts.slice(i, j - i)))[0] for i, j in slices(texts, SLICE_BYTES)]
    return pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        for i, j in slices(texts, SLICE_BYTES):
            words = _words(texts.slice(i, j - i))
            found = Passages(words)
            key = content_keys(words)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x)
                    for x in (
                        key[found.row].view(np.int64),
                        found.pos * 64 + found.windows,
                        found.anchor.view(np.int64),
                        found.content.view(np.int64),
                    )
                ],
                ["k", "place", "h", "r"],
            )


def _passage_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted passages; of hot anchors a hash for each window."""
    schema = pa.schema(
        [("k", pa.int64()), ("place", pa.int64()), ("h", pa.int64()), ("r", pa.int64()), ("n", pa.int64()),
         ("codes", pa.binary())]
    )
    for batch in batches:
        texts = batch.column("text")
        for i, j in slices(texts, SLICE_BYTES):
            words = _words(texts.slice(i, j - i))
            hashes, key = words.hashes(), content_keys(words)[0].view(np.int64)
            codes = (hashes >> np.uint64(32)).astype(np.uint32)
            windows = shingle_hashes(hashes, WINDOW).view(np.int64)
            rows: list[list] = [[] for _ in schema]
            for d in range(j - i):
                if key[d] != batch.column("k")[i + d].as_py():
                    continue  # another text with the same id
                n, first = batch.column("n")[i + d].as_py(), int(words.first[d])
                for w in batch.column("wanted")[i + d].as_py():
                    pos, count = w["place"] >> 6, w["place"] & 63
                    if w["hot"]:
                        for x in range(count):
                            h = int(windows[first + pos + x])
                            for c, v in zip(rows, (key[d], (pos + x) * 64 + 1, h, h, n, None), strict=True):
                                c.append(v)
                    else:
                        own = codes[first + pos : first + pos + count + WINDOW - 1].tobytes()
                        for c, v in zip(rows, (key[d], w["place"], w["h"], w["r"], n, own), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


class Automaton:
    """A suffix automaton of several sequences with the number of places of each
    state's substrings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, follow: dict[int, int], link: int, places: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.places.append(places)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest substring followed by c, alone."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q], 0)
        self.link[q] = own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def add(self, codes: list[int], places: int) -> None:
        last = 0
        for c in codes:
            if c in self.next[last]:  # known from an earlier sequence
                last = self._split(last, c)
                self.places[last] += places
                continue
            now = self._state(self.length[last] + 1, {}, 0, places)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            self.link[now] = self._split(p, c) if p >= 0 else 0
            last = now

    def count(self) -> None:
        """Add each state's places to those of its suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] += self.places[s]

    def repeated(self, codes: list[int], window: int) -> int:
        """Bit i is set if the window from word i has two places or more: the text
        is streamed, and at each word the matching statistics are cut to the window."""
        bits, s, matched = 0, 0, 0
        for i, c in enumerate(codes):
            while s and c not in self.next[s]:
                s = self.link[s]
                matched = self.length[s]
            if c in self.next[s]:
                s, matched = self.next[s][c], matched + 1
            if matched >= window:
                while self.length[self.link[s]] >= window:
                    s = self.link[s]
                    matched = self.length[s]
                if self.places[s] >= 2:
                    bits |= 1 << (i - window + 1)
        return bits


def _shard(h: int, passages: dict[int, tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    """(h, r, bits) of an anchor's passages: content hash -> (places, codes)."""
    texts = {r: np.frombuffer(codes, np.uint32).tolist() for r, (_, codes) in passages.items()}
    if len(texts) == 1:
        ((r, (n, _)),) = passages.items()
        return [(h, r, (1 << (len(texts[r]) - WINDOW + 1)) - 1)] if n > 1 else []
    machine = Automaton()
    for r, codes in texts.items():
        machine.add(codes, passages[r][0])
    machine.count()
    found = ((h, r, machine.repeated(codes, WINDOW)) for r, codes in texts.items())
    return [x for x in found if x[2]]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages in the order of anchor and content."""
    now, passages, out = None, {}, []

    def told(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "r", "bits"])

    for batch in batches:
        h, r, n = (batch.column(c).to_pylist() for c in ("h", "r", "n"))
        for i in range(len(h)):
            if h[i] != now:
                if passages:
                    out += _shard(now, passages)
                now, passages = h[i], {}
            old = passages.get(r[i])
            passages[r[i]] = (old[0] + n[i], old[1]) if old else (n[i], batch.column("codes")[i].as_py())
        yield told(out)
        out = []
    if passages:
        yield told(_shard(now, passages))


def repeated_places(documents: DataFrame) -> DataFrame:
    """(k, spots): for each text key the places of repeated windows, as (place, bits):
    place // 64 is the first word, bit i the window from i words on."""
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        return _repeated_places(documents)


def _repeated_places(documents: DataFrame) -> DataFrame:
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
    places = texts.select("text").mapInArrow(_anchors, "k long, place long, h long, r long")
    anchors = (
        places.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("_lo"), F.max("r").alias("_hi"))
        .where("n > 1")
        .select("h", (F.col("_lo") != F.col("_hi")).alias("mixed"), (F.col("n") > MOST_PASSAGES).alias("hot"))
    )
    # written, so that the join below meets two plain tables and a hot anchor is split
    anchors = written(anchors, "repeat-anchors")
    # equal texts share their key and places
    spots = places.join(anchors, "h").groupBy("k").agg(
        F.collect_set(F.struct("place", "h", "r", "mixed", "hot")).alias("all")
    )
    spots = written(spots, "repeat-spots")
    whole = F.transform(
        F.filter("all", lambda s: ~s["mixed"]),
        lambda s: F.struct(
            s["place"].alias("place"), F.lit(-1).cast("long").alias("bits")
        ),
    )
    wanted = spots.select("k", F.filter("all", lambda s: s["mixed"]).alias("wanted")).where(F.size("wanted") > 0)
    nodes = texts.select("doc", text_key("text").alias("k")).groupBy("k").agg(
        F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")
    )
    wanted = wanted.join(nodes, "k")
    passages = (
        texts.join(wanted, F.col("doc").eqNullSafe(F.col("first")))
        .select("text", "k", "n", "wanted")
        .mapInArrow(_passage_words, "k long, place long, h long, r long, n long, codes binary")
    )
    # rows that repeat an id and a text were both found
    passages = written(passages.dropDuplicates(["k", "place"]), "repeat-passages")
    cold, hot = passages.where("codes is not null"), passages.where("codes is null")
    matched = (
        cold.select("h", "r", "n", "codes")
        .repartition("h")
        .sortWithinPartitions("h", "r")
        .mapInArrow(_match, "h long, r long, bits long")
    )
    single = hot.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    single = written(single, "repeat-single")  # a plain table, as the anchors
    found = cold.join(matched, ["h", "r"]).select("k", F.struct("place", "bits").alias("spot"))
    found = found.union(
        hot.join(single, "h").select("k", F.struct("place", F.lit(1).cast("long").alias("bits")).alias("spot"))
    )
    plain = spots.select("k", F.explode(whole).alias("spot"))
    return plain.union(found).groupBy("k").agg(F.collect_list("spot").alias("spots"))


def covered(n: int, spots: pa.StructArray) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``spots``."""
    place, bits = (x.to_numpy(zero_copy_only=False) for x in spots.flatten())
    x = np.arange(64)
    starts = (place >> 6)[:, None] + x
    starts = starts[((bits[:, None] >> x) & 1 == 1) & (x < (place & 63)[:, None])]
    cover = np.bincount(starts, minlength=n + 1) - np.bincount(starts + WINDOW, minlength=n + 1)
    return np.cumsum(cover)[:n] > 0


@F.arrow_udf(
    T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )
)
def without_spots(texts: pa.Array, spots: pa.Array) -> pa.Array:
    out = []
    for text, spot in zip(texts.cast(pa.binary()), spots, strict=True):
        words = (text.as_py() or b"").split()  # bytes part at ASCII spaces only
        n = len(words)
        if spot.is_valid and len(spot.values):
            words = list(compress(words, ~covered(n, spot.values)))
        out.append((b" ".join(words), n, n - len(words)))
    kept, n_words, n_removed = zip(*out, strict=True) if out else ((), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
        ["text", "n_words", "n_removed"],
    )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents with ``kept_text`` (the words that stay, joined by a space),
    ``n_words`` and ``n_removed``.

    Null, empty and blank texts have no word; texts under 35 words lose none. Rows
    that repeat a text, with or without its id, are places of their own: all their
    windows are repeated. Null ids matter to nothing. Columns named like an added
    one are replaced. An empty table gives no rows.
    """
    kept = without(documents, "kept_text", "n_words", "n_removed", "_key", "_k", "_spots", "_cut")
    spots = repeated_places(documents).select(F.col("k").alias("_k"), F.col("spots").alias("_spots"))
    found = kept.withColumn("_key", text_key("text")).join(spots, F.col("_key") == F.col("_k"), "left")
    found = found.withColumn("_cut", without_spots("text", "_spots"))
    return found.withColumns(
        {"kept_text": F.col("_cut.text"), "n_words": F.col("_cut.n_words"), "n_removed": F.col("_cut.n_removed")}
    ).drop("_key", "_k", "_spots", "_cut")
