"""Phrase collocations from depth-truncated suffix trees, built group by group.

A suffix is a word of a text and up to two words that follow it in its piece. Suffixes
with equal first words belong to one prefix, and a subtree of the suffix tree holds all
suffixes of one prefix.

1. Vertical partitioning: a scan counts all words, and per slice the pairs that are
   frequent in it. A prefix of one word with more than a share ``HEAVY`` of all suffixes
   is extended to two words, and a pair with more to three, so that no prefix but a
   single suffix holds more. There are at most about 1 / ``HEAVY`` of each.
2. A second scan cuts the suffixes, equal ones of a slice together. Prefixes are dealt to
   groups, as many as the suffixes need at ``GROUP_ROWS`` a group.
3. A group's suffixes are sorted, which is the order of the leaves of its subtrees. A leaf
   is a run of equal suffixes, and its total their number; an inner node's total is the
   sum of the leaves below it. The stream is read once, whatever the group's size.
4. Nodes are the phrases' counts. Those of extended prefixes lie in several groups:
   words have theirs from the first scan, pairs get the sum of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import flat, slices
from .coded import SLICE_BYTES, Coded, lowered, strings
from .tables import arrow_rows, written

LEAST = 10
SHADOW = 50  # percent: a longer phrase so frequent hides the shorter one
SCALE = 1_000_000
TOP = 2000
HEAVY = 1 / 16_384
GROUP_ROWS = 1_000_000
SALTS = 64
END = "\t"  # after each word of a suffix; no word holds one


def _bytes(values: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[values] = True
    return out


_BREAKS = _bytes([*b".,;:!?", *range(0x0A, 0x0E)])
_SEPARATORS = _BREAKS | _bytes([0x20, 0x09])


class Suffixes:
    """The words of a slice, numbered with their language, and the pieces they are in."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.coded = coded = Coded(lowered(texts), _SEPARATORS)
        langs = langs.fill_null("und").dictionary_encode()
        self.langs, self.width = langs.dictionary, max(len(coded.distinct), 1)
        lang = langs.indices.to_numpy().astype(np.int64)
        self.word = lang[coded.doc] * self.width + coded.code  # with its language
        n = len(coded)
        breaks = np.cumsum(_BREAKS[coded.words.data])[coded.words.start] if n else np.zeros(0, np.int64)
        #: whether the next word follows in the same piece
        self.goes_on = np.zeros(n, bool)
        self.goes_on[:-1] = (breaks[1:] == breaks[:-1]) & (coded.doc[1:] == coded.doc[:-1])
        self.follower = np.zeros(n, np.int64)  # 0: the piece ends
        self.follower[:-1] = np.where(self.goes_on[:-1], coded.code[1:] + 1, 0)

    def lang_of(self, word: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(word // self.width))

    def text_of(self, word: np.ndarray) -> pa.Array:
        return self.coded.distinct.take(pa.array(word % self.width)).cast(pa.string())

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position its number among ``first``, the different (word, follower)."""
        both, which = np.unique(self.word * (self.width + 1) + self.follower, return_inverse=True)
        return both, which

    def joined(self, word: np.ndarray, *followers: np.ndarray) -> pa.Array:
        """Suffixes as text: each word and ``END``."""
        found = [pc.binary_join_element_wise(self.text_of(word), END, "")]
        ended = pa.concat_arrays([pa.array([""]), pc.binary_join_element_wise(self.coded.distinct.cast(pa.string()), END, "")])
        found += [ended.take(pa.array(f)) for f in followers]
        return pc.binary_join_element_wise(*found, "")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        for i, j in slices(texts, SLICE_BYTES):
            yield Suffixes(texts.slice(i, j - i), langs.slice(i, j - i))


_PREFIX = "lang string, prefix string, depth int, n long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all words, and of the pairs that make an eighth of ``HEAVY`` of the slice.
    Pairs over ``HEAVY`` of all words lose less than an eighth of it this way."""
    for s in _each(batches):
        word, n = np.unique(s.word, return_counts=True)
        pair, m = np.unique((s.word * (s.width + 1) + s.follower)[s.goes_on], return_counts=True)
        often = m > HEAVY / 8 * len(s.word)
        pair, m = pair[often], m[often]
        first = np.concatenate([word, pair // (s.width + 1)])
        follower = np.concatenate([np.zeros(len(word), np.int64), pair % (s.width + 1)])
        depth = np.repeat(np.array([1, 2], np.int32), [len(word), len(pair)])
        columns = [s.lang_of(first), s.joined(first, follower), pa.array(depth), pa.array(np.concatenate([n, m]))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "depth", "n"])


def _cut(heavy: dict[int, pa.Array]):
    """The suffixes of a slice, with the number of words of their prefix."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _each(batches):
            both, which = s.pairs()
            third = np.zeros(len(s.word), np.int64)
            third[:-1] = np.where(s.goes_on[:-1], s.follower[1:], 0)
            found, n = np.unique(which * (s.width + 1) + third, return_counts=True)
            pair, third = both[found // (s.width + 1)], found % (s.width + 1)
            first, second = pair // (s.width + 1), pair % (s.width + 1)
            lang = s.lang_of(first)
            name = [pc.binary_join_element_wise(x, lang, "\n") for x in (s.joined(first), s.joined(first, second))]
            extended = [pc.is_in(x, value_set=heavy[d]).to_numpy(zero_copy_only=False) for d, x in enumerate(name, 1)]
            depth = 1 + extended[0] + (extended[0] & extended[1])
            columns = [lang, s.joined(first, second, third), pa.array(depth.astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "depth", "n"])

    return cut


class _Level:
    """The runs of one depth in a sorted stream; the last one may go on."""

    def __init__(self, depth: int):
        self.depth, self.last = depth, None

    def add(self, langs: pa.Array, keys: pa.Array, totals: np.ndarray, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The nodes of the runs that these rows complete."""
        if self.last is not None:
            lang, key, total, level = self.last
            langs, keys = (pa.concat_arrays([pa.array([x], y.type), y]) for x, y in ((lang, langs), (key, keys)))
            totals, levels = np.insert(totals, 0, total), np.insert(levels, 0, level)
        if not len(keys):
            return
        new = np.ones(len(keys), bool)
        for column in (langs, keys):
            differs = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = differs if column is langs else new[1:] | differs
        first = np.flatnonzero(new)
        sums, levels = np.add.reduceat(totals, first), levels[first]
        langs, keys = (column.take(pa.array(first)) for column in (langs, keys))
        self.last = (langs[-1].as_py(), keys[-1].as_py(), int(sums[-1]), int(levels[-1]))
        yield from self._nodes(langs[:-1], keys[:-1], sums[:-1], levels[:-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.last is not None:
            lang, key, total, level = self.last
            yield from self._nodes(pa.array([lang]), pa.array([key]), np.array([total]), np.array([level]))

    def _nodes(self, langs: pa.Array, keys: pa.Array, totals: np.ndarray, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The nodes that are wanted: frequent ones, and all parts of extended pairs."""
        use = np.flatnonzero(np.where(levels > self.depth, self.depth == 2, totals >= LEAST))
        if len(use):
            langs, keys = (x.take(pa.array(use)).cast(pa.string()) for x in (langs, keys))
            depth = np.full(len(use), self.depth, np.int32)
            yield pa.RecordBatch.from_arrays(
                [langs, keys, pa.array(depth), pa.array(totals[use])], ["lang", "prefix", "depth", "n"]
            )


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a group's subtrees; suffixes come sorted by language and text."""
    levels = [_Level(d) for d in (1, 2, 3)]
    for batch in batches:
        langs = batch.column("lang").cast(pa.large_string())
        totals, depths = batch.column("n").to_numpy(), batch.column("depth").to_numpy()
        data, offsets = flat(batch.column("prefix"))
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == ord(END), out=ends[1:])  # words that have ended before each byte
        sizes = np.diff(offsets)
        words = ends[offsets[1:]] - ends[offsets[:-1]]
        place = ends[:-1] - np.repeat(ends[offsets[:-1]], sizes)  # of each byte's word
        for level in levels:
            own = words >= level.depth
            inside = (place < level.depth) & np.repeat(own, sizes)
            kept = np.zeros(len(data) + 1, np.int64)
            np.cumsum(inside, out=kept[1:])
            bounds = np.append(kept[offsets[:-1][own]], kept[-1])
            keep = pa.array(np.flatnonzero(own))
            yield from level.add(langs.take(keep), strings(data[inside], bounds), totals[own], depths[own])
    for level in levels:
        yield from level.end()


def phrase_counts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with all words of each language, and (lang, prefix, depth, n) of all
    phrases of up to three words that occur ``LEAST`` times; each word ends in ``END``."""
    spark = documents.sparkSession
    texts = documents.where(F.col("text").isNotNull()).select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = texts.mapInArrow(_prefixes, _PREFIX).groupBy("lang", "prefix", "depth").agg(F.sum("n").alias("n"))
    counted = written(counted, "phrase-prefixes")
    sizes = written(counted.where("depth = 1").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0

    # at most 1 / HEAVY words, and little more pairs
    over = F.col("n") > HEAVY * total * F.when(F.col("depth") == 1, 1.0).otherwise(7 / 8)
    heavy = counted.where(over).select("depth", F.concat("prefix", F.lit("\n"), "lang").alias("name"), "lang", "prefix", "n")
    names = heavy.select("depth", "name").toArrow()
    held = {d: names.filter(pc.equal(names["depth"], d))["name"].combine_chunks().cast(pa.string()) for d in (1, 2)}
    suffixes = texts.mapInArrow(_cut(held), _PREFIX)
    group = F.xxhash64("lang", F.expr("substring_index(prefix, '\\t', depth)"))
    with arrow_rows(spark, 50_000):
        nodes = (
            suffixes.repartition(max(1, -(-total // GROUP_ROWS)), group)
            .sortWithinPartitions("lang", "prefix")
            .mapInArrow(_subtrees, _PREFIX)
            .groupBy("lang", "prefix", "depth")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST)
        )
        known = heavy.where("depth = 1").select("lang", "prefix", "depth", "n").where(F.col("n") >= LEAST)
        return sizes, written(nodes.unionByName(known), "phrase-nodes")


def collocations(documents: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``TOP`` phrases.

    A phrase of two or three words is a candidate from ``LEAST`` occurrences on, unless
    one of three words that holds it is at least ``SHADOW`` percent as frequent. The
    score is that of its weakest cut. A null language is ``und``; null and empty texts
    hold no word, and documents that repeat count again. Words and texts may be of any
    length. Other columns are ignored. An empty table gives no rows.
    """
    sizes, nodes = phrase_counts(documents)
    phrases = nodes.where("depth > 1").select("lang", F.col("prefix").alias("p"), "depth", F.col("n").alias("a"))
    ends = F.col("depth") - 1
    cuts = phrases.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), ends)).alias("k"))
    left = F.concat(F.expr("substring_index(p, '\\t', k)"), F.lit(END))
    cuts = cuts.withColumn("left", left).withColumn("right", F.expr("substring(p, length(left) + 1)"))
    cuts = written(cuts, "phrase-cuts")  # a plain table, so that a hot word is split
    counts = nodes.select("lang", "prefix", F.col("n").cast("decimal(18,0)").alias("_n"))
    with_left = cuts.join(counts.select("lang", F.col("prefix").alias("left"), F.col("_n").alias("l")), ["lang", "left"])
    with_both = with_left.join(counts.select("lang", F.col("prefix").alias("right"), F.col("_n").alias("r")), ["lang", "right"])
    exact = F.expr(f"cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * {SCALE}bd div (l * r)")
    weakest = with_both.groupBy("lang", "p", "a").agg(
        F.min(F.struct(exact.alias("score"), "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("w")
    )
    longer = phrases.where("depth = 3").select("lang", "a", "p")
    inner = F.array(F.concat(F.substring_index("p", END, 2), F.lit(END)), F.expr("substring(p, locate('\\t', p) + 1)"))
    longer = longer.select("lang", F.explode(inner).alias("p"), "a").groupBy("lang", "p").agg(F.max("a").alias("_longer"))
    shown = weakest.join(longer, ["lang", "p"], "left").where(
        F.col("_longer").isNull() | (100 * F.col("_longer") < SHADOW * F.col("a"))
    )
    phrase = F.expr("replace(substring(p, 1, length(p) - 1), '\\t', ' ')").alias("phrase")
    shown = shown.select("lang", phrase, "a", "w.l", "w.r", "w.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # a language's first rows of each salt, then of all salts
    salted = shown.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("_r") <= TOP)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    first = ranked.where(F.col("rank") <= TOP).drop("_salt", "_r")
    return first.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
