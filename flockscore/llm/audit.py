"""How filters of a corpus interact, from a sparse document-term matrix.

1. All words are counted, and the dictionary gives each different one a number. Its
   ``TABLE_ROWS`` most frequent words are bounded and go to all tasks.
2. A slice of texts becomes a shard of the matrix in compressed rows (CSR) for those
   columns. Words outside the table leave it as entries (row, word, count).
3. The entries meet the dictionary and become shards for the other columns. A word is
   in one column and a column in one kind of shard, so a document's row sum (its
   words) and number of nonzeros (its different words) are the sums over its shards.
4. They decide filters A and B; the others come from the text itself. Documents are
   counted by part, failed filters and labels, and all orders are read from these counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import flat, slices, space_bytes
from .coded import SLICE_BYTES, Coded, frequent
from .tables import written

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
SPECIAL = "#$%&*|"
TABLE_ROWS = 131_072
WORD_BYTES = 256  # of a word in the table


class Csr:
    """A shard of the matrix; ``rows`` says which documents its rows are."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        order = np.lexsort((column, row))
        self.rows, first = np.unique(row[order], return_index=True)
        self.indptr = np.append(first, len(row))
        self.indices, self.data = column[order], value[order]

    def row_sums(self) -> np.ndarray:
        return np.add.reduceat(self.data, self.indptr[:-1]) if len(self.rows) else self.data[:0]

    def nonzeros(self) -> np.ndarray:
        return np.diff(self.indptr)


def _entries(coded: Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word code, count) of the words of a slice, by row."""
    width = max(len(coded.distinct), 1)
    cell, count = np.unique(coded.doc * width + coded.code, return_counts=True)
    return cell // width, cell % width, count


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        for i, j in slices(texts, SLICE_BYTES):
            coded = Coded(texts.slice(i, j - i), space_bytes())
            n = np.bincount(coded.code, minlength=len(coded.distinct))
            yield pa.RecordBatch.from_arrays([coded.distinct.cast(pa.string()), pa.array(n)], ["word", "n"])


def dictionary(documents: DataFrame) -> DataFrame:
    """(word, id, n) of all different words of ``documents``."""
    counted = documents.where(F.col("text").isNotNull()).select("text").mapInArrow(_words, "word string, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.withColumn("id", F.monotonically_increasing_id()), "audit-words")


_TAIL = pa.struct([("word", pa.string()), ("n", pa.int64())])
_FEATURES = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("words", "different", "capitals", "points")),
        T.StructField("special", T.BooleanType()),
        T.StructField(
            "tail", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
        ),
    ]
)


def _marked(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many bytes of each text are ``wanted``."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(wanted[data], out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _bytes(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_CAPITALS = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_POINTS = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def features(texts: pa.Array, known: pa.Array, ids: np.ndarray) -> pa.StructArray:
    """Row sums and nonzeros over the ``known`` words, the other words as entries, and
    what the other filters ask of each text."""
    coded, n = Coded(texts, space_bytes()), len(texts)
    row, code, count = _entries(coded)
    at = pc.index_in(coded.distinct, value_set=known)
    column = np.append(ids, -1)[at.fill_null(len(ids)).to_numpy()][code]
    inside = column >= 0
    shard = Csr(row[inside], column[inside], count[inside])
    words, different = np.zeros(n, np.int64), np.zeros(n, np.int64)
    words[shard.rows], different[shard.rows] = shard.row_sums(), shard.nonzeros()
    rest = np.flatnonzero(~inside)
    tail = pa.StructArray.from_arrays(
        [coded.distinct.take(pa.array(code[rest])).cast(pa.string()), pa.array(count[rest])], fields=list(_TAIL)
    )
    ends = np.searchsorted(row[rest], np.arange(n + 1)).astype(np.int32)
    data, offsets = flat(texts)
    columns = [
        pa.array(words),
        pa.array(different),
        pa.array(_marked(data, offsets, _CAPITALS)),
        pa.array(_marked(data, offsets, _POINTS)),
        pa.array(_marked(data, offsets, _bytes(SPECIAL)) > 0),
        pa.ListArray.from_arrays(pa.array(ends), tail),
    ]
    return pa.StructArray.from_arrays(columns, [f.name for f in _FEATURES])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and nonzeros of shards; an entry (row, id, n) is in one of them."""
    for batch in batches:
        shard = Csr(*(batch.column(c).to_numpy() for c in ("row", "id", "n")))
        columns = [shard.rows, shard.row_sums(), shard.nonzeros()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "words", "different"])


def matrix_rows(documents: DataFrame) -> DataFrame:
    """(row, doc_id, part, digest, capitals, points, special, words, different) of each
    document; ``words`` and ``different`` are its row sum and nonzeros in the matrix."""
    words = dictionary(documents)
    table = frequent(words, TABLE_ROWS, WORD_BYTES).toArrow()
    known = table["word"].combine_chunks().cast(pa.large_string())
    held = documents.sparkSession.sparkContext.broadcast((known, table["id"].to_numpy()))

    @F.arrow_udf(_FEATURES)
    def described(texts: pa.Array) -> pa.Array:
        parts = [features(texts.slice(i, j - i), *held.value) for i, j in slices(texts, SLICE_BYTES)]
        return pa.chunked_array(parts).combine_chunks()

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        described(text).alias("_f"),
    )
    rows = written(rows.select("row", "doc_id", "part", "digest", "_f.*"), "audit-rows")
    entries = rows.select("row", F.explode("tail").alias("_t")).select("row", "_t.word", "_t.n")
    shards = entries.join(words.select("word", "id"), "word").select("row", "id", "n")
    shards = shards.mapInArrow(_shards, "row long, words long, different long")
    more = shards.groupBy("row").agg(F.sum("words").alias("_words"), F.sum("different").alias("_different"))
    rows = rows.drop("tail").join(more, "row", "left")
    for name in ("words", "different"):
        rows = rows.withColumn(name, F.col(name) + F.coalesce(f"_{name}", F.lit(0)))
    return rows.drop("_words", "_different")


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of each document; bit i of ``failed`` is set if it fails
    filter i of ``FILTERS``."""
    rows = written(matrix_rows(documents), "audit-matrix")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"))
    first = written(first, "audit-first")  # a plain table, so that a hot text is split
    fails = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("different") < LEAST_DISTINCT * F.col("words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("points"),
        F.col("special"),
        F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)),
    ]
    failed = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))
    return rows.join(first, "digest").select("doc_id", "part", failed.alias("failed"))


def _steps() -> Column:
    """All orders and steps: the filter's bit, and the bits of those before it."""
    steps = [
        {"filter_order": "".join(o), "step": k + 1, "bit": 1 << FILTERS.index(f), "before": sum(1 << FILTERS.index(g) for g in o[:k])}
        for o in permutations(FILTERS)
        for k, f in enumerate(o)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, by part, order of the filters and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. A null text is empty, a null source the empty
    string. Documents with a null id have no label and repeat nothing; a repeated row
    is a document of its own and repeats only smaller ids. Of several labels for an id
    the largest counts. Other columns are ignored. An empty table gives no rows.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    judged = failures(documents).join(known, "doc_id", "left")
    flags = [F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("_quality", "_toxic")]
    counts = judged.groupBy("part", "failed", flags[0].alias("good"), flags[1].alias("bad")).agg(F.count(F.lit(1)).alias("n"))
    cases = counts.select("*", F.inline(_steps()))

    def number(case: Column, name: str) -> Column:
        return F.sum(F.when(case, F.col("n")).otherwise(0)).alias(name)

    failed, bit, before = F.col("failed"), F.col("bit"), F.col("before")
    fails, passed = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(before) == 0
    steps = cases.groupBy("part", "filter_order", "step").agg(
        number(passed & ~fails, "kept"),
        number(fails & passed, "removed"),
        number(fails & ~passed, "redundant"),
        number(failed == bit, "unique_fails"),
        number(fails & passed & F.col("good"), "good_lost"),
        number(fails & passed & F.col("bad"), "toxic_lost"),
    )
    steps = written(steps, "audit-steps")
    letter = F.expr("substring(filter_order, step, 1)").alias("_filter")
    shapley = steps.groupBy("part", letter).agg(F.sum("removed").alias("shapley"))
    named = steps.withColumn("_filter", F.expr("substring(filter_order, step, 1)"))
    return named.join(shapley, ["part", "_filter"]).drop("_filter")
