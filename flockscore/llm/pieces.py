"""SentencePiece encoding and decoding through a table of distinct chunks.

The library puts a marker before the text and one for each space. Where no piece of
the vocabulary holds a marker behind another character, no merge crosses from a
character to a marker, so a text falls into chunks, a run of markers and what follows
up to the next one, and its ids are those of its chunks, one after another.

1. Spark counts the chunks of all texts, and segments the ``TABLE_ROWS`` most frequent
   ones, each once. This table is bounded and goes to all tasks.
2. A slice of texts becomes a dictionary of its different chunks and, by position, the
   number of each. Chunks that the table lacks are segmented, once a slice. Ids and
   decoded texts are then taken by position from the dictionary's.

The rest of the chunks is not joined from a table of the whole corpus: the text itself
would have to be shuffled to meet it, for chunks that hardly occur twice in a task.

A vocabulary with a piece across markers, a normalisation of its own, or without the
marker before the text is refused: its texts can't be cut this way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import flat, slices
from .coded import SLICE_BYTES, frequent, strings
from .tables import without, written

MARK = "▁"
TABLE_ROWS = 65_536
CHUNK_BYTES = 64  # of a chunk in the table


def load(model: bytes):
    """The library's processor of the model file's bytes."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> None:
    """Raise ValueError unless texts of this vocabulary fall into chunks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
    if not (plain and spec.add_dummy_prefix and spec.escape_whitespaces) or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("this model normalises texts in a way that chunks don't follow")
    matched = [p for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
    if any(MARK in p.piece.lstrip(MARK) for p in matched):
        raise ValueError("a piece of this model crosses a marker")
    if any(p.type == p.USER_DEFINED for p in matched):
        raise ValueError("this model has user-defined pieces")


@lru_cache(maxsize=2)
def _processor(model: bytes):
    return load(model)


def segment(model: bytes, chunks: list[str]) -> list[list[int]]:
    """The ids of each chunk, given with spaces for markers; the library puts the
    first marker itself, but for a chunk of one marker alone."""
    processor = _processor(model)
    ids = processor.encode([c[1:] for c in chunks], num_threads=1)
    lone = processor.piece_to_id(MARK)
    return [[lone] if c == " " else x for c, x in zip(chunks, ids, strict=True)]


def surfaces(model: bytes, ids: list[list[int]]) -> list[str]:
    """What the library decodes from each chunk's ids behind another piece; only at
    the start of a text it leaves a marker out."""
    processor = _processor(model)
    ahead = processor.encode("a")
    skip = len(processor.decode(ahead))
    return [x[skip:] for x in processor.decode([ahead + x for x in ids], num_threads=1)]


class Chunks:
    """The chunks of a slice: ``distinct``, ``code`` by position, and the text ``first``
    to ``first`` + 1 of which row each belongs to. Empty texts have none."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        marked = pc.replace_substring(texts, MARK, " ")
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        marked = pc.if_else(pc.equal(texts, nothing), nothing, pc.binary_join_element_wise(space, marked, nothing))
        data, offsets = flat(marked)
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(start)
        self.first = np.searchsorted(starts, offsets)
        coded = strings(data, np.append(starts, len(data))).dictionary_encode()
        self.distinct, self.code = coded.dictionary, coded.indices


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        for i, j in slices(texts, SLICE_BYTES):
            found = Chunks(texts.slice(i, j - i))
            n = np.bincount(found.code.to_numpy(), minlength=len(found.distinct))
            short = pc.less_equal(pc.binary_length(found.distinct), CHUNK_BYTES)
            yield pa.RecordBatch.from_arrays(
                [found.distinct.filter(short).cast(pa.string()), pa.array(n).filter(short)], ["chunk", "n"]
            )


_SEGMENTED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("surface", T.StringType())])


def chunk_table(documents: DataFrame, model: bytes) -> DataFrame:
    """(chunk, n, ids, surface) of the most frequent chunks of all texts."""

    @F.arrow_udf(_SEGMENTED)
    def segmented(chunks: pa.Array) -> pa.Array:
        ids = segment(model, chunks.to_pylist())
        columns = [pa.array(ids, pa.list_(pa.int32())), pa.array(surfaces(model, ids), pa.string())]
        return pa.StructArray.from_arrays(columns, ["ids", "surface"])

    counted = documents.where(F.col("text").isNotNull()).select("text").mapInArrow(_counted, "chunk string, n long")
    counted = counted.groupBy("chunk").agg(F.sum("n").alias("n"))
    table = written(frequent(counted, TABLE_ROWS, CHUNK_BYTES, "chunk"), "pieces-chunks")
    return written(table.withColumn("_s", segmented("chunk")).select("chunk", "n", "_s.ids", "_s.surface"), "pieces-table")


class Encoder:
    """Encodes slices with the shared table; travels to the tasks as a broadcast."""

    def __init__(self, model: bytes, table: pa.Table):
        self.model = model
        self.chunk = table["chunk"].combine_chunks().cast(pa.large_string())
        self.ids = table["ids"].combine_chunks().cast(pa.large_list(pa.int32()))
        self.surface = table["surface"].combine_chunks().cast(pa.large_string())
        self.end = load(model).eos_id()

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded text) of each text; null texts are empty."""
        found = Chunks(texts)
        at = pc.index_in(found.distinct, value_set=self.chunk)
        new = pc.is_null(at)
        own = segment(self.model, found.distinct.filter(new).to_pylist())
        ids = pa.concat_arrays([self.ids, pa.array(own, pa.large_list(pa.int32()))])
        surface = pa.concat_arrays([self.surface, pa.array(surfaces(self.model, own), pa.large_string())])
        where = at.fill_null(0).to_numpy().astype(np.int64)
        is_new = new.to_numpy(zero_copy_only=False)
        where[is_new] = len(self.chunk) + np.arange(int(is_new.sum()))
        by_position = pa.array(where[found.code.to_numpy()])
        return self._joined_ids(ids.take(by_position), found.first), self._joined_text(surface.take(by_position), found.first)

    def _joined_ids(self, ids: pa.Array, first: np.ndarray) -> pa.Array:
        """Each text's ids in one list, and the end id behind them."""
        values = ids.flatten().to_numpy()
        inner = ids.offsets.to_numpy()
        ends = (inner - inner[0])[first]
        out = np.insert(values, ends[1:], self.end)
        return pa.LargeListArray.from_arrays(ends + np.arange(len(ends)), pa.array(out, pa.int32()))

    @staticmethod
    def _joined_text(surface: pa.Array, first: np.ndarray) -> pa.Array:
        """Each text's decoded chunks in one string, without the marker before the text."""
        data, offsets = flat(surface)
        ends = offsets[first]
        filled = ends[:-1] < ends[1:]
        kept = np.ones(len(data), bool)
        kept[ends[:-1][filled]] = False
        lengths = np.diff(ends) - filled
        return strings(data[kept], np.concatenate([[0], np.cumsum(lengths)]))


_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])


def encode_documents(documents: DataFrame, model: bytes) -> DataFrame:
    """The documents with ``ids``, the text's ids and the end id, and ``decoded``, the
    text that the ids give back.

    Null and empty texts have the end id alone and decode to an empty text. Texts of
    any length are encoded whole; repeated rows are encoded alike. A literal marker is
    a space to the library, and decodes to one. Columns named like an added one are
    replaced. An empty table gives no rows.
    """
    check_model(model)
    spark: SparkSession = documents.sparkSession
    encoder = spark.sparkContext.broadcast(Encoder(model, chunk_table(documents, model).toArrow()))

    @F.arrow_udf(_ENCODED)
    def encoded(texts: pa.Array) -> pa.Array:
        parts = [encoder.value.encode(texts.slice(i, j - i)) for i, j in slices(texts, SLICE_BYTES)]
        ids = pa.chunked_array([p[0] for p in parts], pa.large_list(pa.int32())).combine_chunks()
        text = pa.chunked_array([p[1] for p in parts], pa.large_string()).combine_chunks()
        return pa.StructArray.from_arrays([ids.cast(pa.list_(pa.int32())), text.cast(pa.string())], ["ids", "text"])

    kept = without(documents, "ids", "decoded", "_e")
    found = kept.withColumn("_e", encoded(F.coalesce("text", F.lit(""))))
    return found.withColumns({"ids": F.col("_e.ids"), "decoded": F.col("_e.text")}).drop("_e")
