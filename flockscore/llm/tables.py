"""Reading tables, sampling labelled rows, cutting lineage."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscore.session import materialise, run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so its lineage ends here
    and later readers survive lost executors."""
    return materialise(df, run_dir(df.sparkSession, name))


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of the id as text; null ids have none."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    train: Column,
    rows: int,
) -> DataFrame:
    """At most ``rows`` labelled texts, (text, label, id), smallest id hashes first.

    ``train`` says by ``doc_id`` which rows may be learnt from. Equal texts are
    taken once, as is an id: with its smallest text and its largest label.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
        .limit(rows)
    )
    texts = (
        documents.where(train & F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    )
    first = texts.groupBy("text").agg(F.min(F.struct("doc_id", "_label")).alias("_f"))
    return first.select("text", F.col("_f._label").alias("label"), F.col("_f.doc_id").alias("id"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """What ``fit`` makes of the (text, label) rows of a bounded sample. It runs in a
    task, so the driver receives the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["text"], r["label"]) for batch in batches for r in batch.to_pylist())
        model = pickle.dumps(fit([(text, y) for _, text, y in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([])  # no row, no task


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with result names, in any letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run that send large binary cells to Python: so few rows a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
