"""The corpus pipeline: filter, deduplicate, decontaminate and mix ``documents``.

Each stage takes what its predecessor kept, as a table, and returns the columns of
documents; the last adds how often each document is taken.

Extra columns go through all stages untouched, also those named like a column that an
operator adds; only the last stage's own columns replace them. An empty table stays empty. Rows that repeat
an id and a text share their fate up to the mix, where each is a document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscore.llm import decontam, linededup, mixing, orderhash, toxicity
from flockscore.llm.tables import table, written

TOXIC_AT = 0.5
OWN = {"doc_id", "text", "lang", "source", "n_chars"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _others_aside(stage: Stage) -> Stage:
    """A stage whose operator does not see the names of extra columns."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"_extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


@_others_aside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_AT``; the model is learnt from the labelled
    ones among them. Null and empty texts score as a text without a word."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.where(F.col("toxic_score") < TOXIC_AT).select(*docs.columns)


@_others_aside
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds; ``n_chars`` is
    that of the new text. Null texts stay null; one that loses all lines stays, empty."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_others_aside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Empty texts
    and those without a word are one group; null texts are alone; a row with a null id
    stays only if no row of its group has one."""
    return orderhash.near_duplicates(docs).where("kept").select(*docs.columns)


@_others_aside
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts hold none."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the copies that the mix takes of each: a plan, in which those
    taken no time stay as rows. Null texts have size 0, null sources are one source."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Models, sketches and roundings are not SQL; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
