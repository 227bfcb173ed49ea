"""Reference tables in and out as CSV, and resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscore.schemas import CHALLENGE_CSV, SOURCE_Q

FACTS = (
    "status",
    "users",
    "place",
    "hashtag",
    "url",
    "mention",
    "media",
    "session",
    "geolocation",
)


def read_source_qualification(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(SOURCE_Q)
        .options(sep=";", header=True, quote='"', escape='"')
        .csv(path)
    )


def extend_source_qualification(known: DataFrame, more: DataFrame) -> DataFrame:
    """Newly qualified clients below the known ones."""
    return known.unionByName(more)


def read_challenge(spark: SparkSession, path: str) -> DataFrame:
    """Listed accounts; the newest known post starts at 1."""
    return (
        spark.read.schema(CHALLENGE_CSV)
        .options(sep=",", header=True, quote='"', escape='"')
        .csv(path)
        .withColumn("maxtweetid", F.lit(1).cast("bigint"))
    )


def write_csv(df: DataFrame, path: str, *, sep: str = ",") -> None:
    """CSV with header; quotes inside values are doubled."""
    df.write.mode("overwrite").options(
        sep=sep, header=True, quote='"', escape='"'
    ).csv(path)


def backup_challenge(challenge: DataFrame, path: str) -> None:
    columns = ["user_id", "parent_screen_name", "parent_id", "botscore", "maxtweetid"]
    write_csv(challenge.select(columns), path)


def backup_source_qualification(source_q: DataFrame, path: str) -> None:
    columns = ["source", "comment", "botscore", "kobotscore"]
    write_csv(source_q.select(columns), path, sep=";")


def reset_facts(frames: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """Empty fact tables below ``out``; all other frames stay as they are."""
    kept = {}
    for name, frame in frames.items():
        if name not in FACTS:
            kept[name] = frame
            continue
        frame.limit(0).write.mode("overwrite").parquet(f"{out}/{name}")
        kept[name] = frame.sparkSession.read.schema(frame.schema).parquet(
            f"{out}/{name}"
        )
    return kept


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Number of rows per frame."""
    counts = None
    for name, frame in frames.items():
        row = frame.agg(F.count(F.lit(1)).alias("anz")).select(
            F.lit(name).alias("tabelle"), "anz"
        )
        counts = row if counts is None else counts.unionByName(row)
    return counts
