"""Where a fetcher continues: the newest known post per account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_posts(status: DataFrame) -> DataFrame:
    return status.groupBy(F.col("status_user_id").alias("userid")).agg(
        F.max("id").alias("tweetid")
    )


def fetch_positions(
    universe: DataFrame, status: DataFrame, *, default: int = 1
) -> DataFrame:
    """All accounts of ``universe`` and of ``status``; ``default`` if unseen."""
    return (
        universe.select("userid")
        .distinct()
        .join(newest_posts(status), "userid", "full")
        .select("userid", F.coalesce("tweetid", F.lit(default)).alias("tweetid"))
    )


def init_positions(
    challenge: DataFrame, status: DataFrame, *, default: int = 1
) -> DataFrame:
    """``challenge`` with ``maxtweetid`` set anew from the known posts."""
    newest = newest_posts(status).select(
        F.col("userid").alias("user_id"), F.col("tweetid").alias("_newest")
    )
    return (
        challenge.drop("maxtweetid")
        .join(newest, "user_id", "left")
        .withColumn("maxtweetid", F.coalesce("_newest", F.lit(default)))
        .drop("_newest")
    )
