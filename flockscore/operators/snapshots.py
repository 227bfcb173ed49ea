"""Posts together with the profile snapshot recorded with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscore.functions.joins import count_rows
from flockscore.functions.temporal import local_time

SNAPSHOT_KEY = ["userid", "recorded_at", "session_id"]


def with_author(status: DataFrame, users: DataFrame) -> DataFrame:
    """Each post with language and offset of its own snapshot (K6, K8, K9).

    Posts stored with their snapshot (``author``) need no join. Otherwise the
    recording time is part of the join key, so that a busy account spreads over
    all tasks.

    Snapshots of one key that agree in language and offset are one row, and
    ``n_snapshots`` their number: posts recorded together would else meet each
    other's snapshots, the square of their number. Counts of posts add it up.
    """
    posts = status.withColumnRenamed("status_user_id", "userid")
    if "author" in posts.columns:
        return posts.withColumns(
            {
                "profile_lang": F.col("author.lang"),
                "utcoffset": F.col("author.utcoffset"),
                "n_snapshots": F.lit(1).cast("bigint"),
            }
        )
    author = users.select(
        F.col("id").alias("userid"),
        "recorded_at",
        "session_id",
        F.col("lang").alias("profile_lang"),
        "utcoffset",
        *([F.col("status_id").alias("id")] if "status_id" in users.columns else []),
    )
    # snapshots that name their post belong to it alone
    key = [*SNAPSHOT_KEY, *(["id"] if "status_id" in users.columns else [])]
    # dealt by the key of the join, which then needs no shuffle of its own
    author = author.repartition(*key).groupBy(*key, "profile_lang", "utcoffset")
    return posts.join(author.agg(count_rows().alias("n_snapshots")), key)


def sum_snapshots(condition: Column) -> Column:
    """Number of the rows with ``condition``, one for each snapshot of a post."""
    return F.coalesce(F.sum(F.when(condition, F.col("n_snapshots"))), F.lit(0))


def local_posts(*datasets: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Distinct posts of all (status, users) pairs with the author's clock."""
    parts = [
        with_author(status, users).select(
            "id",
            "userid",
            "in_reply_to_status_id",
            local_time(F.col("created_at"), F.col("utcoffset")).alias("local_at"),
        )
        for status, users in datasets
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
