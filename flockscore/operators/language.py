"""Indicators on the languages of posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscore.functions.joins import count_rows
from flockscore.operators.snapshots import sum_snapshots, with_author

UNDETERMINED = "und"


def mismatch_counts() -> list[Column]:
    """Aggregates of ``with_author`` for ``mismatch``: posts, undetermined ones, other mismatches.

    Counts instead of a sum of scores, so that their order does not matter.
    """
    undetermined = F.col("lang") == UNDETERMINED
    fits = undetermined | (F.col("lang") == F.col("profile_lang"))
    return [
        F.sum("n_snapshots").alias("n"),
        sum_snapshots(undetermined).alias("n_und"),
        sum_snapshots(~F.coalesce(fits, F.lit(False))).alias("n_other"),
    ]


def mismatch(und_score: float = 0.2) -> Column:
    """Mean over the posts; an unknown language is a mismatch."""
    return (F.col("n_und") * und_score + F.col("n_other")) / F.col("n")


def kpi_langusertweets(
    status: DataFrame, users: DataFrame, *, und_score: float = 0.2
) -> DataFrame:
    """K6: mean mismatch between post and profile language; copies count."""
    facts = with_author(status, users).groupBy("userid").agg(*mismatch_counts())
    return facts.select(
        F.lit("LANGUSERTWEETS").alias("kpiname"),
        "userid",
        mismatch(und_score).alias("botscore"),
    )


def kpi_tweetlangs(
    *statuses: DataFrame, ratio: float = 0.06, drop_retweets: bool = False
) -> DataFrame:
    """Many different languages for the number of posts."""
    if drop_retweets:
        statuses = tuple(s.where(F.col("isretweet") == 0) for s in statuses)
    posts = reduce(
        DataFrame.unionByName,
        [
            s.where(F.col("lang") != UNDETERMINED).select(
                "id", F.col("status_user_id").alias("userid"), "lang"
            )
            for s in statuses
        ],
    )
    facts = (
        posts.distinct()
        .groupBy("userid", "lang")
        .agg(count_rows().alias("n"))
        .groupBy("userid")
        .agg(count_rows().alias("anzlang"), F.sum("n").alias("anztweets"))
    )
    share = F.col("anzlang") / F.col("anztweets")
    return facts.select(
        F.lit("TWEETLANGS").alias("kpiname"),
        "userid",
        F.when(share > ratio, 1.0).otherwise(0.0).alias("botscore"),
        "anzlang",
        "anztweets",
    )
