"""Indicator on the time between a post and its reply (K9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscore.functions.joins import spread_join
from flockscore.operators.snapshots import local_posts


def reply_gaps(posts: DataFrame, answered: DataFrame, self_only: bool = False) -> DataFrame:
    """(userid, gap): microseconds from a post to each reply, by the local clocks.

    ``posts`` are ``local_posts``; ``answered`` has the ``parent_id`` of all replies,
    and tells which posts draw a large part of them: they are spread over many tasks.
    """
    replies = posts.where(F.col("in_reply_to_status_id") > 0).select(
        F.col("in_reply_to_status_id").alias("parent_id"),
        "userid",
        F.col("id").alias("reply_id"),
        F.unix_micros("local_at").alias("reply_at"),
    )
    parents = posts.select(
        F.col("id").alias("parent_id"),
        *(["userid"] if self_only else []),
        F.unix_micros("local_at").alias("parent_at"),
    )
    gaps = spread_join(
        replies,
        parents,
        "parent_id",
        spread_by=["reply_id"],
        keys_of=answered.where(F.col("parent_id") > 0),
        also_on=("userid",) if self_only else (),
    )
    return gaps.select("userid", (F.col("reply_at") - F.col("parent_at")).alias("gap"))


def kpi_reactiontime(
    *datasets: tuple[DataFrame, DataFrame],
    seconds: float = 5,
    self_only: bool = False,
) -> DataFrame:
    """K9: a reply within ``seconds`` of its parent, by the local clocks.

    Both times are shifted by the offsets of their authors, so different
    offsets distort the gap and negative gaps count as fast. ``self_only``
    looks only at replies to the account's own posts. A post that draws a large
    part of all replies is spread over many tasks.
    """
    answered = reduce(
        DataFrame.unionByName,
        [
            status.select(F.col("in_reply_to_status_id").alias("parent_id"))
            for status, _ in datasets
        ],
    )
    gaps = reply_gaps(local_posts(*datasets), answered, self_only)
    facts = gaps.groupBy("userid").agg(
        (F.min("gap") / 1e6).alias("minawz"),
        (F.sum("gap") / F.count("gap") / 1e6).alias("mittelawz"),
        (F.max("gap") / 1e6).alias("maxawzeit"),
        F.count("gap").alias("anzawzeit"),
    )
    return facts.select(
        F.lit("REACTIONTIME").alias("kpiname"),
        "userid",
        F.when(F.col("minawz") < seconds, 1.0).otherwise(0.0).alias("botscore"),
        "minawz",
        "mittelawz",
        "maxawzeit",
        "anzawzeit",
    )
