"""Indicators on the client a post was sent with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscore.functions.joins import lookup_join


def source_facts(status: DataFrame, source_q: DataFrame) -> DataFrame:
    """Mean score and mean knock-out flag over the posts of an account.

    Copies of a post are one post: the mean score and the largest flag of them.
    """
    posts = status.select(
        "id", "status_user_id", F.col("status_source").alias("source")
    )
    known = source_q.select("source", "botscore", "kobotscore")
    return (
        lookup_join(posts, known, "source")
        .groupBy("id")
        .agg(
            F.min("status_user_id").alias("userid"),
            F.avg(F.coalesce("botscore", F.lit(0.0))).alias("botscore"),
            F.max(F.coalesce("kobotscore", F.lit(0.0))).alias("kobotscore"),
        )
        .groupBy("userid")
        .agg(
            F.avg("botscore").alias("botscore"),
            F.avg("kobotscore").alias("ko_share"),
        )
    )


def knocked_out(majority: float = 0.5) -> Column:
    return F.when(F.col("ko_share") > majority, 1.0).otherwise(0.0)


def kpi_sourcequalification(status: DataFrame, source_q: DataFrame) -> DataFrame:
    """Mean qualification of the clients used; unknown clients count 0."""
    return source_facts(status, source_q).select(
        F.lit("SOURCEQUALIFICATION").alias("kpiname"), "userid", "botscore"
    )


def kpi_ko_source(
    status: DataFrame, source_q: DataFrame, *, majority: float = 0.5
) -> DataFrame:
    """Knock-out when more than ``majority`` of the posts are flagged."""
    return source_facts(status, source_q).select(
        F.lit("KOSOURCEQUALIFICATION").alias("kpiname"),
        "userid",
        knocked_out(majority).alias("kobotscore"),
    )
