"""Distinct accounts per topic and day as bitmaps that add up (A3; R3, R4, R10).

Accounts get dense numbers. A stored row holds, for a topic, a day and 32,768 numbers,
the bitmap of those that posted and of the bots among them, and counts of their posts.
Days merge to topics and topics to all by or-ing bitmaps, without reading posts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flockscore.functions.joins import count_rows, lookup_join

LANES = 1024


def number_accounts(accounts: DataFrame) -> DataFrame:
    """(userid, number) from 0 on, without gaps. Accounts are numbered within lanes, and
    lanes by their sizes, so no task sees all accounts."""
    lane = F.pmod(F.xxhash64("userid"), F.lit(LANES)).alias("lane")
    known = accounts.where(F.col("userid").isNotNull()).select("userid", lane).distinct()
    sizes = known.groupBy("lane").agg(count_rows().alias("size"))
    before = F.sum("size").over(W.orderBy("lane")) - F.col("size")  # 1,024 rows
    sizes = sizes.select("lane", before.alias("before"))
    nth = F.row_number().over(W.partitionBy("lane").orderBy("userid")) - 1
    numbered = known.withColumn("nth", nth).join(F.broadcast(sizes), "lane")
    return numbered.select("userid", (F.col("before") + F.col("nth")).alias("number"))


def daily_rollup(status: DataFrame, session: DataFrame, bots: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row per topic, day of posting and block of account numbers. A post counts
    once for a topic and day, however often it was recorded."""
    topics = session.select(F.col("id").alias("session_id"), "track_topics")
    listed = bots.select("userid", F.lit(True).alias("is_bot"))
    posts = status.select(
        "id",
        F.col("status_user_id").alias("userid"),
        "session_id",
        F.date_trunc("day", "created_at").alias("tweetdatum"),
        "recorded_at",
    )
    posts = lookup_join(posts, topics, "session_id")
    single = posts.groupBy("track_topics", "tweetdatum", "id", "userid").agg(
        F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last")
    )
    single = single.join(numbers, "userid", "left").join(listed, "userid", "left")
    number, bot = F.col("number"), F.col("is_bot")
    position = F.bitmap_bit_position(number)
    return single.groupBy("track_topics", "tweetdatum", F.bitmap_bucket_number(number).alias("block")).agg(
        F.bitmap_construct_agg(position).alias("users"),
        F.bitmap_construct_agg(F.when(bot, position)).alias("bots"),
        F.count("id").alias("tweets"),
        F.count(F.when(bot, F.col("id"))).alias("bottweets"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def merged_rollup(rollup: DataFrame, *keys: str) -> DataFrame:
    """Fewer rows per ``keys``: users, bots, tweets, bottweets, first and last of each."""
    blocks = rollup.groupBy(*keys, "block").agg(
        F.bitmap_or_agg("users").alias("users"),
        F.bitmap_or_agg("bots").alias("bots"),
        *[F.sum(c).alias(c) for c in ("tweets", "bottweets")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    # posts without an author are in a block of their own, whose bitmap is empty
    return blocks.groupBy(*keys).agg(
        F.sum(F.bitmap_count("users")).alias("users"),
        F.sum(F.bitmap_count("bots")).alias("bots"),
        *[F.sum(c).alias(c) for c in ("tweets", "bottweets")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def topics_of(rollup: DataFrame) -> DataFrame:
    """R3 from the stored table."""
    found = merged_rollup(rollup, "track_topics")
    return found.select("track_topics", F.col("users").alias("useranzahl"), F.col("bots").alias("botanzahl"))


def days_of(rollup: DataFrame) -> DataFrame:
    """R4 from the stored table."""
    return merged_rollup(rollup, "track_topics", "tweetdatum").select(
        "track_topics",
        "tweetdatum",
        F.col("users").alias("useranzahl"),
        F.col("tweets").alias("tweetanzahl"),
        F.col("bottweets").alias("bottweetanzahl"),
    )


def _day(column: str) -> Column:
    return F.date_format(column, "dd.MM.yyyy")


def stats_of(rollup: DataFrame) -> DataFrame:
    """R10 from the stored table."""
    found = merged_rollup(rollup.where(F.col("track_topics").isNotNull()), "track_topics")
    return found.select(
        "track_topics",
        _day("first").alias("startdatum"),
        _day("last").alias("enddatum"),
        F.col("tweets").alias("anztweets"),
        F.col("users").alias("anzuser"),
    )
