"""Reports on scores and posts.

``bots`` has the column ``userid`` and no account twice. It is read more than
once: hand in a written table (``session.materialise``), as the bot list itself
is an expensive query. A post has one author, so posts are counted per account
before bots are looked up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscore.functions.joins import count_rows, lookup_join

CUT = 0.5
TOP = 30
PROFILE_URL = "https://twitter.com/"


def bot_flag(score: Column, cut: float = CUT) -> Column:
    """An unknown score is no bot."""
    return F.when(score > cut, "Bot").otherwise("Kein Bot")


def _topics(session: DataFrame) -> DataFrame:
    return session.select(
        F.col("id").alias("session_id"), "track_topics"
    ).distinct()


def _mark_bots(accounts: DataFrame, bots: DataFrame) -> DataFrame:
    marked = bots.select("userid").distinct().withColumn("_bot", F.lit(True))
    return accounts.join(marked, "userid", "left").withColumn(
        "is_bot", F.coalesce("_bot", F.lit(False))
    )


def bots_per_topic(
    status: DataFrame, bots: DataFrame, session: DataFrame
) -> DataFrame:
    """Accounts and bots per topic; several sessions can share a topic."""
    accounts = status.select(
        F.col("status_user_id").alias("userid"), "session_id"
    ).distinct()
    marked = _mark_bots(accounts, bots)
    return (
        lookup_join(marked, _topics(session), "session_id")
        .groupBy("track_topics", "userid")
        .agg(F.max("is_bot").alias("is_bot"))
        .groupBy("track_topics")
        .agg(
            F.count("userid").alias("useranzahl"),
            F.count_if("is_bot").alias("botanzahl"),
        )
    )


def counts_per_day(
    status: DataFrame, bots: DataFrame, session: DataFrame
) -> DataFrame:
    """Per topic and UTC day the accounts, posts and posts of bots."""
    posts = status.select(
        "id",
        F.col("status_user_id").alias("userid"),
        F.date_trunc("day", "created_at").alias("tweetdatum"),
        "session_id",
    )
    per_user = (
        lookup_join(posts, _topics(session), "session_id")
        .select("track_topics", "tweetdatum", "userid", "id")
        .distinct()
        .groupBy("track_topics", "tweetdatum", "userid")
        .agg(count_rows().alias("n"))
    )
    return (
        _mark_bots(per_user, bots)
        .groupBy("track_topics", "tweetdatum")
        .agg(
            F.count("userid").alias("useranzahl"),
            F.sum("n").alias("tweetanzahl"),
            F.sum(F.when(F.col("is_bot"), F.col("n")).otherwise(0)).alias(
                "bottweetanzahl"
            ),
        )
    )


def _top_values(
    statuses: list[DataFrame], bots: DataFrame, entity: Column, name: str, n: int
) -> DataFrame:
    posts = reduce(
        DataFrame.unionByName,
        [
            s.select(F.col("status_user_id").alias("userid"), entity.alias("values"))
            for s in statuses
        ],
    )
    # only posts of bots reach the shuffle of the distinct pairs
    by_bots = lookup_join(posts, bots.select("userid"), "userid", how="left_semi")
    pairs = by_bots.select("userid", F.explode("values").alias("value"))
    return (
        pairs.where(F.col("value").isNotNull())
        .distinct()
        .groupBy(F.col("value").alias(name))
        .agg(count_rows().alias("anz"))
        .orderBy(F.desc("anz"), name)
        .limit(n)
    )


def top_urls(
    statuses: list[DataFrame], bots: DataFrame, *, n: int = TOP
) -> DataFrame:
    """Links by the number of bots that posted them."""
    return _top_values(
        statuses, bots, F.col("urls.expanded_url"), "url", n
    ).withColumnRenamed("anz", "urlanz")


def top_hashtags(
    statuses: list[DataFrame], bots: DataFrame, *, n: int = TOP
) -> DataFrame:
    """Hashtags by the number of bots that posted them."""
    return _top_values(
        statuses, bots, F.col("hashtags.text"), "httext", n
    ).withColumnRenamed("anz", "htanz")


def _stats(posts: DataFrame, keys: list[str], day_of: str) -> DataFrame:
    per_user = (
        posts.groupBy(*keys, "status_user_id", "id")
        .agg(F.min(day_of).alias("first"), F.max(day_of).alias("last"))
        .groupBy(*keys, "status_user_id")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            count_rows().alias("n"),
        )
    )
    return per_user.groupBy(*keys).agg(
        F.date_format(F.min("first"), "dd.MM.yyyy").alias("startdatum"),
        F.date_format(F.max("last"), "dd.MM.yyyy").alias("enddatum"),
        F.sum("n").alias("anztweets"),
        F.count("status_user_id").alias("anzuser"),
    )


def collection_stats(status: DataFrame, session: DataFrame) -> DataFrame:
    """Per topic first and last recording day, posts and accounts."""
    posts = status.select("id", "status_user_id", "session_id", "recorded_at")
    topics = _topics(session)
    posts = lookup_join(posts, topics, "session_id", how="inner")
    return _stats(posts, ["track_topics"], "recorded_at")


def collection_stats_all(status: DataFrame, label: str) -> DataFrame:
    """R10 over everything, by the day of posting."""
    return _stats(status, [], "created_at").select(
        F.lit(label).alias("track_topics"),
        "startdatum",
        "enddatum",
        "anztweets",
        "anzuser",
    )


def score_histogram(
    scores: DataFrame, column: str, *, width: float = 0.01, cut: float = CUT
) -> DataFrame:
    """Accounts per bin of the score; bins are closed on the right.

    ``place`` tells scores in [0, 1] from those below, above and unknown, which
    have no bin; the numbers add up to the rows of ``scores``.
    """
    score = F.col(column)
    step = F.greatest(F.ceil(F.round(score / width, 9)), F.lit(1))
    place = (
        F.when(score < 0, "below").when(score > 1, "above").when(score.isNull(), "unknown")
    )
    return (
        scores.groupBy(
            F.when(score.between(0, 1), step).alias("bin"),
            F.coalesce(place, F.lit("inside")).alias("place"),
            bot_flag(score, cut).alias("botflag"),
        )
        .agg(count_rows().alias("anz"))
    )


def long_form(report: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and measure."""
    measures = [c for c in report.columns if c not in keys]
    return report.select(
        *keys, *[F.col(c).cast("bigint").alias(c) for c in measures]
    ).unpivot(keys, measures, "variable", "value")


def topic_label(report: DataFrame) -> DataFrame:
    """Topics one below the other."""
    return report.withColumn(
        "track_topics", F.replace("track_topics", F.lit(","), F.lit("\n"))
    )


def validation_sample(
    challenge: DataFrame, users: DataFrame, *, n: int = 100, seed: int = 0
) -> DataFrame:
    """``n`` scored accounts for a manual check, drawn by hash order."""
    names = users.select(F.col("id").alias("user_id"), "screen_name").distinct()
    drawn = (
        challenge.where(F.col("botscore").isNotNull())
        .select("user_id", "botscore")
        .distinct()
        .join(names, "user_id", "left")
        .select(
            F.concat(F.lit(PROFILE_URL), "screen_name").alias("userurl"),
            F.format_string("%.2f", F.round("botscore", 2)).alias("botscore"),
        )
        .distinct()
    )
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "userurl", "botscore"))
    return drawn.orderBy(order).limit(n)


def unqualified_sources(status: DataFrame, source_q: DataFrame) -> DataFrame:
    """Clients without a qualification, with their number of posts."""
    counts = (
        status.where(F.col("status_source").isNotNull())
        .groupBy("status_source")
        .agg(count_rows().alias("anz"))
    )
    known = source_q.select(F.col("source").alias("status_source"))
    return counts.join(known, "status_source", "left_anti")


def all_sources(statuses: list[DataFrame]) -> DataFrame:
    """All clients with their number of posts in all datasets."""
    posts = reduce(
        DataFrame.unionByName,
        [s.select(F.col("status_source").alias("sourceatt")) for s in statuses],
    )
    return (
        posts.groupBy("sourceatt")
        .agg(count_rows().alias("anz"))
        .orderBy(F.desc("anz"), "sourceatt")
    )
