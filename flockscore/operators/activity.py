"""Indicators on volume and rhythm of posting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flockscore.functions.joins import count_rows
from flockscore.functions.temporal import local_time
from flockscore.operators.snapshots import with_author

TIE_GROUPS = 1021
NIGHT = (1, 2, 3, 4)


def kpi_tweetmention(status: DataFrame, *, limit: float = 0.5) -> DataFrame:
    """K4: few mentions of other accounts per post; copies of a post count."""
    facts = status.groupBy(F.col("status_user_id").alias("userid")).agg(
        count_rows().alias("anzahltweets"),
        F.sum(F.coalesce(F.size("mentions"), F.lit(0))).alias("n_mentions"),
    )
    rate = F.col("umprotweet")
    return facts.withColumn(
        "umprotweet", F.col("n_mentions") / F.col("anzahltweets")
    ).select(
        F.lit("TWEETMENTION").alias("kpiname"),
        "userid",
        F.when(rate < limit, 1 - rate).otherwise(0.0).alias("botscore"),
        "anzahltweets",
        "umprotweet",
    )


def _tile(rank: Column, rows: Column, tiles: int) -> Column:
    """The ``ntile`` number of a 1-based rank among ``rows`` rows."""
    size = F.floor(rows / tiles)
    n_longer = rows % tiles
    in_longer = n_longer * (size + 1)
    return F.when(rank <= in_longer, F.ceil(rank / (size + 1))).otherwise(
        n_longer + F.ceil((rank - in_longer) / F.nullif(size, F.lit(0)))
    )


def _with_tile_range(groups: DataFrame, tiles: int) -> DataFrame:
    """First and last tile of groups that follow ``start`` earlier rows."""
    start, rows = F.col("start"), F.col("rows")
    return groups.withColumn("lo", _tile(start + 1, rows, tiles)).withColumn(
        "hi", _tile(start + F.col("size"), rows, tiles)
    )


def session_counts(status: DataFrame) -> DataFrame:
    """(userid, sessionid, anz): posts by account and session, copies included."""
    return status.groupBy(
        F.col("status_user_id").alias("userid"),
        F.col("session_id").alias("sessionid"),
    ).agg(count_rows().alias("anz"))


def post_tiles(status: DataFrame, *, tiles: int = 20) -> DataFrame:
    """``ntile`` over all (account, session) pairs by number of posts."""
    return tiles_of(session_counts(status), tiles=tiles)


def tiles_of(counts: DataFrame, *, tiles: int = 20) -> DataFrame:
    """``ntile`` over the rows of ``session_counts`` by number of posts.

    Ties are ordered by (userid mod 1021, userid, sessionid). No task sorts all
    pairs. A histogram of the post counts settles every count whose pairs share
    one tile; it is short, because k different counts need k*(k+1)/2 posts. At
    most ``tiles`` - 1 counts straddle a border. A second histogram over their
    tie groups leaves at most ``tiles`` - 1 groups to be ranked pair by pair.
    """
    tie = F.coalesce(F.pmod("userid", F.lit(TIE_GROUPS)), F.lit(0))
    pairs = counts.withColumn("tie", tie)

    by_count = W.orderBy("anz")
    counts = pairs.groupBy("anz").agg(count_rows().alias("size"))
    counts = counts.select(
        "anz",
        "size",
        (F.sum("size").over(by_count) - F.col("size")).alias("start"),
        F.sum("size").over(W.partitionBy()).alias("rows"),
    )
    counts = _with_tile_range(counts, tiles).withColumn(
        "last_hi", F.lag("hi").over(by_count)
    )
    # only counts that begin another tile or straddle a border: < 2 * tiles
    steps = counts.where(
        F.col("last_hi").isNull()
        | (F.col("hi") != F.col("last_hi"))
        | (F.col("lo") != F.col("hi"))
    ).agg(
        F.sort_array(
            F.collect_list(F.struct("anz", "start", "rows", "lo", "hi"))
        ).alias("steps")
    )
    placed = (
        pairs.crossJoin(F.broadcast(steps))
        .withColumn(
            "step",
            F.element_at(
                F.filter("steps", lambda s: s["anz"] <= F.col("anz")), -1
            ),
        )
        .drop("steps")
    )
    straddles = (F.col("step.anz") == F.col("anz")) & (
        F.col("step.lo") != F.col("step.hi")
    )
    columns = ["userid", "sessionid", "anz", "decil"]
    settled = placed.where(~straddles).withColumn("decil", F.col("step.hi"))

    open_pairs = placed.where(straddles).select(
        "userid", "sessionid", "anz", "tie", "step.start", "step.rows"
    )
    ties = open_pairs.groupBy("anz", "tie").agg(
        count_rows().alias("size"),
        F.min("start").alias("start"),
        F.min("rows").alias("rows"),
    )
    by_tie = W.partitionBy("anz").orderBy("tie")
    ties = ties.withColumn(
        "start", F.col("start") + F.sum("size").over(by_tie) - F.col("size")
    )
    ties = _with_tile_range(ties, tiles)
    # at most (tiles - 1) * 1021 rows
    grouped = open_pairs.drop("start", "rows").join(
        F.broadcast(ties), ["anz", "tie"]
    )
    same_tile = F.col("lo") == F.col("hi")
    by_group = grouped.where(same_tile).withColumn("decil", F.col("hi"))
    within = W.partitionBy("anz", "tie").orderBy("userid", "sessionid")
    ranked = grouped.where(~same_tile).withColumn(
        "decil",
        _tile(
            F.col("start") + F.row_number().over(within), F.col("rows"), tiles
        ),
    )
    return (
        settled.select(columns)
        .unionByName(by_group.select(columns))
        .unionByName(ranked.select(columns))
    )


def kpi_decilposts(
    status: DataFrame, *, tiles: int = 20, above: int = 10
) -> DataFrame:
    """K5: the upper tiles by number of posts, one row per account and session."""
    return scored_tiles(post_tiles(status, tiles=tiles), tiles=tiles, above=above)


def scored_tiles(placed: DataFrame, *, tiles: int = 20, above: int = 10) -> DataFrame:
    tile = F.col("decil")
    return placed.select(
        F.lit("DECILPOSTS").alias("kpiname"),
        "userid",
        F.when(tile > above, tile / tiles).otherwise(0.0).alias("botscore"),
        "sessionid",
        "anz",
        "decil",
    )


def min_gaps(status: DataFrame) -> DataFrame:
    """Shortest time between two different posting times of an account.

    Times are compared within an hour first, then the edges of the account's
    hours with each other, so no task holds all posts of a busy account.
    """
    micros = F.unix_micros("created_at")
    times = status.select(
        F.col("status_user_id").alias("userid"),
        F.date_trunc("hour", "created_at").alias("hour"),
        micros.alias("at"),
    ).distinct()
    in_hour = W.partitionBy("userid", "hour").orderBy("at")
    hours = (
        times.withColumn("gap", F.col("at") - F.lag("at").over(in_hour))
        .groupBy("userid", "hour")
        .agg(
            F.min("gap").alias("gap"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
        )
    )
    in_order = W.partitionBy("userid").orderBy("hour")
    across = F.col("first_at") - F.lag("last_at").over(in_order)
    return (
        hours.withColumn("gap", F.least("gap", across))
        .groupBy("userid")
        .agg((F.min("gap") / 1e6).alias("mingap"))
        .where(F.col("mingap").isNotNull())
    )


def kpi_tweetfreq(*statuses: DataFrame, seconds: float = 5) -> DataFrame:
    """K7: two posts closer than ``seconds``; needs two different times."""
    return min_gaps(_all_posts(statuses)).select(
        F.lit("TWEETFREQ").alias("kpiname"),
        "userid",
        F.when(F.col("mingap") < seconds, 1.0).otherwise(0.0).alias("botscore"),
        "mingap",
    )


def local_hour() -> Column:
    return F.hour(local_time(F.col("created_at"), F.col("utcoffset")))


def kpi_statusfrequency(
    *datasets: tuple[DataFrame, DataFrame], hours: Sequence[int] = NIGHT
) -> DataFrame:
    """K8: posts at night by the author's clock; 24 hourly counts as details."""
    parts = [
        with_author(status, users).select("id", "userid", "created_at", "utcoffset")
        for status, users in datasets
    ]
    posts = parts[0]
    for part in parts[1:]:
        posts = posts.unionByName(part)
    counts = [
        F.count(F.when(F.col("hour") == h, 1)).alias(f"uhr{h}") for h in range(24)
    ]
    at_night = sum(F.col(f"uhr{h}") for h in hours) > 0
    return (
        posts.distinct()
        .withColumn("hour", local_hour())
        .groupBy("userid")
        .agg(*counts)
        .select(
            F.lit("STATUSFREQUENCY").alias("kpiname"),
            "userid",
            F.when(at_night, 1.0).otherwise(0.0).alias("botscore"),
            *[f"uhr{h}" for h in range(24)],
        )
    )


def kpi_tweetcount(*statuses: DataFrame, per_day: int = 50) -> DataFrame:
    """More than ``per_day`` different posts on one UTC day."""
    posts = _all_posts(statuses).select(
        "id", "created_at", F.col("status_user_id").alias("userid")
    )
    return (
        posts.distinct()
        .groupBy("userid", F.to_date("created_at").alias("day"))
        .agg(count_rows().alias("n"))
        .groupBy("userid")
        .agg(F.max("n").alias("n"))
        .select(
            F.lit("TWEETCOUNT").alias("kpiname"),
            "userid",
            F.when(F.col("n") > per_day, 1.0).otherwise(0.0).alias("botscore"),
        )
    )


def _all_posts(statuses: Sequence[DataFrame]) -> DataFrame:
    """Posts of all datasets one below the other; users of it remove copies."""
    columns = ["id", "status_user_id", "created_at"]
    posts = statuses[0].select(columns)
    for status in statuses[1:]:
        posts = posts.unionByName(status.select(columns))
    return posts
