"""The given tables mapped onto the frames of the library.

Posts are the events, with text and language of a document and the link of a
page; accounts are the customers. The fetched history holds all events once
more, recorded a day later, and the orders as older posts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscore.plans.registry import Inputs
from flockscore.schemas import HASHTAG, MENTION, SESSION, SOURCE_Q, URL
from flockscore.sources.tweets import tweets_from_values

AS_OF = datetime(2024, 1, 31)
OLD_POSTS = 1_000_000_000_000


_known: WeakKeyDictionary[SparkSession, dict[tuple, object]] = WeakKeyDictionary()


def once(build: Callable) -> Callable:
    """Build a frame once per session and arguments."""

    @wraps(build)
    def known(spark: SparkSession, *args, **more):
        frames = _known.setdefault(spark, {})
        key = (build.__name__, args, tuple(sorted(more.items())))
        if key not in frames:
            frames[key] = build(spark, *args, **more)
        return frames[key]

    return known


SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, "
    "c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "conversations": "text string",
    "labels": "doc_id bigint, toxic int",
    "nation": "n_nationkey int, n_name string",
    "region": "r_regionkey int",
    "supplier": "s_suppkey bigint, s_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, "
    "event_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def _with_row_of(
    events: DataFrame, other: DataFrame, key: str, number: str
) -> DataFrame:
    """Each event with the row of ``other`` at its id modulo the row count."""
    size = other.agg(F.count(F.lit(1)).alias("_size"))
    numbered = events.crossJoin(F.broadcast(size)).withColumn(
        key, F.col(number) % F.col("_size")
    )
    return numbered.drop("_size").join(other, key)


@once
def posts(spark: SparkSession, sf: str, *, spread: bool = False) -> DataFrame:
    """The live stream. ``spread`` deals the narrow events over tasks before they meet
    their texts, for work on the texts: one file of events is one task otherwise."""
    documents = table(spark, sf, "documents").select(
        "doc_id", "text", "lang", F.col("source").alias("doc_source")
    )
    events = table(spark, sf, "events")
    if spread:
        events = events.repartition("event_id")
    e = _with_row_of(events, documents, "doc_id", "event_id")
    number = F.col("event_id")
    tags = F.array(
        F.col("event_type"), F.when(number % 2 == 0, F.col("doc_source"))
    )
    return e.select(
        number.alias("id"),
        F.col("ts").alias("recorded_at"),
        F.col("ts").alias("created_at"),
        (number % 3).alias("session_id"),
        F.col("user_id").alias("status_user_id"),
        F.when(F.col("lang") == "es", "und").otherwise(F.col("lang")).alias("lang"),
        F.col("event_type").alias("status_source"),
        F.concat(
            "text",
            F.when(
                number % 7 == 0,
                " (#gameinsight) the-new/www https://t.co/ab12...",
            ).otherwise(""),
        ).alias("status_text"),
        F.when(number % 5 == 0, 1).otherwise(0).alias("isretweet"),
        F.when(
            (number % 4 == 0) & (number > 7), number - 1 - number % 7
        ).alias("in_reply_to_status_id"),
        _mentions(number, F.col("user_id")),
        _hashtags(tags),
    )


def _mentions(number: Column, account: Column) -> Column:
    """Accounts with a higher last digit than the post's mention themselves."""
    parts = {"user_id": account, "start": F.lit(0), "end": F.lit(1)}
    parts |= dict.fromkeys(("username", "screen_name", "text"), F.lit("u"))
    mention = F.struct(*[c.alias(n) for n, c in parts.items()]).cast(MENTION)
    nobody = F.array().cast(f"array<{MENTION}>")
    mentions = F.when(number % 10 < account % 10, F.array(mention)).otherwise(nobody)
    return mentions.alias("mentions")


def _hashtags(tags: Column) -> Column:
    spans = F.transform(
        tags,
        lambda t: F.struct(
            F.lit(0).alias("start"), F.lit(1).alias("end"), t.alias("text")
        ),
    )
    return spans.cast(f"array<{HASHTAG}>").alias("hashtags")


@once
def posts_with_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The live stream; clicks and views carry the link of a page."""
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("_url"))
    link = F.struct(
        F.col("_url").alias("display_url"),
        F.col("_url").alias("expanded_url"),
        F.lit(0).alias("start"),
        F.lit(1).alias("end"),
        F.col("_url").alias("url"),
        F.col("_url").alias("text"),
    )
    linked = F.col("status_source").isin("click", "view")
    return (
        _with_row_of(posts(spark, sf), pages, "page_id", "id")
        .withColumn("urls", F.when(linked, F.array(link)).cast(f"array<{URL}>"))
        .drop("page_id", "_url")
    )


@once
def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """One profile per customer."""
    key = F.col("c_custkey")
    age = key * 13 % 700 * 86_400 + key * 7919 % 86_400
    return table(spark, sf, "customer").select(
        key.alias("id"),
        F.when(key % 6 == 0, F.substring("c_mktsegment", 1, 5))
        .when(key % 3 != 2, F.col("c_mktsegment"))
        .otherwise(F.col("c_name"))
        .alias("screen_name"),
        F.when(key % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("description"),
        F.timestamp_seconds(F.unix_seconds(F.lit(AS_OF)) - age).alias("created_at"),
        F.when(key % 4 == 0, "de").when(key % 4 == 1, "fr").otherwise("en").alias(
            "lang"
        ),
        F.floor(F.abs("c_acctbal")).cast("int").alias("followers_count"),
        (key * 37 % 5 * 1000).cast("int").alias("friends_count"),
        F.when(key % 11 == 0, None)
        .otherwise((F.col("c_nationkey") % 24 - 11) * 3600)
        .cast("int")
        .alias("utcoffset"),
    )


def _snapshots(profiles: DataFrame, recorded: DataFrame) -> DataFrame:
    """A snapshot with every post; followers change a little over time."""
    seen = recorded.select(
        F.col("status_user_id").alias("id"),
        "recorded_at",
        "session_id",
        (F.col("id") % 50).cast("int").alias("_more"),
    )
    return (
        seen.join(profiles, "id")
        .withColumn("followers_count", F.col("followers_count") + F.col("_more"))
        .drop("_more")
    )


def _recorded_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("status_user_id"),
        F.col("ts").alias("recorded_at"),
        (F.col("event_id") % 3).alias("session_id"),
    )


@once
def users(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of the live stream and one of every customer at ``AS_OF``."""
    profiles = accounts(spark, sf)
    known = profiles.withColumn("recorded_at", F.lit(AS_OF)).withColumn(
        "session_id", F.lit(0).cast("bigint")
    )
    return known.unionByName(_snapshots(profiles, _recorded_events(spark, sf)))


@once
def old_posts(spark: SparkSession, sf: str) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    made = F.timestamp_seconds(F.unix_seconds("o_orderdate") + key * 7 % 86_400)
    return table(spark, sf, "orders").select(
        (key + OLD_POSTS).alias("id"),
        F.timestamp_micros(F.unix_micros(made) + key).alias("recorded_at"),
        made.alias("created_at"),
        F.lit(3).cast("bigint").alias("session_id"),
        F.col("o_custkey").alias("status_user_id"),
        F.when(priority == "1-URGENT", "en")
        .when(priority == "2-HIGH", "de")
        .when(priority == "3-MEDIUM", "fr")
        .otherwise("und")
        .alias("lang"),
        F.col("o_orderstatus").alias("status_source"),
        F.lit(0).alias("isretweet"),
        F.when(priority == "1-URGENT", key + OLD_POSTS - 1).alias(
            "in_reply_to_status_id"
        ),
        F.concat(F.lit("order #"), "o_orderstatus", F.lit(" "), priority).alias(
            "status_text"
        ),
        _mentions(key, F.col("o_custkey")),
        _hashtags(F.array("o_orderstatus", "o_orderpriority")),
    )


@once
def old_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Links and hashtags of the older posts; urgent ones carry a link."""
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("_url"))
    orders = _with_row_of(table(spark, sf, "orders"), pages, "page_id", "o_orderkey")
    link = F.struct(
        *[F.col("_url").alias(n) for n in ("display_url", "expanded_url", "url", "text")]
    )
    linked = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return orders.select(
        F.col("o_custkey").alias("status_user_id"),
        F.when(linked, F.array(link)).alias("urls"),
        _hashtags(F.array("o_orderstatus", "o_orderpriority")),
    )


@once
def history(spark: SparkSession, sf: str) -> DataFrame:
    """The fetched history: the stream's posts once more, and older ones."""
    old = old_posts(spark, sf)
    again = (
        posts(spark, sf)
        .withColumn("recorded_at", F.expr("recorded_at + interval 1 day"))
        .withColumn("session_id", F.lit(3).cast("bigint"))
    )
    return again.select(old.columns).unionByName(old)


@once
def history_users(spark: SparkSession, sf: str) -> DataFrame:
    again = (
        _recorded_events(spark, sf)
        .withColumn("recorded_at", F.expr("recorded_at + interval 1 day"))
        .withColumn("session_id", F.lit(3).cast("bigint"))
    )
    old = old_posts(spark, sf).select(again.columns)
    return _snapshots(accounts(spark, sf), again.unionByName(old))


@once
def source_q(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            ("click", "", 0.0, 0.0),
            ("view", "", 0.2, 0.0),
            ("error", "", 1.0, 1.0),
            ("signup", "", 0.5, 1.0),
        ],
        SOURCE_Q,
    )


@once
def session(spark: SparkSession) -> DataFrame:
    topics = ["#a", "#b,#c", "#d"]
    rows = [(i, topic, "", "streaming") for i, topic in enumerate(topics)]
    return spark.createDataFrame(rows, SESSION)


@once
def challenge(spark: SparkSession, sf: str) -> DataFrame:
    """All customers; those of one segment are listed under two parents."""
    key = F.col("c_custkey")
    listed = table(spark, sf, "customer").select(
        key.alias("user_id"),
        F.col("c_mktsegment").alias("parent_screen_name"),
        F.col("c_nationkey").cast("bigint").alias("parent_id"),
        F.when(key % 10 == 3, None)
        .otherwise(key * 17 % 101 / F.lit(100.0))
        .alias("botscore"),
        F.lit(1).cast("bigint").alias("maxtweetid"),
    )
    twice = listed.where(F.col("parent_screen_name") == "BUILDING").withColumn(
        "parent_id", F.col("parent_id") + 100
    )
    return listed.unionByName(twice)


@once
def live(spark: SparkSession, sf: str) -> Inputs:
    """The stream alone."""
    return Inputs(
        posts(spark, sf), users(spark, sf), AS_OF, source_q=source_q(spark)
    )


@once
def fetched(spark: SparkSession, sf: str) -> Inputs:
    """The fetched history alone."""
    return Inputs(
        history(spark, sf), history_users(spark, sf), AS_OF, source_q=source_q(spark)
    )


@once
def both(spark: SparkSession, sf: str) -> Inputs:
    """History first, the stream as second dataset."""
    return Inputs(
        history(spark, sf),
        history_users(spark, sf),
        AS_OF,
        other_status=posts(spark, sf),
        other_users=users(spark, sf),
    )


@once
def messages(spark: SparkSession, sf: str) -> DataFrame:
    """The stream as it comes over the wire: one JSON object per row."""

    def stamp(ts):
        return F.concat(F.lit("Mon "), F.date_format(ts, "MMM dd HH:mm:ss Z yyyy"))

    documents = table(spark, sf, "documents").select(
        "doc_id", "text", F.col("lang").alias("doc_lang"), "source"
    )
    pages = table(spark, sf, "pages").select("page_id", "url")
    events = table(spark, sf, "events")
    profiles = accounts(spark, sf).select(
        F.col("id").alias("user_id"), F.struct("*").alias("p")
    )
    # texts last: what is joined before them is shuffled without one
    e = _with_row_of(events.join(profiles, "user_id"), pages, "page_id", "event_id")
    e = _with_row_of(e, documents, "doc_id", "event_id")
    number, spans = F.col("event_id"), F.array(F.lit(0), F.lit(1))
    link = F.struct(
        "url",
        F.col("url").alias("expanded_url"),
        F.col("url").alias("display_url"),
        spans.alias("indices"),
    )
    tags = F.filter(
        F.array("event_type", F.when(number % 2 == 0, F.col("source"))),
        lambda t: t.isNotNull(),
    )
    mention = F.struct(
        F.col("user_id").alias("id"),
        F.lit("u").alias("name"),
        F.lit("u").alias("screen_name"),
        spans.alias("indices"),
    )
    mentioned = F.transform(
        F.when(number % 10 < F.col("user_id") % 10, F.array(F.lit(1))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda _: mention,
    )
    linked = F.transform(
        F.when(
            F.col("event_type").isin("click", "view"), F.array(F.lit(1))
        ).otherwise(F.array().cast("array<int>")),
        lambda _: link,
    )
    lon, lat = F.col("user_id") % 180, F.col("user_id") % 90
    photo = F.struct(
        F.col("url").alias("media_url"),
        F.lit("photo").alias("type"),
        "url",
        spans.alias("indices"),
    )
    attached = F.transform(
        F.when(number % 6 == 0, F.sequence(F.lit(0), (number / 6 % 2).cast("int"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda _: photo,
    )
    home = F.concat(F.lit("https://home/"), F.col("user_id"))
    # one account in three has a profile link, another an empty one
    own_link = F.when(
        F.col("user_id") % 3 < 2,
        F.array(F.struct(F.when(F.col("user_id") % 3 == 0, home).otherwise("").alias("url"))),
    )
    about = F.when(F.col("user_id") % 5 == 0, F.array(F.struct(home.alias("url")), F.struct(F.lit("https://b").alias("url"))))
    profile_links = F.struct(
        F.struct(own_link.alias("urls")).alias("url"), F.struct(about.alias("urls")).alias("description")
    )
    corner = F.array(lon.cast("double"), lat.cast("double"))
    box = F.struct(
        F.lit("Polygon").alias("type"),
        F.array(F.array(corner, corner)).alias("coordinates"),
    )
    place = F.struct(
        F.col("source").alias("name"),
        F.col("source").alias("full_name"),
        box.alias("bounding_box"),
    )
    tweet = F.struct(
        number.alias("id"),
        stamp(F.col("ts")).alias("created_at"),
        "text",
        F.when(F.col("doc_lang") == "es", "und")
        .otherwise(F.col("doc_lang"))
        .alias("lang"),
        F.col("event_type").alias("source"),
        F.when(
            (number % 4 == 0) & (number > 7), number - 1 - number % 7
        ).alias("in_reply_to_status_id"),
        F.when(number % 5 == 0, F.struct((number + 1).alias("id"))).alias(
            "retweeted_status"
        ),
        F.when(F.col("event_type") == "signup", place).alias("place"),
        F.struct(
            F.transform(
                tags,
                lambda t: F.struct(t.alias("text"), spans.alias("indices")),
            ).alias("hashtags"),
            linked.alias("urls"),
            mentioned.alias("user_mentions"),
            attached.alias("media"),
        ).alias("entities"),
        F.struct(
            "p.id",
            F.col("p.screen_name").alias("name"),
            "p.screen_name",
            stamp(F.col("p.created_at")).alias("created_at"),
            "p.description",
            "p.lang",
            "p.followers_count",
            "p.friends_count",
            F.col("p.utcoffset").alias("utc_offset"),
            profile_links.alias("entities"),
        ).alias("user"),
    )
    return e.select(F.to_json(tweet).alias("value"))


@once
def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return tweets_from_values(messages(spark, sf))


@once
def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The stream with control messages and rubbish in between.

    Toxic documents give deletion notices, suppliers limit notices, nations stall
    warnings, regions notices to remove places, the turns of conversations lines that
    are no JSON.
    """
    notice = F.struct(
        F.struct(
            F.struct(F.col("doc_id").alias("id"), F.col("doc_id").alias("user_id"))
            .alias("status")
        ).alias("delete")
    )
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1)
    track = F.struct(F.struct(F.col("s_suppkey").alias("track")).alias("limit"))
    region = F.col("r_regionkey").cast("bigint")
    scrub = F.struct(F.struct(region.alias("user_id"), region.alias("up_to_status_id")).alias("scrub_geo"))
    stall = F.struct(F.struct(F.lit("FALLING_BEHIND").alias("code"), F.col("n_name").alias("message")).alias("warning"))
    spoken = F.regexp_replace(F.concat(F.lit("> "), "text"), "[\r\n]+", " ")
    return (
        messages(spark, sf)
        .unionByName(toxic.select(F.to_json(notice).alias("value")))
        .unionByName(table(spark, sf, "supplier").select(F.to_json(track).alias("value")))
        .unionByName(table(spark, sf, "region").select(F.to_json(scrub).alias("value")))
        .unionByName(table(spark, sf, "nation").select(F.to_json(stall).alias("value")))
        .unionByName(
            table(spark, sf, "conversations").select(spoken.alias("value"))
        )
    )
