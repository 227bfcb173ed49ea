"""Nested tweets into flat tables with deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["status_id", "recorded_at", "session_id"]
NONE = -1  # stands for a missing id or offset


def tweet_time(text: Column) -> Column:
    """``Wed Aug 27 13:08:45 +0000 2008``; null where it cannot be read."""
    return F.try_to_timestamp(
        F.substring(text, 5, 30), F.lit("MMM dd HH:mm:ss Z yyyy")
    )


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False)).cast("int")


def _key(kind: str | Column, *more: Column) -> Column:
    """Surrogate key of a part of a status, the same on every attempt."""
    return F.xxhash64(*KEY, F.lit(kind), *more)


def _group_key(kind: str, values: Column) -> Column:
    """Key shared by all entities of one kind; null if there are none."""
    return F.when(F.size(values) > 0, _key(kind))


def prepare(
    tweets: DataFrame, session_id: int, recorded_at: Column | None = None
) -> DataFrame:
    """Tweets with the key columns all tables share; arrival time is now."""
    arrival = F.current_timestamp() if recorded_at is None else recorded_at
    return tweets.select(
        F.col("id").alias("status_id"),
        arrival.alias("recorded_at"),
        F.lit(session_id).cast("bigint").alias("session_id"),
        *[c for c in tweets.columns if c != "id"],
    )


def statuses(t: DataFrame) -> DataFrame:
    """The status rows, with entities and the author's snapshot nested."""
    author, entities = F.col("user"), F.col("entities")
    start, end = (lambda e: e["indices"][0]), (lambda e: e["indices"][1])
    return t.select(
        F.col("status_id").alias("id"),
        "recorded_at",
        tweet_time(F.col("created_at")).alias("created_at"),
        "session_id",
        author["id"].alias("status_user_id"),
        F.struct(
            author["lang"].alias("lang"),
            F.coalesce(author["utc_offset"], F.lit(NONE)).alias("utcoffset"),
        ).alias("author"),
        "lang",
        F.col("source").alias("status_source"),
        F.col("text").alias("status_text"),
        F.col("retweeted_status").isNotNull().cast("int").alias("isretweet"),
        F.coalesce("in_reply_to_status_id", F.lit(NONE)).alias(
            "in_reply_to_status_id"
        ),
        F.transform(
            entities["user_mentions"],
            lambda e: F.struct(
                e["id"].alias("user_id"),
                start(e).alias("start"),
                end(e).alias("end"),
                e["name"].alias("username"),
                e["screen_name"].alias("screen_name"),
                e["screen_name"].alias("text"),
            ),
        ).alias("mentions"),
        F.transform(entities["urls"], _url).alias("urls"),
        F.transform(
            entities["hashtags"],
            lambda e: F.struct(
                start(e).alias("start"), end(e).alias("end"), e["text"].alias("text")
            ),
        ).alias("hashtags"),
        F.col("favorite_count").alias("favourites_count"),
        author["name"].alias("username"),
        author["screen_name"].alias("screen_name"),
        F.array_join("withheld_in_countries", ",").alias("withheld_in_countries"),
        F.col("in_reply_to_screen_name").alias("inreplytoscreenname"),
        F.coalesce("in_reply_to_user_id", F.lit(NONE)).alias(
            "inreplytouserid"
        ),
        F.coalesce("quoted_status_id", F.lit(NONE)).alias("quoted_status_id"),
        F.col("retweet_count").alias("retweetcount"),
        F.col("retweeted_status.id").alias("retweeted_status_id"),
        _flag(F.col("favorited")).alias("isfavorited"),
        _flag(F.col("possibly_sensitive")).alias("ispossiblysensitive"),
        _flag(F.col("retweeted")).alias("isretweeted"),
        F.col("current_user_retweet").isNotNull().cast("int").alias(
            "isretweetedbyme"
        ),
        _flag(F.col("truncated")).alias("istruncated"),
        F.get(F.col("coordinates.coordinates"), F.lit(1)).alias("latitude"),
        F.get(F.col("coordinates.coordinates"), F.lit(0)).alias("longitude"),
        F.when(F.col("place").isNotNull(), _key("place")).alias("status_place_id"),
        _group_key("url", entities["urls"]).alias("urlentities_id"),
        _group_key("hashtag", entities["hashtags"]).alias("hashtagentities_id"),
        _group_key("mention", entities["user_mentions"]).alias(
            "usermentionentities_id"
        ),
        _group_key("media", entities["media"]).alias("mediaentities_id"),
    )


def user_snapshots(t: DataFrame) -> DataFrame:
    """One profile snapshot per post, keyed by the post.

    How many posts arrive together has no influence on the snapshots.
    """
    u = F.col("user")
    profile_urls = _profile_urls()
    about_urls = u["entities"]["description"]["urls"]
    snapshot = F.struct(
        u["name"].alias("username"),
        u["screen_name"].alias("screen_name"),
        tweet_time(u["created_at"]).alias("created_at"),
        u["description"].alias("description"),
        _flag(u["geo_enabled"]).alias("geo_enabled"),
        u["lang"].alias("lang"),
        u["followers_count"].alias("followers_count"),
        u["favourites_count"].alias("favourites_count"),
        u["friends_count"].alias("friends_count"),
        u["listed_count"].alias("listed_count"),
        u["location"].alias("loca"),
        u["statuses_count"].alias("statuses_count"),
        u["time_zone"].alias("timezone"),
        u["url"].alias("user_url"),
        F.coalesce(u["utc_offset"], F.lit(NONE)).alias("utcoffset"),
        F.array_join(u["withheld_in_countries"], ",").alias("withheldincountries"),
        _flag(u["contributors_enabled"]).alias("iscontributorsenabled"),
        _flag(u["default_profile"]).alias("isdefaultprofile"),
        _flag(u["default_profile_image"]).alias("isdefaultprofileimage"),
        _flag(u["follow_request_sent"]).alias("isfollowrequestsent"),
        _flag(u["profile_background_tile"]).alias("isprofilebackgroundtiled"),
        _flag(u["profile_use_background_image"]).alias(
            "isprofileusebackgroundimage"
        ),
        _flag(u["protected"]).alias("isprotected"),
        _flag(u["is_translator"]).alias("istranslator"),
        _flag(u["verified"]).alias("isverified"),
        _group_key("user_url", profile_urls).alias("urlentity_id"),
        _group_key("description_url", about_urls).alias("descurlentity_id"),
    )
    known = t.where(u["id"].isNotNull())
    return known.select(u["id"].alias("id"), *KEY, snapshot.alias("snapshot")).select(
        "id", *KEY, "snapshot.*"
    )


def _url(e: Column) -> Column:
    return F.struct(
        e["display_url"].alias("display_url"),
        e["expanded_url"].alias("expanded_url"),
        e["indices"][0].alias("start"),
        e["indices"][1].alias("end"),
        e["url"].alias("url"),
        e["url"].alias("text"),
    )


def _profile_urls() -> Column:
    """The profile's own link, which can be present without content."""
    return F.filter(
        F.col("user.entities.url.urls"), lambda e: F.length(e["url"]) > 0
    )


def _children(t: DataFrame, values: Column, kind: str, fields) -> DataFrame:
    """One row per element of an entity array, keyed by position."""
    rows = t.select(*KEY, F.posexplode(values).alias("pos", "e"))
    return rows.select(
        _key(kind, F.col("pos")).alias("id"),
        _key(kind).alias("entity_id"),
        *KEY,
        "pos",
        *fields(F.col("e")),
    )


def _listed(t: DataFrame, parts: dict[str, Column], name: str) -> DataFrame:
    """One row per element of several arrays of one type, which ``kind`` tells apart. A
    union would read the messages, and take them apart, once for each."""
    arrays = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in parts.items()])
    rows = t.select(*KEY, F.inline(arrays))
    return rows.select(*KEY, "kind", F.posexplode("v").alias("pos", name))


def _link_fields(e: Column) -> list[Column]:
    return [
        e["display_url"].alias("display_url"),
        e["expanded_url"].alias("expanded_url"),
        e["indices"][0].alias("indices_start"),
        e["indices"][1].alias("indices_end"),
        e["url"].alias("url"),
        e["url"].alias("urltext"),
    ]


def urls(t: DataFrame) -> DataFrame:
    """Links in posts, in profiles and in profile descriptions, in one pass."""
    parts = {
        "url": F.col("entities.urls"),
        "user_url": _profile_urls(),
        "description_url": F.col("user.entities.description.urls"),
    }
    rows = _listed(t, parts, "e")
    kind = F.col("kind")
    return rows.select(
        _key(kind, F.col("pos")).alias("id"),
        _key(kind).alias("entity_id"),
        *KEY,
        "pos",
        *_link_fields(F.col("e")),
        "kind",
    )


def hashtags(t: DataFrame) -> DataFrame:
    return _children(
        t,
        F.col("entities.hashtags"),
        "hashtag",
        lambda e: [
            e["indices"][0].alias("indices_start"),
            e["indices"][1].alias("indices_end"),
            e["text"].alias("httext"),
        ],
    )


def mentions(t: DataFrame) -> DataFrame:
    return _children(
        t,
        F.col("entities.user_mentions"),
        "mention",
        lambda e: [
            e["id"].alias("user_id"),
            e["indices"][0].alias("indices_start"),
            e["indices"][1].alias("indices_end"),
            e["name"].alias("username"),
            e["screen_name"].alias("screen_name"),
            e["screen_name"].alias("umtext"),
        ],
    )


def media(t: DataFrame) -> DataFrame:
    return _children(
        t,
        F.col("entities.media"),
        "media",
        lambda e: [
            e["media_url"].alias("media_url"),
            e["media_url_https"].alias("media_url_https"),
            e["type"].alias("media_type"),
            *_link_fields(e),
            F.coalesce(e["sizes"], F.lit("")).alias("sizes"),
        ],
    )


def places(t: DataFrame) -> DataFrame:
    p = F.col("place")
    return t.where(p.isNotNull()).select(
        _key("place").alias("id"),
        *KEY,
        p["name"].alias("pname"),
        p["full_name"].alias("pfullname"),
        p["url"].alias("place_url"),
        p["bounding_box"]["type"].alias("bb_type"),
        p["geometry"]["type"].alias("geo_type"),
        p["country"].alias("country"),
        p["country_code"].alias("country_code"),
        p["place_type"].alias("place_type"),
        p["street_address"].alias("street_address"),
        F.lit(None).cast("bigint").alias("contained_place_id"),
    )


def geolocations(t: DataFrame) -> DataFrame:
    """Corners of the first polygon of a place, longitude first on the wire."""
    fields = {"bbox": "bounding_box", "geo": "geometry"}
    parts = {
        kind: F.get(F.col(f"place.{field}.coordinates"), F.lit(0))
        for kind, field in fields.items()
    }
    kind, corner, place = F.col("kind"), F.col("corner"), _key("place")
    return _listed(t, parts, "corner").select(
        _key(kind, F.col("pos")).alias("id"),
        *KEY,
        "pos",
        corner[1].alias("latitude"),
        corner[0].alias("longitude"),
        F.when(kind == "bbox", place).alias("bboxcoord_place_id"),
        F.when(kind == "geo", place).alias("geocoord_place_id"),
    )


TABLES = {
    "status": statuses,
    "users": user_snapshots,
    "url": urls,
    "hashtag": hashtags,
    "mention": mentions,
    "media": media,
    "place": places,
    "geolocation": geolocations,
}


def normalise(
    tweets: DataFrame, session_id: int, recorded_at: Column | None = None
) -> dict[str, DataFrame]:
    """All tables of a batch of tweets."""
    t = prepare(tweets, session_id, recorded_at)
    return {name: build(t) for name, build in TABLES.items()}
