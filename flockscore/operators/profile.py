"""Indicators on the profile snapshots of an account (K1-K3)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscore.functions.temporal import calendar_age_days


def name_facts(users: DataFrame) -> DataFrame:
    """Per account what K1-K3 need of its snapshots, as sums that add up."""
    name, about = F.char_length("screen_name"), F.char_length("description")
    return users.groupBy(F.col("id").alias("userid")).agg(
        F.min("created_at").alias("first_created"),
        F.sum(name).cast("bigint").alias("name_sum"),
        F.count(name).alias("name_n"),
        F.sum(about).cast("bigint").alias("desc_sum"),
        F.count(about).alias("desc_n"),
        F.count_if(F.col("screen_name").rlike("[0-9]")).alias("digits"),
        F.sum("followers_count").cast("bigint").alias("followers_sum"),
        F.count("followers_count").alias("followers_n"),
        F.sum("friends_count").cast("bigint").alias("friends_sum"),
        F.count("friends_count").alias("friends_n"),
    )


def scored_profile(
    *,
    age: Column,
    name_len: Column,
    desc_len: Column,
    digit: Column,
    followers: Column,
    friends: Column,
    max_days: int = 365,
    min_name_len: int = 8,
) -> dict[str, Column]:
    """K1-K3 and their details from means over an account's snapshots."""
    name_len, desc_len = (F.coalesce(c, F.lit(0.0)) for c in (name_len, desc_len))
    ratio = followers / F.nullif(friends, F.lit(0.0))
    odd_name = ((name_len < min_name_len) & (desc_len == 0)) | digit
    return {
        "profileage": age,
        "profilenamelen": name_len,
        "desclen": desc_len,
        "anzfollower": followers,
        "anzfriends": friends,
        "ratiofolfriend": ratio,
        "age_score": F.when(age > max_days, 0.0).otherwise(1 - age / max_days),
        "name_score": F.when(odd_name, 1.0).otherwise(0.0),
        "follow_score": F.when(ratio < 1, 1 - ratio).otherwise(0.0),
    }


def profile_facts(
    users: DataFrame,
    *,
    as_of: datetime | Column,
    max_days: int = 365,
    min_name_len: int = 8,
) -> DataFrame:
    """One pass over the snapshots: everything K1-K3 need, per account."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)

    def mean(name: str) -> Column:
        return F.col(f"{name}_sum") / F.nullif(f"{name}_n", F.lit(0))

    means = name_facts(users).select(
        "userid",
        calendar_age_days(F.col("first_created"), as_of).alias("_age"),
        *[mean(n).alias(f"_{n}") for n in ("name", "desc", "followers", "friends")],
        (F.col("digits") > 0).alias("_digit"),
    )
    scored = scored_profile(
        age=F.col("_age"),
        name_len=F.col("_name"),
        desc_len=F.col("_desc"),
        digit=F.col("_digit"),
        followers=F.col("_followers"),
        friends=F.col("_friends"),
        max_days=max_days,
        min_name_len=min_name_len,
    )
    return means.select("userid", *[c.alias(n) for n, c in scored.items()])


def kpi_profileage(
    users: DataFrame, *, as_of: datetime | Column, max_days: int = 365
) -> DataFrame:
    """K1: the younger the profile, the higher the score."""
    return profile_facts(users, as_of=as_of, max_days=max_days).select(
        F.lit("PROFILEAGE").alias("kpiname"),
        "userid",
        F.col("age_score").alias("botscore"),
        "profileage",
    )


def kpi_namdesclen(users: DataFrame, *, min_name_len: int = 8) -> DataFrame:
    """K2: short name without description, or a digit in the name."""
    return profile_facts(
        users, as_of=F.current_timestamp(), min_name_len=min_name_len
    ).select(
        F.lit("NAMDESCLEN").alias("kpiname"),
        "userid",
        F.col("name_score").alias("botscore"),
        "profilenamelen",
        "desclen",
    )


def kpi_anzfollow(users: DataFrame) -> DataFrame:
    """K3: fewer followers than friends."""
    return profile_facts(users, as_of=F.current_timestamp()).select(
        F.lit("ANZFOLLOW").alias("kpiname"),
        "userid",
        F.col("follow_score").alias("botscore"),
        "anzfollower",
        "anzfriends",
        "ratiofolfriend",
    )
