"""All indicators of an account from facts that add up.

Posts are read once. Copies of a post become one row first: a post keeps its author,
time, language and client, however often it is recorded. Each post then gives facts of
several kinds, (userid, kind, key, word) with counts, sums, and the ends of a stretch
of time. Facts of equal keys add up, so facts of two parts of the posts give those of
both; the streaming scores keep them instead of posts.

The shortest gap between posts (K7) needs no sorted list of times: within a bucket of
``SECONDS`` two different times are closer than that, and between buckets only the
ends of neighbours count. Where facts are not kept, times go their own way, since they
are the most rows and have two of the many columns of a fact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flockscore.functions.joins import count_rows, lookup_join
from flockscore.functions.temporal import calendar_age_days, local_time
from flockscore.operators.activity import NIGHT, scored_tiles, session_counts, tiles_of
from flockscore.operators.language import UNDETERMINED
from flockscore.operators.profile import name_facts, scored_profile
from flockscore.operators.reaction import reply_gaps
from flockscore.operators.snapshots import sum_snapshots, with_author
from flockscore.plans.registry import Inputs
from flockscore.session import materialise, run_dir

SECONDS = 5
_BUCKET = SECONDS * 1_000_000
_HOUR = 3600 * 1_000_000
KEYS = ["userid", "kind", "key", "word"]
COUNTS = [f"n{i}" for i in range(1, 10)]
SUMS = ["s1", "s2"]
FACTS = ", ".join(
    ["userid bigint", "kind string", "key bigint", "word string"]
    + [f"{c} bigint" for c in COUNTS]
    + [f"{c} double" for c in SUMS]
    + ["lo bigint", "hi bigint"]
)

# which kinds of facts an indicator is made of
KINDS = {
    "PROFILEAGE": ("profile",),
    "NAMDESCLEN": ("profile",),
    "ANZFOLLOW": ("profile",),
    "TWEETMENTION": ("post",),
    "LANGUSERTWEETS": ("author",),
    "TWEETFREQ": ("time",),
    "STATUSFREQUENCY": ("author",),
    "REACTIONTIME": ("reply",),
    "REACTIONTIME_SELF": ("reply",),
    "TWEETLANGS": ("lang",),
    "TWEETLANGS_OWN": ("own",),
    "TWEETCOUNT": ("day",),
    "SOURCEQUALIFICATION": ("post",),
    "KOSOURCEQUALIFICATION": ("post",),
}

# what is asked of each kind, and how the parts of an account's are put together
COLUMNS = {
    "profile": "n1 n2 n3 n4 n5 n6 n7 n8 n9 lo",
    "post": "n1 n2 n3 s1 s2",
    "author": "n1 n2 n3 n4",
    "time": "gap",
    "reply": "lo",
    "lang": "n1 rows",
    "own": "n1 rows",
    "day": "most",
}
LAST = {"gap": F.min, "lo": F.min, "most": F.max}
# columns that facts of posts fill
FILLED = {"post": "n1 n2 n3 s1 s2", "day": "n1", "lang": "n1", "own": "n1", "time": "lo hi"}


def fact(kind: str, **values: Column) -> Column:
    """One fact as a struct of ``FACTS`` without the account."""
    fields = []
    for column in FACTS.split(", ")[1:]:
        name, of = column.split()
        value = F.lit(kind) if name == "kind" else values.get(name, F.lit(None))
        fields.append(value.cast(of).alias(name))
    return F.struct(*fields)


def merged(facts: DataFrame, filled: Sequence[str] = (*COUNTS, *SUMS, "lo", "hi")) -> DataFrame:
    """Facts of equal keys as one; columns that are not ``filled`` are null."""
    last = {"lo": F.min, "hi": F.max}
    added = facts.groupBy(*KEYS).agg(*[last.get(c, F.sum)(c).alias(c) for c in filled])
    columns = [c.split() for c in FACTS.split(", ")]
    return added.select(
        [F.col(c) if c in added.columns else F.lit(None).cast(of).alias(c) for c, of in columns]
    )


def _stacked(statuses: Sequence[DataFrame], source_q: DataFrame | None) -> DataFrame:
    """Posts of all datasets; those of the first one are ``own``."""
    parts = [
        status.select(
            "id",
            F.col("status_user_id").alias("userid"),
            F.unix_micros("created_at").alias("at"),
            "lang",
            "isretweet",
            F.coalesce(F.size("mentions"), F.lit(0)).alias("n_mentions")
            if "mentions" in status.columns
            else F.lit(0).alias("n_mentions"),
            F.col("status_source").alias("source"),
            F.lit(n == 0).alias("own"),
        )
        for n, status in enumerate(statuses)
    ]
    posts = reduce(DataFrame.unionByName, parts)
    if source_q is None:
        return posts.withColumns({"q": F.lit(0.0), "ko": F.lit(0.0)})
    known = source_q.select("source", F.col("botscore").alias("q"), F.col("kobotscore").alias("ko"))
    return lookup_join(posts, known, "source")


def single_posts(
    statuses: Sequence[DataFrame], source_q: DataFrame | None = None
) -> DataFrame:
    """One row per account and post, with the number of its copies."""
    own = F.col("own")
    return (
        _stacked(statuses, source_q)
        .groupBy("userid", "id")
        .agg(
            F.count_if(own).alias("copies"),
            F.sum(F.when(own, F.col("n_mentions"))).alias("mentions"),
            F.min("at").alias("at"),
            F.min("lang").alias("lang"),
            F.max("isretweet").alias("isretweet"),
            F.avg(F.coalesce("q", F.lit(0.0))).alias("q"),
            F.max(F.coalesce("ko", F.lit(0.0))).alias("ko"),
        )
    )


def _bucket(at: Column) -> Column:
    return at - F.pmod(at, F.lit(_BUCKET))


def post_facts(posts: DataFrame, kinds: Sequence[str], new: Column | None = None) -> DataFrame:
    """Facts of ``single_posts``. Where ``new`` is false a post has been counted
    before: it only adds its copies and mentions."""
    new = F.lit(True) if new is None else new
    one, at = F.lit(1), F.col("at")
    known_lang = F.col("lang") != UNDETERMINED
    first = F.when(new, one)
    each = {
        "post": fact(
            "post", n1=F.col("copies"), n2=F.col("mentions"), n3=first,
            s1=F.when(new, F.col("q")), s2=F.when(new, F.col("ko")),
        ),
        "day": F.when(new, fact("day", key=F.unix_date(F.to_date(F.timestamp_micros(at))), n1=one)),
        "lang": F.when(new & known_lang, fact("lang", word=F.col("lang"), n1=one)),
        "own": F.when(
            new & known_lang & (F.col("isretweet") == 0), fact("own", word=F.col("lang"), n1=one)
        ),
        "time": F.when(at.isNotNull(), fact("time", key=_bucket(at), lo=at, hi=at)),
    }
    wanted = F.array(*[each[k] for k in each if k in kinds])
    filled = dict.fromkeys(c for k in each if k in kinds for c in FILLED[k].split())
    return merged(posts.select("userid", F.inline(F.filter(wanted, lambda f: f.isNotNull()))), [*filled])


def local_frame(datasets: Sequence[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Posts with what K6, K8 and K9 ask of the author's snapshot (K15); posts of the
    first dataset are ``own``. Equal snapshots of a post are one row with their number."""
    parts = []
    for n, (status, users) in enumerate(datasets):
        clock = local_time(F.col("created_at"), F.col("utcoffset"))
        undetermined = F.col("lang") == UNDETERMINED
        fits = undetermined | (F.col("lang") == F.col("profile_lang"))
        parts.append(
            with_author(status, users).select(
                "id",
                "userid",
                "in_reply_to_status_id",
                clock.alias("local_at"),
                F.coalesce(undetermined, F.lit(False)).alias("und"),
                (~F.coalesce(fits, F.lit(False))).alias("other"),
                F.lit(n == 0).alias("own"),
                "n_snapshots",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def author_facts(local: DataFrame) -> DataFrame:
    """Languages other than the profile's, and posts at night, per account."""
    own = F.col("own")
    counts = local.groupBy("userid").agg(
        sum_snapshots(own).alias("n1"),
        sum_snapshots(own & F.col("und")).alias("n2"),
        sum_snapshots(own & F.col("other")).alias("n3"),
        sum_snapshots(F.hour("local_at").isin(*NIGHT)).alias("n4"),
    )
    values = {c: F.col(c) for c in ("n1", "n2", "n3", "n4")}
    return counts.select("userid", F.inline(F.array(fact("author", **values))))


def reply_facts(local: DataFrame, self_only: bool) -> DataFrame:
    """The shortest time between a post and its reply, per account."""
    posts = local.select("id", "userid", "in_reply_to_status_id", "local_at").distinct()
    answered = local.select(F.col("in_reply_to_status_id").alias("parent_id"))
    gaps = reply_gaps(posts, answered, self_only).groupBy("userid").agg(F.min("gap").alias("lo"))
    return gaps.select("userid", F.inline(F.array(fact("reply", lo=F.col("lo")))))


def snapshot_facts(users: DataFrame) -> DataFrame:
    """Sums over an account's snapshots."""
    facts = name_facts(users)
    names = "name_sum name_n desc_sum desc_n digits followers_sum followers_n friends_sum friends_n"
    values = {c: F.col(name) for c, name in zip(COUNTS, names.split(), strict=True)}
    values["lo"] = F.unix_micros("first_created")
    return facts.select("userid", F.inline(F.array(fact("profile", **values))))


def _shortest_gaps(facts: DataFrame) -> DataFrame:
    """Facts per account, kind and hour, with the shortest ``gap`` between times."""
    key = F.col("key")
    hour = F.when(F.col("kind") == "time", key - F.pmod(key, F.lit(_HOUR)))
    in_hour = W.partitionBy("userid", "kind", "hour").orderBy("key")
    before = F.col("lo") - F.lag("hi").over(in_hour)
    inside = F.when((F.col("kind") == "time") & (F.col("lo") != F.col("hi")), F.col("hi") - F.col("lo"))
    return (
        facts.withColumn("hour", hour)
        .withColumn("gap", F.least(before, inside))
        .groupBy("userid", "kind", "hour")
        .agg(
            *[F.sum(c).alias(c) for c in COUNTS + SUMS],
            F.max("n1").alias("most"),
            count_rows().alias("rows"),
            F.min("gap").alias("gap"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )


def gaps_of(posts: DataFrame) -> DataFrame:
    """(userid, kind, gap) of ``single_posts``: what ``account_facts`` takes from facts of
    kind ``time``, one row per account, out of rows of two times."""
    at = F.col("at")
    buckets = posts.where(at.isNotNull()).groupBy("userid", _bucket(at).alias("key"))
    times = buckets.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    hour = F.col("key") - F.pmod("key", F.lit(_HOUR))
    in_hour = W.partitionBy("userid", "hour").orderBy("key")
    before = F.col("lo") - F.lag("hi").over(in_hour)
    inside = F.when(F.col("lo") != F.col("hi"), F.col("hi") - F.col("lo"))
    hours = (
        times.withColumn("hour", hour)
        .withColumn("gap", F.least(before, inside))
        .groupBy("userid", "hour")
        .agg(F.min("gap").alias("gap"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    across = F.col("lo") - F.lag("hi").over(W.partitionBy("userid").orderBy("hour"))
    least = hours.withColumn("gap", F.least("gap", across)).groupBy("userid")
    return least.agg(F.min("gap").alias("gap")).select("userid", F.lit("time").alias("kind"), "gap")


def account_facts(facts: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One row per account out of merged facts, as struct columns by kind. With ``gaps_of``
    the posts, facts have none of kind ``time``.

    No task holds the posts of an account: an hour has at most 720 buckets, and an
    account as many rows as it has hours with posts, days and languages.
    """
    if gaps is None:
        by_hour = W.partitionBy("userid", "kind").orderBy("hour")
        across = F.when(F.col("kind") == "time", F.col("lo") - F.lag("hi").over(by_hour))
        parts = _shortest_gaps(facts).withColumn("gap", F.least("gap", across))
    else:
        parts = facts.withColumns({"most": F.col("n1"), "rows": F.lit(1).cast("bigint")})
        # an account has few of them, so they are dealt before they become wide rows, of
        # which a task would else hold one for nearly every account
        parts = parts.unionByName(gaps, allowMissingColumns=True).repartition("userid")

    def of(kind: str, columns: str) -> Column:
        own = F.col("kind") == kind
        parts = [
            LAST.get(c, F.sum)(F.when(own, F.col(c))).alias(c) for c in columns.split()
        ]
        return F.when(F.count_if(own) > 0, F.struct(*parts)).alias(kind)

    return parts.groupBy("userid").agg(*[of(*x) for x in COLUMNS.items()])


def indicator_rows(facts: DataFrame, names: dict[str, str], as_of: Column) -> DataFrame:
    """(kpiname, userid, botscore) out of ``account_facts``; ``names`` maps the names to
    give to the indicators of ``KINDS``. Accounts without facts have no row."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    mean = lambda k, a, b: F.col(k)[a] / F.nullif(F.col(k)[b], F.lit(0))
    # columns of their own, since each is used more than once
    means = {
        "_age": calendar_age_days(F.timestamp_micros(F.col("profile.lo")), as_of),
        "_name": mean("profile", "n1", "n2"),
        "_desc": mean("profile", "n3", "n4"),
        "_followers": mean("profile", "n6", "n7"),
        "_friends": mean("profile", "n8", "n9"),
        "_mentions": mean("post", "n2", "n1"),
    }
    posts, author = F.col("post"), F.col("author")
    profile = scored_profile(
        age=F.col("_age"), name_len=F.col("_name"), desc_len=F.col("_desc"), digit=F.col("profile.n5") > 0,
        followers=F.col("_followers"), friends=F.col("_friends"),
    )
    mentions = F.col("_mentions")
    score = {
        "PROFILEAGE": profile["age_score"],
        "NAMDESCLEN": profile["name_score"],
        "ANZFOLLOW": profile["follow_score"],
        "TWEETMENTION": F.when(mentions < 0.5, 1 - mentions).otherwise(0.0),
        "LANGUSERTWEETS": (author["n2"] * 0.2 + author["n3"]) / F.nullif(author["n1"], F.lit(0)),
        "TWEETFREQ": flag(F.col("time.gap") < SECONDS * 1_000_000),
        "STATUSFREQUENCY": flag(author["n4"] > 0),
        "REACTIONTIME": flag(F.col("reply.lo") < 5_000_000),
        "TWEETLANGS": flag(F.col("lang.rows") / F.col("lang.n1") > 0.06),
        "TWEETLANGS_OWN": flag(F.col("own.rows") / F.col("own.n1") > 0.06),
        "TWEETCOUNT": flag(F.col("day.most") > 50),
        "SOURCEQUALIFICATION": posts["s1"] / posts["n3"],
        "KOSOURCEQUALIFICATION": flag(posts["s2"] / posts["n3"] > 0.5),
    }
    score["REACTIONTIME_SELF"] = score["REACTIONTIME"]
    known = {"TWEETFREQ": F.col("time.gap").isNotNull(), "TWEETMENTION": posts["n1"] > 0}
    rows = [
        F.struct(
            F.lit(name).alias("kpiname"),
            score[of].cast("double").alias("botscore"),
            F.coalesce(known.get(of, F.col(KINDS[of][0]).isNotNull()), F.lit(False)).alias("known"),
        )
        for name, of in names.items()
    ]
    found = facts.withColumns(means).select("userid", F.array(*rows).alias("_rows"))
    found = found.select("userid", F.inline(F.filter("_rows", lambda r: r["known"])))
    return found.select("kpiname", "userid", "botscore")


def tile_rows(status: DataFrame) -> DataFrame:
    """K5 from a written table of posts by account and session, which its steps read
    several times instead of the posts."""
    path = run_dir(status.sparkSession, "session-counts")
    rows = scored_tiles(tiles_of(materialise(session_counts(status), path)))
    return rows.select("kpiname", "userid", "botscore").distinct()


def standard_rows(inputs: Inputs, names: dict[str, str]) -> DataFrame:
    """The indicators ``names`` (name -> its entry in ``KINDS``) in one pass over the
    posts; those on the author's clock take a second one."""
    kinds = {k for of in names.values() for k in KINDS[of]}
    parts, gaps = [], None
    if kinds & set(FILLED):
        asked = "SOURCEQUALIFICATION" in names.values() or "KOSOURCEQUALIFICATION" in names.values()
        posts = single_posts(inputs.statuses, inputs.source_q if asked else None)
        if "time" in kinds and kinds != {"time"}:
            gaps = gaps_of(posts)
        kept = kinds if gaps is None else kinds - {"time"}
        if kept & set(FILLED):
            parts.append(post_facts(posts, sorted(kept)))
    if kinds & {"author", "reply"}:
        local = local_frame(inputs.datasets)
        if "reply" in kinds:
            # read again by the replies and their parents
            local = materialise(local, run_dir(local.sparkSession, "local-posts"))
            parts.append(reply_facts(local, "REACTIONTIME_SELF" in names.values()))
        if "author" in kinds:
            parts.append(author_facts(local))
    if "profile" in kinds:
        parts.append(snapshot_facts(inputs.users))
    facts = account_facts(reduce(DataFrame.unionByName, parts), gaps)
    as_of = inputs.as_of if isinstance(inputs.as_of, Column) else F.lit(inputs.as_of)
    return indicator_rows(facts, names, as_of)
