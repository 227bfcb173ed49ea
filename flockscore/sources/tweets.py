"""Tweets from JSON lines, and which of them a collection admits."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscore.functions.words import tokens_of, whole_words
from flockscore.schemas import CORRUPT, TWEET_JSON



def read_tweets(
    spark: SparkSession, path: str, *, streaming: bool = False, **options: str
) -> DataFrame:
    """One JSON object per line; unreadable lines fill ``_corrupt_record``."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(f"{TWEET_JSON}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .options(**options)
        .json(path)
    )


def tweets_from_values(messages: DataFrame, column: str = "value") -> DataFrame:
    """The same columns out of a string column, e.g. of a Kafka topic."""
    parsed = F.from_json(
        F.col(column).cast("string"),
        f"{TWEET_JSON}, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return messages.select(parsed.alias("tweet")).select("tweet.*")


CONTROLS = ("delete", "limit", "scrub_geo", "warning")
KINDS = ("status", *CONTROLS, "corrupt")


def message_kind(tweets: DataFrame) -> Column:
    """What a line is: a status, a control message or unreadable."""
    kind = F.when(F.col(CORRUPT).isNotNull(), "corrupt")
    for control in CONTROLS:
        kind = kind.when(tweets[control].isNotNull(), control)
    return kind.when(F.col("id").isNotNull(), "status").otherwise("corrupt")


def split_list(value: str | None) -> list[str]:
    """Trimmed parts of a comma-separated setting."""
    if value is None or not value.strip():
        return []
    return [part.strip() for part in value.split(",")]


def _is_token(term: str) -> bool:
    return re.fullmatch(r"[#@]?\w+", term) is not None


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tracks(text: Column, phrases: Sequence[str]) -> Column:
    """Whether all terms of any phrase occur in the text, in any order.

    Case does not matter. A plain term also matches as hashtag or mention; a term with
    ``#`` or ``@`` only matches as such. The text is cut into tokens once, and phrases
    are only looked at with those tokens that are a term of any. A term that is no
    token needs a search of its own.
    """
    text = F.lower(text)
    wanted = [sorted(set(phrase.lower().split())) for phrase in phrases if phrase.strip()]
    terms = {t for words in wanted for t in words if _is_token(t)}
    forms = sorted(terms | {mark + t for t in terms if t[0] not in "#@" for mark in "#@"})

    def listed(values: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), kind)

    def judged(seen: Column) -> Column:
        plain = [words for words in wanted if all(map(_is_token, words))]
        found = F.exists(
            listed(plain, "array<array<string>>"),
            lambda words: F.forall(words, lambda w: F.array_contains(seen, w)),
        )
        for words in wanted:
            if words not in plain:
                known = [F.array_contains(seen, F.lit(w)) for w in words if _is_token(w)]
                searched = [text.rlike(whole_words([w])) for w in words if not _is_token(w)]
                found = found | reduce(Column.__and__, known + searched)
        return found

    def with_plain(seen: Column) -> Column:
        return F.concat(seen, F.transform(seen, lambda t: F.ltrim(t, F.lit("#@"))))

    hits = F.array_intersect(tokens_of(text), listed(forms, "array<string>"))
    found = _once(hits, lambda seen: _once(with_plain(seen), judged))
    return F.coalesce(found, F.lit(False))


def admit(
    tweets: DataFrame,
    *,
    follow: Sequence[int] = (),
    track: Sequence[str] = (),
    language: str | None = None,
    author: str = "user.id",
    text: str = "text",
) -> DataFrame:
    """Tweets by followed accounts or with a tracked phrase, in a language.

    The accounts are a table as long as the given list, which goes to all tasks.
    """
    if not follow and not track:
        raise ValueError("give accounts to follow or phrases to track")
    rows = [(int(f),) for f in dict.fromkeys(follow)]
    accounts = tweets.sparkSession.createDataFrame(rows, "_followed bigint")
    marked = tweets.join(F.broadcast(accounts), F.col(author) == F.col("_followed"), "left")
    wanted = F.col("_followed").isNotNull()
    if track:
        wanted = wanted | tracks(F.col(text), track)
    if language:
        wanted = (F.col("lang") == language) & wanted
    return marked.where(F.coalesce(wanted, F.lit(False))).select(*[F.col(f"`{c}`") for c in tweets.columns])
