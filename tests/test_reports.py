"""Reports on topics, days, links, words and scores."""

import random
import re

import pytest
from frames import at, challenge, session, source_q, status, users
from pyspark.sql import functions as F

from flockscore.functions.words import blank_out, drop_words, whole_words
from flockscore.plans import reports, texts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def bots(spark):
    return spark.createDataFrame([(1,)], "userid bigint")


def test_topics_and_days(spark, bots):
    posts = status(
        spark,
        {"u": 1, "session": 0}, {"u": 1, "session": 2, "t": 86_400},
        {"u": 2, "session": 0}, {"u": 2, "session": 1},
        {"u": 3, "session": 9},
        {"id": 1, "u": 1, "session": 2, "recorded_at": at(5)},
    )
    topics = session(spark, "#a", "#b", "#a")
    assert rows(reports.bots_per_topic(posts, bots, topics)) == [
        ("#a", 2, 1), ("#b", 1, 0), (None, 1, 0),
    ]
    days = [
        (t, d.day, u, n, b)
        for t, d, u, n, b in reports.counts_per_day(posts, bots, topics).collect()
    ]
    assert sorted(days, key=str) == [
        ("#a", 10, 2, 2, 1), ("#a", 11, 1, 1, 1), ("#b", 10, 1, 1, 0),
        (None, 10, 1, 1, 0),
    ]


def test_links_and_hashtags_count_accounts(spark):
    found = spark.createDataFrame([(1,), (2,)], "userid bigint")
    posts = status(
        spark,
        *[{"u": 1, "urls": ["a"], "tags": ["x"]}] * 5,
        {"u": 2, "urls": ["a", "b", None], "tags": ["y", "x"]},
        {"u": 3, "urls": ["b", "c"], "tags": ["z"]},
    )
    assert rows(reports.top_urls([posts, posts], found)) == [("a", 2), ("b", 1)]
    assert rows(reports.top_hashtags([posts], found, n=1)) == [("x", 2)]


def test_statistics(spark):
    posts = status(
        spark,
        {"id": 1, "u": 1}, {"id": 1, "u": 1, "recorded_at": at(86_400)},
        {"id": 2, "u": 1, "session": 1, "t": -86_400},
    )
    got = reports.collection_stats(posts, session(spark, "#a", "#b"))
    assert rows(got) == [
        ("#a", "10.01.2024", "11.01.2024", 1, 1),
        ("#b", "09.01.2024", "09.01.2024", 1, 1),
    ]
    assert rows(reports.collection_stats_all(posts, "all")) == [
        ("all", "09.01.2024", "10.01.2024", 2, 1)
    ]


def test_histogram_bins_close_on_the_right(spark):
    values = [0.0, 0.01, 0.011, 0.29, 0.5, 0.51, 1.0, 1.2, -0.1, None]
    frame = spark.createDataFrame([(v,) for v in values], "s double")
    assert rows(reports.score_histogram(frame, "s")) == sorted(
        [
            (1, "inside", "Kein Bot", 2), (2, "inside", "Kein Bot", 1),
            (29, "inside", "Kein Bot", 1), (50, "inside", "Kein Bot", 1),
            (51, "inside", "Bot", 1), (100, "inside", "Bot", 1),
            (None, "above", "Bot", 1), (None, "unknown", "Kein Bot", 1),
            (None, "below", "Kein Bot", 1),
        ],
        key=str,
    )


def test_long_form(spark):
    frame = spark.createDataFrame(
        [("#a,#b", 3, 1)], "track_topics string, useranzahl int, botanzahl int"
    )
    got = reports.long_form(reports.topic_label(frame), ["track_topics"])
    assert rows(got) == [("#a\n#b", "botanzahl", 1), ("#a\n#b", "useranzahl", 3)]


def test_validation_sample(spark):
    listed = challenge(spark, (1, 0.125), (1, 0.125), (2, None), (3, 1.0))
    people = users(spark, {"id": 1, "name": "ann"}, {"id": 1, "name": "ann", "t": 1})
    got = reports.validation_sample(listed, people)
    assert rows(got) == [("https://twitter.com/ann", "0.13"), (None, "1.00")]
    assert reports.validation_sample(listed, people, n=1).count() == 1


def test_sources(spark):
    posts = status(
        spark, {"source": "a"}, {"source": "b"}, {"source": "b"}, {"source": None}
    )
    known = source_q(spark, a=(0, 0))
    assert rows(reports.unqualified_sources(posts, known)) == [("b", 2)]
    assert reports.all_sources([posts, posts]).collect()[0] == ("b", 4)
    assert rows(reports.all_sources([posts])) == [("a", 1), ("b", 2), (None, 1)]


def test_text_in_parts(spark, bots):
    posts = status(
        spark,
        {"id": 66, "u": 1, "t": 0, "text": "CC"},
        {"id": 2, "u": 1, "t": 0, "text": "bb"},
        {"id": 4, "u": 1, "t": 70, "text": "dd"},
        {"id": 5, "u": 1, "t": 71, "text": "ee"},
        {"id": 6, "u": 2, "t": 1, "text": None},
        {"id": 8, "u": 2, "t": 1, "session": 1, "text": "zz"},
    )
    topics = session(spark, "#a", "#b")
    got = texts.topic_text(posts, topics, bots, part_chars=7)
    assert rows(got) == [
        ("#a", True, 0, "bb cc dd"), ("#a", True, 1, "ee"), ("#b", False, 0, "zz"),
    ]


def test_posts_without_time_or_id_keep_their_text(spark, bots):
    posts = status(spark, {"id": 3, "text": "c"}, {"id": 64, "text": "b"}, {"id": 65, "text": "a"})
    posts = posts.withColumn("created_at", F.when(F.col("id") != 65, F.col("created_at")))
    posts = posts.withColumn("id", F.when(F.col("id") != 64, F.col("id")))
    assert rows(texts.topic_text(posts, session(spark, "#a"), bots)) == [("#a", True, 0, "a b c")]


@pytest.mark.parametrize("part", [1, 5, 40, 333, 100_000])
def test_parts_hold_all_text_in_order(spark, bots, part):
    words = [f"w{n % 17}" * (n % 5 + 1) for n in range(300)]
    posts = status(
        spark,
        *[{"id": n, "t": n * 7 % 900, "text": w} for n, w in enumerate(words)],
    )
    order = sorted(range(300), key=lambda n: (n * 7 % 900 // 60, n % 64, n * 7 % 900, n))
    got = texts.topic_text(posts, session(spark, "#a"), bots, part_chars=part).collect()
    found = " ".join(r.text for r in sorted(got, key=lambda r: r.part))
    assert found == " ".join(words[n] for n in order)
    longest = max(map(len, words))
    assert all(len(r.text) <= part + longest for r in got)


def test_listed_accounts_text(spark):
    posts = status(
        spark,
        {"u": 1, "text": "One"},
        {"u": 1, "text": "x #gameinsight"},
        {"u": 2, "text": "Two"},
        {"u": 3, "text": "three"},
    )
    listed = challenge(spark, (1, 0.9), (2, None), (2, 0.1))
    assert rows(texts.challenge_text(posts, listed)) == [
        (False, 0, "two two"), (True, 0, "one"),
    ]
    assert rows(texts.tagged_bot_posts(posts, listed)) == [(1,)]


def test_words_are_dropped_whole(spark):
    frame = spark.createDataFrame(
        [("und, haus-und-hof hund undine 'und' über_und",)], "t string"
    )
    got = frame.select(drop_words(F.col("t"), ["und"])).first()[0]
    assert got == ", haus--hof hund undine '' über_und"


def test_phrases_in_order(spark):
    frame = spark.createDataFrame([("xhttpx #afd#",)], "t string")
    first = frame.select(blank_out(F.col("t"), ["http", "xhttpx", "#afd", "#"]))
    assert first.first()[0] == "x x   "
    second = frame.select(blank_out(F.col("t"), ["xhttpx", "#", "#afd"]))
    assert second.first()[0] == "   afd "


def test_pattern_of_marked_words():
    assert whole_words(["#a", "b"]).count("(?<!") == 1


def test_term_frequencies(spark, bots):
    posts = status(
        spark,
        *[{"u": 1, "text": "Der Hund https://t.co/x1 #AfD don't, HAUS-und-hof"}] * 3,
        *[{"u": 2, "text": "der hund und die Katze katze katze aa"}] * 2,
    )
    frame = texts.topic_posts(posts, session(spark, "#a"), bots)
    got = texts.term_frequencies(frame, stopwords=["der", "die", "und"])
    assert rows(got) == [
        ("#a", False, "katze", 6),
        ("#a", True, "dont", 3),
        ("#a", True, "haushof", 3),
        ("#a", True, "hund", 3),
    ]
    stems = texts.term_frequencies(
        frame, max_words=1, normalise=lambda w: F.left(w, F.lit(3))
    )
    assert rows(stems) == [("#a", False, "kat", 6), ("#a", True, "der", 3)]


def test_strings_are_counted_before_they_become_rows(spark):
    random.seed(5)
    ends = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "  ", "\x1c", "\u00a0", ""]
    made = [
        "".join(random.choice(["hund", "Äpfel", "katze", "ab"]) + random.choice(ends) for _ in range(random.randint(0, 30)))
        for _ in range(60)
    ]
    made += ["", " ", " hund", None]
    data = [(random.choice([True, False, None]), text) for text in made]
    frame = spark.createDataFrame(data, "is_bot boolean, status_text string")
    found = texts.term_frequencies(frame, ["is_bot"], own_stopwords=[], min_freq=1, max_words=10_000)
    expected = {}
    for key, text in data:
        for word in re.split("[ \t\r\n\x0b\f]+", (text or "").lower()):
            if len(word) >= 3:
                expected[key, word] = expected.get((key, word), 0) + 1
    assert {(r.is_bot, r.word): r.freq for r in found.collect()} == expected
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    # empty strings too, where they may get letters
    stems = texts.term_frequencies(
        frame, ["is_bot"], own_stopwords=[], min_freq=1, max_words=10_000,
        normalise=lambda w: F.when(w == "", "none").otherwise(w),
    )
    empty = sum(re.split("[ \t\r\n\x0b\f]+", text).count("") for _, text in data if text is not None)
    assert sum(r.freq for r in stems.collect() if r.word == "none") == empty


@pytest.mark.parametrize("part", [3, 5, 8, 1_000])
def test_copies_on_both_sides_of_a_border(spark, bots, part):
    posts = status(spark, *[{"id": n // 5, "t": n // 5, "text": "ab" * (n // 5 % 3 + 1)} for n in range(40)])
    got = texts.topic_text(posts, session(spark, "#a"), bots, part_chars=part).collect()
    words = ["ab" * (n // 5 % 3 + 1) for n in sorted(range(40), key=lambda n: n // 5)]
    found, begin = {}, 0
    for word in words:
        found.setdefault(begin // part, []).append(word)
        begin += len(word) + 1
    assert {r.part: r.text for r in got} == {k: " ".join(v) for k, v in found.items()}


def test_no_text_is_shuffled_to_find_its_place(spark, bots):
    posts = status(spark, {"id": 1, "text": "a"})
    found = texts.topic_text(posts, session(spark, "#a"), bots)
    top = found._jdf.queryExecution().executedPlan().initialPlan()
    nodes, cells = [top], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(n) for n in range(node.children().size())]
        if node.nodeName() == "Exchange" and "lane" in node.outputPartitioning().toString():
            cells.append(node.outputPartitioning().toString() + node.output().toString())
    # but for equal texts on a border, which are dealt by all of their columns
    cells = [c for c in cells if "created_at" not in c.split(")")[0]]
    assert cells and not any("text#" in c for c in cells)


def test_texts_are_shuffled_once_and_packed(spark, bots):
    """Neither topics nor bots nor listed accounts make texts move before their parts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts = status(spark, *[{"id": n, "u": 1 + n % 2, "text": "Text %d" % n} for n in range(9)])
        listed = challenge(spark, (1, 0.9), (2, None), (2, 0.2))
        for found in (texts.topic_text(posts, session(spark, "#a"), bots), texts.challenge_text(posts, listed)):
            nodes, moved = [found._jdf.queryExecution().executedPlan().initialPlan()], []
            while nodes:
                node = nodes.pop()
                nodes += [node.children().apply(n) for n in range(node.children().size())]
                if node.nodeName() == "Exchange" and "text#" in node.output().toString():
                    moved.append(node.output().toString())
            assert moved and all("bytes#" in columns for columns in moved if "created_at" not in columns)
            assert not any("status_text#" in columns for columns in moved)
            assert sum(r.text.count("text") for r in found.collect()) in (9, 13)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_of_listed_accounts_shuffle_no_texts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts = status(spark, {"u": 1, "text": "One two"}, {"u": 2, "text": "two"}, {"u": 3, "text": "three"})
        listed = challenge(spark, (1, 0.9), (2, 0.2), (2, 0.9))
        found = texts.term_frequencies(texts.challenge_posts(posts, listed), ["is_bot"], own_stopwords=[], min_freq=1)
        nodes, moved = [found._jdf.queryExecution().executedPlan().initialPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(n) for n in range(node.children().size())]
            if node.nodeName() == "Exchange":
                moved.append(node.output().toString())
        assert moved and not any("status_text#" in columns for columns in moved)
        assert sorted(map(tuple, found.collect())) == [(False, "two", 1), (True, "one", 1), (True, "two", 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
