"""Rules and null branches of the single indicators."""

from datetime import datetime, timedelta

import pytest
from frames import at, scores, snapshots, source_q, status, users

from flockscore import operators as op

AS_OF = datetime(2024, 1, 31)


def test_profile_age(spark):
    ages = {1: 365, 2: 366, 3: 364, 4: 0, 5: -10}
    frame = users(
        spark,
        *[
            {"id": i, "created_at": AS_OF - timedelta(days=d)}
            for i, d in ages.items()
        ],
        {"id": 3, "created_at": AS_OF},
        {"id": 6, "created_at": None},
    )
    # 366 days are one year (365.25) and one day; 365 are one year
    got = scores(op.kpi_profileage(frame, as_of=AS_OF))
    assert got[1] == 0.0 and got[2] == 0.0
    assert 0 < got[3] < 0.02
    assert got[4] == 1.0
    assert got[5] == pytest.approx(1 + 10 / 365)
    assert got[6] is None


def test_name_and_description(spark):
    frame = users(
        spark,
        {"id": 1, "name": "short", "about": ""},
        {"id": 2, "name": "longenough", "about": ""},
        {"id": 3, "name": "ab1", "about": "x"},
        {"id": 4, "name": "ab", "about": "x"},
        {"id": 5, "name": None, "about": None},
        {"id": 6, "name": "clean", "about": "x"},
        {"id": 6, "name": "clean9", "about": "x", "t": 1},
    )
    assert scores(op.kpi_namdesclen(frame)) == {
        1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 1.0, 6: 1.0,
    }


def test_follower_ratio(spark):
    frame = users(
        spark,
        {"id": 1, "followers": 5, "friends": 0},
        {"id": 2, "followers": 5, "friends": 20},
        {"id": 3, "followers": 50, "friends": 20},
        {"id": 4, "followers": 10, "friends": 10},
        {"id": 4, "followers": 0, "friends": 10, "t": 1},
    )
    assert scores(op.kpi_anzfollow(frame)) == {1: 0.0, 2: 0.75, 3: 0.0, 4: 0.5}


def test_mentions_count_copies(spark):
    frame = status(
        spark,
        {"u": 1, "mentions": 0},
        {"u": 2, "mentions": 1, "id": 50},
        {"u": 2, "mentions": 1, "id": 50, "recorded_at": at(9)},
        {"u": 3, "mentions": 1},
        {"u": 3}, {"u": 3}, {"u": 3},
    )
    assert scores(op.kpi_tweetmention(frame)) == {1: 1.0, 2: 0.0, 3: 0.75}


def test_gap_between_posts(spark):
    frame = status(
        spark,
        {"u": 1, "t": 0}, {"u": 1, "t": 4.9},
        {"u": 2, "t": 0}, {"u": 2, "t": 5.0},
        {"u": 3, "t": 0}, {"u": 3, "t": 0},
        {"u": 4, "t": 0},
        # over the full hour
        {"u": 5, "t": 3599}, {"u": 5, "t": 3601}, {"u": 5, "t": 9000},
        {"u": 6, "t": 0}, {"u": 6, "t": 0}, {"u": 6, "t": 100},
    )
    assert scores(op.kpi_tweetfreq(frame)) == {1: 1.0, 2: 0.0, 5: 1.0, 6: 0.0}
    gaps = scores(op.kpi_tweetfreq(frame), "mingap")
    assert gaps == {1: 4.9, 2: 5.0, 5: 2.0, 6: 100.0}


def test_night_posts(spark):
    midnight = datetime(2024, 1, 10)
    hours = {1: 0, 2: 1, 3: 4, 4: 5}
    posts = status(
        spark,
        *[
            {"u": u, "created_at": midnight + timedelta(hours=h)}
            for u, h in hours.items()
        ],
        {"u": 5, "created_at": midnight + timedelta(hours=2)},
        {"u": 6, "created_at": midnight + timedelta(hours=2)},
        {"u": 6, "id": 6, "created_at": midnight + timedelta(hours=2),
         "recorded_at": at(77)},
    )
    snaps = snapshots(spark, posts, u5={"offset": None}, u6={"offset": -3600})
    kpi = op.kpi_statusfrequency((posts, snaps))
    assert scores(kpi) == {1: 0.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 1.0}
    counts = scores(kpi, "uhr1")
    assert counts[6] == 1 and counts[5] == 0


def test_posts_per_day(spark):
    posts = status(
        spark,
        *[{"u": 1, "t": n} for n in range(50)],
        *[{"u": 2, "t": n} for n in range(51)],
        *[{"u": 3, "id": 900, "recorded_at": at(n)} for n in range(60)],
    )
    assert scores(op.kpi_tweetcount(posts)) == {1: 0.0, 2: 1.0, 3: 0.0}
    assert scores(op.kpi_tweetcount(posts, posts)) == {1: 0.0, 2: 1.0, 3: 0.0}


def test_language_match(spark):
    posts = status(
        spark,
        {"u": 1, "lang": "und"}, {"u": 1, "lang": "de", "t": 1},
        {"u": 2, "lang": None}, {"u": 2, "lang": "fr", "t": 1},
        {"u": 3, "lang": "de", "t": 1},
        {"u": 3, "lang": "fr", "t": 2, "id": 70},
        {"u": 3, "lang": "fr", "t": 3, "id": 70},
    )
    kpi = op.kpi_langusertweets(posts, snapshots(spark, posts))
    assert scores(kpi) == {1: 0.1, 2: 1.0, 3: pytest.approx(2 / 3)}


def test_number_of_languages(spark):
    def fifty(user, langs):
        return [
            {"u": user, "lang": langs[n % len(langs)], "t": n} for n in range(50)
        ]

    posts = status(
        spark,
        *fifty(1, ["a", "b", "c"]),
        *fifty(2, ["a", "b", "c", "d"]),
        {"u": 3, "lang": "und"},
        *fifty(4, ["a"]),
        *[{"u": 4, "lang": x, "retweet": 1} for x in "bcdef"],
        {"u": 5, "lang": "a", "retweet": 1},
    )
    assert scores(op.kpi_tweetlangs(posts)) == {1: 0.0, 2: 1.0, 4: 1.0, 5: 1.0}
    own = op.kpi_tweetlangs(posts, drop_retweets=True)
    assert scores(own) == {1: 0.0, 2: 1.0, 4: 0.0}


def test_reaction_time(spark):
    posts = status(
        spark,
        {"id": 1, "u": 1, "t": 0},
        {"id": 2, "u": 2, "t": 3, "reply": 1},
        {"id": 3, "u": 3, "t": 60, "reply": 1},
        {"id": 4, "u": 4, "t": 60, "reply": 99},
        {"id": 5, "u": 5, "t": 10, "reply": 1},
        {"id": 6, "u": 6, "t": 0},
        {"id": 7, "u": 3, "t": 70, "reply": 6},
        {"id": 8, "u": 1, "t": 2, "reply": 1},
        {"id": 9, "u": 7, "t": 2, "reply": -1},
    )
    snaps = snapshots(
        spark, posts, u6={"offset": 7200}, u5={"offset": None}, u3={"offset": 0}
    )
    kpi = op.kpi_reactiontime((posts, snaps))
    # account 3: 60 s and, because of the offset, -7130 s
    assert scores(kpi) == {1: 1.0, 2: 1.0, 3: 1.0, 5: 0.0}
    assert scores(kpi, "minawz")[3] == 70 - 7200
    assert scores(kpi, "anzawzeit") == {1: 1, 2: 1, 3: 2, 5: 0}
    assert scores(op.kpi_reactiontime((posts, snaps), self_only=True)) == {1: 1.0}


def test_clients(spark):
    known = source_q(spark, app=(1, 1), web=(0.5, 0))
    posts = status(
        spark,
        {"u": 1, "source": "app"}, {"u": 1, "source": "none"},
        {"u": 2, "source": "app"}, {"u": 2, "source": "app"},
        {"u": 2, "source": "web"},
        {"u": 3, "source": None},
        {"u": 4, "id": 80, "source": "app"},
        {"u": 4, "id": 80, "source": "none", "recorded_at": at(5)},
    )
    assert scores(op.kpi_sourcequalification(posts, known)) == {
        1: 0.5, 2: pytest.approx(2.5 / 3), 3: 0.0, 4: 0.5,
    }
    assert scores(op.kpi_ko_source(posts, known), "kobotscore") == {
        1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0,
    }


def test_client_listed_twice_counts_both(spark):
    twice = source_q(spark, app=(1, 0)).unionByName(source_q(spark, app=(0, 1)))
    posts = status(spark, {"u": 1, "source": "app"})
    assert scores(op.kpi_sourcequalification(posts, twice)) == {1: 0.5}
    assert scores(op.kpi_ko_source(posts, twice), "kobotscore") == {1: 1.0}


def test_two_datasets_without_copies(spark):
    stream = status(spark, {"id": 1, "u": 1, "t": 0}, {"id": 2, "u": 1, "t": 3})
    fetched = status(
        spark,
        {"id": 2, "u": 1, "t": 3, "recorded_at": at(90)},
        {"id": 3, "u": 1, "t": 4, "reply": 1},
    )
    assert scores(op.kpi_tweetfreq(fetched, stream), "mingap") == {1: 1.0}
    assert scores(op.kpi_tweetlangs(fetched, stream), "anztweets") == {1: 3}
    pairs = [(fetched, snapshots(spark, fetched)), (stream, snapshots(spark, stream))]
    assert scores(op.kpi_statusfrequency(*pairs), "uhr12") == {1: 3}
    assert scores(op.kpi_reactiontime(*pairs), "minawz") == {1: 4.0}


def test_positions(spark):
    posts = status(spark, {"id": 5, "u": 1}, {"id": 9, "u": 1}, {"id": 4, "u": 2})
    universe = spark.createDataFrame([(1,), (3,), (3,)], "userid bigint")
    got = op.fetch_positions(universe, posts).collect()
    assert sorted(map(tuple, got)) == [(1, 9), (2, 4), (3, 1)]
