"""Tweets in, tables out."""

import json

import pytest
from frames import T0, challenge, source_q, status, users
from pyspark.sql import functions as F

from flockscore.session import materialise, shared_dir
from flockscore.sources import normalise as norm
from flockscore.sources import sessions, tables, versioned
from flockscore.sources.tweets import (
    admit,
    message_kind,
    read_tweets,
    split_list,
    tweets_from_values,
)

TWEET = {
    "id": 77,
    "created_at": "Wed Jan 10 12:00:05 +0000 2024",
    "text": "hi @bob see #Topic https://t.co/1",
    "lang": "de",
    "source": "web",
    "retweeted_status": {"id": 70, "text": "ignored"},
    "withheld_in_countries": ["DE", "FR"],
    "coordinates": {"type": "Point", "coordinates": [11.5, 48.1]},
    "place": {
        "name": "Lyon",
        "full_name": "Lyon, France",
        "bounding_box": {
            "type": "Polygon",
            "coordinates": [[[11.0, 48.0], [12.0, 49.0]], [[0.0, 0.0]]],
        },
        "geometry": None,
    },
    "entities": {
        "hashtags": [{"text": "Topic", "indices": [12, 18]}],
        "urls": [
            {"url": "https://t.co/1", "expanded_url": "https://x.org/",
             "display_url": "x.org", "indices": [19, 33]},
            {"url": "https://t.co/2", "expanded_url": "https://y.org/",
             "display_url": "y.org", "indices": [34, 40]},
        ],
        "user_mentions": [
            {"id": 5, "name": "Bob", "screen_name": "bob", "indices": [3, 7]}
        ],
        "media": [{"media_url": "http://m/1.png", "type": "photo",
                   "indices": [1, 2], "url": "https://t.co/3"}],
    },
    "user": {
        "id": 9, "name": "Ann", "screen_name": "ann", "description": "",
        "created_at": "Sat Feb 01 00:00:00 +0000 2020", "lang": "de",
        "followers_count": 3, "friends_count": 4, "verified": True,
        "utc_offset": None,
        "entities": {
            "url": {"urls": [{"url": "", "indices": [0, 1]}]},
            "description": {"urls": [{"url": "https://t.co/4", "indices": [0, 9]}]},
        },
    },
}


@pytest.fixture
def tweets(spark):
    bare = {"id": 78, "created_at": "broken", "user": {"id": 9, "screen_name": "new"}}
    lines = [(json.dumps(TWEET),), (json.dumps(bare),)]
    return tweets_from_values(spark.createDataFrame(lines, "value string"))


def tables_of(tweets):
    return norm.normalise(tweets, 4, F.lit(T0))


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_status_rows(tweets):
    got = by_id(tables_of(tweets)["status"])
    full, bare = got[77], got[78]
    assert full.created_at.second == 5 and bare.created_at is None
    assert (full.isretweet, full.retweeted_status_id) == (1, 70)
    assert full.in_reply_to_status_id == -1
    assert (full.latitude, full.longitude) == (48.1, 11.5)
    assert full.withheld_in_countries == "DE,FR"
    assert bare.withheld_in_countries is None
    assert [u.expanded_url for u in full.urls] == ["https://x.org/", "https://y.org/"]
    assert full.hashtags[0].text == "Topic" and full.mentions[0].user_id == 5
    assert full.session_id == 4 and full.status_user_id == 9
    assert bare.status_place_id is None and bare.urlentities_id is None


def test_child_rows_point_to_their_status(tweets):
    got = tables_of(tweets)
    post = by_id(got["status"])[77]
    links = [r for r in got["url"].collect() if r.kind == "url"]
    assert sorted(r.pos for r in links) == [0, 1]
    assert {r.entity_id for r in links} == {post.urlentities_id}
    assert len({r.id for r in links}) == 2
    assert {r.entity_id for r in got["hashtag"].collect()} == {post.hashtagentities_id}
    assert [r.umtext for r in got["mention"].collect()] == ["bob"]
    media = got["media"].collect()
    assert media[0].sizes == "" and media[0].entity_id == post.mediaentities_id
    place = got["place"].collect()
    assert [r.id for r in place] == [post.status_place_id]
    corners = sorted(got["geolocation"].collect(), key=lambda r: r.pos)
    assert [(r.latitude, r.longitude) for r in corners] == [(48.0, 11.0), (49.0, 12.0)]
    assert {r.bboxcoord_place_id for r in corners} == {post.status_place_id}
    assert {r.geocoord_place_id for r in corners} == {None}


@pytest.mark.parametrize("table", ["url", "geolocation"])
def test_messages_are_taken_apart_once(tweets, table):
    plan = tables_of(tweets)[table]._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_user_links(tweets):
    kinds = [r.kind for r in tables_of(tweets)["url"].collect()]
    # the empty profile link is left out
    assert sorted(kinds) == ["description_url", "url", "url"]


def test_one_snapshot_per_post(tweets):
    got = {r.status_id: r for r in tables_of(tweets)["users"].collect()}
    assert {i: r.screen_name for i, r in got.items()} == {77: "ann", 78: "new"}
    assert got[78].utcoffset == -1 and {r.id for r in got.values()} == {9}


def test_keys_are_stable(tweets):
    first, second = (
        sorted(r.id for r in tables_of(tweets)["url"].collect()) for _ in range(2)
    )
    assert first == second


def test_kinds_of_lines(spark, tmp_path):
    lines = [
        json.dumps(TWEET),
        json.dumps({"delete": {"status": {"id": 1, "user_id": 2}}}),
        json.dumps({"limit": {"track": 4}}),
        json.dumps({"scrub_geo": {"user_id": 1, "up_to_status_id": 2}}),
        json.dumps({"warning": {"code": "FALLING_BEHIND", "message": "slow"}}),
        "{broken",
        "{}",
    ]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = read_tweets(spark, str(tmp_path))
    kinds = got.select(message_kind(got).alias("k")).collect()
    assert sorted(r.k for r in kinds) == [
        "corrupt", "corrupt", "delete", "limit", "scrub_geo", "status", "warning",
    ]


def test_admission(spark):
    posts = status(
        spark,
        {"id": 1, "u": 1, "text": "nothing"},
        {"id": 2, "u": 2, "text": "The WAHL, today"},
        {"id": 3, "u": 2, "text": "wahlen"},
        {"id": 4, "u": 2, "text": "#btw17!"},
        {"id": 5, "u": 2, "text": "btw17"},
        {"id": 6, "u": 2, "text": "two apples and one pear"},
        {"id": 7, "u": 2, "text": "one"},
        {"id": 8, "u": 2, "text": "@wahl", "lang": "fr"},
        {"id": 9, "u": 2, "text": None},
    )

    def ids(**wanted):
        got = admit(posts, author="status_user_id", text="status_text", **wanted)
        return sorted(r.id for r in got.collect())

    assert ids(follow=[1]) == [1]
    assert ids(track=["wahl"]) == [2, 8]
    assert ids(track=["wahl"], language="de") == [2]
    assert ids(track=["#btw17"]) == [4]
    assert ids(track=["one two"]) == [6]
    assert ids(follow=[1], track=["#BTW17", "one two"]) == [1, 4, 6]
    # no list is cut
    assert ids(follow=range(10_000, 3_990, -1)) == []
    assert ids(follow=[*range(10, 6_010), 1]) == [1]
    assert ids(track=[*(f"nothing{n}" for n in range(500)), "wahl"]) == [2, 8]
    with pytest.raises(ValueError):
        ids()


def test_lists_in_settings():
    assert split_list(" a, b ,c") == ["a", "b", "c"]
    assert split_list("  ") == [] and split_list(None) == []


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "session")
    new = sessions.open_session(spark, path, track=[" #a", "#b"], follow=[1, 2])
    assert sessions.open_session(spark, path, session_id=5) == 5
    row = spark.read.parquet(path).collect()
    assert [tuple(r) for r in row] == [(new, "#a,#b", "1,2", "streaming")]
    with pytest.raises(ValueError):
        sessions.open_session(spark, path)
    long = sessions.session_row(spark, 1, track=["x" * 9] * 900).first()
    assert long.track_topics == ",".join(["x" * 9] * 900)


def test_csv(spark, tmp_path):
    known = source_q(spark, app=(0.5, 1)).withColumn("comment", F.lit('say "x"; y'))
    tables.backup_source_qualification(known, str(tmp_path / "q"))
    header = next((tmp_path / "q").glob("*.csv")).read_text().splitlines()[0]
    assert header == "source;comment;botscore;kobotscore"
    back = tables.read_source_qualification(spark, str(tmp_path / "q"))
    assert back.collect() == known.collect()
    assert tables.extend_source_qualification(known, back).count() == 2
    listed = challenge(spark, (1, 0.5), (2, None))
    tables.backup_challenge(listed, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()[0]
    assert text == "user_id,parent_screen_name,parent_id,botscore,maxtweetid"
    short = listed.drop("maxtweetid")
    tables.write_csv(short, str(tmp_path / "d"))
    assert tables.read_challenge(spark, str(tmp_path / "d")).collect() == (
        listed.collect()
    )


def test_reset_keeps_lists(spark, tmp_path):
    frames = {
        "status": status(spark, {"u": 1}),
        "users": users(spark, {"id": 1}),
        "challenge": challenge(spark, (1, 0.5)),
    }
    empty = tables.reset_facts(frames, str(tmp_path))
    assert empty["status"].schema == frames["status"].schema
    assert dict(map(tuple, tables.row_counts(empty).collect())) == {
        "status": 0, "users": 0, "challenge": 1,
    }


def test_written_tables(spark, tmp_path):
    frame = spark.range(3)
    assert materialise(frame, str(tmp_path / "t")).count() == 3
    assert shared_dir(spark) == shared_dir(spark)


def test_scores_are_written_in_place(spark, tmp_path):
    listed = challenge(spark, *[(u, 0.1) for u in range(200)], (7, 0.2), (None, 0.3))
    path = str(tmp_path / "listed")
    versioned.create_table(listed, path)
    begun = versioned.read_table(spark, path)
    before = set(begun.inputFiles())
    new = spark.createDataFrame([(7, 0.9), (9999, 0.5)], "userid bigint, totalscore double")
    assert versioned.write_back_stored(spark, path, new) == 1
    after = versioned.read_table(spark, path)
    want = [(u, 0.9 if u == 7 else 0.1) for u in range(200)] + [(7, 0.9), (None, 0.3)]
    found = [(r.user_id, r.botscore) for r in after.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert after.columns == listed.columns
    # a reader that began before sees the first version; other folders keep their files
    assert {r.botscore for r in begun.where("user_id = 7").collect()} == {0.1, 0.2}
    changed = {f for f in after.inputFiles() if "/v1/" in f}
    assert 1 <= len(changed) <= 2 and before & set(after.inputFiles()) > set()
    assert versioned.write_back_stored(spark, path, new.limit(0)) == 1
