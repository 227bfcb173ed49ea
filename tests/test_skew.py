"""Hot keys: the spread plans against brute force."""

import random

import pytest
from frames import at, scores, snapshots, status, users
from pyspark.sql import functions as F

from flockscore import operators as op
from flockscore.functions.joins import hot_keys, lookup_join, spread_join, text_join
from flockscore.operators.activity import post_tiles
from flockscore.operators.snapshots import with_author
from flockscore.plans import facts as fc


@pytest.mark.parametrize("n", [7, 19, 20, 23, 400, 1501])
def test_tiles_equal_ntile(spark, n):
    random.seed(n)
    # most accounts have one post: a count that straddles many tiles
    rows = []
    for u in range(n):
        count = 1 if random.random() < 0.6 else random.randint(1, 12)
        rows += [(u * 3, u % 2)] * count
    posts = spark.createDataFrame(rows, "status_user_id bigint, session_id bigint")
    posts.createOrReplaceTempView("tile_posts")
    expected = spark.sql(
        """select *, ntile(20) over (
               order by anz, userid % 1021, userid, sessionid) as decil
           from (select status_user_id as userid, session_id as sessionid,
                        count(*) as anz from tile_posts group by 1, 2)"""
    )
    assert sorted(map(tuple, post_tiles(posts).collect())) == sorted(
        map(tuple, expected.collect())
    )


def test_copies_count_in_tiles(spark):
    copies = [{"id": 5, "u": 1, "recorded_at": at(n)} for n in range(4)]
    tiles = post_tiles(status(spark, *copies, {"id": 6, "u": 2}))
    assert sorted((r.userid, r.anz, r.decil) for r in tiles.collect()) == [
        (1, 4, 2), (2, 1, 1),
    ]


def test_gaps_of_a_hot_account(spark):
    random.seed(1)
    rows = [
        {"u": 1 if n % 3 == 0 else n % 40, "t": random.randint(0, 40_000) / 2}
        for n in range(3000)
    ]
    times = {}
    for r in rows:
        times.setdefault(r["u"], set()).add(r["t"])
    expected = {}
    for u, ts in times.items():
        ts = sorted(ts)
        if len(ts) > 1:
            expected[u] = min(b - a for a, b in zip(ts, ts[1:]))
    got = scores(op.kpi_tweetfreq(status(spark, *rows)), "mingap")
    assert got == expected


def test_replies_to_a_hot_post(spark):
    random.seed(2)
    rows = [{"id": 1, "u": 500, "t": 0}]
    for n in range(2, 1500):
        parent = 1 if n % 3 == 0 else random.randint(1, n - 1)
        rows.append(
            {"id": n, "u": n % 50, "t": random.randint(1, 10_000), "reply": parent}
        )
    by_id = {r["id"]: r for r in rows}
    expected = {}
    for r in rows[1:]:
        gap = float(r["t"] - by_id[r["reply"]]["t"])
        low, high, n = expected.get(r["u"], (gap, gap, 0))
        expected[r["u"]] = (min(low, gap), max(high, gap), n + 1)
    posts = status(spark, *rows)
    kpi = op.kpi_reactiontime((posts, snapshots(spark, posts)))
    got = {
        r.userid: (r.minawz, r.maxawzeit, r.anzawzeit) for r in kpi.collect()
    }
    assert got == expected


def test_posts_recorded_together_do_not_multiply(spark):
    langs = ["de", "und", "fr", None, "en"]
    rows = [{"id": n, "u": 1, "t": 0, "lang": langs[n % 5]} for n in range(40)]
    rows.append({"id": 90, "u": 2, "lang": "fr"})
    # the snapshots of a moment agree but for a few
    seen = [{"id": 1, "lang": "fr" if n < 5 else "de", "offset": 0 if n < 9 else None} for n in range(40)]
    posts, people = status(spark, *rows), users(spark, *seen, {"id": 2})
    joined = with_author(posts, people)
    assert joined.count() == 40 * 3 + 1  # one row for each of three different snapshots
    assert joined.agg(F.sum("n_snapshots")).first()[0] == 40 * 40 + 1

    pairs = [(r, s) for r in rows[:40] for s in seen]
    und = sum(r["lang"] == "und" for r, _ in pairs)
    other = sum(r["lang"] not in ("und", s["lang"]) for r, s in pairs)
    expected = (und * 0.2 + other) / len(pairs)
    assert scores(op.kpi_langusertweets(posts, people)) == pytest.approx({1: expected, 2: 1.0})
    kept = fc.author_facts(fc.local_frame([(posts, people)])).where("userid = 1").first()
    assert (kept.n1, kept.n2, kept.n3, kept.n4) == (len(pairs), und, other, 0)


def test_times_apart_from_facts_give_the_same(spark):
    random.seed(3)
    rows = [
        {
            "id": n // 2, "u": n // 2 % 23, "lang": ["de", "fr", "und", None][n // 2 % 4],
            "created_at": at((n // 2) ** 2 * 7 / 2 % 90_000), "mentions": n % 3, "retweet": n // 2 % 2,
        }
        for n in range(600)
    ]
    rows.append({"id": 900, "u": 77, "created_at": None, "recorded_at": at(0)})
    rows.append({"id": 901, "u": 78})
    posts = fc.single_posts([status(spark, *rows)])
    kinds = ["post", "day", "lang", "own"]
    expected = fc.account_facts(fc.post_facts(posts, [*kinds, "time"]))
    few = fc.post_facts(posts, kinds)
    got = fc.account_facts(few, fc.gaps_of(posts))
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    # no column that is null in all facts is added up
    assert "sum(n9" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert few.columns == fc.merged(few).columns


@pytest.fixture
def sides(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 500 == 1, None)
        .otherwise(F.col("id"))
        .alias("k"),
        "id",
    )
    right = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "k bigint, v string"
    )
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_join(sides, how):
    left, right = sides
    got = spread_join(left, right, "k", spread_by=["id"], how=how)
    expected = left.join(right, "k", how)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_hot_keys_are_few(sides):
    left, _ = sides
    assert [r.k for r in hot_keys(left, "k", 1).collect()] == [1]
    assert hot_keys(left, "k", 100).count() == 100


@pytest.mark.parametrize("hot", [1, 100, 5000])
def test_any_number_of_hot_keys_gives_the_same(sides, hot):
    left, right = sides
    got = spread_join(left, right, "k", spread_by=["id"], how="left", hot=hot)
    expected = left.join(right, "k", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_lookup_runs_nothing_while_planned(sides):
    left, right = sides
    got = lookup_join(left, right, "k")
    assert sorted(map(str, got.collect())) == sorted(
        map(str, left.join(right, "k", "left").collect())
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_text_join_equals_a_lookup(spark, how):
    """Keys that repeat on either side, are null, missing, or of another type; null values."""
    facts = spark.createDataFrame(
        [(n, None if n % 9 == 0 else n % 40, f"text {n}") for n in range(200)], "n int, k int, status_text string"
    )
    rows = [(k, k % 3 == 0 if k % 5 else None, "x" * (k % 4)) for k in [*range(30), 7, 7, 60]]
    lookup = spark.createDataFrame([*rows, (None, True, "y")], "k bigint, bot boolean, name string")
    for kept in (lookup, lookup.where("k is null"), lookup.where("false")):
        want = lookup_join(facts, kept, "k", how=how)
        for most in (0, 1_000):
            got = text_join(facts, kept, "k", how=how, most=most)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
