"""What the physical plans must and must not contain."""

import re
from datetime import datetime

import pytest
from frames import T0

from contract import fixtures as fx
from contract import queries
from flockscore import operators as op
from flockscore.plans import facts, texts
from flockscore.plans import score as sc
from flockscore.plans.registry import BATCH, PERUSER, STAGE2, Inputs
from flockscore.plans.sqlfunctions import register_functions
from flockscore.sources.bucketed import store_pair
from flockscore.sources.tweets import admit

SF = "/root/testdata/sf0.001"
AS_OF = datetime(2024, 1, 31)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def live(spark):
    return fx.live(spark, SF)


def test_no_python_in_any_plan(spark):
    for name, build in queries.QUERIES.items():
        if name.startswith(("stream_", "ingest_", "csv_", "reset_")):
            continue
        text = plan(build(spark, SF))
        assert not re.search("Python|ArrowEval|MapInPandas", text), name


def test_cartesian_products_only_with_one_row(spark, live):
    for profile in (BATCH, PERUSER):
        universe = sc.challenge_accounts(fx.challenge(spark, SF))
        text = plan(sc.score(live, universe, profile))
        assert "CartesianProduct" not in text
        loops = re.findall(r"BroadcastNestedLoopJoin.*", text)
        assert loops and all("BuildRight, Cross" in loop for loop in loops)


def _scans(spark, build):
    """Scans of posts in all plans that ``build`` and its result have run."""
    seen = []

    def count(df):
        df.collect()
        ran = plan(df).split("== Initial Plan ==")[0]
        seen.append(len(re.findall(r"FileScan parquet \[[^]]*status_user_id", ran)))

    stored = facts.materialise

    def watched(df, path):
        count(df)
        return stored(df, path)

    facts.materialise = watched
    try:
        count(build())
    finally:
        facts.materialise = stored
    return sum(seen)


@pytest.mark.parametrize("name, most", [("batch", 3), ("peruser", 2), ("stage2", 4)])
def test_scoring_reads_the_posts_at_most_three_times(spark, tmp_path, name, most):
    """``most`` is for all datasets together: stage two has two of them."""
    for frame, df in (("p", fx.posts(spark, SF)), ("u", fx.users(spark, SF)), ("h", fx.history(spark, SF))):
        df.write.parquet(str(tmp_path / frame))
    read = {n: spark.read.parquet(str(tmp_path / n)) for n in "puh"}
    known = fx.source_q(spark)
    one = Inputs(read["p"], read["u"], AS_OF, known)
    two = Inputs(read["h"], read["u"], AS_OF, known, read["p"], read["u"])
    listed = sc.challenge_accounts(fx.challenge(spark, SF))
    builds = {
        "batch": lambda: sc.score(one, listed, BATCH),
        "peruser": lambda: sc.score(one, listed, PERUSER),
        "stage2": lambda: sc.kpi_rows(two, STAGE2),
    }
    assert _scans(spark, builds[name]) == most


def test_windows_never_hold_all_rows(live):
    for df in (
        op.kpi_tweetfreq(live.status),
        op.kpi_reactiontime((live.status, live.users)),
        op.kpi_tweetcount(live.status),
    ):
        for window in re.findall(r"\bWindow \[.*", plan(df)):
            assert "userid" in window


def test_tiles_sort_only_the_histogram_in_one_place(live):
    text = plan(op.kpi_decilposts(live.status))
    # every single-partition window is ordered by the count alone
    windows = re.findall(r"\bWindow \[.*", text)
    lone = [w for w in windows if "anz" in w and "tie" not in w]
    assert lone and all("userid" not in w for w in lone)


def test_scans_read_only_needed_columns(live, spark):
    text = plan(op.kpi_tweetfreq(live.status))
    events = re.search(r"ReadSchema: (struct<[^>]*user_id[^>]*>)", text).group(1)
    assert "event_type" not in events and "value" not in events
    assert "text:string" not in text
    people = plan(op.kpi_anzfollow(live.users))
    assert "c_name" not in re.search(r"ReadSchema: .*c_custkey.*", people).group(0)


def test_filter_on_one_account_reaches_the_scan(spark, tmp_path):
    fx.posts(spark, SF).drop("status_text").write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    one = op.kpi_tweetcount(stored).where("userid = 7")
    assert "EqualTo(status_user_id,7)" in plan(one)


def test_admission_cuts_texts_into_tokens_once(live):
    phrases = [f"word{n} other{n % 7}" for n in range(500)] + ["the", "der die"]
    admitted = admit(
        live.status, follow=range(6000), track=phrases, author="status_user_id", text="status_text"
    )
    text = plan(admitted.select("id"))
    assert text.count("regexp_extract_all") == 1 and "BroadcastHashJoin" in text
    assert "5999" not in text


def test_bucketed_posts_meet_their_snapshots_without_a_shuffle(spark, tmp_path):
    posts, people = store_pair(
        fx.posts(spark, SF).drop("status_text"), fx.users(spark, SF), str(tmp_path), buckets=4
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (op.kpi_langusertweets(posts, people), op.kpi_statusfrequency((posts, people))):
            text = plan(df)
            below = text[text.index("SortMergeJoin") :]
            assert "Exchange" not in below and text.count("SelectedBucketsCount") >= 2
        joined = op.kpi_langusertweets(posts, people).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    alone = op.kpi_langusertweets(fx.posts(spark, SF), fx.users(spark, SF))
    assert sorted(map(tuple, joined)) == sorted(map(tuple, alone.collect()))


def test_sql_functions_filter_the_scan(spark, tmp_path):
    fx.posts(spark, SF).drop("status_text").write.parquet(str(tmp_path / "p"))
    one = Inputs(spark.read.parquet(str(tmp_path / "p")), fx.users(spark, SF), AS_OF, fx.source_q(spark))
    names = register_functions(one, sc.accounts_of(one.status))
    assert len(names) == 15 and "kpi_tweetcount" in names
    assert "EqualTo(status_user_id,7)" in plan(spark.sql("select * from kpi_tweetcount(7)"))


def test_top_words_are_cut_before_the_shuffle(spark, live):
    bots = spark.createDataFrame([(1,)], "userid bigint")
    posts = texts.topic_posts(live.status, fx.session(spark), bots)
    text = plan(texts.term_frequencies(posts))
    assert text.count("WindowGroupLimit") == 2
    assert T0.year == 2024


def test_messages_are_shuffled_before_they_get_their_texts(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(fx.messages(spark, SF).select("value"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    joins = re.findall(r"SortMergeJoin \[(\w+)#", text)
    assert len(joins) == 3 and joins[0] == "doc_id"


def test_keys_take_the_messages_apart_once(spark):
    assert "from_json" not in plan(queries.QUERIES["normalise_keys"](spark, SF))
