"""Ingestion and re-scoring as streams, run to the end of their input."""

import copy
import json
import re
import time
from datetime import datetime

from frames import at, challenge, scores, snapshots, source_q, status
from test_sources import TWEET

from flockscore.plans import score as sc
from flockscore.plans.registry import PERUSER, Inputs
from flockscore.sources.tweets import tweets_from_values
from flockscore.streaming import commits, ingest, rescore, rolling

AS_OF = datetime(2024, 1, 31)


def tweet(number, user, second, **more):
    t = copy.deepcopy(TWEET)
    t.update(id=number, created_at=f"Wed Jan 10 12:00:{second:02d} +0000 2024", **more)
    t["user"]["id"] = user
    return json.dumps(t)


def write(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines))


def run_ingest(spark, base, **wanted):
    ingest.ingest_stream(
        spark,
        str(base / "in"),
        str(base / "out"),
        str(base / "checkpoint"),
        session_id=3,
        **wanted,
    ).awaitTermination()


def test_ingest_and_resume(spark, tmp_path):
    write(
        tmp_path / "in", "1.json", tweet(1, 9, 1), "{broken", '{"limit":{"track":1}}'
    )
    run_ingest(spark, tmp_path)
    out = str(tmp_path / "out")
    assert ingest.read_table(spark, out, "status").count() == 1
    write(tmp_path / "in", "2.json", tweet(2, 9, 3), tweet(3, 8, 9))
    run_ingest(spark, tmp_path)
    posts = ingest.read_table(spark, out, "status")
    assert sorted(r.id for r in posts.collect()) == [1, 2, 3]
    report = ingest.read_table(spark, out, "_report").groupBy("kind").sum("anz")
    assert dict(map(tuple, report.collect())) == {
        "status": 3, "corrupt": 1, "limit": 1,
    }
    rubbish = ingest.read_table(spark, out, "_quarantine").collect()
    assert [r._corrupt_record for r in rubbish] == ["{broken"]
    # each post finds its snapshot, also where two arrived together
    users = ingest.read_table(spark, out, "users")
    joined = posts.withColumnRenamed("status_user_id", "userid").join(
        users.withColumnRenamed("id", "userid"),
        ["userid", "recorded_at", "session_id"],
    )
    assert joined.count() == 3


def test_repeated_batch_replaces_itself(spark, tmp_path):
    write(tmp_path / "in", "1.json", tweet(1, 9, 1))
    lines = ingest.read_tweets(spark, str(tmp_path / "in"))
    for _ in range(2):
        ingest.store_batch(lines, 0, str(tmp_path / "out"), session_id=3)
    ingest.store_batch(lines, 1, str(tmp_path / "out"), session_id=3)
    # batches 0 and 1: a tweet sent again is stored again
    assert ingest.read_table(spark, str(tmp_path / "out"), "status").count() == 2


def _break_off(spark, lines, batch_id, out, tables):
    """A batch that ends after it has written the first ``tables`` tables."""
    batch = ingest.arrive(lines, batch_id, out)
    for name, table in list(ingest.batch_tables(batch, session_id=3).items())[:tables]:
        ingest.write_batch(table, f"{out}/{name}", batch_id, ingest.BY_ACCOUNT.get(name))


def test_a_batch_is_visible_whole_or_not_at_all(spark, tmp_path):
    write(tmp_path / "in", "1.json", tweet(1, 9, 1), tweet(2, 8, 1), "{broken")
    lines, out = ingest.read_tweets(spark, str(tmp_path / "in")), str(tmp_path / "out")
    _break_off(spark, lines, 0, out, 3)
    assert ingest.read_table(spark, out, "status").count() == 0
    first = spark.read.parquet(f"{out}/users").select("id", "recorded_at", "status_id").collect()
    ingest.store_batch(lines, 0, out, session_id=3)
    users = ingest.read_table(spark, out, "users").select("id", "recorded_at", "status_id").collect()
    assert sorted(first) == sorted(users) and len(users) == 2
    # committed: another attempt leaves it alone
    ingest.store_batch(lines.limit(0), 0, out, session_id=3)
    assert ingest.read_table(spark, out, "status").count() == 2
    report = ingest.read_table(spark, out, "_report")
    assert {(r.kind, r.anz) for r in report.collect()} == {("status", 2), ("corrupt", 1)}


def test_compaction_keeps_rows_and_readers(spark, tmp_path):
    out = str(tmp_path / "out")
    for n in range(4):
        write(tmp_path / f"in{n}", "1.json", *[tweet(10 * n + i, 5 + i % 4, i) for i in range(6)])
        lines = ingest.read_tweets(spark, str(tmp_path / f"in{n}"))
        ingest.store_batch(lines, n, out, session_id=3)
    begun = ingest.read_table(spark, out, "status")
    rows = sorted(map(str, begun.select(sorted(begun.columns)).collect()))
    many = len(begun.inputFiles())
    _break_off(spark, lines, 4, out, 3)
    ingest.compact_tables(spark, out)
    after = ingest.read_table(spark, out, "status")
    assert sorted(map(str, after.select(sorted(begun.columns)).collect())) == rows
    assert sorted(map(str, begun.select(sorted(begun.columns)).collect())) == rows
    assert len([f for f in after.inputFiles() if "_generations" in f]) <= 4 < many
    commits.vacuum(spark, out, ingest.STORED)
    ingest.store_batch(lines, 4, out, session_id=3)
    ingest.compact_tables(spark, out)
    commits.vacuum(spark, out, ingest.STORED)
    assert ingest.read_table(spark, out, "status").count() == 30
    assert len(commits.folders(spark, f"{out}/_generations")) == 1


def test_admission_on_the_way_in(spark, tmp_path):
    write(
        tmp_path / "in", "1.json", tweet(1, 9, 1), tweet(2, 8, 1, text="other words")
    )
    run_ingest(spark, tmp_path, track=["#topic"])
    got = ingest.read_table(spark, str(tmp_path / "out"), "status")
    assert [r.id for r in got.collect()] == [1]


def test_rescore_touched_accounts(spark, tmp_path):
    known = source_q(spark, web=(0.1, 0))
    out = str(tmp_path / "out")

    def history():
        return tuple(ingest.read_table(spark, out, t) for t in ("status", "users"))

    def follow():
        posts = spark.readStream.schema(history()[0].schema).parquet(f"{out}/status")
        rescore.rescore_stream(
            posts,
            history,
            known,
            str(tmp_path / "scores"),
            str(tmp_path / "rescored"),
            as_of=lambda: AS_OF,
        ).awaitTermination()
        latest = rescore.latest_scores(spark, str(tmp_path / "scores"))
        return dict(map(tuple, latest.collect()))

    write(tmp_path / "in", "1.json", tweet(1, 9, 1), tweet(2, 8, 1))
    run_ingest(spark, tmp_path)
    first = follow()
    assert set(first) == {8, 9}
    # a second post of account 9 two seconds later raises its score
    write(tmp_path / "in", "2.json", tweet(3, 9, 3))
    run_ingest(spark, tmp_path)
    second = follow()
    assert second[8] == first[8] and second[9] > first[9]
    batches = spark.read.parquet(str(tmp_path / "scores" / "scores")).collect()
    assert sorted(r.userid for r in batches) == [8, 9, 9]

    posts, users = history()
    touched = spark.createDataFrame([(9,)], "userid bigint")
    again = rescore.rescore_batch(touched, history, known, AS_OF)
    assert dict(map(tuple, again.collect())) == {9: second[9]}
    text = again._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*user_bucket#\d+ (=|IN)", text)

    # stored posts carry their snapshot; joining it gives the same
    joined = sc.score(
        Inputs(posts.drop("author"), users, AS_OF, known),
        sc.accounts_of(posts),
        PERUSER,
    )
    assert dict(map(tuple, joined.collect())) == second
    batch = sc.score(Inputs(posts, users, AS_OF, known), sc.accounts_of(posts), PERUSER)
    assert dict(map(tuple, batch.collect())) == second
    listed = challenge(spark, (9, None), (5, 0.4))
    current = rescore.current_challenge(listed, str(tmp_path / "scores"))
    assert {r.user_id: r.botscore for r in current.collect()} == {9: second[9], 5: 0.4}


def test_positions_follow_the_stream(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = [(1, 5), (7, 5), (3, 6)]
    frame = spark.createDataFrame(rows, "id bigint, status_user_id bigint")
    frame.write.parquet(path)
    stream = spark.readStream.schema(frame.schema).parquet(path)
    query = (
        rescore.stream_positions(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("positions")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.table("positions").collect()
    assert sorted(map(tuple, got)) == [(5, 7), (6, 3)]


ROLLING = [
    [
        {"id": 1, "u": 1, "t": 0, "source": "app", "lang": "und"},
        {"id": 2, "u": 2, "t": 0, "source": "web", "mentions": 2},
        {"id": 9, "u": 2, "t": 5000, "reply": 8, "lang": "fr"},  # answers a later one
        {"id": 3, "u": 3, "t": 50, "retweet": 1, "lang": "en"},
    ],
    [
        {"id": 4, "u": 1, "t": 7203, "reply": 1, "source": "app"},
        {"id": 3, "u": 3, "t": 50, "recorded_at": at(60), "lang": "en", "retweet": 1},  # sent again
        *[{"id": 100 + i, "u": 4, "t": 600 * i} for i in range(30)],
    ],
    [
        {"id": 8, "u": 2, "t": 4998},
        {"id": 5, "u": 1, "t": 7200},
        *[{"id": 200 + i, "u": 4, "t": 600 * i + 300} for i in range(30)],
        {"id": 6, "u": 5, "t": 1, "source": "app"},
    ],
]


def test_rolling_scores_equal_one_batch(spark, tmp_path):
    """Replies before and after their posts, a copy in a later batch, a day that
    several batches fill, an hour that they share; a batch that is repeated."""
    known, out = source_q(spark, app=(0.8, 1), web=(0.1, 0)), str(tmp_path / "out")
    latest = {}
    for n, rows in enumerate(ROLLING):
        posts = status(spark, *rows)
        people = snapshots(spark, posts, u2={"followers": 1, "friends": 9}, u3={"offset": 14 * 3600})
        for _ in range(1 + (n == 1)):
            touched = rolling.fold_batch(posts, people, n, out, known)
            new = rolling.score_touched(spark, out, n, touched, AS_OF)
            found = scores(new, "totalscore")
        assert set(found) == {r["u"] for r in rows}
        latest |= found
        commits.commit(spark, out, n)
        if n == 1:
            rolling.compact_facts(spark, out)
            commits.vacuum(spark, out, rolling.TABLES)
    every = status(spark, *[r for rows in ROLLING for r in rows])
    people = snapshots(spark, every, u2={"followers": 1, "friends": 9}, u3={"offset": 14 * 3600})
    whole = sc.score(Inputs(every, people, AS_OF, known), sc.accounts_of(every), PERUSER)
    assert latest == scores(whole, "totalscore")
    # only stored facts, and the table of ids and times, have been read
    assert new.inputFiles() and all("/_facts/" in f or "/_seen/" in f for f in new.inputFiles())


def test_a_committed_batch_keeps_its_lines_once(spark, tmp_path):
    write(tmp_path / "in", "1.json", tweet(1, 9, 1), tweet(2, 8, 1))
    run_ingest(spark, tmp_path)
    out = tmp_path / "out"
    assert ingest.read_table(spark, str(out), "status").count() == 2
    assert list((out / "_arrivals").glob("batch_id=*")) == []
    files = ingest.read_table(spark, str(out), "status").inputFiles()
    assert files and all(".zstd." in f for f in files)


def test_texts_are_stored_and_packed_without_a_shuffle(spark, tmp_path, monkeypatch):
    dealt, frame = [], type(spark.range(0))
    for name in ("repartition", "hint"):
        real = getattr(frame, name)
        told = lambda self, *a, real=real: dealt.append(self.columns) or real(self, *a)
        monkeypatch.setattr(frame, name, told)
    out, writers = str(tmp_path / "out"), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    monkeypatch.setattr(commits, "SMALL", 0)
    for n in range(2):
        write(tmp_path / f"in{n}", "1.json", *[tweet(10 * n + i, 5 + i % 3, i) for i in range(6)])
        ingest.store_batch(ingest.read_tweets(spark, str(tmp_path / f"in{n}")), n, out, session_id=3)
    ingest.compact_tables(spark, out)
    packed = ingest.read_table(spark, out, "status")
    assert sorted(r.id for r in packed.collect()) == [*range(6), *range(10, 16)]
    assert len(packed.where("status_text is not null").select("status_user_id").distinct().collect()) == 3
    # one file for each account folder, and no row with a text was dealt anew
    assert len([f for f in packed.inputFiles() if "_generations" in f]) <= 3
    assert dealt and not any("status_text" in columns for columns in dealt)
    assert spark.conf.get(writers) == before


def test_posts_sent_again_are_stored_once(spark, tmp_path):
    """Within a batch and between batches, after a batch that broke off, and until the ids
    are older than asked for; other lines stay."""
    out = str(tmp_path / "out")

    def send(n, *lines, within="2 days"):
        write(tmp_path / f"in{n}", "1.json", *lines)
        rows = ingest.read_tweets(spark, str(tmp_path / f"in{n}"))
        ingest.store_batch(rows, n, out, session_id=3, once_within=within)

    def stored():
        rows = ingest.read_table(spark, out, "status").select("id", commits.BATCH).collect()
        report = ingest.read_table(spark, out, "_report").collect()
        return sorted(map(tuple, rows)), sorted((r.batch_id, r.kind, r.anz) for r in report)

    gone = json.dumps({"delete": {"status": {"id": 1, "user_id": 9}}})
    send(0, tweet(1, 9, 1), tweet(2, 8, 1), tweet(1, 9, 1), gone, gone)
    assert stored() == ([(1, 0), (2, 0)], [(0, "delete", 2), (0, "status", 2)])
    # a batch that broke off after its ids were written, and its repetition
    write(tmp_path / "in1", "1.json", tweet(2, 8, 1), tweet(3, 8, 1), gone)
    arrived = ingest.arrive(ingest.read_tweets(spark, str(tmp_path / "in1")), 1, out)
    ingest.sent_once(arrived, 1, out, "2 days")
    send(1, tweet(2, 8, 1), tweet(3, 8, 1), gone)
    assert stored() == (
        [(1, 0), (2, 0), (3, 1)],
        [(0, "delete", 2), (0, "status", 2), (1, "delete", 1), (1, "status", 1)],
    )
    send(2, tweet(3, 8, 1), tweet(1, 9, 1))  # nothing new
    assert [r for r in stored()[1] if r[0] == 2] == []
    time.sleep(1.1)
    send(3, tweet(1, 9, 1), tweet(4, 9, 1), within="1 second")
    assert [r for r in stored()[0] if r[1] == 3] == [(1, 3), (4, 3)]
    assert commits.folders(spark, f"{out}/_ids") == ["batch_id=3"]  # older ids are gone
    assert not commits.folders(spark, f"{out}/_first")


def test_many_rows_of_many_files_are_told_apart(spark, tmp_path):
    """More rows than a bitmap holds, in several files, each id twice."""
    out, half = str(tmp_path / "out"), spark.range(40_000)
    lines = half.union(half).selectExpr("to_json(struct(id, named_struct('id', id % 7) as user)) as value")
    arrived = ingest.arrive(tweets_from_values(lines.coalesce(2)), 0, out)
    kept = ingest.sent_once(arrived, 0, out, "1 day")
    assert kept.count() == kept.select("id").distinct().count() == 40_000
    top = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in top  # whole lines do not move


def test_lines_of_earlier_batches_can_go(spark, tmp_path):
    """Lines that the source removes once they are stored; the session is resumed after."""
    for n in range(3):
        write(tmp_path / "in", f"{n}.json", tweet(n, 9, n))
        ingest.ingest_stream(
            spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), session_id=3, cleanSource="delete"
        ).awaitTermination()
    stored = ingest.read_table(spark, str(tmp_path / "out"), "status")
    assert sorted(r.id for r in stored.collect()) == [0, 1, 2]
    assert [p.name for p in (tmp_path / "in").glob("*.json")] == ["2.json"]
