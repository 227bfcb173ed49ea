"""Scores of single accounts from stored facts, not from their posts (T4).

A micro-batch turns its own posts and snapshots into facts (``plans.facts``) and
stores them beside those of earlier batches. Facts add up, so an account that it
touches is scored from the facts of all batches. Two indicators look back at single
posts, and for them a narrow table keeps account, id, parent and local time of each:
a reply may answer an older post, or come before the post that it answers, and a copy
of an older post must not count again. Only folders of touched accounts are read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flockscore.functions.joins import spread_join
from flockscore.plans import facts as fc
from flockscore.plans.registry import PERUSER
from flockscore.plans.score import score_rows
from flockscore.streaming.commits import BATCH, commit, compact, read_committed, state
from flockscore.streaming.ingest import write_batch
from flockscore.streaming.rescore import _own

NAMES = {n: PERUSER.renamed.get(n, n) for n in (*PERUSER.weights, *PERUSER.knockouts)}
SEEN = "userid bigint, id bigint, in_reply_to_status_id bigint, local_at timestamp"
TABLES = ("_facts", "_seen")


def _stored(spark: SparkSession, out: str, name: str, schema: str, touched: DataFrame) -> DataFrame:
    """Rows that committed batches keep of the touched accounts."""
    try:
        table = read_committed(spark, out, name, state(spark, out))
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    columns = [c.split()[0] for c in schema.split(", ")]
    return _own(table, touched, "userid").select(columns)


def _reply_facts(fresh: DataFrame, older: DataFrame) -> DataFrame:
    """The shortest gaps of pairs of an account's posts of which one is fresh."""
    gaps = []
    for replies, posts in ((fresh, fresh.unionByName(older)), (older, fresh)):
        replies = replies.where("in_reply_to_status_id > 0").select(
            "userid",
            F.col("in_reply_to_status_id").alias("parent_id"),
            F.col("id").alias("reply_id"),
            F.unix_micros("local_at").alias("reply_at"),
        )
        parents = posts.select("userid", F.col("id").alias("parent_id"), F.unix_micros("local_at").alias("parent_at"))
        pairs = spread_join(replies, parents, "parent_id", spread_by=["reply_id"], also_on=("userid",))
        gaps.append(pairs.select("userid", (F.col("reply_at") - F.col("parent_at")).alias("gap")))
    least = gaps[0].unionByName(gaps[1]).groupBy("userid").agg(F.min("gap").alias("lo"))
    return least.select("userid", F.inline(F.array(fc.fact("reply", lo=F.col("lo")))))


def fold_batch(
    batch: DataFrame, snapshots: DataFrame, batch_id: int, out: str, source_q: DataFrame | None
) -> DataFrame:
    """Store a batch's facts and return the accounts that it touches.

    ``snapshots`` are the profiles recorded with the batch. Of stored tables only
    those of committed batches are read, so a repeated batch replaces itself.
    """
    spark = batch.sparkSession
    local = fc.local_frame([(batch, snapshots)])
    seen = batch.select(F.col("status_user_id").alias("userid"), "id").distinct().join(
        local.select("userid", "id", "in_reply_to_status_id", "local_at").distinct(), ["userid", "id"], "left"
    )
    write_batch(seen, f"{out}/_seen", batch_id, "userid")
    fresh = spark.read.parquet(f"{out}/_seen").where(F.col(BATCH) == batch_id)
    fresh = fresh.select(*[c.split()[0] for c in SEEN.split(", ")])
    touched = fresh.select("userid").distinct()
    older = _stored(spark, out, "_seen", SEEN, touched)

    known = older.select("userid", "id").distinct().withColumn("_known", F.lit(True))
    posts = fc.single_posts([batch], source_q).join(known, ["userid", "id"], "left")
    kinds = sorted({k for of in NAMES.values() for k in fc.KINDS[of]})
    parts = [
        fc.post_facts(posts, kinds, F.col("_known").isNull()),
        fc.author_facts(local),
        _reply_facts(fresh.where("local_at is not null"), older.where("local_at is not null")),
        fc.snapshot_facts(snapshots),
    ]
    write_batch(reduce(DataFrame.unionByName, parts), f"{out}/_facts", batch_id, "userid")
    return touched


def score_touched(spark: SparkSession, out: str, batch_id: int, touched: DataFrame, as_of: datetime) -> DataFrame:
    """Scores of the touched accounts from the facts of all batches up to this one."""
    own = spark.read.parquet(f"{out}/_facts").where(F.col(BATCH) == batch_id)
    columns = [c.split()[0] for c in fc.FACTS.split(", ")]
    stored = _stored(spark, out, "_facts", fc.FACTS, touched)
    kept = fc.merged(stored.unionByName(_own(own, touched, "userid").select(columns)))
    rows = fc.indicator_rows(fc.account_facts(kept), NAMES, F.lit(as_of))
    return score_rows(rows, touched, PERUSER)


def rolling_scores(
    posts: DataFrame,
    snapshots: Callable[[DataFrame, int], DataFrame],
    source_q: DataFrame | None,
    out: str,
    checkpoint: str,
    *,
    as_of: Callable[[], datetime],
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Score every account with new rows in ``posts`` (a streaming status frame).

    ``snapshots`` gives the profiles recorded with a batch. Scores are written per
    batch below ``out``; ``rescore.latest_scores`` reads them.
    """
    spark = posts.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = fold_batch(batch, snapshots(batch, batch_id), batch_id, out, source_q)
        write_batch(score_touched(spark, out, batch_id, touched, as_of()), f"{out}/scores", batch_id)
        commit(spark, out, batch_id)

    return (
        posts.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact_facts(spark: SparkSession, out: str) -> None:
    """Add up the facts of all committed batches, one row per key."""
    compact(spark, out, TABLES, {"_facts": fc.merged})
