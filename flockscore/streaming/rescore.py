"""Re-scoring of accounts as their posts arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flockscore.plans.registry import PERUSER, Inputs
from flockscore.plans.score import accounts_of, score, write_back
from flockscore.streaming.ingest import BATCH, BUCKET, user_bucket, write_batch


def _own(table: DataFrame, touched: DataFrame, account: str) -> DataFrame:
    """Rows of the touched accounts.

    Of a table with account folders only theirs are read; the list of folders
    has at most ``BUCKETS`` entries.
    """
    if BUCKET in table.columns:
        folder = user_bucket(F.col("userid")).alias(BUCKET)
        folders = [row[BUCKET] for row in touched.select(folder).distinct().collect()]
        table = table.where(F.col(BUCKET).isin(folders))
    wanted = touched.withColumnRenamed("userid", account)
    return table.join(wanted, account, "left_semi")


def rescore_batch(
    touched: DataFrame,
    history: Callable[[], tuple[DataFrame, DataFrame]],
    source_q: DataFrame,
    as_of: datetime,
) -> DataFrame:
    """New scores of the touched accounts from their whole history."""
    status, users = history()
    inputs = Inputs(
        _own(status, touched, "status_user_id"),
        _own(users, touched, "id"),
        as_of,
        source_q,
    )
    return score(inputs, touched, PERUSER)


def rescore_stream(
    posts: DataFrame,
    history: Callable[[], tuple[DataFrame, DataFrame]],
    source_q: DataFrame,
    out: str,
    checkpoint: str,
    *,
    as_of: Callable[[], datetime],
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Score every account with new rows in ``posts`` (a streaming status frame).

    ``history`` reads the stored posts and snapshots, the new ones included.
    Scores are written per batch below ``out``; ``latest_scores`` reads them.
    """
    spark = posts.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(accounts_of(batch), f"{out}/_touched", batch_id)
        touched = spark.read.schema("userid bigint").parquet(
            f"{out}/_touched/{BATCH}={batch_id}"
        )
        scores = rescore_batch(touched, history, source_q, as_of())
        write_batch(scores, f"{out}/scores", batch_id)

    return (
        posts.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_scores(spark: SparkSession, out: str) -> DataFrame:
    """The newest score of each account out of all batches."""
    return (
        spark.read.parquet(f"{out}/scores")
        .groupBy("userid")
        .agg(F.max_by("totalscore", BATCH).alias("totalscore"))
    )


def current_challenge(challenge: DataFrame, out: str) -> DataFrame:
    """The listed accounts with the scores written so far."""
    return write_back(challenge, latest_scores(challenge.sparkSession, out))


def stream_positions(posts: DataFrame) -> DataFrame:
    """T5: newest post per account, kept up to date by the stream."""
    return posts.groupBy(F.col("status_user_id").alias("userid")).agg(
        F.max("id").alias("tweetid")
    )
