"""Posts and snapshots stored so that they meet without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def _store(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    spark: SparkSession = df.sparkSession
    name = f"flockscore_{uuid.uuid4().hex[:16]}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def store_pair(
    status: DataFrame, users: DataFrame, path: str, *, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """Both frames as tables below ``path``, bucketed and sorted by author, time of
    recording and session. The three together spread a busy account over all buckets.
    The number of buckets is fixed here, for the size that the tables will have.
    """
    posts = _store(status, f"{path}/status", ["status_user_id", "recorded_at", "session_id"], buckets)
    people = _store(users, f"{path}/users", ["id", "recorded_at", "session_id"], buckets)
    return posts, people

