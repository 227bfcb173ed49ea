"""A table by account that is changed in place, one folder of accounts at a time.

A version is a list of folders, each with the version that wrote it. A change writes
the touched folders anew and then the list, a single file; all other folders stay as
they are. Readers see the version that was newest when they began.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscore.plans.score import write_back
from flockscore.streaming.commits import BUCKET, folders, user_bucket

LIST = f"{BUCKET} int, version bigint"


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = folders(spark, f"{path}/_versions")
    return sorted(int(n.removeprefix("v")) for n in names if "_SUCCESS" in folders(spark, f"{path}/_versions/{n}"))


def _write(rows: DataFrame, path: str, version: int, kept: list[tuple[int, int]]) -> None:
    spark = rows.sparkSession
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/v{version}")
    new = [int(f.removeprefix(f"{BUCKET}=")) for f in folders(spark, f"{path}/data/v{version}") if f.startswith(BUCKET)]
    listed = spark.createDataFrame([*kept, *((b, version) for b in new)], LIST).coalesce(1)
    listed.write.mode("overwrite").parquet(f"{path}/_versions/v{version:09d}")


def create_table(rows: DataFrame, path: str, account: str = "user_id") -> None:
    """The first version. Accounts that are null have a folder as well."""
    bucket = F.coalesce(user_bucket(F.col(account)), F.lit(0))
    _write(rows.withColumn(BUCKET, bucket), path, 0, [])


def _listed(spark: SparkSession, path: str, version: int) -> list[tuple[int, int]]:
    """At most one row per folder of accounts."""
    rows = spark.read.schema(LIST).parquet(f"{path}/_versions/v{version:09d}").collect()
    return [(r[BUCKET], r["version"]) for r in rows]


def _read(spark: SparkSession, path: str, listed: list[tuple[int, int]]) -> DataFrame:
    parts = []
    for version in sorted({v for _, v in listed}):
        own = [b for b, v in listed if v == version]
        parts.append(spark.read.parquet(f"{path}/data/v{version}").where(F.col(BUCKET).isin(own)))
    return reduce(DataFrame.unionByName, parts)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version."""
    return _read(spark, path, _listed(spark, path, _versions(spark, path)[-1])).drop(BUCKET)


def write_back_stored(spark: SparkSession, path: str, scores: DataFrame) -> int:
    """New scores into the stored listed accounts; returns the version. Only folders
    with a scored account are read and written."""
    version = _versions(spark, path)[-1]
    listed = _listed(spark, path, version)
    buckets = scores.select(user_bucket(F.col("userid")).alias(BUCKET)).distinct().collect()
    touched = {r[BUCKET] for r in buckets} & {b for b, _ in listed}
    if not touched:
        return version
    rows = _read(spark, path, [x for x in listed if x[0] in touched])
    _write(write_back(rows, scores), path, version + 1, [x for x in listed if x[0] not in touched])
    return version + 1
