"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "flockscore") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # rows of a few bytes that lead to long texts: 1 MB of them is too much a task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches, named by ``spark.checkpoint.dir``.

    Without the setting a folder of this machine stands in for it, but only where
    driver and executors are one process; on a cluster that is an error, as
    executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir: {master} needs a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="flockscore-")
    return _local_dirs[app]


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the shared one."""
    return f"{shared_dir(spark)}/flockscore/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back.

    Cuts the lineage with a table that outlives lost executors, and later
    readers still get column pruning and the file statistics from which Spark
    decides whether a join side is small enough to broadcast.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
