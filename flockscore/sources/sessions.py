"""Collection sessions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flockscore.schemas import SESSION


def _joined(values: Sequence[object]) -> str:
    """Comma-separated, whole."""
    return ",".join(str(value).strip() for value in values)


def session_row(
    spark: SparkSession,
    session_id: int,
    *,
    track: Sequence[str] = (),
    follow: Sequence[int] = (),
    datasource: str = "streaming",
) -> DataFrame:
    row = (session_id, _joined(track), _joined(follow), datasource)
    return spark.createDataFrame([row], SESSION)


def open_session(
    spark: SparkSession,
    path: str,
    *,
    session_id: int | None = None,
    track: Sequence[str] = (),
    follow: Sequence[int] = (),
    datasource: str = "streaming",
) -> int:
    """Register a new session, or go on with a given one without writing."""
    if session_id is not None:
        return session_id
    if not track and not follow:
        raise ValueError("give accounts to follow or phrases to track")
    new_id = uuid.uuid4().int >> 65
    session_row(
        spark, new_id, track=track, follow=follow, datasource=datasource
    ).write.mode("append").parquet(path)
    return new_id
