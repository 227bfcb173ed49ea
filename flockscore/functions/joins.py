"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000
SPREAD = 64
PACKED_ROWS = 1 << 24  # rows of a reference table that go to all tasks, packed
PACK = 32  # keys looked through for each fact


def count_rows() -> Column:
    return F.count(F.lit(1))


def hot_keys(df: DataFrame, key: str, n: int = HOT_KEYS) -> DataFrame:
    """The ``n`` most frequent keys, flagged ``_hot``.

    Any other key holds less than 1/``n`` of the rows, whatever the data, and
    ``n`` rows are always safe to broadcast.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(count_rows().alias("_n"))
        .orderBy(F.desc("_n"), key)
        .limit(n)
        .select(key, F.lit(True).alias("_hot"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    spread_by: list[str],
    how: str = "inner",
    also_on: tuple[str, ...] = (),
    keys_of: DataFrame | None = None,
    hot: int = HOT_KEYS,
    spread: int = SPREAD,
) -> DataFrame:
    """Join on ``key`` where single keys may hold much of ``left``.

    The rows of the most frequent keys are dealt over ``spread`` tasks by the hash of
    ``spread_by`` (columns that tell the rows of one key apart) and only the
    matching rows of ``right`` are repeated. All other keys join as usual. Keys
    are counted in ``keys_of``, by default in ``left`` itself.
    """
    flagged = F.broadcast(hot_keys(left if keys_of is None else keys_of, key, hot))
    deal = F.pmod(F.xxhash64(*spread_by), F.lit(spread)).cast("int")
    dealt = left.join(flagged, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), deal).otherwise(0)
    )
    copies = F.when(
        F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))
    ).otherwise(F.array(F.lit(0)))
    repeated = right.join(flagged, key, "left").withColumn("_salt", F.explode(copies))
    return dealt.drop("_hot").join(
        repeated.drop("_hot"), [key, *also_on, "_salt"], how
    ).drop("_salt")


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, *, how: str = "left"
) -> DataFrame:
    """Join a reference table.

    The statistics of the tables, or of their shuffles as they run, decide
    whether it is broadcast; else adaptive execution splits the hot keys of
    ``facts``. Nothing runs while the plan is built.
    """
    return facts.join(lookup, key, how)


def text_join(
    facts: DataFrame, lookup: DataFrame, key: str, *, how: str = "left", most: int = PACKED_ROWS
) -> DataFrame:
    """Join a reference table to rows with whole texts, which a shuffle would put on disk.

    A table of up to ``most`` rows, which are counted first, goes to all tasks. Its rows
    are dealt by key into arrays of about ``PACK``, so that they take little more than
    their values there. Of a larger one Spark decides, as in ``lookup_join``.
    """
    n = lookup.count()
    if n > most:
        return lookup_join(facts, lookup, key, how=how)
    kind, values = dict(facts.dtypes)[key], [c for c in lookup.columns if c != key]

    def deal(k: Column) -> Column:
        return F.pmod(F.xxhash64(k.cast(kind)), F.lit(1 + n // PACK)).alias("_deal")

    listed = F.collect_list(F.struct(F.col(key).alias("_key"), *values)).alias("_listed")
    arrays = [F.col("_listed").getField(c).alias(f"_list{c}") for c in ("_key", *values)]
    packed = lookup.groupBy(deal(F.col(key))).agg(listed).select("_deal", *arrays)
    dealt = facts.withColumn("_deal", deal(F.col(key))).join(F.broadcast(packed), "_deal", how)
    found = F.filter(
        F.arrays_zip(*[f"_list{c}" for c in ("_key", *values)]), lambda r: r["_list_key"] == F.col(key)
    )
    explode = F.explode if how == "inner" else F.explode_outer
    rows = dealt.select(*facts.columns, explode(found).alias("_found"))
    others = [c for c in facts.columns if c != key]
    return rows.select(key, *others, *[F.col("_found")[f"_list{c}"].alias(c) for c in values])
