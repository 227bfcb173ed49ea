"""Indicators and scores as SQL table functions of one account.

``select * from kpi_tweetcount(7)`` is a filter on the account over a view; it moves
below the grouping by account and into the scans of posts and snapshots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscore.plans.registry import PERUSER, Inputs, Profile
from flockscore.plans.score import integrate, ko_table, ko_total, kpi_table, weighted_total

INDICATOR = "kpiname string, userid bigint, botscore double"


def _register(spark: SparkSession, name: str, rows: DataFrame, returns: str) -> str:
    view = f"{name}_rows"
    columns = [c.split()[0] for c in returns.split(", ")]
    rows.select(columns).createOrReplaceTempView(view)
    spark.sql(
        f"create or replace temporary function {name}(account bigint) returns table ({returns}) "
        f"return select {', '.join(columns)} from {view} where userid = account"
    )
    return name


def register_functions(
    inputs: Inputs, universe: DataFrame, profile: Profile = PERUSER, prefix: str = "kpi_"
) -> list[str]:
    """Create a function for each indicator of ``profile``, and for the weighted total,
    the knock-out and the integrated score of the accounts in ``universe``; returns
    their names. Accounts without rows have none in an indicator's function, and the
    profile's fixed scores in the totals."""
    spark = inputs.status.sparkSession
    built = {
        name: profile.indicator(name)
        .build(inputs)
        .select(F.lit(name).alias("kpiname"), "userid", F.col("botscore").cast("double").alias("botscore"))
        for name in (*profile.weights, *profile.knockouts)
    }
    names = [_register(spark, prefix + n.lower(), rows, INDICATOR) for n, rows in built.items()]

    def union(wanted) -> DataFrame:
        return reduce(DataFrame.unionByName, [built[n].distinct() for n in wanted])

    total = weighted_total(kpi_table(union(profile.weights), universe, profile))
    names.append(_register(spark, f"{prefix}total", total, "userid bigint, totalbotscore double"))
    if profile.knockouts:
        ko = ko_total(ko_table(union(profile.knockouts), universe, profile))
        names.append(_register(spark, f"{prefix}knockout", ko, "userid bigint, totalkobotscore double"))
        whole = integrate(total, ko)
        names.append(_register(spark, f"{prefix}score", whole, "userid bigint, totalscore double"))
    return names
