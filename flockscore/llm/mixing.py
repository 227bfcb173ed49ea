"""Mix sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times. The whole
part is certain; the fractions are rounded by the pivotal method: two fractional
documents meet, a random choice moves words from one to the other until one is a
whole copy or none, and the other goes on. The moves keep the words of the pair,
so a source misses its target by less than one document. Long documents meet
first, so that what is left in the end is mostly short. Documents meet first
inside small buckets, the residuals of the buckets meet in a tree of fan-in
``FAN``; a hot source has more buckets, not larger ones.

DataFrame functions only. Choices are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import without, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
FAN = 256

_UNIT = "struct<doc_id:bigint,size:bigint,rows:bigint,more:bigint,p:double>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``source, source_size`` (one row each) with its ``target`` words.

    Sources in code point order, null last, take ``weights`` in turn. A target
    stops at ``cap`` times the source; what is over goes to the others by weight
    until none is above. That is one water level: target = min(cap, weight x
    level), and the level is the largest one reached when the sources are filled
    in the order of cap / weight.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn(
        "_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    )
    turns = F.array(*[F.lit(int(w)) for w in weights])
    ranked = (
        ranked.withColumn("_w", F.element_at(turns, (F.col("_rank") - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_all", F.sum("source_size").over(everything) * share)
    )
    filled = everything.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    below = F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing))
    return (
        ranked.withColumn("_level", (F.col("_all") - below) / rest)
        .withColumn("_level", F.max("_level").over(everything))
        .select("source", "source_size", F.least("_cap", F.col("_w") * F.col("_level")).alias("target"))
    )


def _unit_key(df: DataFrame) -> DataFrame:
    """Rows with equal id, source and size are one unit; nulls are equal."""
    return df.withColumn("_unit", F.to_json(F.struct("doc_id", "source", "size")))


def _chance(a: Column, b: Column, level: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(a["doc_id"], a["size"], b["doc_id"], b["size"], F.lit(level)), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def _unit(u: Column, p: Column) -> Column:
    return F.struct(
        u["doc_id"].alias("doc_id"),
        u["size"].alias("size"),
        u["rows"].alias("rows"),
        u["more"].alias("more"),
        p.cast("double").alias("p"),
    )


def _meet(level: int):
    """One step of the fold: ``state.now`` meets the next unit."""

    def step(state: Column, b: Column) -> Column:
        a = state["now"]
        up_a = (1 - a["p"]) * a["size"]  # words until a is whole
        all_b = b["p"] * b["size"]  # words until b is none
        all_a = a["p"] * a["size"]
        up_b = (1 - b["p"]) * b["size"]
        to_a, to_b = F.least(up_a, all_b), F.least(all_a, up_b)
        give_a = F.coalesce(_chance(a, b, level) * (to_a + to_b) < to_b, F.lit(True)) | (to_a + to_b <= 0)
        rest_b = F.greatest(F.lit(0.0), b["p"] - to_a / b["size"])
        rest_a = F.least(F.lit(1.0), a["p"] + to_a / a["size"])
        more_b = F.least(F.lit(1.0), b["p"] + to_b / b["size"])
        less_a = F.greatest(F.lit(0.0), a["p"] - to_b / a["size"])
        one, none = F.lit(1.0), F.lit(0.0)
        settled = (
            F.when(give_a & (up_a <= all_b), _unit(a, one))
            .when(give_a, _unit(b, none))
            .when(all_a <= up_b, _unit(a, none))
            .otherwise(_unit(b, one))
        )
        goes_on = (
            F.when(give_a & (up_a <= all_b), _unit(b, rest_b))
            .when(give_a, _unit(a, rest_a))
            .when(all_a <= up_b, _unit(b, more_b))
            .otherwise(_unit(a, less_a))
        )
        return F.struct(F.concat(state["done"], F.array(settled)).alias("done"), goes_on.alias("now"))

    return step


def _fold(units: DataFrame, level: int) -> DataFrame:
    """One row per (source, bucket): the settled units and the one that is left."""
    met = units.groupBy("source", "_bucket").agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.col("u.size")).alias("_s"), F.xxhash64("u.doc_id", F.lit(level)).alias("_h"), "u")
            )
        ).alias("_all")
    )
    rest = F.transform(F.expr("slice(_all, 2, size(_all))"), lambda x: x["u"])
    start = F.struct(
        F.array().cast(f"array<{_UNIT}>").alias("done"), F.col("_all")[0]["u"].cast(_UNIT).alias("now")
    )
    return met.select(
        "source", "_bucket", F.aggregate(rest, start, _meet(level)).alias("_met")
    ).select("source", "_bucket", "_met.done", "_met.now")


def _rounded(units: DataFrame) -> DataFrame:
    """(source, u) with every ``u.p`` 0 or 1."""
    counts = units.groupBy("source").count()
    counts = written(counts.select("source", F.ceil(F.col("count") / FAN).alias("_buckets")), "mix-buckets")
    widest = counts.agg(F.max("_buckets")).first()[0] or 0
    level, left = 0, units.join(
        counts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).select(
        "source",
        F.pmod(F.xxhash64("u.doc_id", "u.size", F.lit("bucket")), F.col("_buckets")).alias("_bucket"),
        "u",
    )
    parts = []
    while True:
        folded = written(_fold(left, level), f"mix-level{level}")
        parts.append(folded.select("source", F.explode("done").alias("u")))
        left = folded.select("source", F.floor(F.col("_bucket") / FAN).alias("_bucket"), F.col("now").alias("u"))
        if widest <= 1:
            break
        level, widest = level + 1, -(-widest // FAN)
    last = F.shiftrightunsigned(F.xxhash64("u.doc_id", "u.size", F.lit("last")), 11).cast("double") * 2.0**-53
    parts.append(
        left.select(
            "source",
            F.struct("u.doc_id", "u.size", "u.rows", "u.more", (last < F.col("u.p")).cast("double").alias("p")).alias("u"),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _units(sized: DataFrame) -> DataFrame:
    """One row per (doc_id, source, size) with how often a row of it is taken:
    each of ``rows`` rows ``base`` times, and the first ``more`` once again."""
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = written(units, "mix-units")
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = written(targets(by_source), "mix-targets").withColumnRenamed("source", "_source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    units = (
        units.withColumn("base", F.floor(wanted).cast("long"))
        .withColumn("_part", (wanted - F.floor(wanted)) * F.col("rows"))
        .withColumn("more", F.floor("_part").cast("long"))
        .withColumn("p", F.col("_part") - F.floor("_part"))
    )
    split = (F.col("size") > 0) & (F.col("p") > 0)
    rounded = _rounded(
        units.where(split).select(
            "source", F.struct("doc_id", "size", "rows", "more", "p").cast(_UNIT).alias("u")
        )
    ).select("source", "u.*")
    settled = units.where(~split).select("source", "doc_id", "size", "rows", "more", F.lit(0.0).alias("p"))
    decided = rounded.unionByName(settled).withColumn("more", F.col("more") + F.col("p").cast("long")).drop("p")
    per_source = goal.withColumn(
        "base",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    )
    return decided.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _sized(documents: DataFrame) -> DataFrame:
    return documents.withColumn("size", word_count(F.col("text")))


def mix_plan(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies,
    taken`` (words, repeats counted).

    Null texts have size 0, null sources are one source, null ids are rounded
    like any id. Rows equal in id, source and size share one rounding: each gets
    the whole part, and as many of them as their joint fraction says one more.
    Sources without words have target 0. An empty table gives no rows.
    """
    units = _units(_sized(documents.select("doc_id", "text", "source")).drop("text"))
    each = units.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_n"))
    copies = F.col("base") + (F.col("_n") <= F.col("more")).cast("long")
    return each.select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mix_documents(documents: DataFrame) -> DataFrame:
    """The documents, all columns kept, with the columns of :func:`mix_plan`.

    Columns named like a result column are replaced.
    """
    kept = without(documents, "size", "source_size", "target", "copies", "taken", "_unit", "_n")
    units = _unit_key(_units(_sized(kept.select("doc_id", "text", "source")).drop("text")))
    numbered = _unit_key(_sized(kept)).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_unit").orderBy(F.xxhash64("text")))
    )
    copies = F.col("base") + (F.col("_n") <= F.col("more")).cast("long")
    return (
        numbered.join(units.select("_unit", "source_size", "target", "base", "more"), "_unit")
        .withColumn("copies", copies)
        .withColumn("taken", copies * F.col("size"))
        .drop("_unit", "_n", "base", "more")
    )
