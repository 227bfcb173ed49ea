"""Embedding near-dedup by an epsilon grid order join.

Cosine ``least`` or more is a distance of at most epsilon between unit vectors.
The vectors are turned to their principal dimensions, sorted by their grid cells
(of width epsilon) on the leading ones, and the sequence is cut into blocks. The
sequence is joined with itself by intervals: a pair of intervals whose boxes are
further apart than epsilon is dropped, the others are cut into their parts, down
to pairs of blocks, whose vectors are compared in double precision.

Equal vectors are compared once and counted. A pair of blocks returns the number
of links of each vector and a spanning forest of its links, so what it returns is
linear in its vectors whatever the number of links.

The rotation is fitted on at most ``SAMPLE_ROWS`` vectors; it decides how much is
skipped, never what is found. Vectors without a direction in which they differ
cannot be skipped, by this or any other grid; then all blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import components
from .tables import arrow_rows, without, written

LEAST = 0.95
SAMPLE_ROWS = 4096
CELL_DIMS = 6  # principal dimensions whose cells are sorted by
BOX_DIMS = 8  # principal dimensions of the boxes of intervals
BLOCK_VALUES = 1 << 18  # numbers in a block
FAN = 8  # parts of an interval
STRIP = 512  # rows compared with a block at a time


def comparable(v: Column) -> Column:
    """Whether a vector can be linked: finite numbers only, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def rotations(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """The principal axes, strongest first, for each number of dimensions."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = _unit(np.array([v for v in sample if len(v) == dim], float))
        out[dim] = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))[1][:, ::-1].copy()
    return out


def _turned(rows: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    dim = rows.shape[1]
    turned = _unit(rows) @ axes[dim] if dim in axes else _unit(rows)
    return np.pad(turned, ((0, 0), (0, max(0, BOX_DIMS - dim))))


def _cells(axes: dict[int, np.ndarray], epsilon: float):
    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            v = np.array(v.as_py(), float)[None]
            out.append(np.floor(_turned(v, axes)[0, :CELL_DIMS] / epsilon).astype(int).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return cells


_BLOCK = "block long, dim int, ids binary, weights binary, vectors binary, lo array<double>, hi array<double>"


def _to_blocks(axes: dict[int, np.ndarray]):
    """Blocks of consecutive vectors of one number of dimensions."""
    schema = pa.schema(
        [("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()),
         ("vectors", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            rows = np.stack([v for _, _, v in held])
            turned = _turned(rows, axes)[:, :BOX_DIMS]
            row = {
                "block": number,
                "dim": rows.shape[1],
                "ids": np.array([c for c, _, _ in held], np.int64).tobytes(),
                "weights": np.array([n for _, n, _ in held], np.int64).tobytes(),
                "vectors": rows.tobytes(),
                "lo": turned.min(0).tolist(),
                "hi": turned.max(0).tolist(),
            }
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for c, n, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                v = np.array(v, float)
                if held and (len(held[0][2]) != len(v) or (len(held) + 1) * len(v) > BLOCK_VALUES):
                    yield block()
                held.append((c, n, v))
        if held:
            yield block()

    return run


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b: the smallest label of each component."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label = label[label]


def _join_blocks(least: float):
    names = ["node", "links", "root"]

    def compare(row: dict) -> pa.RecordBatch:
        def side(s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return (
                np.frombuffer(row[f"ids_{s}"], np.int64),
                np.frombuffer(row[f"weights_{s}"], np.int64),
                np.frombuffer(row[f"vectors_{s}"], np.float64).reshape(-1, row["dim"]),
            )

        (ids_a, w_a, raw_a), (ids_b, w_b, raw_b) = side("a"), side("b")
        same = row["a"] == row["b"]
        unit_a, unit_b = _unit(raw_a), _unit(raw_b)
        n = len(ids_a)
        offset = 0 if same else n
        label = np.arange(n + (0 if same else len(ids_b)))
        links = np.zeros(len(label), np.int64)
        for s in range(0, n, STRIP):
            cosine = unit_a[s : s + STRIP] @ unit_b.T
            i, j = np.nonzero(cosine >= least - 1e-9)
            near = np.abs(cosine[i, j] - least) < 1e-9
            i += s
            if near.any():  # at the threshold, as the product over the norms
                x, y = raw_a[i[near]], raw_b[j[near]]
                exact = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                keep = np.ones(len(i), bool)
                keep[np.flatnonzero(near)[exact < least]] = False
                i, j = i[keep], j[keep]
            if same:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, w_b[j], len(label)).astype(np.int64)
            links += np.bincount(j + offset, w_a[i], len(label)).astype(np.int64)
            label = _hook(label, i, j + offset)
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[hit], links[hit], ids[label][hit])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield compare(batch.slice(i, 1).to_pylist()[0])

    return run


def _apart(a: str, b: str) -> Column:
    """The squared distance of two boxes."""
    total = F.lit(0.0)
    for i in range(BOX_DIMS):
        gap = F.greatest(
            F.lit(0.0),
            F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}"),
            F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}"),
        )
        total = total + gap * gap
    return total


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b) of the blocks that may hold vectors within epsilon, by intervals of
    the sequence: the whole sequence with itself, then part with part."""
    boxes = [F.col("lo")[i].alias(f"lo{i}") for i in range(BOX_DIMS)]
    boxes += [F.col("hi")[i].alias(f"hi{i}") for i in range(BOX_DIMS)]
    leaves = blocks.select(
        "block", "dim", (F.row_number().over(Window.orderBy("dim", "block")) - 1).cast("long").alias("node"), *boxes
    )
    leaves = written(leaves, "grid-leaves")
    count = leaves.count()
    depth, levels = 0, [leaves.drop("block")]
    while FAN**depth < count:
        depth += 1
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
            F.min("dim").alias("dim"),
            *[f(f"{e}{i}").alias(f"{e}{i}") for e, f in (("lo", F.min), ("hi", F.max)) for i in range(BOX_DIMS)],
        )
        levels.append(written(up, "grid-level"))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels[-2::-1]:
        parts = level.withColumn("parent", F.floor(F.col("node") / FAN))
        pairs = (
            pairs.join(parts.alias("x"), F.col("a") == F.col("x.parent"))
            .join(parts.alias("y"), F.col("b") == F.col("y.parent"))
            .where((F.col("x.node") <= F.col("y.node")) & (_apart("x", "y") <= epsilon**2 + 1e-9))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        )
        pairs = written(pairs, "grid-pairs")
    x, y = (leaves.select(F.col("node").alias(f"n{s}"), F.col("block").alias(s), F.col("dim").alias(f"d{s}")) for s in "ab")
    return (
        pairs.withColumnsRenamed({"a": "p", "b": "q"})
        .join(x, F.col("p") == F.col("na"))
        .join(y, (F.col("q") == F.col("nb")) & (F.col("da") == F.col("db")))
        .select("a", "b")
    )


def link_vectors(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row ``vec_id, n_links, component_id, kept``.

    Rows whose vectors have a cosine of ``least`` or more are linked; ``n_links``
    counts the other rows, ``component_id`` is the smallest id that links lead to,
    and rows with that id are kept. Null, empty and zero vectors and those with
    null or non-finite numbers link with nothing, nor do vectors of different
    lengths. Null ids take part but name no component; their rows are not kept.
    Other columns are left out. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    epsilon = float(np.sqrt(2 - 2 * least))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    classes = rows.where(comparable(F.col("v"))).groupBy("v").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")
    )
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    sample = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).collect()
    axes = rotations([r["v"] for r in sample])
    ordered = (
        classes.select("c", "n", "v", F.size("v").alias("_dim"), _cells(axes, epsilon)("v").alias("_cell"))
        .orderBy("_dim", "_cell", "c")
        .select("c", "n", "v")
    )
    blocks = written(ordered.mapInArrow(_to_blocks(axes), _BLOCK), "vector-blocks")
    pairs = block_pairs(blocks, epsilon)
    data = blocks.select("block", "dim", "ids", "weights", "vectors")
    left = data.select(*[F.col(c).alias(c if c == "dim" else f"{c}_a") for c in data.columns])
    right = data.drop("dim").select(*[F.col(c).alias(f"{c}_b") for c in data.columns if c != "dim"])
    both = (
        pairs.join(left, F.col("a") == F.col("block_a")).join(right, F.col("b") == F.col("block_b"))
    ).drop("block_a", "block_b")
    with arrow_rows(spark, 2):
        found = written(both.mapInArrow(_join_blocks(least), "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = (
        classes.join(links.withColumnRenamed("node", "c"), "c", "left")
        .join(member.withColumnRenamed("node", "c"), "c", "left")
        .withColumn("component", F.coalesce("component", "c"))
    )
    labelled = written(labelled.select("v", "n", "first", "links", "component"), "vector-labels")
    least_id = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    told = labelled.join(least_id, "component").select(
        F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), "component_id"
    )
    out = rows.join(told, F.col("v") == F.col("_v"), "left")
    alone = F.col("_v").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.when(alone, 0).otherwise(F.col("_links")).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
