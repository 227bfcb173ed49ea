"""Document quality by a factorisation machine.

Features are hashed words (a document's distinct words, scaled to unit length),
steps of structure statistics, and steps of the metadata column ``n_chars``. The
score is logistic in w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the
pairs cost as much as the features, because their sum is half of
sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, other_bytes, slices, space_bytes
from .tables import fold, without

FOLDS = 3
SAMPLE_ROWS = 4000  # labelled rows that the model is fitted on, at most
BUCKETS = 1 << 14
FACTORS = 8
STEPS = 8  # of each statistic, at quantiles of the sample
N_STATS = 14


def _stats(words: Words, n_chars: np.ndarray) -> np.ndarray:
    """Structure statistics of each document; 0 for empty texts."""
    data, n = words.data, words.n_docs
    size = np.diff(words.offsets)
    doc = np.repeat(np.arange(n), size)

    def share(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(doc[chosen[data]], minlength=n) / np.maximum(size, 1)

    def bytes_of(text: bytes) -> np.ndarray:
        out = np.zeros(256, bool)
        out[list(text)] = True
        return out

    h = words.hashes()
    n_words = np.maximum(np.bincount(words.doc, minlength=n), 1)
    length = (words.end - words.start).astype(float)
    order = np.lexsort((h, words.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    upper, lower = bytes_of(bytes(range(65, 91))), bytes_of(bytes(range(97, 123)))
    letters = upper | lower | (np.arange(256) >= 128)
    lines = np.bincount(doc[data == 10], minlength=n) + 1
    return np.stack(
        [
            np.log1p(size),
            share(upper),
            share(bytes_of(b"0123456789")),
            share(bytes_of(b"!?")),
            share(bytes_of(b"|\t<>{}[]\\=_~^")),
            share(bytes_of(b"#$%&*+@")),
            share(space_bytes()),
            share(bytes_of(b".,;:'\"()-")),
            share(~letters),
            np.bincount(words.doc, length, minlength=n) / n_words,
            np.bincount(words.doc[order][new], minlength=n) / n_words,
            np.bincount(words.doc, again, minlength=n) / n_words,
            np.log1p(size / lines),
            np.where(np.isnan(n_chars), -1.0, np.log1p(np.maximum(np.nan_to_num(n_chars), 0))),
        ],
        1,
    )


def _rows(texts: pa.Array, n_chars: np.ndarray) -> tuple[Any, ...]:
    """(doc, feature, value) of the hashed words, and the statistics."""
    stats = _stats(Words(texts, space_bytes()), n_chars)
    words = Words(pc.utf8_lower(texts.fill_null("").cast(pa.string())), other_bytes())
    key = np.unique(words.doc.astype(np.int64) * BUCKETS + (words.hashes() % np.uint64(BUCKETS)).astype(np.int64))
    doc, feature = key // BUCKETS, key % BUCKETS
    value = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=words.n_docs), 1))[doc]
    return doc, feature, value, stats


def _steps(stats: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Feature numbers of the statistics' steps, one for each statistic."""
    at = np.stack([np.searchsorted(c, s, "right") for c, s in zip(cuts, stats.T, strict=True)], 1)
    return BUCKETS + np.arange(N_STATS) * (STEPS + 1) + at


N_FEATURES = BUCKETS + N_STATS * (STEPS + 1)


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by document (``doc`` ascending)."""
    out = np.zeros((n, *values.shape[1:]))
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = np.add.reduceat(values, first)
    return out


def _z(model: dict, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, steps: np.ndarray) -> tuple[Any, ...]:
    n, w, v = len(steps), model["w"], model["v"]
    own = v[feature] * value[:, None]
    total = _sums(doc, own, n) + v[steps].sum(1)
    squares = _sums(doc, (own**2).sum(1), n) + (v[steps] ** 2).sum((1, 2))
    z = model["w0"] + _sums(doc, w[feature] * value, n) + w[steps].sum(1)
    return z + 0.5 * ((total**2).sum(1) - squares), total


def fit(sample: list[tuple[str, float | None, int]], epochs: int = 8, batch: int = 256, rate: float = 0.08) -> dict:
    """The machine for (text, n_chars, label) rows, by Adagrad on the log loss; the
    base rate scores everything if one label is missing."""
    y = np.array([r[2] for r in sample], float)
    base = (y.sum() + 1) / (len(y) + 2)
    w0 = float(np.log(base / (1 - base)))
    rng = np.random.default_rng(5)
    model: dict[str, Any] = {
        "w0": w0, "w": np.zeros(N_FEATURES), "v": np.zeros((N_FEATURES, FACTORS)), "cuts": np.zeros((N_STATS, STEPS))
    }
    if len(set(y)) < 2:
        return model
    model["v"] = rng.normal(0, 0.05, (N_FEATURES, FACTORS))
    n_chars = np.array([np.nan if r[1] is None else r[1] for r in sample], float)
    texts = pa.array([r[0] for r in sample], pa.string())
    parts = []
    for i, j in slices(texts):
        own = _rows(texts.slice(i, j - i), n_chars[i:j])
        parts.append((own[0] + i, own[1].astype(np.int32), own[2].astype(np.float32), own[3]))
    doc, feature, value, stats = (np.concatenate(p) for p in zip(*parts, strict=True))
    model["cuts"] = np.quantile(stats, np.linspace(0, 1, STEPS + 2)[1:-1], axis=0).T
    steps = _steps(stats, model["cuts"])
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    w_sq, v_sq = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = np.sort(order[i : i + batch])
            at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            d = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            f = np.concatenate([feature[at], steps[rows].ravel()])
            d_all = np.concatenate([d, np.repeat(np.arange(len(rows)), N_STATS)])
            x = np.concatenate([value[at], np.ones(len(rows) * N_STATS)])
            z, total = _z(model, d, feature[at], value[at], steps[rows])
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            used, slot = np.unique(f, return_inverse=True)
            g = miss[d_all] * x
            gw = np.bincount(slot, g, len(used)) + 1e-4 * model["w"][used]
            gv = g[:, None] * (total[d_all] - model["v"][f] * x[:, None])
            gv = np.stack([np.bincount(slot, c, len(used)) for c in gv.T], 1) + 1e-4 * model["v"][used]
            w_sq[used] += gw**2
            v_sq[used] += gv**2
            model["w"][used] -= rate * gw / np.sqrt(w_sq[used])
            model["v"][used] -= 0.4 * rate * gv / np.sqrt(v_sq[used])
            model["w0"] -= rate * miss.sum()
    return model


def scorer(model: dict[str, Any]) -> Callable[[Column, Column], Column]:
    small = model | {"v": model["v"].astype(np.float32), "w": model["w"].astype(np.float32)}

    @F.arrow_udf("double")
    def score(texts: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for i, j in slices(texts):
            meta = n_chars.slice(i, j - i).to_numpy(zero_copy_only=False).astype(float)
            doc, feature, value, stats = _rows(texts.slice(i, j - i), meta)
            z, _ = _z(small, doc, feature, value, _steps(stats, small["cuts"]))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pa.array(np.concatenate(out))

    return score


def _metadata(documents: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in documents.columns else F.lit(None).cast("double")


def learn(documents: DataFrame, labels: DataFrame, train: Column | None = None) -> dict[str, Any]:
    """A model from rows that ``train`` allows (by default those outside fold 1),
    at most ``SAMPLE_ROWS`` of them, smallest id hashes first."""
    train = fold(F.col("doc_id"), FOLDS) != 1 if train is None else train
    chosen = (
        labels.where(F.col("quality").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("_label"))
        .orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
        .limit(SAMPLE_ROWS)
    )
    rows = (
        documents.where(train)
        .select("doc_id", "text", _metadata(documents).alias("_meta"))
        .join(F.broadcast(chosen), "doc_id")
        .limit(2 * SAMPLE_ROWS)
        .collect()
    )
    unique = {r["text"]: r for r in sorted(rows, key=lambda r: (-r["doc_id"], r["text"] or "", r["_meta"] or 0))}
    rows = sorted(unique.values(), key=lambda r: r["doc_id"])
    return fit([(r["text"] or "", r["_meta"], r["_label"]) for r in rows])


def score_quality(documents: DataFrame, model: dict[str, Any]) -> DataFrame:
    """The documents with ``quality_score`` (0 to 1, higher is better).

    Null and empty texts have no word and all statistics 0, and are scored as such.
    A missing or null ``n_chars`` is a step of its own. Columns named like the added
    one are replaced. An empty table gives no rows.
    """
    kept = without(documents, "quality_score")
    return kept.withColumn("quality_score", scorer(model)(F.col("text"), _metadata(kept)))
