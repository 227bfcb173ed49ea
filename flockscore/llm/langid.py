"""Language identification as multilingual mixture inference.

Each language is a distribution over hashed byte trigrams of lower-cased words
with a space at either end, counted over all documents that may be learnt from. A document
is a mixture: expectation-maximisation estimates the languages' shares of its
trigrams. All learnt languages are fitted, then all but the weakest, and so on; the
set with the largest likelihood less a penalty for each language is taken, and loses
further languages while that raises it. The prediction is the language with the
largest share of that set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SLICE_BYTES, flat, slices
from .tables import fold, without

FOLDS = 4
BUCKETS = 1 << 15
SMOOTH = 0.5
ROUNDS = 10
PENALTY = 3.0  # times log(trigrams), for each language: one trigram shares letters with two others
UNKNOWN = "und"


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[97:123] = True
    out[128:] = True
    return out


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the trigrams, rows and buckets ascending."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(texts.fill_null("").cast(pa.string())), "", " ")  # spaces around
    data, offsets = flat(padded)
    letter = _letters()[data]
    byte = np.where(letter, data, 32).astype(np.uint32)
    if len(byte) < 3:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    use = letter[1:-1].copy()
    code = ((byte[:-2] << 16 | byte[1:-1] << 8 | byte[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    use &= row[:-2] == row[2:]
    key, count = np.unique(row[:-2][use] * BUCKETS + code[use].astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task by language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(1), batch.column(0).to_pylist()
        for i, j in slices(texts):
            row, bucket, count = trigrams(texts.slice(i, j - i))
            own = np.array(langs[i:j], object)
            for lang in set(langs[i:j]):
                chosen = (own == lang)[row]
                add = np.bincount(bucket[chosen], count[chosen], BUCKETS)
                total[lang] = total.get(lang, 0) + add
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))],
            ["lang", "bucket", "n"],
        )


def learn(documents: DataFrame, train: Column | None = None) -> dict[str, Any]:
    """Trigram distributions of every language named in ``lang`` of the rows that
    ``train`` allows (by default those outside fold 2). The driver receives at most
    ``BUCKETS`` counts for each language."""
    train = fold(F.col("doc_id"), FOLDS) != 2 if train is None else train
    rows = (
        documents.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInArrow(_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(rows["lang"].unique())
    n = np.zeros((len(langs), BUCKETS))
    n[np.searchsorted(langs, rows["lang"]) if len(langs) else [], rows["bucket"]] = rows["n"]
    p = (n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    return {"langs": langs, "p": p.T.astype(np.float32).copy()}


def _by_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(values, first)
    return out


def _mixture(row: np.ndarray, p: np.ndarray, count: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages and the log likelihood of each document, by EM."""
    n, k = len(size), p.shape[1]
    share = np.full((n, k), 1 / k)
    for _ in range(ROUNDS if k > 1 else 0):
        part = share[row] * p
        part *= (count / part.sum(1))[:, None]
        share = _by_row(row, part, n) / size[:, None]
    whole = (share[row] * p).sum(1)
    return share, _by_row(row, count * np.log(whole), n)


def infer(texts: pa.Array, model: dict[str, Any]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages by falling share, their shares, number in the set) of each row."""
    row, bucket, count = trigrams(texts)
    n, langs = len(texts), len(model["langs"])
    size = np.maximum(np.bincount(row, count, n), 1)
    penalty = PENALTY * np.log(size + 1)
    chosen, p = np.tile(np.arange(langs), (n, 1)), model["p"][bucket]
    best, best_fit, members, taken = np.zeros((n, langs)), np.full(n, -np.inf), np.full(n, langs), chosen.copy()
    for m in range(langs, 0, -1):
        share, fit = _mixture(row, p, count, size)
        fit = fit - (m - 1) * penalty
        order = np.argsort(-share, 1, kind="stable")
        chosen[:, :m] = np.take_along_axis(chosen[:, :m], order, 1)
        better = fit >= best_fit
        own = np.pad(np.take_along_axis(share, order, 1), ((0, 0), (0, langs - m)))
        best, taken = np.where(better[:, None], own, best), np.where(better[:, None], chosen, taken)
        best_fit, members = np.where(better, fit, best_fit), np.where(better, m, members)
        p = np.take_along_axis(p, order[row][:, : m - 1], 1)
    for m in range(langs, 1, -1):
        _drop(m, row, bucket, count, size, model, best, best_fit, members, taken)
    order = np.argsort(-best, 1, kind="stable")
    return np.take_along_axis(taken, order, 1), np.take_along_axis(best, order, 1), members


def _drop(m: int, row, bucket, count, size, model, best, best_fit, members, taken) -> None:
    """Take from the sets of ``m`` languages the one whose loss raises the penalised
    likelihood most, if any does."""
    docs = np.flatnonzero(members == m)
    at = np.flatnonzero((members == m)[row])
    if not len(docs):
        return
    own = np.searchsorted(docs, row[at])
    before = taken[docs, :m]
    p = np.take_along_axis(model["p"][bucket[at]], before[own], 1)
    for d in range(m):
        share, fit = _mixture(own, np.delete(p, d, 1), count[at], size[docs])
        fit = fit - (m - 2) * PENALTY * np.log(size[docs] + 1)
        better = np.flatnonzero(fit > best_fit[docs])
        to = docs[better]
        rest = np.delete(np.arange(m), d)
        best[to] = 0
        best[to, : m - 1] = share[better]
        taken[to, :m] = before[better][:, [*rest, d]]
        best_fit[to], members[to] = fit[better], m - 1


def scorer(model: dict[str, Any]) -> Callable[[Column], Column]:
    kind = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("langs", pa.string())])

    @F.arrow_udf("lang string, share double, langs string")
    def predict(texts: pa.Array) -> pa.Array:
        out = []
        lettered = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_pylist()
        names = np.array([*model["langs"], UNKNOWN], object)
        for i, j in slices(texts, SLICE_BYTES * 3 // max(len(names) - 1, 3)):
            if not model["langs"]:
                out += [{"lang": UNKNOWN, "share": 0.0, "langs": ""}] * (j - i)
                continue
            chosen, share, members = infer(texts.slice(i, j - i), model)
            for r in range(j - i):
                if not lettered[i + r]:
                    out.append({"lang": UNKNOWN, "share": 0.0, "langs": ""})
                    continue
                m = members[r]
                parts = ",".join(f"{names[c]}:{s:.4f}" for c, s in zip(chosen[r, :m], share[r, :m], strict=True))
                out.append({"lang": names[chosen[r, 0]], "share": min(float(share[r, 0]), 1.0), "langs": parts})
        return pa.array(out, kind)

    return predict


def identify(documents: DataFrame, model: dict[str, Any]) -> DataFrame:
    """The documents with ``lang_pred``, ``lang_share`` (0 to 1, its share of the
    trigrams) and ``lang_mixture`` (``language:share`` by falling share).

    Texts that are null or have no letter, and all texts if nothing was learnt, are
    ``und`` with share 0. Columns named like an added one are replaced. An empty
    table gives no rows.
    """
    kept = without(documents, "lang_pred", "lang_share", "lang_mixture", "_found")
    found = kept.withColumn("_found", scorer(model)("text"))
    return found.withColumns(
        {"lang_pred": F.col("_found.lang"), "lang_share": F.col("_found.share"), "lang_mixture": F.col("_found.langs")}
    ).drop("_found")
