"""Toxicity by a linear-chain conditional random field.

The labels mark documents, so token labels come first: words and word beginnings
that stand in toxic documents far oftener than in others are a lexicon, with a
weight of evidence each; in toxic documents its tokens are labelled 1. The field
has two labels and sees, for each token, the strength of the evidence (in steps)
of the token and its neighbours, and its length. It is fitted by gradient ascent
on the labelled chains. Forward-backward gives each token's marginal; a logistic
regression on sums of marginals gives the document's score; tokens whose marginal
reaches ``SPAN_AT`` are the offending spans.

A chain is a run of words without a full stop, question mark or line end between
them, cut after ``CHAIN`` words, so that a batch of chains moves one step at a
time whatever the texts' lengths. Every word of a text is in a chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, other_bytes, slices
from .tables import fold, fitted, labelled_sample, without

FOLDS = 5
SAMPLE_ROWS = 4000  # labelled rows that the model is fitted on, at most
STARTS = (4, 5, 6, 7, 8)  # bytes of word beginnings
LEAST_DOCS = 6
LEAST_RATIO = 6.0
CHAIN = 64
STEPS = np.array([0.8, 1.4, 2.0, 2.6, 3.2])  # of the evidence, in log units
SPAN_AT = 0.5


def _tokens(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts.fill_null("").cast(pa.string())), other_bytes())


def _forms(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which words, hash) of whole words and of beginnings of each length."""
    length = words.end - words.start
    out = [(np.arange(len(words)), words.hashes())]
    for k in STARTS:
        at = np.flatnonzero(length > k)
        out.append((at, words.span_hash(words.start[at], words.start[at] + k) ^ np.uint64(k)))
    return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``values`` of the wanted keys (sorted keys), 0 for others."""
    out = np.zeros(len(wanted), np.float32)
    if not len(keys):
        return out
    seen = np.zeros(1 << 16, bool)
    seen[(keys >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(seen[(wanted >> np.uint64(48)).astype(np.int64)])
    pos = np.minimum(np.searchsorted(keys, wanted[at]), len(keys) - 1)
    same = keys[pos] == wanted[at]
    out[at[same]] = values[pos[same]]
    return out


def _parts(texts: list[str]) -> Iterator[tuple[int, Words]]:
    """The sample in slices: (first row, words)."""
    whole = pa.array(texts, pa.string())
    for i, j in slices(whole):
        yield i, _tokens(whole.slice(i, j - i))


def _apart(texts: list[str]) -> np.ndarray:
    """Whether each row is taken: not those that look like near copies of an earlier
    row (the same smallest five-word hash under one of three orders), which would
    make words of one text look common."""
    seen: list[set[int]] = [set(), set(), set()]
    keep = np.zeros(len(texts), bool)
    for i, words in _parts(texts):
        h = words.hashes()
        five = h.copy()
        for k in range(1, 5):
            five[:-k] = five[:-k] * np.uint64(31) + h[k:]
        for d in range(words.n_docs):
            own = five[words.first[d] : words.first[d + 1]]
            if not len(own):
                continue
            marks = [int((own * np.uint64(m)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
            keep[i + d] = not any(m in s for m, s in zip(marks, seen, strict=True))
            for m, s in zip(marks, seen, strict=True):
                s.add(m)
    return keep


def _lexicon(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their evidence: log odds over the base rate, at the lower
    end of what the counts allow."""
    found: list[list[np.ndarray]] = [[] for _ in range(1 + len(STARTS))]
    for i, words in _parts(texts):
        for own, (at, h) in zip(found, _forms(words), strict=True):
            order = np.lexsort((words.doc[at], h))
            h, doc = h[order], words.doc[at][order] + i
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            own += [h[new], toxic[doc[new]].astype(np.uint64)]
    n_bad, n_all = toxic.sum(), len(toxic)
    keys, values = [], []
    for own in found:
        h, slot = np.unique(np.concatenate([np.zeros(0, np.uint64), *own[0::2]]), return_inverse=True)
        n = np.bincount(slot, minlength=len(h))
        bad = np.bincount(slot, np.concatenate([np.zeros(0), *own[1::2]]), minlength=len(h))
        low = np.maximum(bad - np.sqrt(bad), 0.5)
        ratio = (low / max(n_bad, 1)) / ((n - bad + 0.5) / max(n_all - n_bad, 1))
        take = (bad >= LEAST_DOCS) & (ratio >= LEAST_RATIO)
        keys.append(h[take])
        values.append(np.log(ratio[take]).astype(np.float32))
    order = np.argsort(np.concatenate(keys))
    return np.concatenate(keys)[order], np.concatenate(values)[order]


def _features(words: Words, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(step of each token's evidence, 0 if none; chain of each token)."""
    evidence = np.zeros(len(words), np.float32)
    for at, h in _forms(words):
        evidence[at] = np.maximum(evidence[at], _lookup(model["keys"], model["values"], h))
    level = np.searchsorted(STEPS, evidence, "right").astype(np.int8)
    level[(evidence > 0) & (level == 0)] = 1
    stop = np.zeros(256, bool)
    stop[[46, 63, 10]] = True
    stops = np.zeros(len(words.data) + 1, np.int32)
    np.cumsum(stop[words.data], out=stops[1:])
    cut = np.ones(len(words), bool)
    cut[1:] = (stops[words.start[1:]] != stops[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(cut)
    run = np.cumsum(cut) - 1
    inside = np.arange(len(words)) - first[run] if len(words) else np.zeros(0, int)
    cut |= inside % CHAIN == 0
    return level, cut


def _design(level: np.ndarray, cut: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Columns of active features of each token: own step, step before, step
    after, length."""
    k = len(STEPS) + 1
    before = np.zeros_like(level)
    before[1:] = np.where(cut[1:], 0, level[:-1])
    after = np.zeros_like(level)
    after[:-1] = np.where(cut[1:], 0, level[1:])
    size = np.searchsorted([3, 6, 9, 13], length, "right")
    return np.stack([level, k + before, 2 * k + after, 3 * k + size], 1).astype(np.int16)


N_FEATURES = 3 * (len(STEPS) + 1) + 5


def _messages(rise: np.ndarray, cut: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    ``rise`` is the odds factor of label 1 from a token's features, ``moves`` the
    2 x 2 transition factors. Returns the marginal of label 1, and the forward and
    backward shares of label 1.
    """
    n = len(rise)
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    f, b = np.full(n, 0.5), np.full(n, 0.5)
    (m00, m01), (m10, m11) = moves
    for t, count in enumerate(live):
        at = first[:count] + t
        if t == 0:
            one, none = rise[at], 1.0
        else:
            was = f[at - 1]
            one = ((1 - was) * m01 + was * m11) * rise[at]
            none = (1 - was) * m00 + was * m10
        f[at] = one / (one + none)
    for t in range(len(live) - 1, -1, -1):
        at = first[: live[t]] + t
        ends = length[: live[t]] == t + 1
        after = np.minimum(at + 1, n - 1)
        one = b[after] * rise[after]
        none = 1 - b[after]
        to_one, to_none = m10 * none + m11 * one, m00 * none + m01 * one
        b[at] = np.where(ends, 0.5, to_one / (to_one + to_none))
    both = f * b
    return both / (both + (1 - f) * (1 - b)), f, b


def _marginals(words: Words, model: dict) -> np.ndarray:
    level, cut = _features(words, model)
    if not len(words):
        return np.zeros(0)
    x = _design(level, cut, words.end - words.start)
    rise = np.exp(np.clip(model["weights"][x].sum(1), -30, 30))
    return _messages(rise, cut, np.exp(model["moves"]))[0]


def _told(words: Words, toxic: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and chain starts of the chains that are fitted: those with
    evidence, and an eighth of the others."""
    level, cut = _features(words, model)
    x = _design(level, cut, words.end - words.start)
    y = (toxic[words.doc] > 0) & (level > 0)
    chain = np.cumsum(cut) - 1
    told = np.bincount(chain, level > 0) > 0
    told |= np.arange(len(told)) % 8 == 0
    use = told[chain] if len(chain) else np.zeros(0, bool)
    return x[use], y[use], cut[use]


def _fit_field(texts: list[str], toxic: np.ndarray, model: dict, rounds: int = 60, rate: float = 2.0) -> None:
    """Gradient ascent on the mean log likelihood of the token labels."""
    parts = [_told(words, toxic[i : i + words.n_docs], model) for i, words in _parts(texts)]
    x, y, cut = (np.concatenate(p) for p in zip(*parts, strict=True))
    n = max(len(y), 1)
    inner = ~cut[1:]
    y_pairs = np.array([[np.sum(inner & (y[:-1] == i) & (y[1:] == j)) for j in (0, 1)] for i in (0, 1)])
    y_sums = np.bincount(x[y].ravel(), minlength=N_FEATURES)
    w, m = np.zeros(N_FEATURES), np.zeros((2, 2))
    w_sq, m_sq = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds if len(y) else 0):
        rise = np.exp(np.clip(w[x].sum(1), -30, 30))
        moves = np.exp(m)
        p, f, b = _messages(rise, cut, moves)
        after = b[1:] * rise[1:]
        cells = np.stack(
            [(1 - f[:-1]) * moves[0, 0] * (1 - b[1:]), (1 - f[:-1]) * moves[0, 1] * after,
             f[:-1] * moves[1, 0] * (1 - b[1:]), f[:-1] * moves[1, 1] * after]
        )
        cells = (cells / cells.sum(0))[:, inner].sum(1).reshape(2, 2)
        w_step = (y_sums - np.bincount(x.ravel(), np.repeat(p, x.shape[1]), minlength=N_FEATURES)) / n - 1e-5 * w
        m_step = (y_pairs - cells) / n - 1e-5 * m
        w_sq += w_step**2
        m_sq += m_step**2
        w += rate * 0.3 * w_step / np.sqrt(w_sq)
        m += rate * 0.3 * m_step / np.sqrt(m_sq)
    model["weights"], model["moves"] = w, m


def _summary(words: Words, p: np.ndarray) -> np.ndarray:
    """Per document: constant, expected toxic tokens (log), their share, the
    largest marginal, and its two highest steps."""
    n = words.n_docs
    total = np.bincount(words.doc, p, minlength=n)
    size = np.maximum(np.bincount(words.doc, minlength=n), 1)
    top = np.zeros(n)
    np.maximum.at(top, words.doc, p)
    sure = np.bincount(words.doc, p > 0.5, minlength=n)
    return np.stack(
        [np.ones(n), np.log1p(total), np.minimum(100 * total / size, 5), top, sure >= 1, sure >= 2, sure >= 3], 1
    ).astype(float)


def _fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(bend, slope)
    return w


def fit(sample: list[tuple[str, int]]) -> dict[str, Any]:
    """The model of (text, toxic) rows; without any, every score is 0."""
    texts, labels = [t for t, _ in sample], np.array([y for _, y in sample], np.int64)
    if not len(labels) or not labels.any():
        return {}
    own = np.flatnonzero(_apart(texts))
    model: dict[str, Any] = {}
    model["keys"], model["values"] = _lexicon([texts[i] for i in own], labels[own])
    _fit_field(texts, labels, model)
    x = np.concatenate([_summary(words, _marginals(words, model)) for _, words in _parts(texts)])
    model["score"] = _fit_score(x, labels.astype(float))
    return model


def scorer(model: dict[str, Any], spans: bool) -> Callable[[Column], Column]:
    """A column function: struct of ``score`` and, if asked for, the ``spans`` as
    (start, end) in code points."""
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def offending(words: Words, p: np.ndarray, texts: pa.Array) -> list[list[list[int]]]:
        out: list[list[list[int]]] = [[] for _ in range(words.n_docs)]
        hit = np.flatnonzero(p >= SPAN_AT)
        if len(hit):
            # code points before a byte: bytes that do not continue a character
            points = np.zeros(len(words.data) + 1, np.int64)
            np.cumsum((words.data & 0xC0) != 0x80, out=points[1:])
            base = points[words.offsets[words.doc[hit]]]
            for d, s, e in zip(words.doc[hit], points[words.start[hit]] - base, points[words.end[hit]] - base, strict=True):
                out[d].append([int(s), int(e)])
        return out

    @F.arrow_udf("score double, spans array<array<bigint>>")
    def score(texts: pa.Array) -> pa.Array:
        scores, found = [np.zeros(0)], []
        for i, j in slices(texts):
            part = texts.slice(i, j - i)
            if not model:
                scores.append(np.zeros(j - i))
                found += [[]] * (j - i)
                continue
            words = _tokens(part)
            p = _marginals(words, model)
            z = _summary(words, p) @ model["score"]
            scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            found += offending(words, p, part) if spans else [None] * (j - i)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(scores)), pa.array(found, kind.field("spans").type)], fields=list(kind)
        )

    return score


def learn(documents: DataFrame, labels: DataFrame, train: Column | None = None) -> dict[str, Any]:
    """A model from rows that ``train`` allows (by default those outside fold 0),
    at most ``SAMPLE_ROWS`` of them."""
    train = fold(F.col("doc_id"), FOLDS) != 0 if train is None else train
    return fitted(labelled_sample(documents, labels, "toxic", train, SAMPLE_ROWS), fit)


def score_toxicity(documents: DataFrame, model: dict[str, Any]) -> DataFrame:
    """The documents with ``toxic_score`` (0 to 1) and ``toxic_spans`` (start and
    end of offending words, in code points of the lower-cased text).

    Null and empty texts hold no token and get the score of a text without one.
    Columns named like an added one are replaced. An empty table gives no rows.
    """
    kept = without(documents, "toxic_score", "toxic_spans", "_scored")
    scored = kept.withColumn("_scored", scorer(model, True)("text"))
    return scored.withColumns(
        {"toxic_score": F.col("_scored.score"), "toxic_spans": F.col("_scored.spans")}
    ).drop("_scored")
