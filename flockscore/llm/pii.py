"""Personal data by candidate gradient boosting.

Generators propose spans with high recall: every base match, whether it passes
its check or not, and looser forms of the same kinds (written-out or bracketed
e-mail addresses, bracketed addresses of hosts, other card separators, national
phone numbers). Boosted trees score each candidate by its format and context. A
threshold for each kind, calibrated on examples that were not fitted, selects the
spans that are added to the base spans. Base spans always stay.

There are no marked examples, so the corpus gives them: base matches that pass
their check, and the same matches rewritten in the looser forms, are positive;
matches that fail, and matches spoilt on purpose (digits changed, parts out of
range, shortened), are negative, each in the context it stands in. They are taken from
at most ``SAMPLE_ROWS`` matches of the whole corpus, smallest hashes first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import without

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 4000
CONTEXT = 40  # code points before a candidate
PRECISION = 0.97  # that the threshold of a kind reaches on held-back examples
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 16

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

_AT = r"(?:\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)"
_LOOSE = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}"), ("at]", "at)", "at}", "AT]", "AT)", "@]", "@)", " dot ", " DOT ")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]{1,3}){3}(?![0-9])"), ("[.]", "(.)", "[dot]", "(dot)")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){2,3}(?:[ ./_-]{1,3}[0-9]{1,3})?(?![0-9])"), ()),
    ("phone", re.compile(r"(?<![0-9.+-])(?:00[1-9][0-9]{0,2}[ .-]?|1[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])"), ()),
)
_HINTS = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "from", "to"),
    "card": ("card", "visa", "credit", "debit", "pay"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "contact"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in one pass: each @ with the run before it, which starts
    after the match before, and the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            last = at + 1  # no match holds this @, and no run crosses it
            at = text.find("@", at + 1)


def valid(kind: str, body: str) -> bool:
    digits = _digits(body)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in body.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it passes) of the base forms, without retries."""
    for start, end in _emails(text):
        yield "email", start, end, True
    for kind, form in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in form.finditer(text):
            yield kind, m.start(), m.end(), valid(kind, m[0])


def loose(text: str) -> Iterator[tuple[str, int, int]]:
    for kind, form, marks in _LOOSE:
        if not marks or any(m in text for m in marks):
            for m in form.finditer(text):
                yield kind, m.start(), m.end()


def features(kind: str, before: str, body: str, after: str) -> list[float]:
    """Format and context of a candidate."""
    digits, n = _digits(body), max(len(body), 1)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    parts = [int(g[:6]) for g in re.findall(r"[0-9]+", body)[:8]]
    separators = re.sub(r"[A-Za-z0-9]", "", body)
    lowered = body.lower()
    words = set(re.findall(r"[a-z]+", before.lower())[-5:])
    return [
        float(KINDS.index(kind)),
        len(digits),
        len(digits) / n,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        max(parts, default=0),
        float(luhn(digits)) if digits else -1.0,
        len(separators),
        len(set(separators)),
        float("+" in body),
        float("(" in body and ")" in body),
        float("@" in body),
        float(" at " in lowered or "at]" in lowered or "at)" in lowered or "at}" in lowered),
        float(bool(re.search(r"dot", lowered)) or "." in body),
        float(len(re.split(r"[^a-z]+", lowered)[-1])),
        float(any(h in w for w in words for h in _HINTS[kind])),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(len(set(digits))),
        float(n),
    ]


def _rewritten(kind: str, body: str) -> list[tuple[str, int]]:
    """Looser forms of a good match (1), and spoilt ones (0)."""
    if kind == "email":
        name, _, domain = body.partition("@")
        head, _, tail = domain.rpartition(".")
        return [
            (f"{name} [at] {domain}", 1), (f"{name}(at){domain}", 1), (f"{name} at {head} dot {tail}", 1),
            (f"{name} [at] {head} [dot] {tail}", 1), (f"{name} at {head}", 0), (f"{name} at 1.{len(name)}", 0),
        ]
    if kind == "ip":
        p = body.split(".")
        return [("[.]".join(p), 1), ("(.)".join(p), 1), ("[.]".join([p[0], "999", *p[2:]]), 0), (".".join([p[0], "640", *p[2:]]), 0), (".".join(["4111", *p[1:]]), 0), (".".join(x * 2 + "7" for x in p), 0)]
    if kind == "card":
        d = _digits(body)
        wrong = d[:-1] + str((int(d[-1]) + 5) % 10)
        four = lambda s, x: s.join(x[i : i + 4] for i in range(0, len(x), 4))
        return [(four(".", d), 1), (four("  ", d), 1), (four("/", d), 1), (four(".", wrong), 0), (four("  ", wrong), 0), (wrong, 0)]
    d = _digits(body)
    area, mid, end = d[-10:-7], d[-7:-4], d[-4:]
    return [
        (f"({area}) {mid}-{end}", 1), (f"{area}-{mid}-{end}", 1), (f"{area}.{mid}.{end}", 1), (f"001-{area}-{mid}-{end}", 1),
        (f"{mid}-{end}", 0), (f"{area}.{mid}", 0), (f"{d[:4]} {d[4:8]}", 0),
    ]


def examples(rows: list[tuple[str, str, str, str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of matches (kind, before, body, after, passes)."""
    x, y, kinds = [], [], []
    for kind, before, body, after, good in rows:
        for form, label in [(body, int(good)), *(_rewritten(kind, body) if good else ())]:
            x.append(features(kind, before, form, after))
            y.append(label)
            kinds.append(KINDS.index(kind))
        if good:  # the same inside a longer word
            x.append(features(kind, before + "x", body, "x"))
            y.append(0)
            kinds.append(KINDS.index(kind))
    return np.array(x, float).reshape(len(x), -1), np.array(y, float), np.array(kinds)


def _grow(x: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray, depth: int) -> list:
    """A tree as nested [feature, cut, low, high], leaves as steps of the log odds."""
    best = (1e-6, None)
    all_s, all_b = slope.sum(), bend.sum()
    if depth and len(x) >= 10:
        base = all_s**2 / (all_b + 1)
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            at = np.searchsorted(own, x[:, j], "left")
            s = np.cumsum(np.bincount(at, slope, len(own) + 1))[:-1]
            b = np.cumsum(np.bincount(at, bend, len(own) + 1))[:-1]
            gain = s**2 / (b + 1) + (all_s - s) ** 2 / (all_b - b + 1) - base
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, own[k]))
    if best[1] is None:
        return [float(RATE * all_s / (all_b + 1))]
    j, cut = best[1]
    low = x[:, j] <= cut
    return [j, float(cut), _grow(x[low], cuts, slope[low], bend[low], depth - 1), _grow(x[~low], cuts, slope[~low], bend[~low], depth - 1)]


def _tree(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _tree(tree[2], x), _tree(tree[3], x))


def boosted(model: dict[str, Any], x: np.ndarray) -> np.ndarray:
    z = model["base"] + sum((_tree(t, x) for t in model["trees"]), np.zeros(len(x)))
    return 1 / (1 + np.exp(-z))


def fit(rows: list[tuple[str, str, str, str, bool]]) -> dict[str, Any]:
    """Trees and thresholds; without examples of both labels nothing is added."""
    if not rows:
        return {}
    x, y, kinds = examples(rows)
    if len(set(y)) < 2:
        return {}
    hold = np.array([xxhash.xxh32_intdigest(r.tobytes()) % 4 == 0 for r in x])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[:-1])) for c in x.T]
    rate = np.clip(y[~hold].mean(), 0.01, 0.99)
    model: dict[str, Any] = {"base": float(np.log(rate / (1 - rate))), "trees": [], "least": {}}
    z = np.full((~hold).sum(), model["base"])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x[~hold], cuts, y[~hold] - p, p * (1 - p), DEPTH)
        model["trees"].append(tree)
        z += _tree(tree, x[~hold])
    p = boosted(model, x[hold])
    for k, kind in enumerate(KINDS):
        own, good = p[kinds[hold] == k], y[hold][kinds[hold] == k]
        for least in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99):
            taken = own >= least
            if taken.any() and good[taken].mean() >= PRECISION:
                model["least"][kind] = least
                break
    return model


def find(text: str | None, model: dict[str, Any]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and the added ones: candidates that reach their kind's
    threshold, best first, that overlap no base span and no better one."""
    text = text or ""
    base, spare = [], []
    for kind, start, end, good in matches(text):
        (base if good else spare).append((kind, start, end))
    if not model:
        return base, []
    taken = sorted((s, e) for _, s, e in base)
    spare += loose(text)
    spare = [c for c in dict.fromkeys(spare) if c[0] in model["least"]]
    if not spare:
        return base, []
    x = np.array(
        [features(k, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + 1]) for k, s, e in spare], float
    )
    p = boosted(model, x)
    added: list[tuple[str, int, int]] = []
    for i in sorted(range(len(spare)), key=lambda i: (-p[i], spare[i][1], KINDS.index(spare[i][0]))):
        kind, start, end = spare[i]
        if p[i] < model["least"][kind]:
            break
        at = int(np.searchsorted([s for s, _ in taken], end))
        if not any(e > start for _, e in taken[max(0, at - 4) : at]):
            added.append((kind, start, end))
            taken.append((start, end))
            taken.sort()
    return base, added


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h", "kind", "before", "body", "after", "good"]
    schema = pa.schema([("h", pa.int64()), *[(n, pa.string()) for n in names[1:5]], ("good", pa.bool_())])
    for batch in batches:
        rows = []
        for text in batch.column(0):
            text = text.as_py() or ""
            for kind, s, e, good in matches(text):
                if e - s <= 200 and not (kind == "card" and e - s < 8):
                    before = text[max(0, s - CONTEXT) : s]
                    h = xxhash.xxh64_intdigest(f"{kind}\0{before}\0{text[s:e]}") >> 1
                    rows.append(dict(zip(names, (h, kind, before, text[s:e], text[e : e + 1], good), strict=True)))
        yield pa.RecordBatch.from_pylist(rows, schema)


def learn(documents: DataFrame) -> dict[str, Any]:
    """A model from at most ``SAMPLE_ROWS`` different matches of all documents."""
    rows = (
        documents.select("text")
        .mapInArrow(_sampled, "h long, kind string, before string, body string, after string, good boolean")
        .groupBy("h")
        .agg(*[F.min(c).alias(c) for c in ("kind", "before", "body", "after", "good")])
        .orderBy("h")
        .limit(SAMPLE_ROWS)
        .collect()
    )
    return fit([(r["kind"], r["before"], r["body"], r["after"], r["good"]) for r in rows])


def finder(model: dict[str, Any]) -> Callable[[Column], Column]:
    kind = pa.struct([("base", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])

    @F.arrow_udf("base string, spans string, redacted string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            text = text.as_py()
            base, added = find(text, model)
            parts, last = [], 0
            for k, s, e in sorted([*base, *added], key=lambda x: (x[1], x[2])) if text else ():
                if e > last:
                    parts += [text[last : max(s, last)], f"<{k}>" if s >= last else ""]
                    last = e
            redacted = None if text is None else "".join([*parts, text[last:]])
            out.append({"base": _told(base), "spans": _told([*base, *added]), "redacted": redacted})
        return pa.array(out, kind)

    return run


def find_personal(documents: DataFrame, model: dict[str, Any]) -> DataFrame:
    """The documents with ``pii_base`` and ``pii_spans`` (``kind:start:end`` by
    start and kind, comma-joined, in code points) and ``redacted``, the text with
    each span replaced by its kind.

    Null and empty texts have no span; a null text stays null. Columns named like
    an added one are replaced. An empty table gives no rows.
    """
    kept = without(documents, "pii_base", "pii_spans", "redacted", "_found")
    found = kept.withColumn("_found", finder(model)("text"))
    return found.withColumns(
        {"pii_base": F.col("_found.base"), "pii_spans": F.col("_found.spans"), "redacted": F.col("_found.redacted")}
    ).drop("_found")
