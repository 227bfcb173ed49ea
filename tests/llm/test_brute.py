"""The operators against brute force, and the models against held-out rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flockscore.llm import (
    components,
    decontam,
    gridjoin,
    langid,
    linededup,
    mixing,
    orderhash,
    pii,
    quality,
    substrings,
    toxicity,
)
from flockscore.llm.tables import fold, table

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, DATA, "documents")


def _texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def _family(seed: int, copies: int, edits: int, words: int = 120) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = base[:]
        for _ in range(edits):
            text[rng.randrange(words)] = f"e{rng.randrange(5000)}"
        out.append(" ".join(text))
    return out


# lines


def test_lines(documents):
    rows = _texts(documents)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for key in linededup.line_keys(text, 10):
            if key:
                holders[key].add(i)
    for r in linededup.dedup_lines(documents).collect():
        text = dict(rows)[r["doc_id"]]
        lines = text.split("\n")
        kept = [
            x
            for x, k in zip(lines, linededup.line_keys(text, 10), strict=True)
            if not k or len(holders[k]) == 1 or min(holders[k]) == r["doc_id"]
        ]
        assert r["text"] == "\n".join(kept) and r["n_dropped"] == len(lines) - len(kept)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in "ab")
    slots, sizes = linededup.perfect_hash(a, b)
    assert sorted(linededup.index_of(slots, sizes, a, b)) == list(range(5000))
    shard = linededup.Shard(**linededup.build_shard(a[:4000], b[:4000], np.ones(4000, int), np.arange(4000)))
    assert (shard.first_doc(a, b)[:4000] == np.arange(4000)).all() and (shard.first_doc(a, b)[4000:] == -1).all()


# substrings


def test_substrings(spark, documents):
    passage = _family(3, 1, 0, 60)[0]
    more = [(900 + i, f"x{i} y {passage} z{i} " + passage * (i == 2), None, None, None) for i in range(4)]
    docs = documents.union(spark.createDataFrame(more, documents.schema))
    rows = _texts(docs)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}
    seen = collections.Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    for r in substrings.remove_repeats(docs).collect():
        own = words[r["doc_id"]]
        gone = set()
        for j in range(len(own) - 34):
            if seen[tuple(own[j : j + 35])] > 1:
                gone |= set(range(j, j + 35))
        assert r["kept_text"] == " ".join(w for j, w in enumerate(own) if j not in gone)
        assert (r["n_words"], r["n_removed"]) == (len(own), len(gone))


def test_hot_passages(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_PASSAGES", 3)
    passage = _family(4, 1, 0, 50)[0]
    rows = [(i, f"a{i} b{i % 3} c {passage} d e{i % 2} f{i}") for i in range(9)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = [t.split() for _, t in rows]
    seen = collections.Counter(tuple(w[j : j + 35]) for w in words for j in range(len(w) - 34))
    for r in out:
        own, gone = words[r["doc_id"]], set()
        for j in range(len(own) - 34):
            if seen[tuple(own[j : j + 35])] > 1:
                gone |= set(range(j, j + 35))
        assert r["n_removed"] == len(gone)


def test_automaton():
    rng = random.Random(2)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(5, 30))] for _ in range(20)]
    texts = [list(t) for t in dict.fromkeys(map(tuple, texts))]
    machine = substrings.Automaton()
    for t in texts:
        machine.add(t, 1)
    machine.count()
    seen = collections.Counter(tuple(t[i : i + 5]) for t in texts for i in range(len(t) - 4))
    for t in texts:
        bits = machine.repeated(t, 5)
        assert [bits >> i & 1 for i in range(len(t) - 4)] == [int(seen[tuple(t[i : i + 5])] > 1) for i in range(len(t) - 4)]


# near duplicates


def _shingles(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates(spark, documents):
    texts = [t for _, t in _texts(documents)]
    for seed, (copies, edits) in enumerate([(2, 1), (30, 1), (12, 2), (6, 0)]):
        texts += _family(seed, copies, edits)
    rows = list(enumerate(texts))
    sets = [_shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if texts[i] == texts[j] or (both and both >= 0.8 * len(sets[i] | sets[j])):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    out = orderhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {i: root(i) for i in range(len(texts))}


def test_bounds_drop_no_pair():
    rng = random.Random(11)
    rows = []
    for _ in range(12):
        base = rng.sample(range(10**6), rng.randrange(20, 400))
        for _ in range(4):
            lost = rng.choice((0.0, 0.04, 0.3))
            kept = [x for x in base if rng.random() >= lost]
            rows.append(np.array(kept + rng.sample(range(10**6, 2 * 10**6), rng.randrange(9)), np.uint32))
    counts = np.stack([orderhash.bins(r) for r in rows])
    lengths, classes = np.array([len(r) for r in rows]), np.arange(len(rows)) // 2
    got = set(zip(*(x.tolist() for x in orderhash.possible_pairs(lengths, counts, classes, 0.8)), strict=True))
    every = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if classes[i] != classes[j]]
    linked = {(i, j) for i, j in every if orderhash.alignment(rows[i], rows[j], 0.8) >= 0.8}
    assert linked and linked <= got and len(got) < len(every) / 4


def test_parts_join_what_their_pairs_join(monkeypatch):
    """Links are fewer than members, and give the classes that all aligned pairs
    of a common part give."""
    monkeypatch.setattr(orderhash, "HELD_BYTES", 1000)
    rng = random.Random(13)
    rows, class_of = [], {}
    for family in range(6):
        base = rng.sample(range(10**6), 150)
        for _ in range(20):
            c, places = len(class_of), sorted(rng.sample(range(4), rng.randrange(1, 4)))
            seq = [x for x in base if rng.random() > 0.08]
            class_of[c] = c - 1 if rng.random() < 0.2 and c else c
            rows.append((c, class_of[c], places, np.array(seq, np.uint32)))
    sent = sorted((p, c, own, places, seq.tobytes()) for c, own, places, seq in rows for p in places)
    names = ["place", "c", "component", "places", "seq"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
        for part in itertools.batched(sent, 33)
    ]
    links = [tuple(r.values()) for out in orderhash.links_within(iter(batches)) for r in out.to_pylist()]
    every = [
        (a[0], b[0])
        for a, b in itertools.combinations(rows, 2)
        if set(a[2]) & set(b[2]) and orderhash.alignment(a[3], b[3], 0.8) >= 0.8
    ]

    def classes(pairs):
        label = {c: class_of[c] for c in class_of}
        for _ in label:
            for a, b in [*pairs, *class_of.items()]:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert classes(links) == classes(every) != classes([])
    assert len(links) < len(sent) < len(every)


def test_one_bucket_of_many_classes(spark):
    """Texts that share a long passage, in pairs of near duplicates: the smallest
    member of their buckets is near none of the others."""
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for pair in range(40):
        own = [f"x{pair}-{i}" for i in range(90)]
        texts += [" ".join(passage + own), " ".join(passage + own + [f"y{pair}-{i}" for i in range(6)])]
    rows = list(enumerate(texts))
    out = orderhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {i: i - i % 2 for i, _ in rows}


def test_large_bucket_of_a_template(spark):
    """Over 1,000 texts of one template, linked only in planted pairs, so that their
    buckets hold several parts."""
    template, texts = " ".join(f"p{i}" for i in range(106)), []
    for pair in range(550):
        both = " ".join(f"x{pair}n{i}" for i in range(6))
        texts += [f"{template} {both} " + " ".join(f"{side}{pair}n{i}" for i in range(12)) for side in "yz"]
    rows = list(enumerate(texts))
    out = orderhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {i: i - i % 2 for i, _ in rows}


def test_alignment_is_the_longest_common_chain():
    rng = random.Random(5)
    for _ in range(200):
        a = rng.sample(range(60), rng.randrange(5, 40))
        b = [x for x in a if rng.random() > 0.1] + rng.sample(range(100, 120), rng.randrange(4))
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        chain = table_[-1][-1]
        exact = chain / (len(a) + len(b) - chain)
        got = orderhash.alignment(np.array(a, np.uint32), np.array(b, np.uint32), 0.8)
        assert got == pytest.approx(exact) if exact >= 0.8 else got < 0.8


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)]
    out = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in out}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: label[n] for n in linked}


# vectors


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(25, 16)) * s for c in centres for s in (0.05, 0.25)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(20)]
    old, gridjoin.BLOCK_VALUES = gridjoin.BLOCK_VALUES, 16 * 40  # several levels of intervals
    try:
        out = gridjoin.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    finally:
        gridjoin.BLOCK_VALUES = old
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in rows])
    label = ids.copy()
    for _ in range(len(ids)):
        low = np.minimum(label, np.where(near, label[None, :], 10**9).min(1))
        if (low == label).all():
            break
        label = low
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label, strict=True)}


# benchmark passages


def test_decontamination(spark):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    items = []
    for item, text in ((r["item_id"], r["text"]) for r in bench.collect()):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        items.append((item, len(words), collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))))
    known = {s for _, _, bag in items for s in bag}
    expected = set()
    for doc, text in _texts(docs):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        hits = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in known]
        for item, size, bag in items:
            for s in {x for h in hits for x in range(max(0, h - size + 5), min(h, len(words) - size) + 1)}:
                own = collections.Counter(tuple(words[i : i + 5]) for i in range(s, s + size - 4))
                if sum((own & bag).values()) >= 0.8 * sum((own | bag).values()):
                    expected.add((doc, item))
    found = decontam.find_leaks(docs, bench).select("doc_id", F.explode("leaks.item_id").alias("i")).collect()
    assert {(r["doc_id"], r["i"]) for r in found} == expected and expected


def test_truncated_items(spark):
    """Documents shorter than the item, against the whole document as its window."""
    item = _family(21, 1, 0, 60)[0].split()
    bag = collections.Counter(tuple(item[i : i + 5]) for i in range(56))
    texts = [item[:57], item[3:], item[2:58], item[:48], item[:47], item[:20], [*item[:30], "x", *item[30:55]], item]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    expected = {}
    for i, words in enumerate(texts):
        own = collections.Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        likeness = sum((own & bag).values()) / sum((own | bag).values())
        if likeness >= 0.8:
            expected[i] = (7, 0, len(words), likeness)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    found = found.selectExpr("doc_id", "inline(leaks)").collect()
    assert {r[0]: tuple(r[1:4]) for r in found} == {i: w[:3] for i, w in expected.items()} and 0 in expected
    assert all(r[4] == pytest.approx(expected[r[0]][3]) for r in found)


def test_item_blocks_give_the_same(spark, monkeypatch):
    docs, bench = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    whole = {(r["doc_id"], str(sorted(map(tuple, r["leaks"])))) for r in decontam.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    parts = {(r["doc_id"], str(sorted(map(tuple, r["leaks"])))) for r in decontam.find_leaks(docs, bench).collect()}
    assert whole == parts


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    known = rng.integers(0, 2**63, 50).astype(np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, False).astype(np.uint64)) for k in range(1, 41)])
    asked = (known[:, None] ^ flips[None, :]).ravel()
    q, k = decontam.MultiIndex(known).near(asked)
    exact = decontam.popcount(asked[:, None] ^ known[None, :]) <= decontam.RADIUS
    assert set(zip(q.tolist(), k.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact)), strict=True))


# personal data


def _base(text):
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, form in forms.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(forms).index(s[0])))


def test_base_spans(documents):
    rng = random.Random(9)
    odd = ["".join(rng.choice("12.@+a -()é") for _ in range(60)) for _ in range(3000)]
    for text in [*odd, *(t for _, t in _texts(documents))]:
        assert pii._told(pii.find(text, {})[0]) == ",".join(f"{k}:{s}:{e}" for k, s, e in _base(text))


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "a" * 200_000 + "@"):
        assert isinstance(pii.find(text, {})[0], list)


def test_added_spans(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = pii.learn(docs)
    text = "jane (at) example (dot) com, call (499) 555-1234 or 10[.]1[.]2[.]3 on page 12 of 2024"
    base, added = pii.find(text, model)
    assert base == [] and {text[s:e] for _, s, e in added} == {"jane (at) example (dot) com", "(499) 555-1234", "10[.]1[.]2[.]3"}
    out = pii.find_personal(docs, model).agg(
        F.sum((F.col("pii_spans") != F.col("pii_base")).cast("int")).alias("added"), F.count("*").alias("n")
    ).first()
    assert out["added"] < 0.005 * out["n"]  # clean documents stay clean


# models


def _accuracy(scored, labels, name, score, held):
    rows = scored.join(labels.where(F.col(name).isNotNull()), "doc_id").where(held)
    return rows.agg(F.avg(((F.col(score) >= 0.5).cast("int") == F.col(name)).cast("int"))).first()[0]


def test_quality_held_out(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    scored = quality.score_quality(docs, quality.learn(docs, labels))
    assert _accuracy(scored, labels, "quality", "quality_score", fold(F.col("doc_id"), 3) == 1) > 0.95


def test_pairwise_identity():
    rng = np.random.default_rng(6)
    model = {"w0": 0.3, "w": rng.normal(size=quality.N_FEATURES), "v": rng.normal(size=(quality.N_FEATURES, quality.FACTORS))}
    feature, value = rng.choice(quality.BUCKETS, 9, False), rng.random(9)
    steps = quality.BUCKETS + np.arange(quality.N_STATS) * (quality.STEPS + 1)
    x = dict(zip(feature, value, strict=True)) | {s: 1.0 for s in steps}
    pairs = sum(model["v"][i] @ model["v"][j] * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    z, _ = quality._z(model, np.zeros(9, int), feature, value, steps[None])
    assert z[0] == pytest.approx(0.3 + sum(model["w"][i] * v for i, v in x.items()) + pairs)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.learn(docs, labels))
    assert _accuracy(scored, labels, "toxic", "toxic_score", fold(F.col("doc_id"), 5) == 0) > 0.93
    spans = scored.where("toxic_score > 0.9").selectExpr("text", "explode(toxic_spans) AS s").collect()
    assert "idiot" in {r["text"][r["s"][0] : r["s"][1]].lower() for r in spans}


def test_forward_backward():
    rng = np.random.default_rng(8)
    rise, cut = rng.random(9) * 3, np.array([1, 0, 0, 1, 0, 0, 0, 1, 1], bool)
    moves = rng.random((2, 2)) + 0.1
    p = toxicity._messages(rise, cut, moves)[0]
    first = [*np.flatnonzero(cut), 9]
    for s, e in zip(first, first[1:], strict=False):
        total, one = 0.0, np.zeros(e - s)
        for y in itertools.product((0, 1), repeat=e - s):
            w = np.prod([rise[s + i] if v else 1 for i, v in enumerate(y)]) * np.prod([moves[a, b] for a, b in zip(y, y[1:], strict=False)])
            total += w
            one += w * np.array(y)
        assert p[s:e] == pytest.approx(one / total)


def test_language_held_out(spark):
    docs = table(spark, SMALL, "documents")
    found = langid.identify(docs, langid.learn(docs)).where((fold(F.col("doc_id"), 4) == 2) & (F.col("lang_pred") != "und"))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_mixture_shares(spark):
    docs = table(spark, SMALL, "documents")
    model = langid.learn(docs)
    pick = {lang: docs.where(F.col("lang") == lang).orderBy(F.length("text").desc()).first()["text"] for lang in ("en", "de")}
    text = pick["en"][:3000] + " " + pick["de"][:3000]
    chosen, share, members = langid.infer(pa.array([text, pick["en"]]), model)
    assert {model["langs"][i] for i in chosen[0, :2]} == {"en", "de"} and members.tolist() == [2, 1]
    assert share[0, :2].min() > 0.35


def test_mixture_of_four(spark):
    docs = table(spark, SMALL, "documents")
    model = langid.learn(docs)
    longest = {x: docs.where(F.col("lang") == x).orderBy(F.length("text").desc()).first()["text"] for x in model["langs"]}
    assert len(longest) == 4
    text = " ".join(t[:2500] for t in longest.values())
    chosen, share, members = langid.infer(pa.array([text, "", longest["en"]]), model)
    assert members.tolist() == [4, 1, 1] and sorted(chosen[0]) == [0, 1, 2, 3]
    assert share[0].min() > 0.15 and share[0].sum() == pytest.approx(1)


# mixing


def _filled(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def test_mix(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").withColumn(
        "source", F.when(F.col("source") != "src3", F.col("source"))
    )
    rows = mixing.mix_plan(docs).collect()
    sizes = collections.Counter()
    for doc in docs.select("source", "text").collect():
        sizes[doc["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", doc["text"]))
    goal, taken = _filled(dict(sizes)), collections.Counter()
    longest = max(r["size"] for r in rows)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= longest for s in goal)
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, rows))


def test_mix_of_documents_agrees_with_the_plan(documents):
    plan = {(r["doc_id"], r["copies"], r["taken"]) for r in mixing.mix_plan(documents).collect()}
    assert plan == {(r["doc_id"], r["copies"], r["taken"]) for r in mixing.mix_documents(documents).collect()}


def test_digest_of_lines(spark):
    from flockscore.llm.queries import op4_line_hash_dedup

    out = op4_line_hash_dedup(spark, DATA).where("n_dropped = 0").limit(5).collect()
    texts = dict(_texts(table(spark, DATA, "documents")))
    assert all(r["kept_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
