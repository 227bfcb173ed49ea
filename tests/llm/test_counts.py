"""The operators that count pieces, phrases and filters, against brute force."""

from __future__ import annotations

import collections
import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flockscore.llm import audit, collocations, pieces
from flockscore.llm.queries import piece_model
from flockscore.llm.tables import table

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, ids string, _e int, `part` string"
ODD = ["", " ", "  ", "a ", "▁", "a▁ b", "</s> <unk>", "x\x00y", "日本 語", "\n\t\n", "é  é", "�", "a" * 100_000]


def odd_rows(texts: list[str | None]) -> list[tuple]:
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "", "b"][i % 3], "clash", 1, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[-1], (None, "a text without id", "en", "b", None, None, None), (500, None, None, None, "x", 2, "y")]


def frame(spark, texts):
    return spark.createDataFrame(odd_rows(texts), DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def model():
    return piece_model()


# pieces


def library(model, texts):
    processor = pieces.load(model)
    ids = processor.encode([t or "" for t in texts], add_eos=True)
    return list(zip(ids, processor.decode(ids), strict=True))


def test_pieces_equal_the_library(documents, model):
    found = pieces.encode_documents(documents, model).select("text", "ids", "decoded").collect()
    assert len(found) == documents.count()
    assert [(r["ids"], r["decoded"]) for r in found] == library(model, [r["text"] for r in found])


def test_pieces_of_odd_texts(spark, model):
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "▁", "é", "\n", "日本", "x\x00", "😀", "<s>", "<0x0A>", "　", "word"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(300)]
    df = frame(spark, [*ODD, *mixed])
    found = pieces.encode_documents(df, model)
    assert set(found.columns) == {*df.columns, "decoded"} - {"_e"}
    rows = found.select("text", "ids", "decoded").collect()
    assert len(rows) == len(ODD) + 304
    assert [(r["ids"], r["decoded"]) for r in rows] == library(model, [r["text"] for r in rows])


def test_pieces_beyond_a_slice(spark, model, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE_BYTES", 1000)
    texts = ["word and more " * 500, "short", "", "x" * 5000]
    rows = pieces.encode_documents(frame(spark, texts), model).select("text", "ids", "decoded").collect()
    assert [(r["ids"], r["decoded"]) for r in rows] == library(model, [r["text"] for r in rows])


def test_pieces_of_no_text(spark, model):
    assert pieces.encode_documents(frame(spark, ["a"]).limit(0), model).count() == 0
    rows = pieces.encode_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), model).collect()
    assert [(r["ids"], r["decoded"]) for r in rows] == [([pieces.load(model).eos_id()], "")]


def test_crossing_pieces_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.pieces[-1].piece = "a▁b"
    with pytest.raises(ValueError, match="crosses"):
        pieces.check_model(proto.SerializeToString())


# phrases


def brute_phrases(rows, least, shadow, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\f\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for d in (1, 2, 3):
                f[lang].update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        hidden = {h for g, a in candidates.items() if len(g) == 3 for h in (g[:2], g[1:]) if 100 * a >= shadow * counts[h]}
        scored = []
        for g, a in candidates.items():
            if g not in hidden:
                cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrases(df):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in names) for r in collocations.collocations(df).collect())


def test_phrases(documents):
    rows = [(r["text"], r["lang"]) for r in documents.select("text", "lang").collect()]
    found = phrases(documents)
    assert found == brute_phrases(rows, 10, 50, 2000) and len(found) > 100


@pytest.mark.parametrize("heavy", [1 / 10, 1 / 200])
def test_phrases_of_extended_prefixes(spark, monkeypatch, heavy):
    """A word and a pair that hold a third of all suffixes, ties, several groups."""
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    monkeypatch.setattr(collocations, "GROUP_ROWS", 500)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 3000)
    monkeypatch.setattr(collocations, "TOP", 40)
    rng = random.Random(3)
    words = ["Hot", "pair", "a", "a\x01", "b", "É", "x\x00", *(f"w{i}" for i in range(30))]
    texts = []
    for _ in range(300):
        text = [rng.choice(["Hot pair", rng.choice(words)]) + rng.choice([" ", "  ", "\t", ", ", "\n", "\r. "]) for _ in range(30)]
        texts.append("".join(text))
    df = frame(spark, [*ODD, *texts, texts[0]]).repartition(3)
    rows = [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]
    assert phrases(df) == brute_phrases(rows, 10, 50, 40)


def test_phrases_of_no_text(spark):
    assert phrases(frame(spark, ["a"]).limit(0)) == []
    assert phrases(spark.createDataFrame([(None, None), ("", "en"), (" ,. ", "en")], "text string, lang string")) == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts as large as a corpus gives them, put in place of the counted ones."""
    big = 3_000_000_000_000
    nodes = [("en", "a\t", 1, big + 1), ("en", "b\t", 1, big + 3), ("en", "a\tb\t", 2, big)]
    sizes = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    nodes = spark.createDataFrame(nodes, "lang string, prefix string, depth int, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda _: (sizes, nodes))
    score = 1_000_000 * big * big // ((big + 1) * (big + 3))
    assert phrases(sizes) == [("en", 1, "a b", big, big + 1, big + 3, 9 * big, score)]


# filters


def brute_audit(rows, labels):
    quality, toxic = collections.defaultdict(int), collections.defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            quality[i], toxic[i] = max(quality[i], q or 0), max(toxic[i], t or 0)
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    judged = collections.defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^ \t-\r]+", text)
        failed = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            i is not None and i > first[text],
        ]
        judged[source or ""].append((dict(zip("ABCDE", failed, strict=True)), i is not None and quality[i] == 1, i is not None and toxic[i] == 1))
    out = []
    for part, documents in judged.items():
        shapley, found = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = documents
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                failing = [d for d in documents if d[0][x]]
                shapley[x] += len(gone)
                alone = sum(sum(d[0].values()) == 1 for d in failing)
                lost = (sum(d[1] for d in gone), sum(d[2] for d in gone))
                found.append((x, (part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), alone, *lost)))
        out += [(*row, shapley[x]) for x, row in found]
    return sorted(out)


def audited(df, labels):
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r[c] for c in names) for r in audit.audit_filters(df, labels).collect())


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_audit(spark, documents):
    labels = table(spark, DATA, "labels")
    known = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert audited(documents, labels) == brute_audit(_rows(documents), known)


def test_audit_of_odd_rows(spark, monkeypatch):
    """A small table, so that most words are joined; copies, nulls, clashing columns."""
    monkeypatch.setattr(audit, "TABLE_ROWS", 3)
    monkeypatch.setattr(audit, "SLICE_BYTES", 500)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(150)}" for _ in range(rng.choice([5, 199, 200, 400]))) for _ in range(40)]
    texts += ["A" * 3 + "b" * 97, "A" * 2 + "b" * 98, "same " * 200, " ".join(f"w{i}" for i in range(100)) * 2, "100 % * done"]
    df = frame(spark, [*ODD, *texts, *texts[:7], "\U0001f600 A"])
    labels = [(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (999, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert audited(df, given) == brute_audit(_rows(df), labels)
    assert audited(df.limit(0), given) == [] and len(audited(df, given.limit(0))) == 2 * 600


def test_csr():
    shard = audit.Csr(pa.array([5, 2, 5, 2]).to_numpy(), pa.array([9, 1, 3, 4]).to_numpy(), pa.array([2, 1, 4, 1]).to_numpy())
    assert shard.rows.tolist() == [2, 5] and shard.indptr.tolist() == [0, 2, 4] and shard.indices.tolist() == [1, 4, 3, 9]
    assert shard.row_sums().tolist() == [2, 6] and shard.nonzeros().tolist() == [2, 2]
