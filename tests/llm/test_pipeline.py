"""The pipeline's rows against each stage's rule, applied by brute force to what the
stage before has kept."""

from __future__ import annotations

import collections
import itertools
import random
import re

import pytest

import corpus_pipeline
from flockscore.llm import toxicity
from flockscore.llm.tables import table

DATA = "/root/testdata/sf0.001"
TOXIC = 60
SPACE = " \t\n\x0b\f\r"


def _words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def _shingles(words):
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _alike(a, b):
    both = sum((a & b).values())
    return both > 0 and both >= 0.8 * sum((a | b).values())


def without_repeated_lines(docs):
    """{id: text} without lines that a smaller id holds."""
    keys = {i: [x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)}) for x in t.split("\n")] for i, t in docs.items()}
    first = {}
    for i in sorted(docs):
        for key in keys[i]:
            first.setdefault(key, i)
    return {
        i: "\n".join(x for x, k in zip(t.split("\n"), keys[i], strict=True) if len(k) < 10 or first[k] == i)
        for i, t in docs.items()
    }


def first_of_groups(docs):
    """Ids that no smaller id's text is near, through links of any length."""
    label, bags = {i: i for i in docs}, {i: _shingles(_words(t)) for i, t in docs.items()}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(sorted(docs), 2):
        if _words(docs[i]) == _words(docs[j]) or _alike(bags[i], bags[j]):
            low, high = sorted((root(i), root(j)))
            label[high] = low
    return {i for i in docs if root(i) == i}


def holds_item(text, items):
    words = _words(text)
    for item in items:
        bag = _shingles(item)
        for at in range(max(1, len(words) - len(item) + 1)):
            if _alike(_shingles(words[at : at + len(item)]), bag):
                return True
    return False


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """The small tables, with copies, a shared passage and benchmark items added."""
    rng, path = random.Random(17), str(tmp_path_factory.mktemp("corpus"))
    rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r["text"] for r in table(spark, DATA, "benchmark").collect()][:6]
    more = []
    for n in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(130)]
        near = words[:]
        near[rng.randrange(130)] = "other"
        more += [" ".join(words), " ".join(near), f"head {n} line\na line that many documents hold\n" + " ".join(words[::-1])]
        more.append(" ".join(words[40:90]) + " " + items[n % len(items)] + " " + " ".join(words[:30]))
    for n in range(TOXIC):
        words = [f"w{rng.randrange(3000)}" for _ in range(40)] + [f"vile{rng.randrange(4)}" for _ in range(8)]
        rng.shuffle(words)
        rows.append((200_000 + n, " ".join(words), "en", "src1", 300))
    rows += [(100_000 + i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(more)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(
        f"{path}/documents.parquet"
    )
    table(spark, DATA, "benchmark").write.parquet(f"{path}/benchmark.parquet")
    table(spark, DATA, "labels").select("doc_id", "quality", "toxic").unionByName(
        spark.createDataFrame([(200_000 + i, 0, 1) for i in range(TOXIC)], "doc_id long, quality int, toxic int")
    ).write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_equals_its_rules(spark, given):
    docs = table(spark, given, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, given, "labels")))
    kept = {r["doc_id"]: r["text"] for r in scored.where("toxic_score < 0.5").collect()}
    assert len(kept) < docs.count()
    kept = without_repeated_lines(kept)
    groups = first_of_groups(kept)
    items = [_words(r["text"]) for r in table(spark, given, "benchmark").collect()]
    clean = {i: kept[i] for i in groups if not holds_item(kept[i], items)}
    assert len(clean) < len(groups) < len(kept)
    found = corpus_pipeline.run(spark, given).collect()
    assert {r["doc_id"]: r["text"] for r in found} == clean
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in clean.items()}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in found)
    # 150 % of all words are taken, but for what one document rounds away per source
    sources = {r["source"] for r in found}
    total = sum(r["taken"] for r in found)
    assert abs(total - sum({r["source"]: r["target"] for r in found}.values())) <= len(sources) * max(size.values())
