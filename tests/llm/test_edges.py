"""Nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flockscore.llm import (
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

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i} of some text" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE, "en", None, None),
    (2, PROSE, "en", None, None),
    (3, "", "en", "a", 0),
    (4, None, None, "b", None),
    (None, "idiot text without id", None, "b", 5),
    (5, "\n\n \t", "fr", "b", 4),
    (6, "x" * 50_000, "en", "a", 50_000),
    (7, (PROSE + "\n") * 30, "en", "a", None),
    (8, "12 — 34 +1", "en", "c", 10),
]
LABELS = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (6, 0, 0), (7, 1, 1), (7, 1, 0), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, " ".join(PROSE.split()[8:48])), (2, None), (None, PROSE), (3, ""), (4, "of some"), (4, "of some")]
    return spark.createDataFrame(items, "item_id long, text string")


def _applied(docs, labels, bench):
    return {
        "langid": lambda d: langid.identify(d, langid.learn(docs)),
        "decontam": lambda d: decontam.find_leaks(d, bench),
        "linededup": linededup.dedup_lines,
        "quality": lambda d: quality.score_quality(d, quality.learn(docs, labels)),
        "pii": lambda d: pii.find_personal(d, pii.learn(docs)),
        "orderhash": orderhash.near_duplicates,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.learn(docs, labels)),
        "mixing": mixing.mix_documents,
        "substrings": substrings.remove_repeats,
    }


NAMES = ["langid", "decontam", "linededup", "quality", "pii", "orderhash", "toxicity", "mixing", "substrings"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_survives_with_its_columns(name, docs, labels, bench):
    wide = docs.withColumns({"keep_me": F.lit(7), "n_lines": F.lit("x"), "kept": F.lit(1), "_k": F.lit(2), "score": F.lit(3)})
    out = _applied(docs, labels, bench)[name](wide)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert len(set(map(str.lower, out.columns))) == len(out.columns)
    assert all(r["keep_me"] == 7 for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, docs, labels, bench):
    assert _applied(docs, labels, bench)[name](docs.limit(0)).collect() == []


def test_models_without_examples(docs, labels, bench):
    none, no_labels = docs.limit(0), labels.limit(0)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(none)).collect()} == {"und"}
    assert {r["toxic_score"] for r in toxicity.score_toxicity(docs, toxicity.learn(docs, no_labels)).collect()} == {0.0}
    scores = {r["quality_score"] for r in quality.score_quality(docs, quality.learn(docs, no_labels)).collect()}
    assert scores == {0.5}
    assert {r["pii_spans"] for r in pii.find_personal(docs, pii.learn(none)).collect()} == {""}
    assert all(not r["leaks"] for r in decontam.find_leaks(docs, bench.limit(0)).collect())


def test_defined_results(docs, labels, bench):
    def by_id(df):
        return {r["doc_id"]: r for r in df.collect()}

    lang = by_id(langid.identify(docs, langid.learn(docs)))
    assert [lang[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4
    lines = by_id(linededup.dedup_lines(docs))
    assert (lines[3]["n_lines"], lines[4]["n_lines"], lines[4]["text"]) == (1, 1, None)
    assert (lines[1]["n_dropped"], lines[2]["n_dropped"], lines[7]["n_dropped"]) == (0, 1, 30)
    near = by_id(orderhash.near_duplicates(docs))
    assert near[2]["class_id"] == 1 and not near[2]["kept"]
    assert near[4]["class_id"] == 4 and near[4]["kept"]
    assert near[5]["class_id"] == 3  # no word in either
    leaks = by_id(decontam.find_leaks(docs, bench))
    assert {w["item_id"] for w in leaks[1]["leaks"]} == {1, 4}
    assert leaks[4]["leaks"] == [] and leaks[6]["leaks"] == []
    cut = by_id(substrings.remove_repeats(docs))
    assert cut[1]["n_removed"] == cut[1]["n_words"] == 240 and cut[4]["n_words"] == 0
    assert cut[6]["n_removed"] == 0 and cut[7]["kept_text"] == ""


def test_repeated_rows_share_a_rounding(spark):
    rows = [(1, "a b c", "s", None, None)] * 5 + [(2, "a b c", "t", None, None)] * 5
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"))
    taken = plan.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect()
    assert all(abs(r["n"] - r["target"]) < 3 for r in taken)


VECTORS = [
    (1, [1.0, 0.0]),
    (2, [2.0, 0.0]),
    (2, [2.0, 0.0]),
    (3, [0.0, 0.0]),
    (4, None),
    (5, [float("nan"), 1.0]),
    (6, [None, 1.0]),
    (7, []),
    (8, [1.0, 0.0, 0.0]),
    (None, [1.0, 0.01]),
    (9, [float("inf"), 0.0]),
]


def test_odd_vectors(spark):
    out = gridjoin.link_vectors(spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")).collect()
    assert len(out) == len(VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[None] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))


def test_no_vectors(spark):
    assert gridjoin.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_pipeline_stages(spark, docs, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing = {c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in ("toxic_score", "kept", "Class_id", "leaks", "_k")}
    for table in (docs.withColumns(clashing), docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == table.columns
            assert kept.count() <= table.count()
        for r in kept.where("doc_id is not null").collect():
            assert all(r[c] == f"{c} of {r['doc_id']}" for c in clashing if c in table.columns)
        mixed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert {"doc_id", "size", "target", "taken"} <= set(mixed.columns)
        assert mixed.count() == kept.count()
