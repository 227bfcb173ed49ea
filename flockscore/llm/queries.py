"""The registered queries of the operators, and their SQL where SQL can
express them. Each runs over its whole table with the default parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    audit,
    collocations,
    decontam,
    gridjoin,
    langid,
    linededup,
    mixing,
    orderhash,
    pieces,
    pii,
    quality,
    substrings,
    toxicity,
)
from .tables import fold, table


def _held_out(folds: int, number: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), folds) == number, F.lit(False)).alias("held_out")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(documents, langid.learn(documents))
    return found.select(
        "doc_id", _held_out(langid.FOLDS, 2), "lang_pred", F.col("lang_share").alias("score"), "lang_mixture"
    )


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids"),
        "leaks",
    )


def op3_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op5_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.learn(documents, table(spark, sf_dir, "labels"))
    found = quality.score_quality(documents, model)
    score = F.col("quality_score")
    return found.select(
        "doc_id", _held_out(quality.FOLDS, 1), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op6_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal(documents, pii.learn(documents))
    kinds = F.transform(F.split("pii_base", ","), lambda s: F.split(s, ":")[0])

    def count(kind: str) -> Column:
        return F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2("pii_base", 256).alias("base_sha256"), F.col("pii_spans").alias("spans")
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return orderhash.near_duplicates(documents).select("doc_id", "class_id", "kept")


def op8_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    found = toxicity.score_toxicity(documents, model)
    score = F.col("toxic_score")
    return found.select(
        "doc_id",
        _held_out(toxicity.FOLDS, 0),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_spans").alias("spans"),
    )


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def piece_model() -> bytes:
    """The vocabulary that op11 uses, read once by the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def op11_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode_documents(documents, piece_model())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_matrix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit_filters(documents, table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_mixture,
        op2_simhash_decontamination,
        op3_grid_order_join,
        op4_line_hash_dedup,
        op5_factorisation_machine,
        op6_candidate_boosting,
        op7_order_minhash,
        op8_toxic_spans,
        op9_pivotal_mixing,
        op10_suffix_automata,
        op11_distinct_chunks,
        op12_suffix_collocations,
        op13_matrix_audit,
    )
}

_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM embeddings JOIN part ON a = vec_id
"""

_LINES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), k AS (
  SELECT doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT doc_id, n, line, r.key IS NOT NULL AND doc_id <> lo AS dropped FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_REPEATS = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35
), t AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS win FROM s
), again AS (
  SELECT win FROM t GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM t WHERE win IN (SELECT win FROM again)
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
         string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE gone.i IS NULL) AS text
  FROM each e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i GROUP BY e.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), places AS (
  SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM w
), grams AS (
  SELECT lang, d, array_to_string(list_slice(words, i, i + d - 1), ' ') AS g
  FROM (SELECT *, unnest([1, 2, 3]) AS d FROM places) WHERE i + d - 1 <= len(words)
), f AS (
  SELECT lang, g, d, count(*) AS n FROM grams GROUP BY ALL
), size AS (
  SELECT lang, sum(n) AS n FROM f WHERE d = 1 GROUP BY lang
), cand AS (
  SELECT lang, g, d, n AS a, string_split(g, ' ') AS w FROM f WHERE d > 1 AND n >= 10
), part AS (
  SELECT *, array_to_string(list_slice(w, 1, k), ' ') AS g1, array_to_string(list_slice(w, k + 1, d), ' ') AS g2
  FROM (SELECT *, unnest(generate_series(1, d - 1)) AS k FROM cand)
), cut AS (
  SELECT p.lang, p.g, p.a, p.k, x.n AS l, y.n AS r,
         (1000000::HUGEINT * p.a * p.a) // (x.n::HUGEINT * y.n) AS score
  FROM part p JOIN f x ON x.lang = p.lang AND x.g = p.g1 JOIN f y ON y.lang = p.lang AND y.g = p.g2
), weakest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, g, max(a) AS a FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS g, a FROM cand WHERE d = 3) GROUP BY lang, g
), shown AS (
  SELECT w.lang, w.g AS phrase, w.a, w.l, w.r, w.score
  FROM weakest w LEFT JOIN longer x ON x.lang = w.lang AND x.g = w.g
  WHERE x.a IS NULL OR 100 * x.a < 50 * w.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM shown
)
SELECT lang, rank, phrase, a, l, r, cast(size.n AS BIGINT) AS n, cast(score AS BIGINT) AS score
FROM ranked JOIN size USING (lang) WHERE rank <= 2000
"""

_AUDIT = """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), first AS (
  SELECT text, min(doc_id) AS lo FROM w GROUP BY text
), judged AS (
  SELECT part, doc_id, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text),
    regexp_matches(w.text, '[#$%&*|]'),
    coalesce(doc_id > lo, false)
  ] AS fails FROM w JOIN first USING (text)
), known AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, count(*) AS n
  FROM judged LEFT JOIN known USING (doc_id) GROUP BY ALL
), f AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), cases AS (
  SELECT part, o, step, o[step] AS filter, n, good, bad, fails[o[step]] AS hit,
         len(list_filter(list_slice(o, 1, step - 1), lambda x: fails[x])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS n_fails
  FROM masks, steps
), counted AS (
  SELECT part, o, step, filter,
         sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
         sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (hit AND n_fails = 1) AS unique_fails,
         sum(n) FILTER (hit AND NOT gone AND good) AS good_lost, sum(n) FILTER (hit AND NOT gone AND bad) AS toxic_lost
  FROM cases GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: substring('ABCDE', x, 1)), '') AS filter_order,
       cast(step AS INTEGER) AS step,
       cast(coalesce(kept, 0) AS BIGINT) AS kept, cast(coalesce(removed, 0) AS BIGINT) AS removed,
       cast(coalesce(redundant, 0) AS BIGINT) AS redundant, cast(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       cast(coalesce(good_lost, 0) AS BIGINT) AS good_lost, cast(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       cast(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""

ORACLES = {
    "op3_grid_order_join": _LINKS,
    "op4_line_hash_dedup": _LINES,
    "op10_suffix_automata": _REPEATS,
    "op12_suffix_collocations": _PHRASES,
    "op13_matrix_audit": _AUDIT,
}
