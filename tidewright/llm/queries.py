"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clustering, conversation_repair, decontaminate, expected_sql, html_text, language_id, license_scan, lm_score, packing, quality_rules, secret_scan, simhash_dedup, source_mixing, token_count
from .common import fold, table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(docs["doc_id"], 4) == 2
    return language_id.identify(docs, language_id.train(docs.where(~held_out)), held_out)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.find_licenses(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.outliers(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.link_components(table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.digest(*centroid_clustering.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.digest(*source_mixing.mix(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


OPERATORS = (
    op1_language_id, op2_html_text, op3_secret_scan, op4_license_scan, op5_quality_rules, op6_decontamination, op7_simhash_dedup, op8_packing, op9_lm_score, op10_token_count,
    op11_centroid_clustering, op12_source_mixing, op13_conversation_repair,
)
QUERIES = {f.__name__: f for f in OPERATORS}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op11_centroid_clustering": expected_sql.clustering(),
    "op12_source_mixing": expected_sql.mixing(),
    "op13_conversation_repair": expected_sql.repair(),
    "op6_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT rid, i, g.k, item_id FROM grams g JOIN windows USING (k, gram)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
who AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN who USING (rid)
""",
}
