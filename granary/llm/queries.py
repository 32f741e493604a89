"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import documents, fold_of


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import langid

    docs = documents(spark, sf_dir)
    fold = fold_of("doc_id", 5)
    return langid.predict(docs, langid.train(docs.where(fold != 0)), fold == 0)


def op3_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.lm_score import learn_and_score

    return learn_and_score(documents(spark, sf_dir), fold_of("doc_id", 7) == 2)


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import toxicity

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = fold_of("doc_id", 4)
    return toxicity.score(docs, toxicity.train(docs.where(fold != 2), labels.where(fold != 2)), fold == 2)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.license_scan import scan

    return scan(documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.media import media_columns

    return media_columns(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.exact_dedup import duplicate_groups

    return duplicate_groups(documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.url_filter import rules_frame, url_verdicts

    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixing import mix

    return mix(documents(spark, sf_dir))


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


_EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

_URL_FILTER_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a),
r(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT b.page_id, b.host, b.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY b.page_id, b.host, b.path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM b LEFT JOIN r ON (b.host = r.rule_host OR ends_with(b.host, '.' || r.rule_host)) AND starts_with(b.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _EXACT_DEDUP_SQL, "op6_url_filter": _URL_FILTER_SQL}
