"""The queries ``opN_...`` of this subpackage, with production parameters over
whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treesift.llm.common import read, tokenizer_file


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.pii import pii_report

    return pii_report(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.html_text import page_report

    return page_report(read(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.decontaminate import decontamination_report

    return decontamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.quality import quality_report

    return quality_report(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.token_files import token_file_report

    return token_file_report(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.unigram_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.secrets import secret_report

    return secret_report(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm import url_filter

    return url_filter.url_report(read(spark, sf_dir, "pages"), url_filter.publish(url_filter.entries(spark)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.mixing import mix_report

    return mix_report(read(spark, sf_dir, "documents"))


def op11_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.line_field import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.spelling import variant_groups, word_counts

    return variant_groups(word_counts(read(spark, sf_dir, "documents"), planted=True))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treesift.llm.periodic_runs import run_report

    return run_report(read(spark, sf_dir, "documents"))


OP9_SQL = """
WITH parts AS (
  SELECT page_id, coalesce(instr(url, '://'), 0) AS sep, substr(url, instr(url, '://') + 3) AS rest FROM pages
), hosts AS (
  SELECT page_id, CASE WHEN sep > 0 THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS raw_host, sep, rest FROM parts
), named AS (
  SELECT page_id,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN sep > 0 THEN regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') ELSE '' END AS path
  FROM hosts
), entries(entry, host_part, path_part, kind) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
  UNION ALL
  SELECT name || '.example.' || top || '/', name || '.example.' || top, '/', 'listed'
  FROM unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) n(name), unnest(['com', 'net', 'org']) t(top)
), fits AS (
  SELECT n.page_id, n.host, n.path, e.entry, e.kind
  FROM named n JOIN entries e ON (n.host = e.host_part OR ends_with(n.host, '.' || e.host_part)) AND starts_with(n.path, e.path_part)
), best AS (
  SELECT page_id, host, path,
         arg_min(entry, (-length(entry), entry)) FILTER (WHERE kind <> 'listed') AS rule,
         arg_min(kind, (-length(entry), entry)) FILTER (WHERE kind <> 'listed') AS rule_kind,
         arg_max(entry, (length(entry), entry)) FILTER (WHERE kind = 'listed') AS listed
  FROM fits GROUP BY page_id, host, path
)
SELECT n.page_id, n.host, n.path, b.rule,
       CASE WHEN b.rule IS NOT NULL THEN b.rule_kind WHEN b.listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       b.listed
FROM named n LEFT JOIN best b USING (page_id, host, path)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_ngram_jaccard, op3_html_extraction, op4_decontaminate, op5_quality_rules, op6_token_files, op7_token_counts, op8_secret_scan, op9_url_filter, op10_mixing, op11_line_field, op12_spelling_variants, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9_SQL}
