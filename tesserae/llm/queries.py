"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz, neardup, packing, pii, quality, suffixes, tokens, urls, vectors

BPE = "byte_bpe_50k.json"
#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sites whose pages make up the list of blocked URLs, under each ending.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_HOSTS = tuple(f"{site}.example.{ending}" for site in LISTED_SITES for ending in ("com", "net", "org"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, which is encoded once as a whole; a token counts where its first character is."""
    return tokens.section_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), size=4)


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "certified")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of the hosts in LISTED_HOSTS, under any scheme, mirror prefix, query or fragment."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(urls.host(F.col("url")), r"^(www|m|blog)\.", "")
    return urls.judge(pages, URL_RULES, pages.select("url").where(bare.isin(*LISTED_HOSTS)))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz.score(table(spark, sf_dir, "documents"), held_out)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_bpe, op4_packing, op5_minhash_dedup, op6_vector_dedup, op7_quality_rules, op8_url_filters, op9_lm_scores, op10_pii)}


_FITS = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_ORDERED = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
OP8_SQL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/+)$', '') END AS canonical,
         regexp_replace(host, '^(www|m|blog)\\.', '') IN ({", ".join(f"'{h}'" for h in LISTED_HOSTS)}) AS on_list
  FROM parts
), names AS (SELECT DISTINCT canonical FROM named WHERE on_list AND canonical IS NOT NULL),
judged AS (
  SELECT page_id, host, path, {_FITS.format(*(h + p for _, h, p in _ORDERED))} AS rule, {_FITS.format(*(v for v, _, _ in _ORDERED))} AS said,
         canonical IS NOT NULL AND canonical IN (SELECT canonical FROM names) AS listed
  FROM named
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": OP8_SQL}
