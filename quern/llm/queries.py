"""The production queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard, language, licenses, media, mixing, pieces, prints, suffixes, urlrules, warc
from quern.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs, language.fit(docs.filter(language.training_rows())))
    return found.select("doc_id", (~language.training_rows()).alias("held_out"), "lang_pred", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.round_trip(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(";", "media_type", "facts", F.concat(F.lit("carved="), F.size("carved")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("expressions")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), digests=True)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.by_position(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filters": op2_url_filters,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_media_columns": op5_media_columns,
        "op6_license_scan": op6_license_scan,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_warc": op9_warc,
        "op10_mix_sources": op10_mix_sources,
    }


def _sql_patterns() -> str:
    names = sorted(p.name for p in urlrules.PATTERNS)
    tests = " ".join(f"WHEN contains(lower_whole, '{n.rstrip('*')}') THEN '{n}'" for n in sorted(names, key=lambda n: (-len(n), n)))
    return f"CASE {tests} END"


_URLS = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS head FROM pages
), split AS (
  SELECT page_id, CASE WHEN strpos(head, '/') > 0 THEN substr(head, 1, strpos(head, '/') - 1) ELSE coalesce(head, '') END AS host0,
         CASE WHEN strpos(head, '/') > 0 THEN substr(head, strpos(head, '/')) ELSE '' END AS path FROM parts
), hosts AS (
  SELECT page_id, path, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM split
), judged AS (
  SELECT *, host || path AS lower_whole, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM hosts
), all_of AS (SELECT *, CASE WHEN rule IS NULL THEN {patterns} END AS pattern FROM judged)
SELECT page_id, host, path, rule, pattern, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM all_of
"""

_MIX = """
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source
), slots AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS slot, 2.0::DOUBLE * source_size AS most FROM sizes
), weights AS (
  SELECT *, CASE slot % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM slots
), levels AS (
  SELECT *, most / weight AS fills_at, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY most / weight, slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weights
), chosen AS (
  SELECT level FROM levels WHERE level <= fills_at ORDER BY fills_at, slot LIMIT 1
), targets AS (
  SELECT source, source_size, slot, CASE WHEN (SELECT level FROM chosen) IS NULL THEN most ELSE least((SELECT level FROM chosen) * weight, most) END AS target FROM levels
), placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows_
), taking AS (
  SELECT doc_id, size, source_size, target, slot, (start + size / 2.0::DOUBLE) / target AS share, (start + size / 2.0::DOUBLE <= target AND size > 0) AS once, (source_size + start + size / 2.0::DOUBLE <= target AND size > 0) AS twice
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (once::BIGINT + twice::BIGINT))::BIGINT AS taken,
  CASE WHEN once THEN CASE slot % 3 WHEN 0 THEN (sqrt(4.0::DOUBLE + (-3.0)::DOUBLE * share) - 2.0::DOUBLE) / (-1.0)::DOUBLE WHEN 1 THEN share ELSE (sqrt(0.25::DOUBLE + 2.0::DOUBLE * share) - 0.5::DOUBLE) / 1.0::DOUBLE END END AS first_position
FROM taking
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _URLS.format(patterns=_sql_patterns()), "op10_mix_sources": _MIX}
