"""Registered queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import urls as ux
from quern.operators import audit, corpus, dedup, explain, history, metrics, sampling, scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inputs ------------------------------------------------------------------------------------------------------------
_ADDRESS, _NUMBER, _IP = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", r"[0-9]{4}", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels (null: unlabelled) as messages, with fields that may be missing."""
    t = F.col("text")
    found = lambda p: F.nullif(F.regexp_extract(t, f"({p})", 1), F.lit(""))
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    d = d.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", found(_ADDRESS).alias("sender"), found(_NUMBER).alias("figure"), found(_IP).alias("network_indicators"), F.when(F.contains(t, F.lit("\n")), F.substring_index(t, "\n", 1)).alias("subject"), (F.col("n_chars") >= 2000).cast("int").alias("has_html"))
    return corpus.with_availability(d)


M = f"""messages AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, nullif(regexp_extract(d.text, '({_ADDRESS})', 1), '') AS sender, nullif(regexp_extract(d.text, '({_NUMBER})', 1), '') AS figure,
    nullif(regexp_extract(d.text, '({_IP})', 1), '') AS network_indicators, CASE WHEN contains(d.text, chr(10)) THEN split_part(d.text, chr(10), 1) END AS subject, (d.n_chars >= 2000)::INT AS has_html,
    (d.n_chars >= 2000) AS has_structure_modality, nullif(regexp_extract(d.text, '({_IP})', 1), '') IS NOT NULL AS has_network_modality
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

MODELS = ("alpha", "beta", "gamma")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, id, y_true, y_proba: scores from a hash, drawn towards the label, so no model is needed."""
    x = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y_true"))
    x = x.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    u = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.col("model"), F.lit("|"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(10001)) / 10000
    return x.select("model", "id", "y_true", (u / 2 + F.col("y_true") * 0.5 * u).alias("y_proba"))


P = """scores AS (
  SELECT model, doc_id AS id, toxic AS y_true, (('0x' || substr(sha256(model || '|' || doc_id::VARCHAR), 1, 8))::BIGINT % 10001) / 10000.0::DOUBLE AS u
  FROM labels, (VALUES ('alpha'), ('beta'), ('gamma')) v(model)
), predictions AS (SELECT model, id, y_true, u / 2 + y_true * 0.5::DOUBLE * u AS y_proba FROM scores)"""
_KEY = "sha256('{seed}|' || {c}::VARCHAR)"


def _r(x: DataFrame, **digits: int) -> DataFrame:
    return x.withColumns({c: F.round(c, n) for c, n in digits.items()})


# -- scans, projections, predicates -------------------------------------------------------------------------------------
@query("SELECT doc_id::VARCHAR AS email_id, source AS source_dataset, text AS clean_text, lang AS language, 0 AS has_html, 0.0::DOUBLE AS url_max_digit_ratio, NULL::VARCHAR AS subject FROM documents")
def canonical_projection(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("email_id"), F.col("source").alias("source_dataset"), F.col("text").alias("clean_text"), F.col("lang").alias("language"))
    return corpus.canonical(d).select("email_id", "source_dataset", "clean_text", "language", "has_html", "url_max_digit_ratio", "subject")


@query("SELECT p_partkey, CASE WHEN t IN ('phishing email', 'phishing', 'spam', '1', 'malicious') OR t LIKE '%phish%' THEN 1 WHEN t IN ('safe email', 'safe', 'ham', 'genuine', 'legitimate', '0', 'benign') OR t LIKE '%safe%' THEN 0 END AS label, CASE WHEN p_size IN (0, 1) THEN p_size END AS binary_label FROM (SELECT *, lower(trim(CASE p_partkey % 7 WHEN 0 THEN ' Phishing Email' WHEN 1 THEN 'Safe Email ' WHEN 2 THEN 'HAM' WHEN 3 THEN 'unsafe' WHEN 4 THEN 'Spam' WHEN 5 THEN p_brand END)) AS t FROM part)")
def label_normalise(spark, sf_dir):
    m = F.col("p_partkey") % 7
    raw = F.when(m == 0, " Phishing Email").when(m == 1, "Safe Email ").when(m == 2, "HAM").when(m == 3, "unsafe").when(m == 4, "Spam").when(m == 5, F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", corpus.normalise_label(raw).alias("label"), corpus.normalise_label(F.col("p_size"), True).alias("binary_label"))


@query("SELECT doc_id, CASE WHEN fam IS NULL THEN 'Unknown' WHEN fam IN ('SpamAssassin', 'Kaggle') THEN fam WHEN fam LIKE 'Spam%' THEN 'Spam_Genuine_Mail' WHEN fam LIKE 'PhishMMF%' THEN 'PhishMMF' WHEN starts_with(fam, 'Kaggle') THEN 'Kaggle_Phishing_Email' ELSE fam END AS family FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'SpamAssassin' WHEN 1 THEN 'Spam_' || source WHEN 2 THEN 'PhishMMF_' || source WHEN 3 THEN 'Kaggle' WHEN 4 THEN 'Kaggle_' || source END AS fam FROM documents)")
def source_families(spark, sf_dir):
    m, s = F.col("doc_id") % 6, F.col("source")
    name = F.when(m == 0, "SpamAssassin").when(m == 1, F.concat(F.lit("Spam_"), s)).when(m == 2, F.concat(F.lit("PhishMMF_"), s)).when(m == 3, "Kaggle").when(m == 4, F.concat(F.lit("Kaggle_"), s))
    return read(spark, sf_dir, "documents").select("doc_id", corpus.source_family(name).alias("family"))


@query(f"WITH {M} SELECT doc_id, CASE WHEN has_structure_modality AND has_network_modality THEN 'text+structure+network' WHEN has_structure_modality THEN 'text+structure' WHEN has_network_modality THEN 'text+network' ELSE 'text' END AS profile FROM messages")
def availability_profile(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", corpus.profile().alias("profile"))


@query(f"WITH {M} SELECT doc_id, 0 AS has_html, NULL::VARCHAR AS network_indicators, false AS has_structure_modality, '' AS clean_text FROM messages WHERE has_structure_modality")
def branch_nulling(spark, sf_dir):
    x = messages(spark, sf_dir).filter("has_structure_modality").withColumn("clean_text", F.col("text"))
    return corpus.without_branch(x, ["has_html"], ["network_indicators"], "has_structure_modality", True).select("doc_id", "has_html", "network_indicators", "has_structure_modality", "clean_text")


@query("SELECT doc_id, text FROM documents WHERE length(trim(text)) >= 6 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_positives(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return read(spark, sf_dir, "documents").filter(corpus.long_enough(F.col("text"))).join(ids, "doc_id", "left_semi").select("doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_resume(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_by_name(spark, sf_dir):
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return a.unionByName(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("SELECT DISTINCT source FROM documents EXCEPT SELECT DISTINCT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def except_sources(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return d.select("source").subtract(d.join(read(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("source"))


@query("SELECT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 1")
def intersect_sides(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.filter("doc_id % 2 = 0").select("lang").intersect(d.filter("doc_id % 2 = 1").select("lang"))


@query("WITH p AS (SELECT unnest(generate_series(1, 9)) AS n), t AS (SELECT DISTINCT lang FROM documents) SELECT a.lang AS lang_a, b.lang AS lang_b FROM t a JOIN t b ON a.lang < b.lang")
def pair_enumeration(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("lang").distinct()
    return t.select(F.col("lang").alias("lang_a")).join(t.select(F.col("lang").alias("lang_b")), F.col("lang_a") < F.col("lang_b"))


# -- text and markup ------------------------------------------------------------------------------------------------------
_WS = r"[ \t\n\x0B\f\r]+"


@query(rf"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS fingerprint, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def text_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"), tx.word_count(F.col("text")).cast("long").alias("words"))


@query(r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct(list_transform(generate_series(1, len(w)::BIGINT - 4), lambda i: array_to_string(w[i:i+4], ' ')))) END::BIGINT AS n_shingles FROM t")
def shingle_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tx.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*>'))::BIGINT AS num_links, len(regexp_extract_all(html, '(?i)<img\\b[^>]*>'))::BIGINT AS num_images, regexp_matches(html, '(?i)<form\\b[^>]*>')::INT AS has_form, regexp_matches(html, '(?i)<script\\b[^>]*>')::INT AS has_javascript, regexp_matches(html, '(?i)</?(?:p|div|html|body|a|span|h[1-6]|table|br)\\b[^>]*>')::INT AS has_html FROM pages")
def html_tag_features(spark, sf_dir):
    h = F.col("html")
    c = ux.markup_counts(h)
    return read(spark, sf_dir, "pages").select("page_id", c["num_links"].cast("long").alias("num_links"), c["num_images"].cast("long").alias("num_images"), c["has_form"].alias("has_form"), c["has_javascript"].alias("has_javascript"), ux.has_html(h).alias("has_html"))


_URLS = r"""WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '^([^"''<>]*)', 1), '[.,;:)\]}''"]+$', '') AS t FROM pages),
h AS (SELECT *, regexp_extract(regexp_replace(lower(regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '^([^:]*)', 1) AS host FROM u)
SELECT page_id, length(t)::INT AS url_max_length, length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t)::DOUBLE AS url_max_digit_ratio, greatest(length(host) - length(replace(host, '.', '')) - 1, 0)::INT AS url_max_subdomain_count,
contains(t, '@')::INT AS url_has_at_symbol, 0 AS url_has_shortener, (regexp_extract(host, '\.([^.]+)$', 1) IN ('click', 'club', 'country', 'gq', 'kim', 'link', 'ml', 'review', 'science', 'support', 'tk', 'top', 'work', 'xyz', 'zip'))::INT AS url_has_suspicious_tld,
round((SELECT -sum(c / length(host)::DOUBLE * log2(c / length(host)::DOUBLE)) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(host, '')) AS x) GROUP BY x)), 6) AS url_domain_max_entropy FROM h"""


@query(_URLS)
def url_lexical_features(spark, sf_dir):
    x = read(spark, sf_dir, "pages").select("page_id", F.array("url").alias("u"))
    return _r(x.select("page_id", *[c.alias(k) for k, c in ux.lexical(F.col("u")).items()]), url_domain_max_entropy=6)


@query(r"SELECT doc_id, array_to_string(list_concat(regexp_extract_all(text, '(?i)https?://[^ \t\n\x0B\f\r]+|www\.[^ \t\n\x0B\f\r]+'), regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')), ', ') AS indicators FROM documents WHERE regexp_matches(text, '(?i)https?://[^ \t\n\x0B\f\r]+|www\.[^ \t\n\x0B\f\r]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')")
def network_indicators(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ux.network_indicators(F.col("text")).alias("indicators")).filter("indicators is not null")


@query("SELECT item_id, translate(text, 'aceiopxy', 'асеіорху') AS lookalike, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS entities, regexp_replace(text, '([A-Za-z])', '\\1' || chr(8203), 'g') AS zero_width FROM benchmark")
def degrade_text(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "benchmark").select("item_id", tx.lookalike(t).alias("lookalike"), tx.entities(t).alias("entities"), tx.zero_width(t).alias("zero_width"))


# -- dedup, sampling, splits ----------------------------------------------------------------------------------------------
@query(r"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup(spark, sf_dir):
    return dedup.keep_first_text(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "source")


@query()
def near_dup_campaigns(spark, sf_dir):
    return dedup.verified_campaigns(read(spark, sf_dir, "documents"), "text", "doc_id", "source")


@query()
def near_dup_banded(spark, sf_dir):
    return dedup.campaigns(read(spark, sf_dir, "documents"), "text", "doc_id", "source")


@query()
def near_dup_recall(spark, sf_dir):
    return dedup.agreement(near_dup_banded(spark, sf_dir), near_dup_campaigns(spark, sf_dir), "doc_id", "source")


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_KEY.format(seed='sample', c='doc_id')}, doc_id) AS r FROM documents) WHERE r <= 20")
def per_source_sample(spark, sf_dir):
    return sampling.per_group(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20, "sample")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {_KEY.format(seed='head', c='doc_id')}, doc_id LIMIT 300")
def hash_ordered_topk(spark, sf_dir):
    return sampling.first_by_hash(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 300, "head")


@query("SELECT doc_id, CASE WHEN u <= 0.8::DOUBLE THEN 'train' WHEN u <= 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, (('0x' || substr(sha256('iid|' || doc_id::VARCHAR), 1, 8))::BIGINT % 10001) / 10000.0::DOUBLE AS u FROM documents)")
def random_split(spark, sf_dir):
    return sampling.random_split(read(spark, sf_dir, "documents"), "doc_id", "iid").select("doc_id", "split")


_SPLIT = """own AS (SELECT o_orderkey, coalesce(o_custkey::VARCHAR, '#' || o_orderkey::VARCHAR) AS c, o_orderstatus AS s FROM orders),
sizes AS (SELECT c, min(s) AS s, count(*) AS n, sha256('split|' || c) AS k FROM own GROUP BY c),
placed AS (SELECT c, sum(n) OVER (PARTITION BY s ORDER BY k, c ROWS UNBOUNDED PRECEDING) / (sum(n) OVER (PARTITION BY s))::DOUBLE AS share FROM sizes),
sides AS (SELECT c, CASE WHEN share <= 0.8::DOUBLE THEN 'train' WHEN share <= 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM placed)"""


@query(f"WITH {_SPLIT} SELECT o_orderkey, split FROM own JOIN sides USING (c)")
def group_split(spark, sf_dir):
    return sampling.group_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", "o_orderkey", "split").select("o_orderkey", "split")


@query(f"WITH {_SPLIT} SELECT c AS cluster, count(DISTINCT split) AS sides FROM own JOIN sides USING (c) GROUP BY c HAVING count(DISTINCT split) > 1")
def split_disjointness(spark, sf_dir):
    x = sampling.group_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", "o_orderkey", "split")
    return sampling.crossing(x.withColumn("cluster", F.col("o_custkey").cast("string")), "cluster", "split")


_BALANCED = f"""WITH RECURSIVE {M}, m AS (SELECT doc_id, source, toxic, has_structure_modality AND has_network_modality AS tri, {_KEY.format(seed='balance', c='doc_id')} AS k FROM messages WHERE toxic IS NOT NULL),
b AS (SELECT round_even(sum(toxic) * (1.0::DOUBLE - 0.4::DOUBLE) / 0.4::DOUBLE, 0)::BIGINT - count(*) FILTER (toxic = 0 AND source = 'src0') AS budget, count(*) FILTER (toxic = 1 AND tri) AS tp, count(*) FILTER (toxic = 0 AND tri AND source IS DISTINCT FROM 'src0') AS tn FROM m),
t AS (SELECT budget, greatest(least(tp, tn, budget), 0) AS spent FROM b),
neg AS (SELECT *, row_number() OVER (PARTITION BY tri ORDER BY k, doc_id) AS r FROM m WHERE toxic = 0 AND source IS DISTINCT FROM 'src0'),
marked AS (SELECT neg.*, budget, spent, tri AND r <= spent AS early FROM neg, t),
q AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS i, greatest(any_value(budget) - any_value(spent), 0) AS free, any_value(budget) AS budget FROM marked WHERE NOT early GROUP BY source),
e AS (SELECT *, least(n, free // (2 * count(*) OVER ())) AS base FROM q),
s AS (SELECT *, n - base AS rest, free - sum(base) OVER () AS open_, sum(n - base) OVER () AS all_, floor(0.4::DOUBLE * budget)::BIGINT AS top FROM e),
fold AS (
  SELECT 0::BIGINT AS i, max(open_)::BIGINT AS open_, NULL::VARCHAR AS source, 0::BIGINT AS take FROM s
  UNION ALL
  SELECT s.i, f.open_ - x.share, s.source, s.base + x.share FROM fold f JOIN s ON s.i = f.i + 1,
    LATERAL (SELECT CASE WHEN s.rest > 0 AND f.open_ > 0 THEN least(greatest(floor(f.open_ * s.rest / s.all_::DOUBLE)::BIGINT, 1), s.top, s.rest, f.open_) ELSE 0 END::BIGINT AS share) x
), late AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS place FROM marked WHERE NOT early)
SELECT doc_id, source, toxic FROM m WHERE toxic = 1 OR source = 'src0' UNION ALL SELECT doc_id, source, toxic FROM marked WHERE early
UNION ALL SELECT l.doc_id, l.source, l.toxic FROM late l JOIN fold f ON f.source IS NOT DISTINCT FROM l.source AND f.i > 0 WHERE l.place <= f.take"""


@query(_BALANCED)
def balanced_sample(spark, sf_dir):
    x = messages(spark, sf_dir).filter("toxic is not null").withColumn("tri", F.col("has_structure_modality") & F.col("has_network_modality"))
    return sampling.balance(x, "doc_id", "source", "toxic", "tri", "src0", "balance").select("doc_id", "source", "toxic")


# -- audit ---------------------------------------------------------------------------------------------------------------------
_FIELDS = ("subject", "sender", "figure", "network_indicators")
_LEAKS = f"""WITH {M}, flat AS ({' UNION ALL '.join(f"SELECT source, toxic AS y, '{f}' AS field, ({f} IS NOT NULL AND length(trim({f})) > 0) AS p FROM messages WHERE toxic IS NOT NULL" for f in _FIELDS)}),
c AS (SELECT source, field, count(*)::DOUBLE AS n, sum((p AND y = 1)::INT)::DOUBLE AS a, sum((p AND y = 0)::INT)::DOUBLE AS b, sum((NOT p AND y = 1)::INT)::DOUBLE AS c, sum((NOT p AND y = 0)::INT)::DOUBLE AS d FROM flat GROUP BY source, field),
m AS (SELECT *, (a + c > 0 AND b + d > 0) AS ok, greatest((CASE WHEN a > 0 THEN a / n * ln(a * n / ((a + b) * (a + c))) ELSE 0 END) + (CASE WHEN b > 0 THEN b / n * ln(b * n / ((a + b) * (b + d))) ELSE 0 END) + (CASE WHEN c > 0 THEN c / n * ln(c * n / ((c + d) * (a + c))) ELSE 0 END) + (CASE WHEN d > 0 THEN d / n * ln(d * n / ((c + d) * (b + d))) ELSE 0 END), 0.0::DOUBLE) AS mi FROM c)
SELECT source, field, (a + b) / n AS coverage, CASE WHEN ok THEN round(mi, 6) END AS mi, CASE WHEN ok THEN mi > 0.05 END AS above, CASE WHEN ok AND a + b > 0 THEN a / (a + b) END AS p_present, CASE WHEN ok AND c + d > 0 THEN c / (c + d) END AS p_absent FROM m"""


@query(_LEAKS)
def leak_audit(spark, sf_dir):
    return _r(audit.leaks(messages(spark, sf_dir), "source", "toxic", list(_FIELDS)), mi=6)


@query(f"WITH {M} SELECT source, count(*) AS n, avg(toxic) AS prevalence, avg(has_structure_modality::INT) AS structure, avg(has_network_modality::INT) AS network, avg((has_structure_modality AND has_network_modality)::INT) AS tri, avg((has_structure_modality OR has_network_modality)::INT) AS bi FROM messages GROUP BY ROLLUP (source)")
def coverage_grouping_sets(spark, sf_dir):
    return audit.coverage(messages(spark, sf_dir), "source", "toxic")


@query(f"""WITH {M}, x AS (SELECT count(*) > 0 AS not_empty, count(*) = count(DISTINCT doc_id) AS unique_ids, count(*) FILTER (doc_id IS NULL) = 0 AS no_null_ids, count(*) FILTER (toxic NOT IN (0, 1)) = 0 AS binary_labels, count(DISTINCT toxic) = 2 AS two_classes, count(*) FILTER (text IS NULL OR length(trim(text)) = 0) = 0 AS no_blank_text, count(DISTINCT source) > 1 AS several_sources, avg(toxic) BETWEEN 0.05 AND 0.95 AS prevalence_in_range FROM messages)
UNPIVOT (SELECT * FROM x) ON COLUMNS(*) INTO NAME "check" VALUE ok""")
def smoke_checks(spark, sf_dir):
    return audit.smoke_checks(messages(spark, sf_dir), "doc_id", "toxic", "text", "source")


@query(f"WITH {M} SELECT source, lang, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share, CASE WHEN count(*) >= 30 THEN avg(toxic) END AS prevalence FROM messages GROUP BY source, lang")
def language_composition(spark, sf_dir):
    return audit.composition(messages(spark, sf_dir), "source", "lang", "toxic")


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), x AS (SELECT n, sum(n) OVER (PARTITION BY lang) AS a, sum(n) OVER (PARTITION BY source) AS b, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t::DOUBLE * ln(n * t::DOUBLE / (a * b))), 9) AS mi FROM x")
def feature_mi(spark, sf_dir):
    return _r(audit.mutual_information(read(spark, sf_dir, "documents"), "lang", "source"), mi=9)


_BEST = "SELECT m.*, CASE WHEN has_structure_modality AND has_network_modality THEN 'all' WHEN has_structure_modality THEN 'structure' WHEN has_network_modality THEN 'network' ELSE 'text' END AS profile, (p.y_proba >= 0.5)::INT AS predicted FROM messages m JOIN predictions p ON m.doc_id = p.id AND p.model = 'alpha'"


@query(f"WITH {M}, {P}, x AS ({_BEST}), g AS (SELECT profile, count(*) AS n, (avg(toxic) > 0.5)::INT AS majority FROM x GROUP BY profile) SELECT profile, n, majority, sum((predicted = toxic AND majority <> toxic)::INT)::BIGINT AS wins, sum((predicted <> toxic AND majority = toxic)::INT)::BIGINT AS losses, sum((predicted = toxic AND majority <> toxic)::INT)::BIGINT - sum((predicted <> toxic AND majority = toxic)::INT)::BIGINT AS net FROM x JOIN g USING (profile) GROUP BY profile, n, majority")
def shortcut_analysis(spark, sf_dir):
    p = predictions(spark, sf_dir).filter("model = 'alpha'").select(F.col("id").alias("doc_id"), (F.col("y_proba") >= 0.5).cast("int").alias("predicted"))
    s, n = F.col("has_structure_modality"), F.col("has_network_modality")
    x = messages(spark, sf_dir).join(p, "doc_id").withColumn("profile", F.when(s & n, "all").when(s, "structure").when(n, "network").otherwise("text"))
    return audit.shortcuts(x, "profile", "toxic", "predicted")


@query("""WITH sz AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) SELECT CASE WHEN c = 1 THEN '1' WHEN c <= 5 THEN '2-5' ELSE '>5' END AS band, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS prevalence, count(DISTINCT (o_orderstatus = 'F')::INT) AS classes, count(*) >= 20 AND count(DISTINCT (o_orderstatus = 'F')::INT) = 2 AS evaluable FROM orders JOIN sz USING (o_custkey) GROUP BY 1""")
def cluster_size_bands(spark, sf_dir):
    return audit.size_bands(read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y")), "o_custkey", "y")


# -- measures of predictions --------------------------------------------------------------------------------------------
_CONF = f"WITH {P}, c AS (SELECT model, sum((y_true = 1 AND y_proba >= 0.5)::INT)::BIGINT AS tp, sum((y_true = 0 AND y_proba >= 0.5)::INT)::BIGINT AS fp, sum((y_true = 1 AND y_proba < 0.5)::INT)::BIGINT AS fn, sum((y_true = 0 AND y_proba < 0.5)::INT)::BIGINT AS tn FROM predictions GROUP BY model)"


@query(_CONF + """ SELECT model, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 9) AS mcc, (tp + fn) / (tp + fp + fn + tn)::DOUBLE AS prevalence FROM c""")
def confusion_metrics(spark, sf_dir):
    return _r(metrics.confusion(metrics.checked(predictions(spark, sf_dir))), mcc=9).drop("balanced_accuracy", "f1_trivial")


_CURVE = f"WITH {P}, g AS (SELECT model, y_proba AS s, sum(y_true)::DOUBLE AS p, sum(1 - y_true)::DOUBLE AS q FROM predictions GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS pos, sum(q) OVER (PARTITION BY model) AS neg FROM g WINDOW w AS (PARTITION BY model ORDER BY s DESC))"


@query(_CURVE + " SELECT model, round(sum(q * (tp - p + p / 2)) / (max(pos) * max(neg)), 9) AS auc, round(sum(p / pos * (tp / (tp + fp))), 9) AS ap FROM c GROUP BY model")
def ranking_metrics(spark, sf_dir):
    return _r(metrics.ranking(predictions(spark, sf_dir)), auc=9, ap=9)


@query(_CURVE + ' SELECT model, l AS "limit", max(CASE WHEN fp / neg <= l AND l >= 1 / neg THEN tp / pos END) AS tpr, min(CASE WHEN fp / neg <= l AND l >= 1 / neg THEN s END) AS threshold FROM c, (VALUES (0.01::DOUBLE), (0.001::DOUBLE)) v(l) GROUP BY model, l')
def tpr_at_fpr(spark, sf_dir):
    return metrics.tpr_at_fpr(predictions(spark, sf_dir))


@query(_CURVE + " SELECT model, min(fp / neg) AS fpr FROM c WHERE tp / pos >= 0.95::DOUBLE GROUP BY model")
def fpr_at_tpr95(spark, sf_dir):
    return metrics.fpr_at_tpr(predictions(spark, sf_dir))


@query(f"WITH {P}, b AS (SELECT model, least(floor(y_proba * 10 + 1e-12::DOUBLE), 9) AS b, count(*) AS n, sum(y_proba) AS sp, sum(y_true) AS sy, sum((y_proba - y_true) * (y_proba - y_true)) AS se FROM predictions GROUP BY 1, 2) SELECT model, round(sum(se) / sum(n), 9) AS brier, round(sum(abs(sp - sy)) / sum(n), 9) AS ece FROM b GROUP BY model")
def calibration_ece(spark, sf_dir):
    return _r(metrics.calibration(predictions(spark, sf_dir)), brier=9, ece=9)


@query(f"WITH {P}, r AS (SELECT model, id, ((y_proba >= 0.5)::INT = y_true) AS ok FROM predictions), d AS (SELECT a.model AS model_a, b.model AS model_b, sum((NOT a.ok AND b.ok)::INT)::BIGINT AS n01, sum((a.ok AND NOT b.ok)::INT)::BIGINT AS n10 FROM r a JOIN r b ON a.id = b.id AND a.model < b.model GROUP BY 1, 2) SELECT model_a, model_b, n01, n10, round(CASE WHEN n01 + n10 = 0 THEN 1 ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2))) FROM unnest(generate_series(0, least(n01, n10))) u(i))) END, 6) AS p_value FROM d")
def mcnemar_pairs(spark, sf_dir):
    return _r(metrics.paired(predictions(spark, sf_dir)), p_value=6).drop("significant")


@query(f"WITH {P}, s AS (SELECT model, id % 5 AS seed, avg(((y_proba >= 0.5)::INT = y_true)::INT) AS accuracy FROM predictions GROUP BY 1, 2) SELECT model, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS std FROM s GROUP BY model")
def seed_aggregate(spark, sf_dir):
    x = predictions(spark, sf_dir).groupBy("model", (F.col("id") % 5).alias("seed")).agg(F.avg(((F.col("y_proba") >= 0.5).cast("int") == F.col("y_true")).cast("int")).alias("accuracy"))
    return _r(metrics.over_seeds(x, "model", "accuracy"), mean=9, std=9)


@query(f"WITH {P} SELECT model, round(quantile_cont(y_proba, 0.9), 9) AS threshold FROM predictions GROUP BY model")
def threshold_by_rate(spark, sf_dir):
    return _r(metrics.threshold_at(predictions(spark, sf_dir), 0.1), threshold=9)


@query(f"""WITH {P}, z AS (SELECT model, y_true, ln(greatest(least(y_proba, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least(y_proba, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE))) AS z FROM predictions), t AS (SELECT round(0.5::DOUBLE + 0.05::DOUBLE * i, 2) AS t FROM generate_series(0, 90) g(i)),
l AS (SELECT model, t, round(avg(-ln(CASE WHEN y_true = 1 THEN 1 / (1 + exp(-z / t)) ELSE 1 - 1 / (1 + exp(-z / t)) END)), 9) AS loss FROM z, t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY loss, t) AS k FROM l) SELECT model, t AS temperature, round(loss, 6) AS loss FROM r WHERE k = 1""")
def temperature_grid(spark, sf_dir):
    return metrics.temperature(predictions(spark, sf_dir))


@query("SELECT toxic, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS weight FROM labels GROUP BY toxic")
def class_weights(spark, sf_dir):
    return metrics.class_weights(read(spark, sf_dir, "labels"), "toxic")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return _r(metrics.latency(read(spark, sf_dir, "events"), "event_type", "value"), mean=6, p50=6, p95=6, p99=6)


@query()
def bootstrap_interval(spark, sf_dir):
    return metrics.bootstrap_f1(predictions(spark, sf_dir))


# -- histories ---------------------------------------------------------------------------------------------------------------
@query("""WITH x AS (SELECT event_type, event_id, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, sum(value) OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events), k AS (SELECT *, greatest(n // 50, 1) AS k FROM x)
SELECT a.event_type, a.event_id, a.value, CASE WHEN a.n >= 50 THEN round((a.t - coalesce(b.t, 0)) / least(a.k, a.r), 8) END AS rolling FROM k a LEFT JOIN k b ON a.event_type = b.event_type AND b.r = a.r - a.k""")
def rolling_loss(spark, sf_dir):
    return _r(history.rolling_mean(read(spark, sf_dir, "events"), "event_type", "event_id", "value"), rolling=8)


_EPOCHS = "e AS (SELECT user_id, date_trunc('day', ts) AS day, round(avg(value), 6) AS val, round(avg(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END), 6) AS train FROM events GROUP BY 1, 2)"


def _epochs(spark, sf_dir):
    x = read(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    return x.agg(F.round(F.avg("value"), 6).alias("val"), F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0)), 6).alias("train"))


@query(f"WITH {_EPOCHS}, x AS (SELECT user_id, lag(day) OVER w AS after, val > lag(val) OVER w AND train < lag(train) OVER w AS hit FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, min(after) AS after_epoch FROM x WHERE hit GROUP BY user_id")
def overfit_lag(spark, sf_dir):
    return history.first_overfit(_epochs(spark, sf_dir), "user_id", "day", "train", "val")


@query(f"""WITH {_EPOCHS}, x AS (SELECT *, row_number() OVER w AS r, max(val) OVER w AS m FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)), y AS (SELECT a.*, a.r - (SELECT min(b.r) FROM x b WHERE b.user_id = a.user_id AND b.r <= a.r AND b.val = a.m) AS since FROM x a),
s AS (SELECT user_id, min(r) FILTER (since >= 3) AS stop FROM y GROUP BY 1) SELECT user_id, max(val) AS best, max(r) AS epochs_run, any_value(stop) IS NOT NULL AS stopped FROM y JOIN s USING (user_id) WHERE stop IS NULL OR r <= stop GROUP BY user_id""")
def early_stop(spark, sf_dir):
    return history.early_stop(_epochs(spark, sf_dir), "user_id", "day", "val", 3)


@query("""WITH k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), x AS (SELECT user_id, ts, event_type, lead(event_type) OVER w AS n, lead(ts) OVER w AS t FROM events, k WHERE event_type IN (a, b) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)) SELECT user_id, ts AS started, CASE WHEN n = b THEN t END AS ended, (CASE WHEN n = b THEN epoch_us(t) END - epoch_us(ts))::BIGINT AS micros FROM x, k WHERE event_type = a""")
def event_pairing(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    k = e.agg(F.min("event_type"), F.max("event_type")).first()
    return history.durations(e, "user_id", "ts", "event_type", k[0], k[1])


@query("WITH x AS (SELECT event_id, event_type, coalesce(sum(event_id % 7) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) SELECT event_id, event_type FROM x WHERE b < 500")
def running_cap(spark, sf_dir):
    x = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 7).alias("size"))
    return history.running_cap(x, "event_type", "event_id", "size", 500).select("event_id", "event_type")


@query("WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(avg(value) FILTER (r <= greatest(n // 10, 1)), 6) AS first, round(avg(value) FILTER (r > n - greatest(n // 10, 1)), 6) AS last FROM x GROUP BY user_id")
def decile_means(spark, sf_dir):
    return _r(history.decile_means(read(spark, sf_dir, "events"), "user_id", "event_id", "value"), first=6, last=6).drop("decreased")


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS user, arg_min(text, turn) FILTER (role = 'assistant') AS assistant, arg_min(text, turn) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id")
def first_part_by_type(spark, sf_dir):
    return history.first_by_type(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", ["user", "assistant", "system"])


# -- explanations ----------------------------------------------------------------------------------------------------------------
_WORDS = r"words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS w FROM documents) GROUP BY 1, 2)"


def _words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.lower("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))


@query(f"WITH {_WORDS} SELECT doc_id, w, n, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM words) WHERE r <= 5")
def topk_factors(spark, sf_dir):
    return explain.top_factors(_words(spark, sf_dir), "doc_id", "w", "n", 5)


@query(f"WITH {_WORDS}, t AS (SELECT doc_id, list(w) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM words) WHERE r <= 5 GROUP BY doc_id) SELECT a.doc_id, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def topk_jaccard(spark, sf_dir):
    t = explain.top_factors(_words(spark, sf_dir), "doc_id", "w", "n", 5).groupBy("doc_id").agg(F.collect_set("w").alias("ws"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("other")), "doc_id").select("doc_id", explain.set_jaccard(F.col("ws"), F.col("other")).alias("jaccard"))


@query(f"WITH {_WORDS}, g AS (SELECT doc_id, CASE WHEN length(w) <= 3 THEN 'network' WHEN length(w) <= 6 THEN 'structure' ELSE 'text' END AS modality, sum(n)::BIGINT AS mass, count(*) AS factors FROM words GROUP BY 1, 2) SELECT doc_id, modality, factors, mass / (sum(mass) OVER (PARTITION BY doc_id))::DOUBLE AS share, row_number() OVER (PARTITION BY doc_id ORDER BY mass DESC, modality) = 1 AS dominant FROM g")
def modality_report(spark, sf_dir):
    m = F.when(F.length("w") <= 3, "network").when(F.length("w") <= 6, "structure").otherwise("text")
    return explain.modality_report(_words(spark, sf_dir), "doc_id", m, "n")


@query("SELECT conv_id, turn AS a, turn + 1 AS b, max(s.w) AS weight FROM conversations c LEFT JOIN (SELECT conv_id AS k, turn AS i, turn + 2 AS f, length(text) AS w FROM conversations WHERE role = 'user') s ON c.conv_id = s.k AND s.i < c.turn + 1 AND c.turn < s.f GROUP BY conv_id, turn")
def span_overlap(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    t = c.select("conv_id", F.col("turn").alias("a"), (F.col("turn") + 1).alias("b"))
    s = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("i"), (F.col("turn") + 2).alias("f"), F.length("text").cast("long").alias("w"))
    return explain.overlapping(t, s, "conv_id")


@query("""WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1)::BIGINT AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), p AS (SELECT doc_id, i, CASE WHEN length(w) > 6 THEN '##' || w ELSE w END AS tok, length(w)::BIGINT AS x FROM t WHERE NOT regexp_matches(CASE WHEN length(w) > 6 THEN '##' || w ELSE w END, '(?s)^\\[.*\\]$')), g AS (SELECT *, sum(CASE WHEN starts_with(tok, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p)
SELECT doc_id, k::BIGINT AS position, string_agg(CASE WHEN starts_with(tok, '##') THEN substr(tok, 3) ELSE tok END, '' ORDER BY i) AS word, sum(x)::BIGINT AS weight FROM g GROUP BY doc_id, k""")
def wordpiece_merge(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    t = t.select("doc_id", "i", F.when(F.length("w") > 6, F.concat(F.lit("##"), "w")).otherwise(F.col("w")).alias("token"), F.length("w").cast("long").alias("x"))
    return explain.merge_wordpieces(t, "doc_id", "i", "token", "x").withColumn("position", F.col("position").cast("long"))


_PANEL = "SELECT c_custkey, " + ", ".join(f"(('0x' || substr(sha256('q{k}|' || c_custkey::VARCHAR), 1, 8))::BIGINT % 5)::INT + 1 AS q{k}" for k in range(1, 9)) + " FROM customer"


@query(f"WITH x AS ({_PANEL}) SELECT c_custkey, ({' + '.join(f'(q{k} >= 4)::INT' for k in range(1, 9))}) / 8.0::DOUBLE * 100 AS \"index\", ((q1 - 1) + (5 - q2) + (q3 - 1) + (5 - q4) + (q5 - 1) + (5 - q6) + (q7 - 1) + (5 - q8)) * 2.5::DOUBLE AS usability, (q1 + q2 + q3) / 3.0::DOUBLE AS quality FROM x")
def panel_scoring(spark, sf_dir):
    q = [f"q{k}" for k in range(1, 9)]
    h = lambda k: (F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"q{k}|"), F.col("c_custkey").cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(5)) + 1).cast("int")
    x = read(spark, sf_dir, "customer").select("c_custkey", *[h(k).alias(f"q{k}") for k in range(1, 9)])
    return explain.panel_scores(x, q[::2], q[1::2], q, q[:3], ["q1"]).select("c_custkey", "index", "usability", "quality")


@query("WITH x AS (SELECT label, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, avg(abs(v::DOUBLE)) AS m FROM x GROUP BY label), s AS (SELECT label, m / sum(m) OVER () AS share, count(*) OVER () AS k FROM m) SELECT label, round(share, 9) AS share, round(sum(-share * ln(share)) OVER () / ln(k), 9) AS evenness FROM s")
def attention_entropy(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")).select("label", F.abs(F.col("v").cast("double")).alias("w"))
    return _r(explain.attention_share(x, "label", "w"), share=9, evenness=9)


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + greatest(least(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.999) FROM lineitem WHERE l_orderkey % 5 <> 0)), 0)), 9) AS scaled FROM lineitem")
def winsor_log1p(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    bound = x.filter("l_orderkey % 5 <> 0").agg(F.percentile("l_extendedprice", F.lit(0.999)).alias("b")).first().b
    v = F.greatest(F.least(F.col("l_extendedprice"), F.lit(bound)), F.lit(0.0)) if bound and bound > 0 else F.greatest(F.col("l_extendedprice"), F.lit(0.0))
    return x.select("l_orderkey", "l_linenumber", F.round(F.log1p(v), 9).alias("scaled"))


@query(f"WITH {P} SELECT model, sum((y_true = 1 AND y_proba < 0.5)::INT)::BIGINT AS missed, sum(y_true)::BIGINT AS positives, sum((y_true = 1 AND y_proba < 0.5)::INT) / sum(y_true)::DOUBLE AS rate FROM predictions GROUP BY model")
def false_negative_rate(spark, sf_dir):
    return metrics.false_negatives(predictions(spark, sf_dir))


@query("SELECT doc_id, s AS share FROM (SELECT doc_id, (('0x' || substr(sha256('curve|' || doc_id::VARCHAR), 1, 8))::BIGINT % 10001) / 10000.0::DOUBLE AS u FROM documents), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(s) WHERE u <= s")
def training_fractions(spark, sf_dir):
    return sampling.fractions(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", "curve")


@query()
def equal_mass_sample(spark, sf_dir):
    return sampling.equal_mass(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 400, "mass")


@query(f"WITH {P}, w AS (SELECT id, max(y_true) AS y, max(y_proba) FILTER (model = 'alpha') AS a, max(y_proba) FILTER (model = 'beta') AS b FROM predictions GROUP BY id), f AS (SELECT id % 5 AS fold, avg(((a >= 0.5)::INT = y)::INT) AS a, avg(((b >= 0.5)::INT = y)::INT) AS b FROM w GROUP BY 1) SELECT count(*) AS folds, round(avg(a - b), 9) AS difference, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t, count(*) < 5 AS few FROM f")
def paired_t_test(spark, sf_dir):
    w = predictions(spark, sf_dir).groupBy("id").agg(F.max("y_true").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("y_proba"))).alias(c) for m, c in (("alpha", "a"), ("beta", "b"))])
    right = lambda c: F.avg(((F.col(c) >= 0.5).cast("int") == F.col("y")).cast("int")).alias(c)
    return _r(metrics.paired_t(w.groupBy((F.col("id") % 5).alias("fold")).agg(right("a"), right("b")), "a", "b"), difference=9, t=6)


@query("SELECT event_type, CASE WHEN s >= 3600 THEN format('{} h {} min', s // 3600, (s % 3600) // 60) WHEN s >= 60 THEN format('{} min', s // 60) ELSE format('{} s', s) END AS span FROM (SELECT event_type, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS s FROM events GROUP BY 1)")
def event_spans(spark, sf_dir):
    from quern.sources.logs import human_duration

    x = read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").cast("timestamp").alias("b"), F.min("ts").cast("timestamp").alias("a"))
    return x.select("event_type", human_duration(F.unix_seconds("b") - F.unix_seconds("a")).alias("span"))


@query("SELECT regexp_extract(c, '^(.)', 1) AS initial, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS c FROM benchmark) WHERE c <> '' AND length(c) BETWEEN 2 AND 20 AND length(regexp_replace(regexp_replace(c, '[-'']', '', 'g'), '[^\\p{L}]', '', 'g')) * 10 >= length(regexp_replace(c, '[-'']', '', 'g')) * 6 AND length(regexp_replace(c, '[-'']', '', 'g')) > 0 AND regexp_matches(c, '[aeiouáéíóú]') GROUP BY 1")
def legible_words(spark, sf_dir):
    w = read(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.lower("text"))).alias("w"))
    return w.filter(tx.legible(F.col("w"))).groupBy(F.substring("w", 1, 1).alias("initial")).agg(F.count("*").alias("n"))


# -- bands, encodings and orders ---------------------------------------------------------------------------------------
@query(f"WITH {P} SELECT model, id, greatest(y_proba, 1 - y_proba) AS confidence, CASE WHEN greatest(y_proba, 1 - y_proba) >= 0.99::DOUBLE THEN 'very high' WHEN greatest(y_proba, 1 - y_proba) >= 0.95::DOUBLE THEN 'high' WHEN greatest(y_proba, 1 - y_proba) >= 0.8::DOUBLE THEN 'medium' ELSE 'low' END AS band, CASE WHEN y_proba >= 0.7::DOUBLE THEN 'positive' WHEN y_proba <= 0.3::DOUBLE THEN 'negative' ELSE 'uncertain' END AS result FROM predictions")
def confidence_bands(spark, sf_dir):
    p = F.col("y_proba")
    return predictions(spark, sf_dir).select("model", "id", scores.confidence(p).alias("confidence"), scores.confidence_band(p).alias("band"), scores.result_band(p).alias("result"))


@query(f"WITH {M}, {P} SELECT doc_id FROM messages m JOIN predictions p ON m.doc_id = p.id AND model = 'alpha' WHERE (y_proba >= 0.5)::INT = toxic AND length(text) BETWEEN 250 AND 1600 AND length(trim(coalesce(subject, ''))) > 0 AND (greatest(y_proba, 1 - y_proba) >= 0.99::DOUBLE OR greatest(y_proba, 1 - y_proba) BETWEEN 0.5::DOUBLE AND 0.95::DOUBLE) AND lang IN ('en', 'es')")
def panel_candidates(spark, sf_dir):
    p = predictions(spark, sf_dir).filter("model = 'alpha'").select(F.col("id").alias("doc_id"), "y_proba")
    return scores.candidates(messages(spark, sf_dir).join(p, "doc_id"), "text", "subject", "y_proba", "toxic", "lang").select("doc_id")


@query(f"WITH {M}, g AS (SELECT CASE WHEN length(text) < 60 THEN 'undetermined' WHEN lang = 'en' THEN 'en' WHEN lang IS NULL THEN 'undetermined' ELSE 'other' END AS grp, toxic FROM messages) SELECT grp, count(*) AS n, count(*) >= 30 AND count(DISTINCT toxic) = 2 AS evaluable FROM g GROUP BY grp")
def language_groups(spark, sf_dir):
    x = messages(spark, sf_dir).select(scores.language_group(F.col("text"), F.col("lang")).alias("grp"), "toxic")
    return scores.evaluable(x, "grp", "toxic")


@query("WITH b AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, least(greatest((l_quantity - a) / (b - a), 0.0::DOUBLE), 1.0::DOUBLE) AS scaled, CASE lower(trim(l_returnflag)) WHEN 'a' THEN 1 WHEN 'n' THEN 2 ELSE 0 END AS flag FROM lineitem, b")
def scaled_and_indexed(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    r = x.filter("l_orderkey % 5 <> 0").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b")).first()
    return x.select("l_orderkey", "l_linenumber", scores.min_max(F.col("l_quantity"), F.lit(r.a), F.lit(r.b)).alias("scaled"), scores.category_index(F.col("l_returnflag"), ["a", "n"]).alias("flag"))


@query(f"WITH {P} SELECT model, round(avg(-(CASE WHEN y_true = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END) * pow(1 - q, 2) * ln(q)), 8) AS focal, round(avg(CASE WHEN y_true = 1 THEN -3.0::DOUBLE * ln(c) ELSE -ln(1 - c) END), 8) AS weighted FROM (SELECT *, greatest(CASE WHEN y_true = 1 THEN y_proba ELSE 1 - y_proba END, 1e-7::DOUBLE) AS q, least(greatest(y_proba, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS c FROM predictions) GROUP BY model")
def losses(spark, sf_dir):
    p, y = F.col("y_proba"), F.col("y_true")
    return _r(predictions(spark, sf_dir).groupBy("model").agg(F.avg(scores.focal_loss(p, y)).alias("focal"), F.avg(scores.weighted_cross_entropy(p, y, 3.0)).alias("weighted")), focal=8, weighted=8)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS shard FROM documents")
def stride_shards(spark, sf_dir):
    return scores.shards(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS turn FROM labels")
def interleaved_classes(spark, sf_dir):
    return scores.interleaved(read(spark, sf_dir, "labels"), "toxic", "doc_id").select("doc_id", "toxic", F.col("turn").cast("long").alias("turn"))


@query()
def length_batches(spark, sf_dir):
    return scores.length_batches(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16, "batch", 4)


@query(f"WITH {P}, x AS (SELECT *, sum(1 - y_true) OVER (PARTITION BY model ORDER BY y_proba DESC, id) AS above FROM predictions) SELECT model, round(1 - sum(above) FILTER (y_true = 1) / (sum(y_true) * sum(1 - y_true))::DOUBLE, 9) AS auc FROM x GROUP BY model")
def step_auc(spark, sf_dir):
    return _r(scores.step_auc(predictions(spark, sf_dir)), auc=9)


@query(r"WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS w FROM documents), x AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) AS w FROM benchmark WHERE item_id % 2 = 0) SELECT w, count(*) AS n FROM w WHERE w NOT IN (SELECT w FROM x) GROUP BY w ORDER BY n DESC, w LIMIT 25")
def frequent_words(spark, sf_dir):
    words = lambda t: read(spark, sf_dir, t[0]).filter(t[1]).select(F.explode(tx.tokens(F.lower("text"))).alias("w"))
    return scores.frequent_words(words(("documents", "true")), "w", words(("benchmark", "item_id % 2 = 0")).distinct(), 25)


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing.path'), ''), nullif(json_extract_string(props, '$.k'), '')) AS k FROM events")
def json_fallback(spark, sf_dir):
    first = lambda p: F.nullif(F.get_json_object("props", p), F.lit(""))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(first("$.missing.path"), first("$.k")).alias("k"))


@query("SELECT vec_id, round(exp((embedding[1] - list_max(embedding[1:4]))::DOUBLE) / list_sum(list_transform(embedding[1:4], lambda v: exp((v - list_max(embedding[1:4]))::DOUBLE))), 5) AS first FROM embeddings")
def softmax_rows(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(scores.softmax(v)[0], 5).alias("first"))


@query("SELECT o_custkey, o_orderkey, year(o_orderdate)::INT AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def year_windows(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.filter((F.col("o_orderdate") >= F.to_timestamp(F.lit("1994-01-01"))) & (F.col("o_orderdate") < F.to_timestamp(F.lit("1996-01-01")))).select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))


@query(f"WITH {P} SELECT model, round(avg(((y_proba >= 0.5)::INT = y_true)::INT), 9) AS accuracy, rank() OVER (ORDER BY avg(((y_proba >= 0.5)::INT = y_true)::INT) DESC) AS place FROM predictions GROUP BY model")
def leaderboard(spark, sf_dir):
    from pyspark.sql import Window

    x = predictions(spark, sf_dir).groupBy("model").agg(F.avg(((F.col("y_proba") >= 0.5).cast("int") == F.col("y_true")).cast("int")).alias("accuracy"))
    return _r(x.withColumn("place", F.rank().over(Window.orderBy(F.desc("accuracy"))).cast("long")), accuracy=9)  # a row for each model
