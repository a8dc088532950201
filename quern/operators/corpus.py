"""The canonical message table: projection, labels, source families, availability of modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text, urls

#: Canonical columns in order, their types, and the default of a missing one (None: null).
CANONICAL = (
    ("email_id", "string", None), ("source_dataset", "string", None), ("label", "int", None), ("label_text", "string", None), ("subject", "string", None), ("sender", "string", None), ("sent_date", "timestamp", None),
    ("body_raw", "string", None), ("body_plain", "string", None), ("body_html", "string", None), ("clean_text", "string", ""), ("has_html", "int", 0), ("network_indicators", "string", None),
    ("num_links", "int", 0), ("num_images", "int", 0), ("has_form", "int", 0), ("has_iframe", "int", 0), ("has_javascript", "int", 0), ("has_ip_link", "int", 0), ("word_count", "int", 0), ("received_origin_ip", "string", None),
    ("spf_result", "string", None), ("dkim_result", "string", None), ("dmarc_result", "string", None), ("num_urls_metadata", "int", 0), ("language", "string", None), ("processing_status", "string", None), ("processing_error", "string", None),
    ("template_cluster_id", "string", None), ("url_max_length", "int", 0), ("url_max_digit_ratio", "double", 0.0), ("url_max_subdomain_count", "int", 0), ("url_has_at_symbol", "int", 0), ("url_has_shortener", "int", 0),
    ("url_has_suspicious_tld", "int", 0), ("url_domain_max_entropy", "double", 0.0), ("total_nodos_dom", "int", 0), ("profundidad_dom", "int", 0),
)


def canonical(df: DataFrame) -> DataFrame:
    """The canonical columns in order; missing ones get their default, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(d)).cast(k).alias(c) for c, k, d in CANONICAL])


def canonical_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k, _ in CANONICAL])


def missing_columns(df: DataFrame, required=tuple(c for c, _, _ in CANONICAL), strict: bool = True) -> list[str]:
    """Required columns that df lacks; with strict an error if there is any."""
    gone = [c for c in required if c not in df.columns]
    if gone and strict:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return gone


#: Fixed values.
POSITIVE = ("phishing email", "phishing", "spam", "1", "malicious")
NEGATIVE = ("safe email", "safe", "ham", "genuine", "legitimate", "0", "benign")


def normalise_label(c: Column, numeric: bool = False) -> Column:
    """1 or 0 from a number (its whole part), a token or a substring, positives first; anything else is null."""
    if numeric:
        whole = c.cast("int")
        return F.when(whole.isin(0, 1), whole)
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*POSITIVE) | F.contains(t, F.lit("phish")), 1).when(t.isin(*NEGATIVE) | F.contains(t, F.lit("safe")), 0)


#: Exact names before prefixes.
FAMILIES_EXACT = ("CEAS_08", "Kaggle", "Nazario", "SpamAssassin", "datacon2023", "phishing_pot")
FAMILIES_PREFIX = (("PhishMMF", "PhishMMF"), ("Kaggle", "Kaggle_Phishing_Email"), ("Spam", "Spam_Genuine_Mail"))


def source_family(c: Column) -> Column:
    """The family of a source: exact names, then prefixes, else the name itself; null is Unknown."""
    out = F.when(c.isNull(), "Unknown").when(c.isin(*FAMILIES_EXACT), c)
    for k, v in FAMILIES_PREFIX:
        out = out.when(c.startswith(k), v)
    return out.otherwise(c)


def with_availability(df: DataFrame) -> DataFrame:
    """Whether text (always), structure (has_html = 1) and network (indicators other than 'None') are there."""
    return df.withColumns({"has_text_modality": F.lit(True), "has_structure_modality": F.coalesce(F.col("has_html") == 1, F.lit(False)), "has_network_modality": F.coalesce("network_indicators", F.lit("None")) != "None"})


def profile() -> Column:
    s, n = F.col("has_structure_modality"), F.col("has_network_modality")
    return F.when(s & n, "text+structure+network").when(s, "text+structure").when(n, "text+network").otherwise("text")


def fold_of(family: Column, composition: dict[str, str], families: set[str]) -> Column:
    """The fold of a family by composition if that covers all families, else the family itself."""
    if not families <= set(composition):
        return family
    return F.create_map(*[F.lit(x) for kv in composition.items() for x in kv])[family]


def without_branch(df: DataFrame, numeric: list[str], categorical: list[str], flag: str, blank_text: bool = False) -> DataFrame:
    """A branch taken away: numbers 0, categories null, its flag false, the text blank if asked."""
    out = {c: F.lit(0).cast(df.schema[c].dataType) for c in numeric} | {c: F.lit(None).cast(df.schema[c].dataType) for c in categorical} | {flag: F.lit(False)}
    return df.withColumns(out | ({"clean_text": F.lit("")} if blank_text else {}))


def body_features(df: DataFrame, body: str = "body_raw") -> DataFrame:
    """All features that follow from the body, by one code path for every source."""
    b = F.col(body)
    x = df.withColumns({"has_html": urls.has_html(b), "network_indicators": urls.network_indicators(b), "word_count": text.word_count(b).cast("int"), "num_urls_metadata": F.size(urls.extract_urls(b))})
    x = x.withColumns(urls.markup_counts(b))
    return x.withColumn("_urls", urls.extract_urls(b)).withColumns(urls.lexical(F.col("_urls"))).drop("_urls")


def clean_csv_bodies(df: DataFrame, body: str, label: str) -> DataFrame:
    """In this order: rows without body or label go, the body 'empty' goes, copies of a body go (the first by order
    column stays), bodies without words go, labels are normalised and unknown ones go."""
    from quern.operators.dedup import keep_first

    x = df.filter(F.col(body).isNotNull() & F.col(label).isNotNull()).filter(F.lower(F.trim(F.col(body))) != "empty")
    x = keep_first(x, F.col(body), "ordinal") if "ordinal" in x.columns else x.dropDuplicates([body])
    x = x.filter(text.word_count(F.col(body)) > 0).withColumn("label", normalise_label(F.col(label)))
    return x.filter("label is not null")


def long_enough(plain: Column, clean: Column | None = None) -> Column:
    """Raw mail: six characters or more in body and clean text."""
    ok = F.length(F.trim(plain)) >= 6
    return ok if clean is None else ok & (F.length(F.trim(clean)) >= 6)
