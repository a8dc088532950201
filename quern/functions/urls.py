"""URL and markup features, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import entropy

#: Fixed values.
SHORTENERS = ("bit.ly", "buff.ly", "cutt.ly", "goo.gl", "is.gd", "ow.ly", "rebrand.ly", "shorturl.at", "t.co", "tinyurl.com")
SUSPICIOUS_TLDS = ("click", "club", "country", "gq", "kim", "link", "ml", "review", "science", "support", "tk", "top", "work", "xyz", "zip")
TAGS = (
    "a abbr address area article aside audio b base big blockquote body br button caption center code col colgroup dd div dl dt em embed fieldset figcaption figure "
    "font footer form frame frameset h[1-6] head header hr html i iframe img input label legend li link main map meta nav noscript object ol option p param picture "
    "pre s script section select small source span strike strong style sub sup table tbody td textarea th thead title tr tt u ul video"
).split()
URL = r"(?i)https?://[^ \t\n\x0B\f\r]+|www\.[^ \t\n\x0B\f\r]+"
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"


def has_html(text: Column) -> Column:
    """Whether a tag with a recognised name occurs."""
    return F.coalesce(text.rlike(rf"(?i)</?(?:{'|'.join(TAGS)})\b[^>]*>"), F.lit(False)).cast("int")


def extract_urls(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), F.array().cast("array<string>"))


def extract_ips(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(IP), F.lit(0)), F.array().cast("array<string>"))


def network_indicators(text: Column) -> Column:
    """URLs as found, then IP literals, joined by ', '; null if there is none."""
    both = F.concat(extract_urls(text), extract_ips(text))
    return F.when(F.size(both) > 0, F.array_join(both, ", "))


def trim_url(url: Column) -> Column:
    """Cut at the first quote or angle bracket, then closing punctuation dropped."""
    return F.regexp_replace(F.regexp_extract(url, "^([^\"'<>]*)", 1), r"[.,;:)\]}'\"]+$", "")


def host(url: Column) -> Column:
    """Lower-cased network location without user and port; null if there is none."""
    full = F.when(F.lower(url).startswith("www."), F.concat(F.lit("http://"), url)).otherwise(url)
    loc = F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.nullif(F.regexp_extract(F.regexp_replace(loc, "^.*@", ""), "^([^:]*)", 1), F.lit(""))


def bare_host(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def is_ip(h: Column) -> Column:
    return h.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")


def digit_ratio(url: Column) -> Column:
    return F.when(F.length(url) > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / F.length(url)).otherwise(F.lit(0.0))


def subdomains(h: Column) -> Column:
    return F.when(is_ip(h), 0).otherwise(F.greatest(F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) - 1, F.lit(0)))


def lexical(urls: Column) -> dict[str, Column]:
    """Maxima and flags over an array of URLs."""
    trimmed = F.filter(F.transform(urls, trim_url), lambda u: F.length(u) > 0)
    hosts = F.filter(F.transform(trimmed, host), lambda h: h.isNotNull())
    most = lambda a, zero: F.coalesce(F.array_max(a), zero)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "url_max_length": most(F.transform(trimmed, F.length), F.lit(0)),
        "url_max_digit_ratio": most(F.transform(trimmed, digit_ratio), F.lit(0.0)),
        "url_max_subdomain_count": most(F.transform(hosts, subdomains), F.lit(0)),
        "url_has_at_symbol": flag(F.exists(trimmed, lambda u: F.contains(u, F.lit("@")))),
        "url_has_shortener": flag(F.exists(hosts, lambda h: bare_host(h).isin(*SHORTENERS))),
        "url_has_suspicious_tld": flag(F.exists(hosts, lambda h: ~is_ip(h) & F.regexp_extract(h, r"\.([^.]+)$", 1).isin(*SUSPICIOUS_TLDS))),
        "url_domain_max_entropy": most(F.transform(hosts, entropy), F.lit(0.0)),
    }


def markup_counts(html: Column) -> dict[str, Column]:
    """Counts and flags by tag, over recognised markup."""
    times = lambda tag: F.coalesce(F.regexp_count(html, F.lit(rf"(?i)<{tag}\b[^>]*>")), F.lit(0))
    any_ = lambda tag: (times(tag) > 0).cast("int")
    return {
        "num_links": times("a"), "num_images": times("img"), "has_form": any_("form"), "has_iframe": any_("iframe"), "has_javascript": any_("script"),
        "has_ip_link": F.coalesce(html.rlike(r"(?i)href\s*=\s*[\"']?[^\"'> ]*(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), F.lit(False)).cast("int"),
    }
