"""URL filters: rules indexed by their rarest literal token; only fetched rules run regular expressions.

A rule is a host with a path prefix (``com/en/``) or a pattern over host and path in which ``*`` stands for any
run of characters. Each rule has literal tokens: runs of a-z0-9 that must stand as whole tokens in each URL that it
fits. Of these the one seen least often in the URL table itself is the rule's key in a hash index, held in the plan
as a literal whose size is that of the rule list. A URL's tokens fetch the candidates; no row is shuffled.

Defined results: a null URL or one without ``://`` has empty host and path and fits only rules without tokens; whole URLs
count, however long; of rules of equal length block wins, then the first by text; repeated rows are judged alike; an
empty table gives an empty result; a column of the caller's whose name clashes with an added one is kept under that name
with an underscore (or more) behind it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, unused


@dataclass(frozen=True)
class Rule:
    """name: as it is reported. A host rule has host and path; a pattern rule has pattern. method: not of the caller."""

    name: str
    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    method: bool = False

    def regex(self) -> str:
        """Over host followed by path; a host holds no slash, a path is empty or begins with one."""
        if self.pattern:
            return "(?s)" + ".*".join(_quoted(x) for x in self.pattern.split("*"))
        return "(?s)^(?:[^/]*\\.)?" + _quoted(self.host + self.path)

    def tokens(self) -> list[str]:
        """Tokens that any URL with this rule must have whole: those bounded by literals on both sides."""
        if self.pattern:
            parts = self.pattern.lower().split("*")
            return [m[0] for p in parts for m in re.finditer(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", p)]
        whole = "." + self.host.lower() + self.path.lower()
        return [m[0] for m in re.finditer(r"[a-z0-9]+(?=[^a-z0-9])", whole)]


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s) if s.isascii() else "\\Q" + s.replace("\\E", "") + "\\E"


def host_rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(text, verdict, host.lower(), "/" + path)


#: The caller's rules of the production query.
RULES = (host_rule("block", "com/en/"), host_rule("allow", "example.com/en/7"), host_rule("allow", "net/de/"), host_rule("block", "example.net/de/8"), host_rule("block", "org/es/"))
#: The method's own: places that crawls commonly refuse. Fixed values.
PATTERNS = tuple(Rule(p, "block", pattern=p, method=True) for p in (".spam-*", "spam-farm.", "-casino.", ".casino.", ".porn.", ".xxx/", ".adult.", "/ads/", "/banner/", "/popup/", "/login/", "/signup/", "/cart/", "/checkout/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    head = F.regexp_extract(rest, r"^([^?#]*)", 1)
    cut = F.instr(head, "/")
    host = F.when(cut > 0, F.substring(head, F.lit(1), cut - 1)).otherwise(head)
    path = F.when(cut > 0, F.substring(head, cut, F.length(head))).otherwise(F.lit(""))
    return ascii_lower(host), path


def url_tokens(c: Column) -> Column:
    """Distinct runs of a-z0-9."""
    return F.array_distinct(F.array_remove(F.split(ascii_lower(c), "[^a-z0-9]+"), ""))


def token_counts(tokens: DataFrame, wanted: list[str]) -> dict[str, int]:
    """tokens: one column of arrays. How many URLs have each of the rules' tokens; the result is bounded by the rules."""
    only = tokens.select(F.explode(F.array_intersect(tokens[tokens.columns[0]], F.array(*[F.lit(t) for t in wanted]))).alias("t")) if wanted else None
    return {r.t: r.n for r in only.groupBy("t").agg(F.count("*").alias("n")).collect()} if wanted else {}


#: Columns that judge() adds.
ADDED = ("host", "path", "rule", "verdict", "pattern", "n_candidates")
_ENTRIES = "array<struct<key:string,rank:int,name:string,verdict:string,method:boolean,regex:string>>"


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode()) % slots


def _index(keyed: list[tuple[int, Rule, str]], slots: int) -> Column:
    """A literal hash table: slots buckets by crc32 of the key token, each an array of entries."""
    entries: dict[int, list[Column]] = {}
    for rank, r, key in keyed:
        e = F.struct(*[F.lit(v).alias(k) for k, v in (("key", key), ("rank", rank), ("name", r.name), ("verdict", r.verdict), ("method", r.method), ("regex", r.regex()))])
        entries.setdefault(_slot(key, slots), []).append(e)
    return F.array(*[F.array(*entries.get(k, [])).cast(_ENTRIES) for k in range(slots)])


def judge(pages: DataFrame, rules=RULES, patterns=PATTERNS, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, pattern and n_candidates added; a caller's rule wins over patterns.

    Of several rules that fit, the one with the longest text wins, then block, then by text.
    """
    x = pages
    for c in pages.columns:
        if c.lower() in ADDED:
            free = unused(x, c)
            x, url = x.withColumnRenamed(c, free), free if c == url else url
    own = [unused(x, c) for c in ("_whole", "_tokens", "_found", "_best")]
    whole, tokens, candidates, best = own
    host, path = host_and_path(F.col(f"`{url}`"))
    x = x.withColumns({"host": host, "path": path})
    x = x.withColumn(whole, F.concat("host", "path"))
    x = x.withColumn(tokens, url_tokens(F.col(whole)))
    every = [*rules, *patterns]
    order = sorted(every, key=lambda r: (r.method, -len(r.name), r.verdict != "block", r.name))
    counts = token_counts(x.select(tokens), sorted({t for r in every for t in r.tokens()}))
    keyed = [(k, r, min(r.tokens(), key=lambda t: (counts.get(t, 0), t)) if r.tokens() else "") for k, r in enumerate(order)]
    slots = max(1, 2 * len(keyed))
    index = _index(keyed, slots)
    fetch = F.concat(F.col(tokens), F.array(F.lit("")))  # rules without a token are candidates for every URL
    found = F.flatten(F.transform(fetch, lambda t: F.filter(F.element_at(index, (F.crc32(t) % slots + 1).cast("int")), lambda e: e["key"] == t)))
    x = x.withColumn(candidates, found)
    fits = F.array_sort(F.transform(F.filter(candidates, lambda e: F.regexp_like(F.col(whole), e["regex"])), lambda e: F.struct(e["rank"], e["name"], e["verdict"], e["method"])))
    x = x.withColumn(best, F.try_element_at(fits, F.lit(1)))
    name, method = F.col(f"{best}.name"), F.col(f"{best}.method")
    return x.withColumns({"rule": F.when(~method, name), "pattern": F.when(method, name), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default)), "n_candidates": F.size(candidates)}).drop(*own)
