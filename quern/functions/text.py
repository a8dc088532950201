"""Scalar functions on message text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(text: Column) -> Column:
    """Hash of the text with runs of white space as one space, trimmed, lower-cased. Null stays null."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))), 256)


def content_id(*fields: Column) -> Column:
    """An id from the content alone: SHA-256 of the fields (null as empty) with NUL between, in the form of a UUID."""
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")


def word_count(text: Column) -> Column:
    """Words between white space; null counts 0."""
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-word shingles of the lower-cased text, empty if it has fewer words."""
    t = tokens(F.lower(text))
    # the token array is bound once by the outer transform, not split again for each shingle
    made = F.transform(F.array(t), lambda a: F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), lambda i: F.array_join(F.slice(a, i, k), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.coalesce(made[0], F.array().cast("array<string>")))


def present(c: Column, kind: str) -> Column:
    """Not null and, for strings, not blank."""
    return c.isNotNull() & (F.length(F.trim(c)) > 0) if kind == "string" else c.isNotNull()


def legible(word: Column) -> Column:
    """2 to 20 characters, at least 60 % letters once - and ' are dropped, and a vowel, plain or with an acute accent."""
    bare = F.regexp_replace(word, "[-']", "")
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    return F.length(word).between(2, 20) & (F.length(bare) > 0) & (letters * 10 >= F.length(bare) * 6) & F.lower(word).rlike("[aeiouáéíóú]")


def token_kind(token: Column) -> Column:
    """What an illegible token is: punctuation (no letter or digit), figure (digits and . , : / -), other alphabet (letters,
    none of them ASCII), abbreviation (at most five ASCII letters), else encoded."""
    return (
        F.when(~token.rlike(r"[\p{L}\p{N}]"), "punctuation").when(token.rlike(r"^[\p{Nd}.,:/-]+$"), "figure").when(token.rlike(r"\p{L}") & ~token.rlike("[A-Za-z]"), "other alphabet")
        .when(token.rlike("^[A-Za-z]{1,5}$"), "abbreviation").otherwise("encoded")
    )


def visible_body(text: Column, most: int = 1600) -> Column:
    """CRLF as LF, three or more newlines as two; cut at the last space before ``most`` characters and marked."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n")
    head = F.substring(t, 1, most)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" [...]")))


def defanged(text: Column) -> Column:
    """Links that no longer work: http as hxxp, dots of hosts and addresses bracketed once; phone numbers masked."""
    t = F.regexp_replace(F.regexp_replace(text, "(?i)http", "hxxp"), r"(?<!\[)\.(?=[A-Za-z0-9])", "[.]")
    return F.regexp_replace(F.regexp_replace(t, r"[A-Za-z0-9._-]+@[A-Za-z0-9\[\].-]+", "[address]"), r"\+?[0-9][0-9 -]{7,}[0-9]", "[phone]")


def clean_lines(text: Column) -> Column:
    """Lines stripped, runs of blank lines as one."""
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), "\n")
    return F.trim(F.regexp_replace(lines, "\n{3,}", "\n\n"))


#: The swaps of the look-alike edit.
LOOKALIKES = {"a": "а", "c": "с", "e": "е", "i": "і", "o": "о", "p": "р", "x": "х", "y": "у"}


def lookalike(text: Column) -> Column:
    """All eligible letters replaced (intensity 1); intensity 0 is the text itself."""
    return F.translate(text, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def zero_width(text: Column) -> Column:
    """A zero-width space after each letter of words (intensity 1)."""
    return F.regexp_replace(text, r"([A-Za-z])", "$1​")


def entities(text: Column) -> Column:
    """& < > as HTML entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def entropy(s: Column) -> Column:
    """Shannon entropy of a string's characters, in bits; 0 if empty."""
    chars = F.split(s, "")
    n = F.length(s).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    total = F.aggregate(F.array_sort(F.array_distinct(F.filter(chars, lambda x: x != ""))), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(F.length(s) > 0, total).otherwise(F.lit(0.0))
