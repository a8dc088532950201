"""License scans: one Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser evaluates
the and/or/with expressions that follow a tag.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII; a phrase stands where its words follow each
other. Labels: those of the phrases, and the lower-cased identifiers of each expression that parses.

Defined results: null and empty texts have no words, no places, empty labels and score 0; whole texts are read,
however long, and each tag of a line; repeated rows give equal rows; an expression that doesn't parse adds no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The caller's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own notice phrases and labels.
PHRASES = {
    "affero general public license": "agpl", "apache license": "apache", "boost software license": "boost", "bsd license": "bsd", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0",
    "creative commons": "cc", "eclipse public license": "epl", "isc license": "isc", "lesser general public license": "lgpl", "mit license": "mit", "mozilla public license": "mpl", "public domain": "public-domain", "unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: Identifiers that an evaluation grants unless told otherwise. Fixed values.
PERMISSIVE = frozenset({"0bsd", "apache-2.0", "boost-1.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"})

_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """Reverse Polish form of the longest expression at the start of the text, by shunting-yard; None if there is none."""
    out: list[str] = []
    stack: list[str] = []
    done: list[str] | None = None
    operand, at = True, 0  # operand: an identifier or "(" must come next
    while m := _TOKEN.match(expression, at):
        t = m[1]
        word = t.lower()
        if operand:
            if t == "(":
                stack.append(t)
            elif t == ")" or word in _BINDS:
                break
            else:
                out.append(word)
                operand = False
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif word in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            break
        at = m.end()
        if not operand and "(" not in stack:
            done = out + stack[::-1]
    return done


def granted(polish: list[str], allowed=PERMISSIVE) -> bool:
    """Whether an allowed choice exists: ``or`` takes either side, ``and`` needs both, ``with`` keeps its licence's value."""
    stack: list[bool] = []
    for t in polish:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if t == "or" else a and b if t == "and" else a)
        else:
            stack.append(t.rstrip("+") in allowed)
    return stack[0]


def identifiers(polish: list[str]) -> list[str]:
    """Licences, with their exception if any."""
    stack: list[list[str]] = []
    for t in polish:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append([f"{x} with {y}" for x in a for y in b] if t == "with" else a + b)
        else:
            stack.append([t])
    return stack[0]


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAGGED = re.compile(r"(?<![0-9a-z\x80-\U0010ffff])spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier(?![0-9a-z\x80-\U0010ffff])\s*:?", re.IGNORECASE | re.ASCII)
_BREAK = re.compile(r"[\r\n]")


def automaton(base=BASE, phrases=PHRASES):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, label in [*phrases.items(), (TAG, ""), *base.items()]:
        a.add_word(f" {p} ", (len(p) + 2, label, p in base))
    a.make_automaton()
    return a


def tagged_texts(text: str) -> Iterator[str]:
    """What follows each tag, up to the end of its line or the next tag."""
    found = list(_TAGGED.finditer(text))
    for m, after in zip(found, [*(n.start() for n in found[1:]), len(text)], strict=True):
        end = _BREAK.search(text, m.end(), after)
        yield text[m.end() : end.start() if end else after]


def scan_text(text: str | None, a, allowed=PERMISSIVE) -> dict:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    flat = " " + b" ".join(words).decode("latin-1") + " "
    hits = sorted((end - n + 1, label, base) for end, (n, label, base) in a.iter(flat))
    labels, base_labels, n_base, first, last, at, seen, tagged = set(), set(), 0, None, None, 0, 0, False
    for start, label, base in hits:
        if not label:
            tagged = True
            continue
        labels.add(label)
        if base:
            seen += flat.count(" ", at, start)
            at = start
            base_labels.add(label)
            n_base += 1
            first, last = seen if first is None else first, seen
    expressions, permitted = [], None
    for after in tagged_texts(text) if tagged else ():
        if polish := parse(after):
            expressions.append(" ".join(polish))
            labels.update(identifiers(polish))
            permitted = granted(polish, allowed) if permitted is None else permitted and granted(polish, allowed)
    score = 1.0 if expressions else 1 - 0.5 ** len(labels) if labels else 0.0
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": score, "expressions": expressions, "permitted": permitted}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"
_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permitted", pa.bool_())])


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", base=BASE, phrases=PHRASES, allowed=PERMISSIVE) -> DataFrame:
    """A row for each row of docs: its id and what its whole text holds."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(base, phrases)
        for b in batches:
            found = [scan_text(t, a, allowed) for t in b.column(1).to_pylist()]
            cols = pa.Table.from_pylist(found, schema=_ARROW).combine_chunks()
            yield pa.RecordBatch.from_arrays([b.column(0), *(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in cols.columns)], names=[id_col, *_ARROW.names])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
