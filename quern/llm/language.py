"""Language ID by word-first backoff.

Known words count with their log frequency in each language. An unseen word falls back to its character n-grams,
longest first: the first length of which any n-gram is known gives the word's score, the mean over those known.

The model is fitted on a bounded sample (about ``SAMPLE`` documents of each language, chosen by hash of the id) and
keeps at most ``WORDS`` words, dealt evenly among the languages, at least ``LEAST`` of each, so what is sent to the
executors is bounded whatever the table's size, and a rare language has its share. No language is left out.

Defined results: null text, empty text and text without letters are ``und`` with score 0; ties go to the language
first by code point; whole texts count, however long; equal texts, so repeated rows too, get equal predictions; an empty
table gives an empty result, and a model fitted on nothing calls everything ``und``; extra columns, whatever their names,
are left out of predictions and stay as they are in ``recognised``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import released

#: Bounds of the model: documents of each language in the sample, words kept in all, words of each language that are kept
#: in any case, longest n-gram.
SAMPLE = 1500
WORDS = 40_000
LEAST = 200
LONGEST = 4
#: Score from which a language counts as recognised: it is likelier than all others together.
CERTAIN = 0.5
#: Unseen words whose scores a task keeps at hand.
HELD = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def training_rows() -> Column:
    """The rule of the production query: documents whose crc32 of the id, mod 3, is not 1."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


class Model:
    def __init__(self, langs: list[str], words: dict[str, int], grams: list[dict[str, int]], table: np.ndarray):
        """table: a row of log frequencies for each word and n-gram; grams[n]: n-grams of n characters."""
        self.langs, self.words, self.grams, self.table = langs, words, grams, table


def fit(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS, longest: int = LONGEST) -> Model:
    """docs (doc_id, text, lang): the labelled rows that may be learned from."""
    x = docs.filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in x.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, [{} for _ in range(longest + 1)], np.zeros((0, 0)))
    wide = 1_000_000
    share = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(wide, -(-wide * sample // sizes[lang])))])
    x = x.filter(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < F.element_at(share, F.col("lang")))
    seen = x.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}++"), F.lit(0))).alias("word"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = seen.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("rank", rank).filter(F.col("rank") <= max(LEAST, words // len(langs))).orderBy("lang", "rank").toPandas()
    at = {lang: k for k, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for lang, word, n in zip(top["lang"], top["word"], top["n"], strict=True):
        counts[word][at[lang]] += n
    by_length: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(longest + 1)]
    for word, c in counts.items():
        marked = f"^{word}$"
        for n in range(1, longest + 1):
            for k in range(len(marked) - n + 1):
                if (gram := marked[k : k + n]) not in "^$":  # the marks alone say nothing
                    by_length[n][gram] += c
    rows: list[np.ndarray] = []

    def logs(of: dict[str, np.ndarray]) -> dict[str, int]:
        total = np.sum(list(of.values()), axis=0) if of else 0
        index = {}
        for k in sorted(of):
            index[k] = len(rows)
            rows.append(np.log((of[k] + 0.1) / (total + 0.1 * len(of))))
        return index

    index = logs(counts)
    grams = [logs(g) for g in by_length]
    return Model(langs, index, grams, np.array(rows))


def backoff(model: Model, word: str) -> np.ndarray:
    """The score of an unseen word, told plainly; Predictor has it for many words at once."""
    marked = f"^{word}$"
    for n in range(min(len(model.grams) - 1, len(marked)), 0, -1):
        g = model.grams[n]
        rows = [i for k in range(len(marked) - n + 1) if (i := g.get(marked[k : k + n])) is not None]
        if rows:
            return model.table[rows].mean(axis=0)
    return np.zeros(len(model.langs))


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A value for each run of n characters."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k] + np.uint64(1)
    return h


class _Rows(dict):
    """Word -> row of scores; an unseen word gets the next row and is noted."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self.pending.append(word)
        self[word] = row = len(self)
        return row


class Predictor:
    """A model, and the scores of the unseen words that a task has met."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = []
        for n, g in enumerate(model.grams):
            keys = _hashes(np.frombuffer("".join(g).encode("utf-32-le"), np.uint32).astype(np.uint64), n)[:: n] if g else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            self.grams.append((keys[order], np.fromiter(g.values(), np.int64, len(g))[order]))
        self.forget()

    def forget(self) -> None:
        m = self.model
        self.rows = _Rows(m.words)
        self.table = np.zeros((len(m.words) + HELD, len(m.langs)))
        self.table[: len(m.words)] = m.table[: len(m.words)]
        self.letters = np.ones(len(self.table), bool)

    def learn_pending(self) -> None:
        words = self.rows.pending
        if not words:
            return
        first = len(self.rows) - len(words)
        if len(self.rows) > len(self.table):
            more = max(len(self.rows) - len(self.table), len(self.table) // 2)
            self.table = np.vstack([self.table, np.zeros((more, self.table.shape[1]))])
            self.letters = np.concatenate([self.letters, np.ones(more, bool)])
        plain = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words]
        self.letters[first : first + len(words)] = [bool(w) for w in plain]
        marked = "^" + "$^".join(plain) + "$"
        codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
        owner = np.repeat(np.arange(len(words)), sizes)
        scores, open_ = np.zeros((len(words), self.table.shape[1])), np.ones(len(words), bool)
        for n in range(len(self.grams) - 1, 0, -1):
            keys, rows = self.grams[n]
            if not len(keys) or len(codes) < n:
                continue
            o = owner[: len(codes) - n + 1]
            at = np.flatnonzero((o == owner[n - 1 :]) & open_[o])
            h = _hashes(codes, n)[at]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            o, r = o[at][hit], rows[k[hit]]
            times = np.bincount(o, minlength=len(words))
            got = times > 0
            for c in range(scores.shape[1]):
                scores[got, c] = np.bincount(o, self.model.table[r, c], len(words))[got] / times[got]
            open_ &= ~got
        self.table[first : first + len(words)] = scores
        self.rows.pending = []

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Predictions for some texts, taken together."""
        m, out = self.model, [("und", 0.0)] * len(texts)
        if not m.langs:
            return out
        found = [Counter(_WORD.findall(t.lower())) if t else {} for t in texts]
        rows = [[self.rows[w] for w in f] for f in found]
        self.learn_pending()
        for k, (f, r) in enumerate(zip(found, rows, strict=True)):
            if not r or not self.letters[r].any():
                continue
            n = np.fromiter(f.values(), float, len(f))
            total = n @ self.table[r]
            p = np.exp((total - total.max()) / max(1.0, n.sum() ** 0.5))
            best = int(np.argmax(total))
            out[k] = (m.langs[best], float(p[best] / p.sum()))
        if len(self.rows) > len(m.words) + HELD:
            self.forget()
        return out


def by_size(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    """Runs of texts of about most characters."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def predict(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred and score of each row, from its whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams, model.table))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(Model(*sent.value))
        for b in batches:
            out = [x for texts in by_size(b.column(1).to_pylist()) for x in p(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(released(run), f"`{id_col}` {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, text: str = "text", accepted: list[str] | None = None, least: float = CERTAIN) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in an accepted language (None: any that the model has),
    predicted with a score of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams, model.table))
    at = docs.columns.index(text)
    wanted = set(model.langs if accepted is None else accepted) - {"und"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(Model(*sent.value))
        for b in batches:
            known = [lang in wanted and score >= least for texts in by_size(b.column(at).to_pylist()) for lang, score in p(texts)]
            yield b.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
