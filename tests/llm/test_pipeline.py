"""The pipeline's stages on the smallest tables, and the queries against their SQL."""

import hashlib
import os

import duckdb
import pytest

import corpus_pipeline
from quern.llm import pieces, queries

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "source_mix", "sampled_pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, no id, clashing columns: each stage has its defined result."""
    base = " ".join(f"the word{k % 37} of and in is" for k in range(60))
    other = " ".join(f"die und der wort{k % 31} ist nicht" for k in range(60))
    texts = [(1, base, "en"), (1, base, "en"), (2, base + " end", "en"), (3, other, "de"), (4, None, "en"), (5, "", None), (6, "123 456 --", "de"), (None, other, "de"), (7, "the of and " * 20_000, "en"), (8, "und der die nicht ist", "de"), (9, "Z" * 40_000, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, owner string, key int, _part string, _gone int, _row int, sample int, size double, score string"
    docs = spark.createDataFrame([(i, t, lang, None if k % 4 == 0 else "s", len(t or ""), "o", 1, "p", 2, 3, 4, 5.0, "x") for k, (i, t, lang) in enumerate(texts)], schema)
    empty = docs.limit(0)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == docs.columns and stage(spark, empty, SF).count() == 0
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id or 0 for r in out.collect()))
        assert {(r.owner, r.key, r._part, r._gone, r._row, r.sample, r.size, r.score) for r in out.collect()} == {("o", 1, "p", 2, 3, 4, 5.0, "x")}
    assert set(kept["language_id"]) >= {0, 1, 2, 3, 7, 8} and not {4, 5, 6} & set(kept["language_id"])
    assert kept["near_duplicates"] == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert kept["repeated_passages"] == sorted(i or 0 for i, _, _ in texts)
    assert not {4, 5} & set(kept["source_mix"])
    last = corpus_pipeline.sampled_pieces(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in last.collect()) == sorted(i or 0 for i, _, _ in texts) and corpus_pipeline.sampled_pieces(spark, empty, SF).count() == 0


def test_sampled_pieces(spark):
    """All of K segmentations of each row, repeated rows too, and what they decode to; batches end within a row's."""
    texts = [(k % 17, f"some words of text number {k % 17}, and more") for k in range(40)] + [(99, ""), (98, None), (97, "é😀 日本")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = corpus_pipeline.sampled_pieces(spark, docs, SF).collect()
        want = {(r.doc_id, r.sample): (r.ids, r.log_prob, r.log_inclusion) for r in pieces.encode(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in texts)
    for r in got:
        assert [s.sample for s in r.samples] == ([1] if r.doc_id in (98, 99) else [1, 2]) and len({tuple(s.ids) for s in r.samples}) == len(r.samples)
        for s in r.samples:
            ids, *logs = want[r.doc_id, s.sample]
            assert s.ids == ids and [s.log_prob, s.log_inclusion] == pytest.approx(logs)
            assert s.decoded_sha256 == hashlib.sha256((dict(texts)[r.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
