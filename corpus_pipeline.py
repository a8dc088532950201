"""A training corpus from the table documents: recognised language, one of each group of near-duplicates, repeated
passages cut out, sources mixed to target weights, and the result encoded in sampled pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents, extra ones too, whatever their names.

Defined results of the stages on awkward rows: null and empty texts, and texts without letters, have no language and go
in the first stage, as do those whose best language has less than half of the likelihood; in the later ones they stay
(without words a text is taken by no mix). Rows without an id are never near-duplicates, count as the last in the cutting
of passages, and have key 0 in sampling. Repeated rows are near-duplicates of one another: one stays. Very long texts are
worked on whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard, language, mixing, pieces, suffixes
from quern.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose predicted language is none or less likely than all others together."""
    return language.recognised(docs, language.fit(docs.filter(language.training_rows())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link by word shingles the one with the smallest id stays."""
    return jaccard.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a long string that also starts in a document with a smaller id are cut out."""
    columns = docs.columns
    cut = suffixes.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else cut


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, in order of training position."""
    return mixing.mixed_documents(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, samples: of each the sampled segmentations (sample, ids, log_prob, log_inclusion, and the length, checksum
    and SHA-256 of what the ids decode to), as many as op4 draws."""
    return pieces.round_trip(docs, by_document=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("sampled_pieces", sampled_pieces)]

#: Language models, sketches and sampling have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()  # nothing reads the table of the stage before any more
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
