"""Sinks that check what they write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.metrics import checked


class Incomplete(RuntimeError):
    """A source that must be there is missing; code is the exit code of a command that meets it."""

    code = 2


def write_corpus(df: DataFrame, path: str, source: str, expected: set[str]) -> None:
    """Writes the corpus, by source, unless an expected source has no rows."""
    found = {r[0] for r in df.select(source).filter(F.col(source).isin(sorted(expected))).distinct().collect()}
    if gone := sorted(expected - found):
        raise Incomplete(f"missing sources: {', '.join(gone)}")
    df.write.partitionBy(source).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """id, y_true, y_proba, model and split of valid, non-empty predictions."""
    if df.isEmpty():
        raise ValueError("no predictions")
    checked(df).write.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All predictions below path; model and split from columns, else from a file name model__split."""
    x = spark.read.option("mergeSchema", True).parquet(path)
    if gone := [c for c in ("id", "y_true", "y_proba") if c not in x.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    for k, c in enumerate(("model", "split")):
        if c not in x.columns:
            x = x.withColumn(c, F.split(folder, "__").getItem(k))
    return x


def write_report(report: dict, path: str, spark: SparkSession, **provenance) -> None:
    """A small JSON report with where it came from, by the session's file system."""
    text = json.dumps(report | {"provenance": provenance | {"spark": spark.version}}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def collection_stats(spark: SparkSession, path: str) -> DataFrame:
    """By folder the number of files and the newest change."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    return f.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.max("modificationTime").alias("newest"))


def content_fingerprint(df: DataFrame, order: list[str]) -> str:
    """16 hex digits over all rows that depend on neither partitions nor the reading order.

    Each row is hashed with its columns; the sum of the hashes is taken map-side.
    """
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[df[c] for c in sorted(df.columns)])), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    total = df.agg(F.sum(row).alias("s"), F.count("*").alias("n")).first()
    import hashlib

    return hashlib.sha256(f"{total.n}:{total.s}:{','.join(order)}".encode()).hexdigest()[:16]
