"""Intermediate tables in the folder that the driver and all executors share, and what is known of their size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_OWN: dict[str, str] = {}
#: Rows of an Arrow batch: a batch of whole texts stands in memory on both sides, in Java and in Python, several times.
BATCH_ROWS = 1000
#: Bytes of rows up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _OWN["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go when each has ended; Spark has a setting for that."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of at most BATCH_ROWS within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written on the way to a result; ``drop`` deletes them once the result itself is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in the shared folder: cuts the lineage and survives lost executors."""
        path = fresh_path(self.spark, name)
        with shuffles_released(self.spark), small_batches(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder that stays, for results that are read later."""
    return Scratch(df.sparkSession).written(df, name)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _bytes(c: Column, kind: DataType) -> Column | None:
    """Bytes that a value of no fixed width takes besides its eight."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.octet_length(c)
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType)):
        return F.size(c) * 8 + 8
    return F.octet_length(F.to_json(c)) * 2 if isinstance(kind, (ArrayType, MapType, StructType)) else None


def row_bytes(df: DataFrame) -> int:
    """Bytes of all rows as they stand in memory; one pass over a written table."""
    wide = [x for f in df.schema.fields if (x := _bytes(F.col(f"`{f.name}`"), f.dataType)) is not None]
    one = F.lit(16 + 8 * len(df.columns)).cast("long")
    for x in wide:
        one = one + F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    return df.agg(F.sum(one)).first()[0] or 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows take at most so many bytes; else joins shuffle it."""
    return F.broadcast(df) if row_bytes(df) <= most else df


def estimated_bytes(df: DataFrame) -> int:
    """What a plan reads, by the size of its sources; runs no job, unless a source's size isn't known to Spark."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if total < 1 << 50:
        return total
    texts = [F.sum(F.octet_length(F.col(f"`{f.name}`"))) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    return sum(x or 0 for x in df.agg(F.count("*"), *texts).first())
