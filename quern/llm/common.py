"""What the operators share beside the intermediate tables: sizes, letters and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.tables import Scratch, estimated_bytes, fresh_path, shared_dir, small, unused, written

__all__ = ["Scratch", "ascii_lower", "estimated_bytes", "fresh_path", "mix64", "release", "released", "shared_dir", "small", "table", "unused", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Only A-Z change, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release() -> None:
    """Gives memory that Python has freed back to the system: workers stay after their task, and count as the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 4) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step of a task that calls ``release`` after some batches of its output each time, and when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(step(batches), 1):
            yield b
            del b
            if k % every == 0:
                release()
        release()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
