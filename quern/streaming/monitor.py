"""Streams of messages: copies dropped within a watermark, coverage by window, and training runs that diverge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import fingerprint


def first_seen(stream: DataFrame, text: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The stream without texts that came already, as far back as the watermark keeps them."""
    return stream.withColumn("_print", fingerprint(F.col(text))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_print"]).drop("_print")


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows and mean value by window and key; a window comes out once the watermark has passed it."""
    x = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return x.select(F.col("window.start").alias("start"), by, "n", "mean")


def best_so_far(stream: DataFrame, run: str, order: str, value: str, patience: int) -> DataFrame:
    """By run the best value so far and whether the last ``patience`` rows or more brought none; state is two numbers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, since = state.get if state.exists else (float("-inf"), 0)
        for b in batches:
            for v in b.sort_values(order)[value]:
                best, since = (float(v), 0) if v > best else (best, since + 1)
        state.update((best, since))
        yield pd.DataFrame({"run": [key[0]], "best": [best], "since": [since], "stop": [since >= patience]})

    kind = stream.schema[run].dataType.simpleString()
    return stream.groupBy(run).applyInPandasWithState(step, f"run {kind}, best double, since int, stop boolean", "best double, since int", "update", "NoTimeout")
