"""Training histories and event logs: windows by run, never over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(df: DataFrame, run: str, order: str, value: str, least: int = 50, share: int = 50) -> DataFrame:
    """Mean over the last max(n // share, 1) rows of the run; null for runs of fewer than ``least`` rows."""
    w, whole = Window.partitionBy(run).orderBy(order), Window.partitionBy(run)
    n, r, total = F.count("*").over(whole), F.row_number().over(w), F.sum(value).over(w)
    x = df.select(run, order, value, n.alias("_n"), r.alias("_r"), total.alias("_t")).withColumn("_k", F.greatest(F.floor(F.col("_n") / share), F.lit(1)))
    # a sum up to k rows before: a run's rows by number, met by number
    back = x.select(F.col(run).alias("_run"), F.col("_r").alias("_at"), F.col("_t").alias("_back"))
    y = x.join(back, (F.col(run) == F.col("_run")) & (F.col("_r") - F.col("_k") == F.col("_at")), "left")
    mean = (F.col("_t") - F.coalesce("_back", F.lit(0.0))) / F.least("_k", F.col("_r"))
    return y.select(run, order, value, F.when(F.col("_n") >= least, mean).alias("rolling"))


def first_overfit(df: DataFrame, run: str, epoch: str, train: str, val: str) -> DataFrame:
    """By run the first epoch after which validation loss rises while training loss falls."""
    w = Window.partitionBy(run).orderBy(epoch)
    x = df.select(run, F.lag(epoch).over(w).alias("after"), ((F.col(val) > F.lag(val).over(w)) & (F.col(train) < F.lag(train).over(w))).alias("hit"))
    return x.filter("hit").groupBy(run).agg(F.min("after").alias("after_epoch"))


def early_stop(df: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """By run the best epoch up to the first one that is ``patience`` epochs past its best so far."""
    w = Window.partitionBy(run).orderBy(epoch)
    x = df.withColumn("_r", F.row_number().over(w)).withColumn("_best", F.max(F.struct(F.col(value), -F.col("_r"))).over(w))
    x = x.withColumn("_since", F.col("_r") + F.col("_best").getField("col2"))
    stop = F.min(F.when(F.col("_since") >= patience, F.col("_r")))
    x = x.select("*", stop.over(Window.partitionBy(run)).alias("_stop")).filter(F.col("_stop").isNull() | (F.col("_r") <= F.col("_stop")))
    return x.groupBy(run).agg(F.max(value).alias("best"), F.max("_r").alias("epochs_run"), F.first("_stop").isNotNull().alias("stopped"))


def durations(df: DataFrame, key: str, ts: str, kind: str, start: str, end: str) -> DataFrame:
    """Each start with the next event of its key, if that is an end: key, started, ended, seconds (null: no end)."""
    w = Window.partitionBy(key).orderBy(ts, kind)
    x = df.filter(F.col(kind).isin(start, end)).withColumns({"_next": F.lead(kind).over(w), "_then": F.lead(ts).over(w)})
    ended = F.when(F.col("_next") == end, F.col("_then"))
    return x.filter(F.col(kind) == start).select(key, F.col(ts).alias("started"), ended.alias("ended"), (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))).alias("micros"))


def running_cap(df: DataFrame, group: str, order: str, size: str, cap: float) -> DataFrame:
    """Rows of a group until the sum before them reaches the cap: checked after each, so it may overshoot by one."""
    before = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", F.coalesce(before, F.lit(0))).filter(F.col("_b") < cap).drop("_b")


def decile_means(df: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """By run the mean of the first and of the last tenth of its rows (one at least), and whether it decreased."""
    w = Window.partitionBy(run)
    x = df.withColumns({"_r": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)}).withColumn("_k", F.greatest(F.floor(F.col("_n") / 10), F.lit(1)))
    x = x.groupBy(run).agg(F.avg(F.when(F.col("_r") <= F.col("_k"), F.col(value))).alias("first"), F.avg(F.when(F.col("_r") > F.col("_n") - F.col("_k"), F.col(value))).alias("last"))
    return x.withColumn("decreased", F.col("last") < F.col("first"))


def first_by_type(df: DataFrame, key: str, order: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """By key the value of the first row of each type; a type that doesn't occur is null."""
    return df.groupBy(key).agg(*[F.min_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.col(order))).alias(k) for k in kinds])
