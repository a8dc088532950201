"""Run logs: lines '[stamp] name' and '[stamp] name finished' or failed, as intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What marks a line as the end of a run.
FINISHED, FAILED = "terminado", "FALLÓ"
LINE = r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\] ([A-Za-z0-9_]+)(.*)$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """stamp, name and kind (start, finished, failed) of each line that has the form; other lines are left out."""
    x = spark.read.text(path).select(*[F.regexp_extract("value", LINE, k).alias(c) for k, c in ((1, "stamp"), (2, "name"), (3, "rest"))]).filter("stamp <> ''")
    kind = F.when(F.contains("rest", F.lit(FAILED)), "failed").when(F.contains("rest", F.lit(FINISHED)), "finished").otherwise("start")
    return x.select(F.to_timestamp("stamp").alias("stamp"), "name", kind.alias("kind"))


def intervals(log: DataFrame) -> DataFrame:
    """name, started, ended, seconds and failed of each start, paired with the next end of its name."""
    w = Window.partitionBy("name").orderBy("stamp", F.col("kind") != "start")
    x = log.withColumns({"_kind": F.lead("kind").over(w), "ended": F.lead("stamp").over(w)}).filter("kind = 'start'")
    ended = F.when(F.col("_kind") != "start", F.col("ended"))
    return x.select("name", F.col("stamp").alias("started"), ended.alias("ended"), (F.unix_seconds(ended) - F.unix_seconds("stamp")).alias("seconds"), (F.coalesce(F.col("_kind") == "failed", F.lit(False))).alias("failed"))


def human_duration(seconds: Column) -> Column:
    """'H h M min', or 'M min' below an hour, or 'S s' below a minute."""
    h, m = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.when(seconds >= 3600, F.format_string("%d h %d min", h, m)).when(seconds >= 60, F.format_string("%d min", m)).when(seconds.isNotNull(), F.format_string("%d s", F.floor(seconds)))
