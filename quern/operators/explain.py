"""Attributions, reports and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_factors(df: DataFrame, id_col: str, name: str, weight: str, k: int) -> DataFrame:
    """The k factors of each id by absolute weight, then name."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs(weight)), name)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def modality_report(df: DataFrame, id_col: str, modality: Column, weight: str) -> DataFrame:
    """By id and modality the share of the sum of absolute weights, and whether it is the id's largest."""
    x = df.groupBy(id_col, modality.alias("modality")).agg(F.sum(F.abs(weight)).alias("mass"), F.count("*").alias("factors"))
    w = Window.partitionBy(id_col)
    share = F.col("mass") / F.sum("mass").over(w)
    return x.select(id_col, "modality", "factors", F.coalesce(share, F.lit(0.0)).alias("share"), (F.row_number().over(w.orderBy(F.desc("mass"), "modality")) == 1).alias("dominant"))


def faithful(cited: Column, weights: Column, slack: float = 0.02) -> Column:
    """Whether each cited share lies within the slack of some weight's share."""
    return F.forall(cited, lambda c: F.exists(weights, lambda w: F.abs(c - w) <= slack))


def overlapping(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens (key, a, b) with the largest weight of the spans (key, i, f, w) that they overlap: i < b and a < f.

    Both meet by key, so the range condition is within a document; a token without a span has weight null.
    """
    x = tokens.alias("t").join(spans.alias("s"), (F.col(f"t.{key}") == F.col(f"s.{key}")) & (F.col("s.i") < F.col("t.b")) & (F.col("t.a") < F.col("s.f")), "left")
    return x.groupBy(f"t.{key}", "t.a", "t.b").agg(F.max("s.w").alias("weight"))


def merge_wordpieces(df: DataFrame, id_col: str, order: str, token: str, weight: str) -> DataFrame:
    """Words from pieces: '##' continues the word before, weights add up, [..] marks go."""
    x = df.filter(~F.col(token).rlike(r"^\[.*\]$"))
    w = Window.partitionBy(id_col).orderBy(order)
    x = x.withColumn("_word", F.sum(F.when(F.col(token).startswith("##"), 0).otherwise(1)).over(w))
    x = x.groupBy(id_col, "_word").agg(F.sum(weight).alias("weight"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda s: F.regexp_replace(s[token], "^##", "")), "").alias("word"))
    return x.select(id_col, F.col("_word").alias("position"), "word", "weight")


def panel_scores(df: DataFrame, clarity: list[str], usefulness: list[str], sus: list[str], quality: list[str], right: list[str]) -> DataFrame:
    """By evaluator: favourable shares (4 or 5 of 5), the usability score, information quality and comprehension."""
    share = lambda cols: sum((F.col(c) >= 4).cast("int") for c in cols) / len(cols) * 100
    points = sum(F.col(c) - 1 if k % 2 == 0 else 5 - F.col(c) for k, c in enumerate(sus))
    return df.withColumns({"index": share(clarity + usefulness), "clarity": share(clarity), "usefulness": share(usefulness), "usability": points * 2.5, "quality": sum(F.col(c) for c in quality) / len(quality), "comprehension": sum(F.col(c) for c in right) / len(right) * 100})


def out_of_range(df: DataFrame, id_col: str, columns: list[str], low: int, high: int) -> DataFrame:
    """id and column of each answer outside the scale or missing."""
    bad = F.filter(F.array(*[F.when(F.col(c).isNull() | ~F.col(c).between(low, high), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return df.select(id_col, F.explode(bad).alias("column"))


def attention_share(df: DataFrame, group: str, weight: str) -> DataFrame:
    """Shares by group (a sentinel's group null is left out) and their entropy over ln of the number of groups."""
    x = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(weight).alias("m"))
    w = Window.partitionBy()
    x = x.select(group, (F.col("m") / F.sum("m").over(w)).alias("share"), F.count("*").over(w).alias("_k"))
    h = F.sum(F.when(F.col("share") > 0, -F.col("share") * F.ln("share")).otherwise(0.0)).over(w)
    return x.select(group, "share", F.when(F.col("_k") > 1, h / F.ln(F.col("_k").cast("double"))).otherwise(F.lit(0.0)).alias("evenness"))
