"""Row-wise scores, bands, encodings and orders of predictions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(p: Column) -> Column:
    """Of the predicted class."""
    return F.greatest(p, 1 - p)


def confidence_band(p: Column) -> Column:
    c = confidence(p)
    return F.when(c >= 0.99, "very high").when(c >= 0.95, "high").when(c >= 0.8, "medium").otherwise("low")


def result_band(p: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return F.when(p >= high, "positive").when(p <= low, "negative").otherwise("uncertain")


def candidates(df: DataFrame, body: str, subject: str, p: str, y: str, language: str) -> DataFrame:
    """Rows fit for a panel: predicted right, a body of 250 to 1600 characters, a subject, very sure or in the middle."""
    c = confidence(F.col(p))
    right = (F.col(p) >= 0.5).cast("int") == F.col(y)
    return df.filter(right & F.length(body).between(250, 1600) & (F.length(F.trim(F.coalesce(subject, F.lit("")))) > 0) & ((c >= 0.99) | c.between(0.5, 0.95)) & F.col(language).isin("en", "es"))


def language_group(text: Column, language: Column, least: int = 60) -> Column:
    """en, other, or undetermined for short texts and unknown languages."""
    return F.when(F.length(text) < least, "undetermined").when(language == "en", "en").when(language.isNull(), "undetermined").otherwise("other")


def evaluable(df: DataFrame, group: str, label: str, least: int = 30) -> DataFrame:
    """By group the rows, and whether they are enough and of two classes."""
    return df.groupBy(group).agg(F.count("*").alias("n"), ((F.count("*") >= least) & (F.count_distinct(label) == 2)).alias("evaluable"))


def min_max(c: Column, low: Column, high: Column, clip: bool = True) -> Column:
    """Scaled to [0, 1]; a range of nothing gives 0."""
    x = F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0))
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if clip else x


def category_index(c: Column, vocabulary: list[str]) -> Column:
    """Trimmed and lower-cased value to its place, from 1; missing and unknown are 0."""
    return F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.lower(F.trim(F.coalesce(c, F.lit(""))))).cast("int")


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Of an array, stable for large values."""
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp((v - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def focal_loss(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    q = F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(1e-7))
    a = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return -a * F.pow(1 - q, F.lit(gamma)) * F.ln(q)


def weighted_cross_entropy(p: Column, y: Column, positive: float) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(F.when(y == 1, F.lit(positive) * F.ln(q)).otherwise(F.ln(1 - q)))


def shards(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """df with shard: the place in the order of ids modulo n, from counts of ranges and places within them.

    Ranges are the ids' leading values, so no step numbers all rows in one task.
    """
    x = df.withColumn("_b", F.floor(F.col(id_col) / 65536))
    sizes = x.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_s")
    place = F.row_number().over(Window.partitionBy("_b").orderBy(id_col)) - 1
    return x.withColumn("_p", place).join(starts, "_b").withColumn("shard", F.pmod(F.col("_s") + F.col("_p"), F.lit(n))).drop("_b", "_p", "_s")


def length_batches(df: DataFrame, id_col: str, length: str, batch: int, seed: str, per_block: int = 50) -> DataFrame:
    """df with block and batch: rows fall into blocks of about batch * per_block by hash, are sorted by length within
    their block and cut into batches."""
    from quern.operators.sampling import rank_key

    n_blocks = max(1, df.count() // (batch * per_block))
    x = df.withColumn("block", F.pmod(F.xxhash64(rank_key(F.col(id_col), seed)), F.lit(n_blocks)))
    w = Window.partitionBy("block").orderBy(length, id_col)
    return x.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch))


def interleaved(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with turn: first of each class, then second of each, and so on; sorts by (turn, class)."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def step_auc(df: DataFrame, by: str = "model") -> DataFrame:
    """Trapezoid area with a step for each row (ties in order of id): 1 less the mean share of negatives above a positive."""
    w = Window.partitionBy(by).orderBy(F.desc("y_proba"), "id")
    x = df.withColumn("_above", F.sum(1 - F.col("y_true")).over(w)).groupBy(by)
    x = x.agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"), F.sum(F.when(F.col("y_true") == 1, F.col("_above"))).alias("above"))
    return x.select(by, (1 - F.col("above") / (F.col("pos") * F.col("neg"))).alias("auc"))


def frequent_words(words: DataFrame, word: str, excluded: DataFrame, k: int) -> DataFrame:
    """The k most frequent words that excluded (word) doesn't hold, then by name."""
    return words.join(excluded, word, "left_anti").groupBy(word).agg(F.count("*").alias("n")).orderBy(F.desc("n"), word).limit(k)
