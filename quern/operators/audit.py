"""Label-leak audit, coverage, composition and provenance measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import present


def mi_2x2(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Mutual information in nats of a 2x2 table of counts; empty cells count 0; not below 0."""
    n = (n11 + n10 + n01 + n00).cast("double")

    def cell(c: Column, row: Column, col: Column) -> Column:
        return F.when(c > 0, c / n * F.ln(c * n / (row * col))).otherwise(F.lit(0.0))

    r1, r0, c1, c0 = n11 + n10, n01 + n00, n11 + n01, n10 + n00
    return F.greatest(cell(n11, r1, c1) + cell(n10, r1, c0) + cell(n01, r0, c1) + cell(n00, r0, c0), F.lit(0.0))


def leaks(df: DataFrame, source: str, label: str, fields: list[str], threshold: float = 0.05) -> DataFrame:
    """A row for each source and field: coverage, information of the field's presence on the label, the positive rate
    with and without it, and whether that is above the threshold; for sources of one class the measures are null.

    One aggregation over presence flags; the fields are unpivoted after it, when a row is left for each source.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    y = F.col(label) == 1
    aggs = [F.count("*").alias("n"), F.count_if(y).alias("pos")]
    for f in fields:
        p = present(F.col(f), kinds[f])
        aggs += [F.count_if(p & y).alias(f"{f}_11"), F.count_if(p & ~y).alias(f"{f}_10")]
    x = df.filter(F.col(label).isNotNull()).groupBy(source).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_11").alias("n11"), F.col(f"{f}_10").alias("n10")) for f in fields]))
    x = x.select(F.col(source).alias("source"), "n", "pos", rows.alias("r")).select("source", "n", "pos", "r.*")
    n01, n00 = F.col("pos") - F.col("n11"), F.col("n") - F.col("pos") - F.col("n10")
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    with_, without = F.col("n11") + F.col("n10"), n01 + n00
    mi = F.when(both, mi_2x2(F.col("n11"), F.col("n10"), n01, n00))
    return x.select("source", "field", (with_ / F.col("n")).alias("coverage"), mi.alias("mi"), F.when(both, mi > threshold).alias("above"), F.when(both & (with_ > 0), F.col("n11") / with_).alias("p_present"), F.when(both & (without > 0), n01 / without).alias("p_absent"))


def coverage(df: DataFrame, source: str, label: str) -> DataFrame:
    """By source and in total (source null): rows, prevalence, shares with structure, network, and all modalities."""
    s, n = F.col("has_structure_modality"), F.col("has_network_modality")
    share = lambda c: F.count_if(c) / F.count("*")
    return df.rollup(source).agg(F.count("*").alias("n"), F.avg(label).alias("prevalence"), share(s).alias("structure"), share(n).alias("network"), share(s & n).alias("tri"), share(s | n).alias("bi"))


def smoke_checks(df: DataFrame, id_col: str, label: str, text: str, source: str) -> DataFrame:
    """Named checks of a corpus, in one pass: check, ok."""
    c = F.col
    x = df.agg(
        (F.count("*") > 0).alias("not_empty"), (F.count("*") == F.count_distinct(id_col)).alias("unique_ids"), (F.count_if(c(id_col).isNull()) == 0).alias("no_null_ids"),
        (F.count_if(c(label).isNotNull() & ~c(label).isin(0, 1)) == 0).alias("binary_labels"), (F.count_distinct(label) == 2).alias("two_classes"), (F.count_if(c(text).isNull() | (F.length(F.trim(c(text))) == 0)) == 0).alias("no_blank_text"),
        (F.count_distinct(source) > 1).alias("several_sources"), F.avg(label).between(0.05, 0.95).alias("prevalence_in_range"),
    )
    return x.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in x.columns]), F.array(*[F.col(k) for k in x.columns]))).alias("check", "ok"))


def composition(df: DataFrame, source: str, group: str, label: str, least: int = 30) -> DataFrame:
    """Rows, share of the source and, with enough rows, prevalence, by source and group."""
    total = df.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("_n"))
    x = df.groupBy(source, group).agg(F.count("*").alias("n"), F.avg(label).alias("_p"))
    return x.join(total, F.col(source).eqNullSafe(F.col("_s"))).select(source, group, "n", (F.col("n") / F.col("_n")).alias("share"), F.when(F.col("n") >= least, F.col("_p")).alias("prevalence"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """mi in nats and both entropies of two discrete columns: one row."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = cells.groupBy(F.col(a).alias("_a")).agg(F.sum("n").alias("na")), cells.groupBy(F.col(b).alias("_b")).agg(F.sum("n").alias("nb"))
    ra = ra.withColumn("t", F.sum("na").over(Window.partitionBy()))  # a row for each value of a
    x = cells.join(ra, F.col(a).eqNullSafe(F.col("_a"))).join(rb, F.col(b).eqNullSafe(F.col("_b")))
    p = F.col("n") / F.col("t")
    return x.agg(F.sum(p * F.ln(F.col("n") * F.col("t").cast("double") / (F.col("na") * F.col("nb")))).alias("mi"))


def shortcuts(df: DataFrame, profile: str, label: str, predicted: str) -> DataFrame:
    """By profile: rows, its majority class, and how often the prediction beats the majority or loses to it."""
    x = df.groupBy(profile).agg(F.count("*").alias("n"), (F.avg(label) > 0.5).cast("int").alias("majority"))
    y = df.join(x.withColumnRenamed(profile, "_p"), F.col(profile) == F.col("_p"))
    right, base = F.col(predicted) == F.col(label), F.col("majority") == F.col(label)
    return y.groupBy(profile, "n", "majority").agg(F.count_if(right & ~base).alias("wins"), F.count_if(~right & base).alias("losses")).withColumn("net", F.col("wins") - F.col("losses"))


def size_bands(df: DataFrame, cluster: str, label: str, least: int = 20) -> DataFrame:
    """Rows and prevalence by the size of their cluster (1, 2-5, >5), evaluable with enough rows of two classes."""
    sizes = df.groupBy(F.col(cluster).alias("_c")).agg(F.count("*").alias("_n"))
    band = F.when(F.col("_n") == 1, "1").when(F.col("_n") <= 5, "2-5").otherwise(">5")
    x = df.join(sizes, F.col(cluster) == F.col("_c")).withColumn("band", band).groupBy("band").agg(F.count("*").alias("n"), F.avg(label).alias("prevalence"), F.count_distinct(label).alias("classes"))
    return x.withColumn("evaluable", (F.col("n") >= least) & (F.col("classes") == 2))
