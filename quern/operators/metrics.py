"""Measures of classifiers from row-level predictions (model, id, y_true, y_proba), by model.

Curves go by distinct scores: rows are first counted by (model, score), which combines map-side, so the ordered windows
see a row for each distinct score of a model and not one for each prediction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(df: DataFrame) -> DataFrame:
    """Predictions without nulls, NaN or labels other than 0 and 1; an error names the first offence when it runs."""
    bad = F.col("y_true").isNull() | ~F.col("y_true").isin(0, 1) | F.col("y_proba").isNull() | F.isnan("y_proba")
    return df.withColumn("y_proba", F.when(bad, F.raise_error(F.lit("invalid prediction")).cast("double")).otherwise(F.col("y_proba")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, by: str = "model", cut: float = 0.5) -> DataFrame:
    """Counts at the threshold and what follows from them; undefined ratios are 0."""
    y, p = F.col("y_true") == 1, F.col("y_proba") >= cut
    x = df.groupBy(by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prevalence = (tp + fn) / n
    return x.select(
        by, "tp", "fp", "fn", "tn", ((tp + tn) / n).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tn, tn + fp).alias("specificity"),
        ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), prevalence.alias("prevalence"), (2 * prevalence / (1 + prevalence)).alias("f1_trivial"),
    )


def curve(df: DataFrame, by: str = "model") -> DataFrame:
    """by, score, tp, fp, pos, neg: cumulative counts at each distinct score, highest first."""
    x = df.groupBy(by, F.col("y_proba").alias("score")).agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") == 0).alias("q"))
    down, whole = Window.partitionBy(by).orderBy(F.desc("score")), Window.partitionBy(by)
    return x.select(by, "score", "p", "q", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("q").over(whole).alias("neg"))


def ranking(df: DataFrame, by: str = "model") -> DataFrame:
    """ROC-AUC (ties count half) and average precision."""
    c = curve(df, by)
    auc = F.sum(F.col("q") * ((F.col("tp") - F.col("p")) + F.col("p") / 2)) / (F.max("pos") * F.max("neg"))
    ap = F.sum(F.col("p") / F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return c.groupBy(by).agg(auc.alias("auc"), ap.alias("ap"))


def tpr_at_fpr(df: DataFrame, limits=(0.01, 0.001), by: str = "model") -> DataFrame:
    """Highest TPR with FPR within each limit and the score there; null below the resolution 1 / negatives."""
    c = curve(df, by).withColumn("limit", F.explode(F.array(*[F.lit(x) for x in limits])))
    ok = (F.col("fp") / F.col("neg") <= F.col("limit")) & (F.col("limit") >= 1 / F.col("neg"))
    return c.groupBy(by, "limit").agg(F.max(F.when(ok, F.col("tp") / F.col("pos"))).alias("tpr"), F.min(F.when(ok, F.col("score"))).alias("threshold"))


def fpr_at_tpr(df: DataFrame, least: float = 0.95, by: str = "model") -> DataFrame:
    """FPR at the first score, from the top, at which TPR reaches ``least``."""
    return curve(df, by).filter(F.col("tp") / F.col("pos") >= least).groupBy(by).agg(F.min(F.col("fp") / F.col("neg")).alias("fpr"))


def calibration(df: DataFrame, by: str = "model", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins, closed below, probabilities clipped to [0, 1]."""
    p = F.least(F.greatest(F.col("y_proba"), F.lit(0.0)), F.lit(1.0))
    b = F.least(F.floor(p * bins + F.lit(1e-12)), F.lit(bins - 1))
    x = df.groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum("y_true").alias("sy"), F.sum((p - F.col("y_true")) * (p - F.col("y_true"))).alias("se"))
    return x.groupBy(by).agg((F.sum("se") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))


def binomial_two_sided(a: Column, b: Column) -> Column:
    """Exact two-sided p of a against b successes at 1/2: min(1, 2 P(X <= min(a, b))); 1 without discordant pairs.

    Terms are added in the log domain, so it holds for any counts.
    """
    n, k = (a + b).cast("double"), F.least(a, b)
    # ln n! by Stirling's series beyond 20, exact below
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])

    def ln_factorial(x: Column) -> Column:
        d = x.cast("double")
        far = d * F.ln(d) - d + 0.5 * F.ln(2 * math.pi * d) + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * d * d * d * d * d)
        return F.when(x <= 20, F.element_at(table, F.least(x, F.lit(20)).cast("int") + 1)).otherwise(far)

    terms = F.transform(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), lambda i: F.exp(ln_factorial(n) - ln_factorial(i) - ln_factorial(n - i) - n * math.log(2)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)))


def paired(df: DataFrame, by: str = "model", id_col: str = "id", cut: float = 0.5) -> DataFrame:
    """All pairs of models a < b over the same ids: n01 (only b right), n10 (only a right) and McNemar's exact p.

    Predictions are gathered by id once (an array of the models' answers, as long as there are models), then paired
    within the row: no join of predictions with themselves.
    """
    right = ((F.col("y_proba") >= cut).cast("int") == F.col("y_true")).alias("right")
    rows = df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("m"), right))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["m"] > a["m"]), lambda b: F.struct(a["m"].alias("model_a"), b["m"].alias("model_b"), a["right"].alias("ra"), b["right"].alias("rb")))))
    x = rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("model_a", "model_b").agg(F.count_if(~F.col("ra") & F.col("rb")).alias("n01"), F.count_if(F.col("ra") & ~F.col("rb")).alias("n10"))
    p = binomial_two_sided(F.col("n01"), F.col("n10"))
    return x.withColumns({"p_value": p, "significant": p < 0.05})


def over_seeds(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and population deviation, nulls skipped."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def agreement(df: DataFrame, a: str, b: str, cut: float = 0.5) -> DataFrame:
    """Share of equal decisions and the largest difference of two score columns."""
    return df.agg(F.avg(((F.col(a) >= cut) == (F.col(b) >= cut)).cast("double")).alias("agreement"), F.max(F.abs(F.col(a) - F.col(b))).alias("largest"))


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, extremes and interpolated percentiles."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(by).agg(F.avg(value).alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.min(value).alias("least"), F.max(value).alias("most"))


def threshold_at(df: DataFrame, rate: float, by: str = "model") -> DataFrame:
    """The score above which ``rate`` of the rows lie, interpolated."""
    return df.groupBy(by).agg(F.percentile("y_proba", F.lit(1 - rate)).alias("threshold"))


def temperature(df: DataFrame, by: str = "model") -> DataFrame:
    """Of the temperatures 0.5, 0.55, ... 5 the first with the least cross-entropy of sigmoid(logit / T)."""
    p = F.least(F.greatest(F.col("y_proba"), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.ln(p / (1 - p))
    x = df.select(by, "y_true", logit.alias("z")).groupBy(by, "y_true", "z").agg(F.count("*").alias("w"))  # each distinct score once
    x = x.withColumn("t", F.explode(F.array(*[F.lit(round(0.5 + 0.05 * i, 2)) for i in range(91)])))
    q = 1 / (1 + F.exp(-F.col("z") / F.col("t")))
    loss = -F.ln(F.when(F.col("y_true") == 1, q).otherwise(1 - q)) * F.col("w")
    x = x.groupBy(by, "t").agg((F.sum(loss) / F.sum("w")).alias("loss"))
    return x.groupBy(by).agg(F.min(F.struct(F.round("loss", 9).alias("l"), F.col("t"))).alias("b")).select(by, F.col("b.t").alias("temperature"), F.round("b.l", 6).alias("loss"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class)."""
    x = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return x.select(label, (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def _resampled(y, right_hits, counts, draws: int, seed: int):
    """F1 of each resample, a row of it for each array in right_hits (the cells predicted positive).

    Rows alike in label and predictions are exchangeable, so a resample of n rows with replacement is one multinomial
    draw of n over the cells' counts: no row is copied, and the work is the same for any number of rows. Resamples of
    one class are skipped.
    """
    import numpy as np

    total = int(counts.sum())
    w = np.random.default_rng(seed).multinomial(total, counts / max(total, 1), size=draws)
    positives = w[:, y].sum(axis=1)
    w = w[(positives > 0) & (positives < total)]

    def f1(weights, p):
        hit, wrong = weights[:, y & p].sum(axis=1), weights[:, y != p].sum(axis=1)
        return np.divide(2.0 * hit, 2 * hit + wrong, out=np.zeros(len(weights)), where=hit > 0)

    return [f1(w, p) for p in right_hits], [float(f1(counts[None, :], p)[0]) for p in right_hits]


def bootstrap_f1(df: DataFrame, by: str = "model", draws: int = 2000, seed: int = 7, cut: float = 0.5) -> DataFrame:
    """Observed F1, the resamples that have both classes, and their 95 % percentile interval with its width; without
    such resamples the interval is null. Rows are counted by label and prediction first: four cells a model."""
    cells = df.groupBy(by, (F.col("y_true") == 1).alias("y"), (F.col("y_proba") >= cut).alias("p")).agg(F.count("*").alias("n"))

    def interval(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["y", "p"])
        (v,), (seen,) = _resampled(pdf["y"].to_numpy(bool), [pdf["p"].to_numpy(bool)], pdf["n"].to_numpy(np.int64), draws, seed)
        low, high = np.percentile(v, [2.5, 97.5]) if len(v) else (None, None)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "observed": [seen], "draws": [len(v)], "low": [low], "high": [high], "width": [None if low is None else high - low]}).astype({c: "float64" for c in ("low", "high", "width")})

    kind = df.schema[by].dataType.simpleString()
    return cells.groupBy(by).applyInPandas(interval, f"`{by}` {kind}, observed double, draws long, low double, high double, width double")


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """t of the paired differences over folds, and their number; equal columns give 0."""
    d = F.col(a) - F.col(b)
    x = df.agg(F.count(d).alias("folds"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    t = F.when(F.coalesce(F.col("s"), F.lit(0.0)) == 0, F.when(F.col("m") == 0, F.lit(0.0))).otherwise(F.col("m") / (F.col("s") / F.sqrt("folds")))
    return x.select("folds", F.col("m").alias("difference"), t.alias("t"), (F.col("folds") < 5).alias("few"))


def within(df: DataFrame, a: str, b: str, y: str, delta: float = 0.005, draws: int = 2000, seed: int = 7, cut: float = 0.5) -> DataFrame:
    """Equivalence of two models by F1: the 95 % interval of the difference over resamples of the same rows for both,
    and whether it lies within delta. Without a resample of both classes, all three are null. No rows give no row."""
    cells = df.groupBy((F.col(y) == 1).alias("y"), (F.col(a) >= cut).alias("a"), (F.col(b) >= cut).alias("b")).agg(F.count("*").alias("n"))

    def interval(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["y", "a", "b"])
        (u, v), _ = _resampled(pdf["y"].to_numpy(bool), [pdf["a"].to_numpy(bool), pdf["b"].to_numpy(bool)], pdf["n"].to_numpy(np.int64), draws, seed)
        if not len(u):
            return pd.DataFrame({"low": [np.nan], "high": [np.nan], "equivalent": [None]})
        low, high = np.percentile(u - v, [2.5, 97.5])
        return pd.DataFrame({"low": [low], "high": [high], "equivalent": [bool(low > -delta and high < delta)]})

    x = cells.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(interval, "low double, high double, equivalent boolean")  # eight cells at most
    return x.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high")})


def false_negatives(df: DataFrame, by: str = "model", cut: float = 0.5) -> DataFrame:
    """Missed positives, positives, and their share."""
    y = F.col("y_true") == 1
    x = df.groupBy(by).agg(F.count_if(y & (F.col("y_proba") < cut)).alias("missed"), F.count_if(y).alias("positives"))
    return x.withColumn("rate", _ratio(F.col("missed"), F.col("positives")))
