"""Baseline classifiers on pyspark.ml, fitted on the training side only, and their evaluation by folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, MinMaxScaler, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _weighted(df: DataFrame, label: str) -> DataFrame:
    """df with the balanced weight n / (2 n of the class)."""
    n, pos = df.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    w = {1: n / (2 * max(pos, 1)), 0: n / (2 * max(n - pos, 1))}
    return df.withColumn("_weight", F.when(F.col(label) == 1, w[1]).otherwise(w[0]))


def _text_stages(text: str, features: int) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False), NGram(n=2, inputCol="_words", outputCol="_pairs"), SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=features), IDF(inputCol="_counts", outputCol="_text", minDocFreq=2),
    ]


def _number_stages(columns: list[str], output: str, scaled: bool) -> list:
    if not scaled:
        return [VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep")]
    return [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"), MinMaxScaler(inputCol="_raw", outputCol=output)]


def variant(name: str, text: str, structure: list[str], network: list[str], label: str, features: int = 1 << 16) -> Pipeline:
    """text: terms and pairs, logistic. structure: 200 trees of depth 20. network: 300 deep trees. all: text and scaled numbers, logistic."""
    logistic = lambda col: LogisticRegression(featuresCol=col, labelCol=label, weightCol="_weight", maxIter=100, regParam=1e-3)
    if name == "text":
        return Pipeline(stages=[*_text_stages(text, features), logistic("_text")])
    if name == "structure":
        return Pipeline(stages=[*_number_stages(structure, "_features", False), RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=200, maxDepth=20, seed=42)])
    if name == "network":
        return Pipeline(stages=[*_number_stages(network, "_features", False), RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=300, maxDepth=30, seed=42)])
    if name == "all":
        return Pipeline(stages=[*_text_stages(text, features), *_number_stages(structure + network, "_numbers", True), VectorAssembler(inputCols=["_text", "_numbers"], outputCol="_features"), logistic("_features")])
    raise ValueError(f"unknown variant: {name}")


def fit(pipeline: Pipeline, train: DataFrame, label: str) -> PipelineModel:
    return pipeline.fit(_weighted(train, label))


def predict(model: PipelineModel, df: DataFrame, name: str, id_col: str, label: str) -> DataFrame:
    """model, id, y_true, y_proba."""
    x = model.transform(df)
    return x.select(F.lit(name).alias("model"), F.col(id_col).alias("id"), F.col(label).alias("y_true"), vector_to_array("probability")[1].alias("y_proba"))


def by_fold(pipeline: Pipeline, df: DataFrame, fold: str, name: str, id_col: str, label: str, most: int = 100) -> DataFrame:
    """Predictions of each fold from a model fitted on the others; folds whose training side has one class are left out.

    A model is fitted for each fold; more folds than ``most`` raise.
    """
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).limit(most + 1).collect()]
    if len(folds) > most:
        raise ValueError(f"more than {most} folds: pass a larger most to fit a model for each")
    out = None
    for f in folds:
        train = df.filter(F.col(fold) != f)
        if train.select(label).distinct().limit(2).count() < 2:
            continue
        x = predict(fit(pipeline, train, label), df.filter(F.col(fold) == f), name, id_col, label).withColumn("fold", F.lit(f))
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no fold can be evaluated")
    return out


def fold_report(df: DataFrame, fold: str, label: str) -> DataFrame:
    """By fold its rows, classes and share of positives (label 0 or 1; other labels count as none), and whether it can
    be evaluated: both classes in it, and both in the other folds together. The window without a key is over folds."""
    y = F.col(label)
    x = df.groupBy(fold).agg(F.count("*").alias("n"), F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_q"))
    every = Window.partitionBy()
    both = (F.col("_p") > 0) & (F.col("_q") > 0) & (F.sum("_p").over(every) > F.col("_p")) & (F.sum("_q").over(every) > F.col("_q"))
    classes = (F.col("_p") > 0).cast("int") + (F.col("_q") > 0).cast("int")
    return x.select(fold, "n", classes.alias("classes"), F.round(F.col("_p") / F.nullif(F.col("_p") + F.col("_q"), F.lit(0)), 4).alias("prevalence"), both.alias("evaluable"))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int, seed: str) -> DataFrame:
    """df with fold: hash order within the label, dealt by hash, so no label is gathered in one place."""
    from quern.operators.sampling import rank_key

    return df.withColumn("fold", F.pmod(F.xxhash64(label, rank_key(F.col(id_col), seed)), F.lit(k)))


def ablation(model: PipelineModel, df: DataFrame, features: list[str], id_col: str, label: str) -> DataFrame:
    """For each feature the mean change of the positive probability when it is set to 0."""
    base = predict(model, df, "base", id_col, label).select("id", F.col("y_proba").alias("base"))
    out = None
    for f in features:
        x = predict(model, df.withColumn(f, F.lit(0).cast(df.schema[f].dataType)), f, id_col, label).join(base, "id").groupBy(F.col("model").alias("feature")).agg(F.avg(F.col("base") - F.col("y_proba")).alias("change"))
        out = x if out is None else out.unionByName(x)
    return out
