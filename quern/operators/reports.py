"""Counts over explanation reports, picks for a panel, survey answers, and effects of words on a score."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

UNKNOWN = "[UNK]"


def _count(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def report_counts(df: DataFrame, predicted: str, text: str, structure: str, network: str, no_structure: str, no_network: str) -> DataFrame:
    """Over all reports (predicted null) and by predicted class: how many give some weight to structure or network, at
    least 5 or 20 % to both together, most to one of them (ties go to the text), or fall by over 0.01 without them."""
    other, most = F.col(structure) + F.col(network), F.greatest(structure, network)
    counts = {
        "structure": F.col(structure) > 0, "network": F.col(network) > 0, "at_least_5": other >= 5, "at_least_20": other >= 20, "dominant": most > F.col(text),
        "falls_structure": F.col(no_structure) > 0.01, "falls_network": F.col(no_network) > 0.01,
    }
    return df.groupingSets([[], [predicted]], predicted).agg(F.count("*").alias("n"), *[_count(c).alias(k) for k, c in counts.items()])


def path_means(df: DataFrame, group: str, json: str, paths: dict[str, str], digits: int = 6) -> DataFrame:
    """By group the mean of the number at each path; rows without the path, or with something else there, are skipped."""
    value = lambda p: F.get_json_object(json, p).try_cast("double")
    return df.groupBy(group).agg(*[F.round(F.avg(value(p)), digits).alias(name) for name, p in paths.items()])


def legibility(df: DataFrame, factors: str, group: str | None = None) -> DataFrame:
    """Reports, cited words, legible ones, and reports with legible words only; a report that cites none counts there."""
    cited, good = F.size(factors), F.size(F.filter(factors, tx.legible))
    x = df.select(*([group] if group else []), cited.cast("long").alias("c"), good.cast("long").alias("g"))
    return x.groupBy(*([group] if group else [])).agg(F.count("*").alias("reports"), F.sum("c").alias("cited"), F.sum("g").alias("legible"), _count(F.col("c") == F.col("g")).alias("all_legible"))


def outcomes(df: DataFrame, group: str, status: Column) -> DataFrame:
    """By group the rows that were processed, failed or were skipped (status of that name), and the share of the first."""
    x = df.groupBy(group).agg(*[_count(status == s).alias(s) for s in ("processed", "errors", "skipped")])
    total = F.col("processed") + F.col("errors") + F.col("skipped")
    return x.withColumn("total", total).withColumn("success_rate", F.round(F.when(total == 0, F.lit(0.0)).otherwise(F.col("processed") / total), 4))


def extremes(df: DataFrame, group: str, id_col: str, p: str, middle: float = 0.6) -> DataFrame:
    """By group, of rows predicted positive: the surest one and the one nearest to ``middle`` (ties: the smallest id)."""
    x = df.filter(F.col(p) >= 0.5)
    return x.groupBy(group).agg(
        F.min_by(id_col, F.struct(-F.col(p), F.col(id_col))).alias("surest"), F.min_by(id_col, F.struct(F.abs(F.col(p) - middle), F.col(id_col))).alias("middle"), F.count("*").alias("candidates")
    )


def cell_shares(df: DataFrame, group: str, p: str, y: str) -> DataFrame:
    """By group and cell (true, predicted) the rows, and their share of the group."""
    x = df.groupBy(group, F.col(y).alias("actual"), (F.col(p) >= 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def weighted_loss(batches: DataFrame, group: str, loss: str, right: str, size: str) -> DataFrame:
    """By group the mean loss of batches by their sizes, and the accuracy; a group without rows has 0."""
    n = F.greatest(F.sum(size), F.lit(1))
    return batches.groupBy(group).agg((F.sum(F.col(loss) * F.col(size)) / n).alias("loss"), (F.sum(right) / n).alias("accuracy"))


def group_weights(losses: DataFrame, group: str, loss: str, weights: DataFrame, eta: float) -> DataFrame:
    """group, weight: each weight times e^(eta * mean loss) where the batch has the group, then all to a sum of 1.

    weights (group, weight) has a row for each group; the window without a key is over these rows.
    """
    mean = losses.groupBy(group).agg(F.avg(loss).alias("_mean"))
    x = weights.join(mean, group, "left").withColumn("weight", F.col("weight") * F.exp(F.lit(eta) * F.coalesce("_mean", F.lit(0.0))))
    return x.select(group, (F.col("weight") / F.greatest(F.sum("weight").over(Window.partitionBy()), F.lit(1e-12))).alias("weight"))


def clarity(df: DataFrame, id_col: str, factors: str, confidence: str, signal: str, stop: list[str]) -> DataFrame:
    """Reports that read well, with points, signals and place.

    Three factors at least, none twice, the first three words with content (legible, of letters, three or more, no stop
    word). Points: 3 for each of the first three that is a signal, 1 for each of the first five that is one, is a word
    with content or is legible, and 8. Order: points, signals, confidence, id. The place is over all that read well:
    meant for a panel's candidates, which are few by then.
    """
    lower = F.transform(factors, F.lower)
    content = lambda w: tx.legible(w) & w.rlike(r"^\p{L}{3,}$") & ~w.isin(stop)
    first = lambda n: F.slice("_f", 1, n)
    count = lambda n, f: F.size(F.filter(first(n), f))
    told = lambda w: w.rlike(signal)
    x = df.withColumn("_f", lower).filter((F.size("_f") >= 3) & (F.size(F.array_distinct("_f")) == F.size("_f")) & F.forall(first(3), content))
    x = x.select(id_col, confidence, count(3, told).alias("signals"), (3 * count(3, told) + count(5, told) + count(5, content) + count(5, tx.legible) + 8).alias("points"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("points"), F.desc("signals"), F.desc(confidence), id_col)))


def readable(factors: Column, stop: list[str]) -> Column:
    """Three factors at least, none twice, the first three legible, the first with content."""
    f = F.transform(factors, F.lower)
    return (F.size(f) >= 3) & (F.size(F.array_distinct(f)) == F.size(f)) & F.forall(F.slice(f, 1, 3), tx.legible) & F.get(f, F.lit(0)).rlike(r"^\p{L}{3,}$") & ~F.get(f, F.lit(0)).isin(stop)


def picks(df: DataFrame, group: str, source: str, order: list[Column], k: int) -> DataFrame:
    """df with turn: by group the first k - 1 rows, then the next from a source that these don't have, else the next.

    Only the first k rows of each source of a group can be among them, so no window holds more than these.
    """
    n, own = F.row_number().over(Window.partitionBy(group).orderBy(*order)), F.row_number().over(Window.partitionBy(group, source).orderBy(*order))
    x = df.withColumn("_own", own).filter(F.col("_own") <= k).drop("_own").withColumn("turn", n)
    x = x.withColumn("_source", F.concat(F.lit("="), F.col(source).cast("string")))
    x = x.withColumn("_source", F.coalesce("_source", F.lit("")))
    seen = F.collect_set(F.when(F.col("turn") < k, F.col("_source"))).over(Window.partitionBy(group))
    x = x.withColumn("_new", ~F.array_contains(seen, F.col("_source")))
    last = F.row_number().over(Window.partitionBy(group, F.col("turn") < k).orderBy(F.desc("_new"), "turn"))
    return x.withColumn("_last", last).filter((F.col("turn") < k) | (F.col("_last") == 1)).withColumn("turn", F.least("turn", F.lit(k))).drop("_source", "_new", "_last")


def label_of_name(name: Column, positive: list[str], negative: list[str]) -> Column:
    """1 or 0 by a part of the file's name, of either case; null: of neither kind."""
    has = lambda parts: F.lower(name).rlike("|".join(map(re.escape, parts)))
    return F.when(has(positive), 1).when(has(negative), 0)


def only_column(df: DataFrame, pattern: str) -> str:
    """The one column whose name has the pattern; none or several raise."""
    found = [c for c in df.columns if re.search(pattern, c)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns have {pattern!r}, not 1")
    return found[0]


def scale_point(answer: Column) -> Column:
    """1 to 5 from the start of an answer; others raise."""
    n = F.regexp_extract(F.coalesce(answer.cast("string"), F.lit("")), r"^\s*([1-5])", 1)
    return F.when(n != "", n.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not on the scale 1 to 5: "), F.coalesce(answer.cast("string"), F.lit("null")))).cast("int"))


def marked(answers: DataFrame, id_col: str, key: dict[str, str]) -> DataFrame:
    """id, question, answer, right: the columns that the key names as rows, each held against its answer."""
    x = answers.unpivot([id_col], sorted(key), "question", "answer").withColumn("answer", F.trim("answer"))
    want = F.create_map(*[F.lit(v) for pair in sorted(key.items()) for v in pair])
    return x.withColumn("right", F.coalesce(F.col("answer") == want[F.col("question")], F.lit(False)).cast("int"))


def repeated_span(text: Column, n: int = 20) -> Column:
    """start, stop (from 0) of the block that repeats the text's first n characters, up to its last link or the end."""
    at = F.call_function("locate", F.substring(text, 1, n), text, F.lit(n + 1)) - 1
    back = F.instr(F.reverse(text), "ptth")
    link = F.when(back > 0, F.length(text) - back - 3).otherwise(-1)
    return F.when((F.length(text) > n) & (at >= 0), F.struct(at.alias("start"), F.when(link > at, link).otherwise(F.length(text)).alias("stop")))


def proper_noun(word: Column, body: Column) -> Column:
    """Whether the word stands in the body, each time with a capital first and not in capitals only."""
    found = F.regexp_extract_all(body, F.concat(F.lit(r"(?iU)\b\Q"), word, F.lit(r"\E\b")), F.lit(0))
    capital = lambda w: (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & (F.upper(w) != w)
    return (F.size(found) > 0) & F.forall(found, capital)


def rebuilt(words: Column) -> Column:
    """Words as a text; none is the unknown token."""
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.lit(UNKNOWN))


def faithfulness(df: DataFrame, text: str, ranked: str, score: Callable[[Column], Column], part: float = 0.2) -> DataFrame:
    """df with comprehensiveness and sufficiency: the fall of the score without the explanation's words, and with them
    alone. ranked: the words by absolute weight, of which a part of the text's number of words counts, one at least.
    Both are null without words or weights. score takes a text."""
    x = df.withColumn("_w", tx.tokens(F.col(text)))
    n = F.greatest(F.lit(1), F.floor(F.size("_w") * part).cast("int"))
    x = x.withColumn("_top", F.transform(F.slice(ranked, F.lit(1), n), F.lower))
    kept = lambda keep: rebuilt(F.filter("_w", lambda w: F.array_contains(F.col("_top"), F.lower(w)) == F.lit(keep)))
    can = (F.size("_w") > 0) & (F.size(ranked) > 0)
    fall = lambda keep: F.when(can, F.round(score(F.col(text)) - score(kept(keep)), 6))
    return x.withColumns({"comprehensiveness": fall(False), "sufficiency": fall(True)}).drop("_w", "_top")


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values whose mask is true; over none it is 0, without an array null."""
    kept = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"])
    return F.aggregate(kept, F.lit(0.0), lambda s, z: s + z["v"]) / F.greatest(F.size(kept), F.lit(1))


def run_name(name: Column) -> Column:
    """Fit for a file: other characters than letters, digits, . _ - as one _, none at the ends; nothing left is run."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit("")), F.lit("run"))


def plain_run(runs: DataFrame, group: str, name: str, tags: list[str]) -> DataFrame:
    """By group the first run by name that has none of the tags."""
    return runs.filter(~F.col(name).rlike("|".join(map(re.escape, tags)))).groupBy(group).agg(F.min(name).alias(name))


def unnamed(features: DataFrame, names: DataFrame, feature: str) -> DataFrame:
    """Features without a display name."""
    return features.select(feature).distinct().join(names, feature, "left_anti")


def reproduced(measured: DataFrame, published: DataFrame, key: str, value: str, slack: float = 0.005) -> DataFrame:
    """key, value, published, agrees: a measure held against the published one; what was not published is null."""
    x = measured.select(key, value).join(published.select(key, F.col(value).alias("published")), key, "left")
    return x.withColumn("agrees", F.abs(F.col(value) - F.col("published")) <= slack)


def with_defaults(overrides: Column, defaults: dict[str, str]) -> Column:
    """The map's entries, and the defaults of keys that it lacks; a null map is the defaults."""
    own = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    every = F.create_map(*[F.lit(v) for pair in sorted(defaults.items()) for v in pair])
    return F.map_concat(F.map_filter(every, lambda k, _: ~F.map_contains_key(own, k)), own)


def factors_of_map(weights: Column) -> Column:
    """(name, weight) of each entry, in order of names."""
    return F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("weight"))))


def factors_of_arrays(names: Column, weights: Column) -> Column:
    """(name, weight) by place; arrays of different lengths raise."""
    same = F.size(names) == F.size(weights)
    return F.when(same, F.zip_with(names, weights, lambda n, w: F.struct(n.alias("name"), w.alias("weight")))).when(same.isNotNull(), F.raise_error(F.lit("names and weights differ in number")).cast("array<struct<name:string,weight:double>>"))
