"""Sampling, balancing and splits; every choice goes by a hash of the id, so it doesn't depend on the rows' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_key(c: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed + "|"), c.cast("string")), 256)


def uniform(c: Column, seed: str) -> Column:
    """A number of 0, 0.0001, ... 1 from the id."""
    return F.pmod(F.conv(F.substring(rank_key(c, seed), 1, 8), 16, 10).cast("bigint"), F.lit(10001)) / 10000


def per_group(df: DataFrame, group: str, id_col: str, n: int, seed: str) -> DataFrame:
    """min(n, size) rows of each group. Spark keeps n rows of a group in each map task before it shuffles."""
    w = Window.partitionBy(group).orderBy(rank_key(F.col(id_col), seed), id_col)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def first_by_hash(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows in a fixed pseudo-random order."""
    return df.withColumn("_k", rank_key(F.col(id_col), seed)).orderBy("_k", id_col).limit(n).drop("_k")


def random_split(df: DataFrame, id_col: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Row by row, independent of clusters."""
    u = uniform(F.col(id_col), seed)
    return df.withColumn("split", F.when(u <= train, "train").when(u <= train + val, "val").otherwise("test"))


def group_split(df: DataFrame, cluster: str, stratum: str, id_col: str, seed: str, train: float = 0.8, val: float = 0.9) -> DataFrame:
    """df with split: within each stratum clusters are put in hash order, and one goes to train, val or test by the
    cumulative share of rows that it ends at; a null cluster is its own. A cluster is never divided: its stratum is
    the smallest that it has.

    The window is over clusters, not rows; its running sum is the only step that needs a stratum in one place.
    """
    own = F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("#"), F.col(id_col).cast("string")))
    x = df.withColumn("_own", own)
    sizes = x.groupBy("_own").agg(F.min(stratum).alias("_stratum"), F.count("*").alias("_n")).withColumn("_k", rank_key(F.col("_own"), seed))
    w = Window.partitionBy("_stratum").orderBy("_k", "_own").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("_n").over(w) / F.sum("_n").over(Window.partitionBy("_stratum"))
    sizes = sizes.withColumn("split", F.when(share <= train, "train").when(share <= val, "val").otherwise("test"))
    return x.join(sizes.select("_own", "split"), "_own").drop("_own")


def ranked(df: DataFrame, group: list[str], id_col: str, seed: str, name: str) -> DataFrame:
    """df with the place of each row, from 1, in hash order of the ids of its group; ids are unique.

    A group may hold any share of the rows: places are counted within 4,096 slices of the hash, and the slices' sizes
    are summed by a window over slices, not rows.
    """
    key = rank_key(F.col(id_col), seed)
    x = df.withColumn("_k", key).withColumn("_slice", F.substring("_k", 1, 3))
    sizes = x.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(g).alias(f"_{k}") for k, g in enumerate(group)], F.col("_slice").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_slice") == F.col("_of")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy("_k", id_col))
    x = x.withColumn("_in", place).join(sizes, on).withColumn(name, F.col("_before") + F.col("_in"))
    return x.select(*df.columns, name)


def negative_budget(positives: Column, kept: Column, prevalence: float) -> Column:
    """Negatives that go with so many positives at the prevalence, beyond those that are kept anyway."""
    return F.bround(positives * (F.lit(1.0) - F.lit(float(prevalence))) / F.lit(float(prevalence))).cast("long") - kept


def source_quotas(pending: DataFrame, most_of_one: float = 0.40) -> DataFrame:
    """pending (source, n, budget, spent): a row for each source with n negatives to choose from -> source, take.

    Half of what the budget leaves is dealt out evenly, as far as a source has so many. The other half goes in
    proportion to what sources have left, in order of their names: each share is of what the sources before it have
    left over, one at least, and at most ``most_of_one`` of the budget. That is a fold over the sources, of which there
    are few, in one row.
    """
    one = pending.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", F.col("n").cast("long").alias("n")))).alias("of"), F.max("budget").alias("budget"), F.max("spent").alias("spent"))
    free = F.greatest(F.col("budget") - F.col("spent"), F.lit(0))
    one = one.withColumn("even", F.floor(free / (F.lit(2) * F.greatest(F.size("of"), F.lit(1)))))
    one = one.withColumn("of", F.transform("of", lambda s: F.struct(s["source"].alias("source"), F.least(s["n"], F.col("even")).alias("first"), (s["n"] - F.least(s["n"], F.col("even"))).alias("rest"))))
    total = lambda field: F.aggregate("of", F.lit(0).cast("long"), lambda a, s: a + s[field])
    one = one.withColumns({"left": free - total("first"), "all": total("rest"), "top": F.floor(F.lit(float(most_of_one)) * F.col("budget"))})

    def deal(state: Column, s: Column) -> Column:
        fair = F.greatest(F.floor(state["left"] * s["rest"] / F.col("all")), F.lit(1))
        share = F.when((s["rest"] > 0) & (state["left"] > 0), F.least(fair, F.col("top"), s["rest"], state["left"])).otherwise(F.lit(0)).cast("long")
        done = F.concat(state["done"], F.array(F.struct(s["source"].alias("source"), (s["first"] + share).cast("long").alias("take"))))
        return F.struct((state["left"] - share).cast("long").alias("left"), done.alias("done"))

    kind = pending.schema["source"].dataType.simpleString()
    start = F.struct(F.col("left").cast("long").alias("left"), F.array().cast(f"array<struct<source:{kind},take:bigint>>").alias("done"))
    return one.select(F.inline(F.aggregate("of", start, deal)["done"]))


def balance(df: DataFrame, id_col: str, source: str, label: str, tri: str, protected: str, seed: str, prevalence: float = 0.40) -> DataFrame:
    """All positives, all rows of the protected source, and negatives up to the target prevalence: first those with all
    modalities, as many as positives have them, then by ``source_quotas`` from all that remain, these included.

    Ids are unique, labels 0 or 1. Nothing is run here; counts are a row for each source, and rows are cut at their
    places in hash order.
    """
    own = df.columns
    x = df.withColumns({"_neg": F.col(label) == 0, "_kept": F.col(source).eqNullSafe(F.lit(protected)), "_tri": F.coalesce(F.col(tri), F.lit(False))})
    counts = x.groupBy(F.col(source).alias("_of")).agg(
        F.count_if(~F.col("_neg")).alias("p"), F.count_if(~F.col("_neg") & F.col("_tri")).alias("tp"), F.count_if(F.col("_neg") & F.col("_kept")).alias("kn"), F.count_if(F.col("_neg") & ~F.col("_kept") & F.col("_tri")).alias("tn")
    )
    everything = Window.partitionBy()  # its rows are the sources
    total = lambda c: F.sum(c).over(everything)
    counts = counts.select("_of", negative_budget(total("p"), total("kn"), prevalence).alias("budget"), total("tp").alias("tp"), total("tn").alias("tn"))
    counts = counts.select("_of", "budget", F.greatest(F.least("tp", "tn", "budget"), F.lit(0)).alias("spent"))
    negatives = ranked(x.filter("_neg and not _kept"), ["_tri"], id_col, seed, "_place").join(counts, F.col(source).eqNullSafe(F.col("_of")))
    negatives = negatives.withColumn("_first", F.col("_tri") & (F.col("_place") <= F.col("spent"))).drop("_place")
    quotas = source_quotas(negatives.filter("not _first").groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.max("budget").alias("budget"), F.max("spent").alias("spent")))
    rest = ranked(negatives.filter("not _first").select(*own), [source], id_col, seed, "_place").join(quotas.select(F.col("source").alias("_of"), "take"), F.col(source).eqNullSafe(F.col("_of")))
    return x.filter("not _neg or _kept").select(*own).unionByName(negatives.filter("_first").select(*own)).unionByName(rest.filter("_place <= take").select(*own))


def crossing(df: DataFrame, cluster: str, split: str) -> DataFrame:
    """Clusters on more than one side of a split: empty if the split is sound."""
    return df.groupBy(cluster).agg(F.count_distinct(split).alias("sides")).filter("sides > 1")


def fractions(df: DataFrame, id_col: str, seed: str, shares=(0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """share, and the rows that belong to it: each share holds the smaller ones."""
    u = uniform(F.col(id_col), seed)
    return df.withColumn("share", F.explode(F.filter(F.array(*[F.lit(s) for s in shares]), lambda s: u <= s)))


def equal_mass(df: DataFrame, group: str, id_col: str, draws: int, seed: str) -> DataFrame:
    """A weighted sample with replacement in which all groups have the same expected mass: df with times >= 1.

    A row's number of draws is Poisson with mean draws / (groups * size of its group), by hash of its id, so rows are
    decided one by one and nothing is gathered but the sizes.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_k", F.count("*").over(Window.partitionBy()))  # a row for each group
    x = df.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_m", F.lit(float(draws)) / (F.col("_k") * F.col("_n")))
    # a mean beyond 500 is a sum of equal parts, each with a hash of its own, so exp(-part) does not vanish
    parts = F.greatest(F.ceil(F.col("_m") / 500), F.lit(1)).cast("int")
    part = F.col("_m") / parts
    last = F.ceil(part + 12 * F.sqrt(part) + 20).cast("int")  # no number of draws lies beyond, at 2^-40

    def drawn(j: Column) -> Column:
        """Inverse of the Poisson distribution function, by summing its terms."""
        h = F.when(j == 0, F.xxhash64(id_col, F.lit(seed))).otherwise(F.xxhash64(id_col, F.lit(seed), j))
        u = (F.pmod(h, F.lit(1 << 40)) + 0.5) / float(1 << 40)
        start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("c"), F.lit(0).alias("n"), u.alias("u"))
        step = lambda a, i: F.struct((a["p"] * part / (i + 1)).alias("p"), (a["c"] + a["p"] * part / (i + 1)).alias("c"), (a["n"] + (a["u"] > a["c"]).cast("int")).alias("n"), a["u"].alias("u"))
        return F.aggregate(F.sequence(F.lit(0), last), start, step)["n"]

    times = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, j: n + drawn(j))
    return x.withColumn("times", times).filter("times > 0").drop("_g", "_n", "_k", "_m")


def shuffled_options(options: Column, correct: Column, question: Column) -> Column:
    """Options in hash order of (question, option), turned by one if the correct one would come first."""
    keyed = F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws("|", question, o), 256).alias("k"), o.alias("o")))
    order = F.transform(F.array_sort(keyed), lambda s: s["o"])
    turned = F.concat(F.slice(order, 2, 1_000_000), F.slice(order, 1, 1))
    return F.when((F.size(order) > 1) & (F.element_at(order, 1) == correct), turned).otherwise(order)
