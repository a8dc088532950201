"""Exact copies and near-duplicate campaigns."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import fingerprint, shingles, tokens
from quern.operators.links import bit_sketch, connected, resolved
from quern.tables import Scratch, small


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with equal key the one with the smallest order value.

    The winner of each key comes from an aggregation that combines map-side; only (key, order) is shuffled for it, and
    the rows are then met by a semi join on the order column, which must be unique.
    """
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias("_first")).select("_first")
    return df.join(first, F.col(order) == F.col("_first"), "left_semi")


def keep_first_text(df: DataFrame, text: str, order: str) -> DataFrame:
    return keep_first(df, fingerprint(F.col(text)), order)


def band_keys(df: DataFrame, text: str, id_col: str, family: str, rows: int = 13, bands: int = 9, k: int = 5) -> DataFrame:
    """id, key for each row and band: the family's hash of ``rows`` minima over k-word shingles; none if the text is short.

    A minimum over seeded hashes of the shingles stands for a permutation. Shingles are rows of one aggregation with all
    minima, compiled, that ends map-side: each text is whole in one task.
    """
    hashes = F.transform(shingles(F.col(text), k), lambda w: F.xxhash64(w))
    x = df.select(F.col(id_col).alias("id"), F.col(family).alias("family"), F.xxhash64(text).alias("of"), F.explode(hashes).alias("h"))
    least = x.groupBy("id", "family", "of").agg(*[F.min(F.xxhash64("h", F.lit(seed))).alias(f"m{seed}") for seed in range(bands * rows)])
    made = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)])
    return least.select("id", "family", F.posexplode(made).alias("band", "value")).select("id", F.xxhash64("family", "band", "value").alias("key"))


def shingle_hashes(text: Column, salt: Column, k: int) -> Column:
    """Sorted distinct hashes of the k-word shingles of the lower-cased text, from hashes of its words and the salt."""
    words = F.transform(tokens(F.lower(text)), lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    made = F.transform(F.array(words), lambda a: F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.xxhash64(salt, *[F.get(a, i + j) for j in range(k)]))).otherwise(none))
    return F.sort_array(F.array_distinct(F.coalesce(made[0], none)))


def verified_campaigns(df: DataFrame, text: str, id_col: str, family: str, k: int = 5) -> DataFrame:
    """id, family, cluster: the smallest id that links reach within the family; short texts are alone.

    Texts link if their sets of k-word shingles have similarity 4/5 or more: every such pair is found, and none below.
    Ids are whole numbers and unique. Sets of a and b shingles that link share 4/5 of either at least, so of the
    a - ceil(4a/5) + l(a) smallest hashes of each, salted by the family, l of the smaller set stand in the other's too;
    l(a) is 1 + a div 20, and no partner has less than ceil(4a/5). These hashes, apart for sizes that can't link, are
    the buckets in which ``quern.operators.links`` looks for links. Equal sets are one node.

    Prefixes are all that is written of every set. Hashes that stand in one set only, most of them, go before sets are
    met; the whole sets are made again from the texts, of those alone that share enough buckets.
    """
    if df.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number")
    s, wide = Scratch(df.sparkSession), Scratch(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.col(family).alias("family"), F.col(text).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("place"))
    made = shingle_hashes(F.col("text"), F.col("family"), k)
    owner = F.when(F.size("tokens") > 0, F.xxhash64("tokens"))
    prefix = F.expr("slice(tokens, 1, size(tokens) - (4 * size(tokens) + 4) div 5 + 1 + size(tokens) div 20)")
    first = wide.written(texts.withColumn("tokens", made).select("id", "family", "place", owner.alias("owner"), F.size("tokens").alias("n"), prefix.alias("prefix")), "prefixes")
    rows = s.written(first.select("id", "family", "place", "owner"), "rows")
    classes = s.written(rows.filter("owner is not null").groupBy("owner").agg(F.min("id").alias("first"), F.min("place").alias("place")), "classes")
    keys = first.join(small(classes.select("owner", "place")), ["owner", "place"], "left_semi").select(F.explode("prefix").alias("key"), "owner", "n")
    shared = keys.groupBy("key").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low <> high").select("key")
    # a set stands in the bands of all sizes from its own to 5/4 of it
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(1.25))).cast("int")
    members = keys.join(small(s.written(shared, "shared")), "key").withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.expr("5 * n div 4")))))
    members = members.select(F.xxhash64("key", "band").alias("key"), "owner", "band", F.expr("cast(1 + (4 * n + 4) div 5 div 20 as int)").alias("least"), F.lit(1).alias("times"))
    members = s.written(members, "members")
    wide.drop()

    def sets_of(owners: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = s.written(classes.join(small(s.written(owners, "able")), "owner").select("place", F.col("owner").alias("wanted")), "wanted")
        own = texts.join(small(wanted), "place").withColumn("tokens", made).select("wanted", "tokens", owner.alias("owner"))
        own = s.written(own, "sets").filter("wanted = owner").select("owner", "tokens")
        if own.count() > wanted.count():  # repeated rows
            own = s.written(own.dropDuplicates(["owner"]), "sets")
        return own, s.written(bit_sketch(own.select("owner", F.explode("tokens").alias("token"))), "sketches")

    labels = connected(members, sets_of, s)
    owners = resolved(classes.select("owner", "first"), labels)
    heads = owners.groupBy("label").agg(F.min("first").alias("cluster"))
    found = owners.join(heads, "label").select("owner", "cluster")
    found = rows.join(found, "owner", "left").select(F.col("id").alias(id_col), F.col("family").alias(family), F.coalesce("cluster", "id").alias("cluster"))
    found = Scratch(df.sparkSession).written(found, "campaigns")
    s.drop()
    return found


def agreement(found: DataFrame, true: DataFrame, id_col: str, family: str) -> DataFrame:
    """family, true_pairs, found_pairs, both_pairs, recall, precision of the clusters ``found`` against ``true``.

    A pair is two rows of one cluster; pairs are counted from the sizes of clusters and their overlaps, not made.
    """
    x = true.select(id_col, F.col(family).alias("family"), F.col("cluster").alias("t")).join(found.select(id_col, F.col("cluster").alias("f")), id_col)
    cells = x.groupBy("family", "t", "f").agg(F.count("*").alias("n"))
    pairs = lambda d, c: d.groupBy("family").agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias(c))
    sides = [pairs(cells.groupBy("family", c).agg(F.sum("n").alias("n")), f"{name}_pairs") for c, name in (("t", "true"), ("f", "found"))]
    out = pairs(cells, "both_pairs")
    for side in sides:
        out = out.withColumnRenamed("family", "_f").join(side, F.col("_f").eqNullSafe(F.col("family"))).drop("_f")
    share = lambda c: F.when(F.col(c) > 0, F.col("both_pairs") / F.col(c)).alias("recall" if c == "true_pairs" else "precision")
    return out.select("family", "true_pairs", "found_pairs", "both_pairs", share("true_pairs"), share("found_pairs"))


def campaigns(df: DataFrame, text: str, id_col: str, family: str, rounds: int | None = None) -> DataFrame:
    """id, family, cluster: the smallest id that shared bands reach within the family; short texts are alone.

    Nothing is verified: a pair at similarity 0.80 shares a band in 0.40 of the cases, one at 0.90 in 0.93, and some
    below 0.80 do (``agreement`` counts both). Labels travel until they settle; more than ``rounds``, if given, raise.

    Members of a band meet its smallest member, not each other. Labels travel along (band, id) memberships: each round
    is two aggregations that combine map-side, whatever a band's size. The lineage is cut by written tables.
    """
    s = Scratch(df.sparkSession)
    linked = s.written(band_keys(df, text, id_col, family), "members")
    labels = s.written(df.select(F.col(id_col).alias("id"), F.col(family).alias("family")).distinct().withColumn("cluster", F.col("id")), "labels")
    for turn in count():
        if turn == rounds:
            raise RuntimeError(f"labels have not settled after {rounds} rounds")
        least = linked.join(labels, "id").groupBy("key").agg(F.min("cluster").alias("least"))
        near = linked.join(least, "key").groupBy("id").agg(F.min("least").alias("near"))
        new = labels.join(near, "id", "left").select("id", "family", "cluster", F.least("cluster", "near").alias("new"))
        jump = new.select(F.col("id").alias("to"), F.col("new").alias("further"))
        new = s.written(new.join(jump, F.col("new") == F.col("to"), "left").select("id", "family", "cluster", F.least("new", "further").alias("new")), "labels")
        if new.filter("new <> cluster").isEmpty():
            break
        labels = new.select("id", "family", F.col("new").alias("cluster"))
    found = Scratch(df.sparkSession).written(labels.select(F.col("id").alias(id_col), F.col("family").alias(family), "cluster"), "banded")
    s.drop()
    return found


def dense_numbers(df: DataFrame, cluster: str, family: str) -> DataFrame:
    """family, cluster, number: clusters numbered from 0 by their first member, within each family."""
    from pyspark.sql import Window

    heads = df.select(family, cluster).distinct()
    return heads.withColumn("number", F.row_number().over(Window.partitionBy(family).orderBy(cluster)) - 1)
