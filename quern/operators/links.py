"""Links between sets, and the components that they make, from buckets that linked sets share.

A node is an owner: a set of 64-bit tokens. ``members`` (key, owner, band, least, times) says which owners stand in
which buckets: any two linked owners share at least ``least`` buckets (a bucket counts ``times``) of some band. What
links is found exactly, without the pairs of a group that one of its members already holds together:

1. Buckets whose members all are in one component are done. An owner with fewer than ``least`` open buckets in a band
   has no link out of its component, and leaves them.
2. In each open bucket one member, the first by a hash of the turn, is met by the members of other components (stars).
   What links is merged, and 1 and 2 are repeated while they still merge much.
3. In the buckets that are still open, members of different components meet.

Before sets are fetched and counted, a pair must pass a bound on parity sketches of 1024 single bits: a token of both
sets changes both alike, so more than (a + b) / 9 differing bits rule similarity 4/5 out. A hot bucket is split by
adaptive skew joins: nothing but a projection follows its join.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.tables import Scratch, small

#: 64-bit words of the sketch of single bits.
WORDS = 16
SKETCH = [f"s{k}" for k in range(WORDS)]
#: Stars go on while they merge at least this share of the components that are left.
GOES_ON = 0.02


def may_link(a: str, b: str) -> Column:
    """The bound on sketches, over rows with n and sketch columns of both sides."""
    apart = F.lit(0)
    for c in SKETCH:
        apart = apart + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return 9 * apart <= F.col(f"{a}.n") + F.col(f"{b}.n")


def bit_sketch(tokens: DataFrame) -> DataFrame:
    """tokens (owner, token), distinct: owner, n and its sketch; combines map-side."""
    word, bit = F.shiftright("token", 6).bitwiseAND(F.lit(WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(F.lit(63)).cast("int"))
    words = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0)).cast("long").alias(c) for k, c in enumerate(SKETCH)]
    return tokens.groupBy("owner").agg(F.count("*").alias("n"), *words)


def linked(pairs: DataFrame, sets: DataFrame, s: Scratch) -> DataFrame:
    """Those of pairs (a, b) whose sets (owner, tokens) have 100 * intersection >= 80 * union."""
    pairs = small(pairs)
    wanted = small(s.written(pairs.select(F.col("a").alias("owner")).union(pairs.select("b")).distinct(), "wanted"))
    own = sets.join(wanted, "owner").select("owner", "tokens")
    x = own.select(F.col("owner").alias("a"), F.col("tokens").alias("ta")).join(pairs, "a").join(own.select(F.col("owner").alias("b"), F.col("tokens").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return x.filter(100 * both >= 80 * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """node, label: the smallest node that edges (a, b) reach; nodes without edges are left out.

    Each round hangs every node below its smallest neighbour, goes one step up, and contracts the edges to the roots;
    edges within a tree vanish, so what is joined shrinks from round to round, and a star is done after one.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left, labels = s.written(edges.select(low, high).filter("a < b").distinct(), "edges"), None
    while True:
        near = left.union(left.select(F.col("b"), F.col("a"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        near = s.written(near.select("node", F.least("node", "near").alias("near")), "near")
        up = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        roots = s.written(near.join(up, "near").select("node", "label"), "roots")
        if labels is None:
            labels = roots
        else:
            again = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = s.written(labels.join(again, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        one, two = (roots.select(F.col("node").alias(c), F.col("label").alias(f"r{c}")) for c in ("a", "b"))
        left = s.written(left.join(one, "a").join(two, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels


def opened(members: DataFrame, s: Scratch) -> DataFrame:
    """The rows of members (with label) that stand in buckets of several components, of owners that may link there."""
    both = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    rest = s.written(members.join(both, "key"), "open")
    able = s.written(rest.groupBy("owner", "band", "least").agg(F.sum("times").alias("shared")).filter("shared >= least").select("owner", "band"), "able")
    return s.written(rest.join(small(able), ["owner", "band"]).select(*members.columns).dropDuplicates(["key", "owner"]), "open")


def stars(rest: DataFrame, sketches: DataFrame, turn: int, s: Scratch) -> DataFrame:
    """Pairs (a, b) of a bucket's first member of this turn with those of other components, as far as the bound allows."""
    order = F.xxhash64("owner", F.lit(turn))
    first = rest.groupBy("key").agg(F.min_by("owner", order).alias("first"), F.min_by("label", order).alias("other"))
    pairs = rest.join(first, "key").filter("label <> other").select(F.least("first", "owner").alias("a"), F.greatest("first", "owner").alias("b")).distinct()
    p, q = (sketches.alias(c) for c in "pq")
    return pairs.join(p, F.col("a") == F.col("p.owner")).join(q, F.col("b") == F.col("q.owner")).filter(may_link("p", "q")).select("a", "b")


def across(rest: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of all members of different components that share a bucket, as far as the bound allows."""
    x = rest.select("key", "owner", "label").join(sketches, "owner")
    a, b = x.alias("a"), x.alias("b")
    apart = (F.col("a.owner") < F.col("b.owner")) & (F.col("a.label") != F.col("b.label"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & apart & may_link("a", "b")).select(F.col("a.owner").alias("a"), F.col("b.owner").alias("b")).distinct()


def relabelled(labels: DataFrame | None, again: DataFrame, s: Scratch) -> DataFrame:
    """labels (node, label) after components (node, label) of the labels."""
    if labels is None:
        return again
    root = again.select(F.col("node").alias("label"), F.col("label").alias("root"))
    old = labels.join(small(root), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return s.written(old.unionByName(again.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")


def connected(members: DataFrame, sets_of, s: Scratch) -> DataFrame | None:
    """node, label for all owners that a link joins to another, None if there is no link.

    members: as above; sets_of: owners (a column owner) -> two written tables with a row for each of them: sets (owner,
    tokens) and sketches (owner, n, s0 to s15).
    """
    rest = opened(members.withColumn("label", F.col("owner")), s)
    sets, sketches = sets_of(rest.select("owner").distinct())
    sketches, labels = small(sketches), None
    for turn in count():
        if rest.isEmpty():
            return labels
        edges = s.written(linked(s.written(stars(rest, sketches, turn, s), "pairs"), sets, s), "edges")
        moved = 0
        if not edges.isEmpty():
            names = small(s.written(rest.select("owner", "label").distinct(), "names"))
            one, two = (names.select(F.col("owner").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
            again = components(edges.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), s)
            labels, root = relabelled(labels, again, s), small(again.select(F.col("node").alias("label"), F.col("label").alias("root")))
            before, moved = rest.select("label").distinct().count(), again.filter("node <> label").count()
            rest = opened(rest.join(root, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root"), s)
        if not moved or moved < GOES_ON * before:
            break
    edges = s.written(linked(s.written(across(rest, sketches), "pairs"), sets, s), "edges")
    if edges.isEmpty():
        return labels
    names = rest.select("owner", "label").distinct()
    one, two = (names.select(F.col("owner").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
    return relabelled(labels, components(edges.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), s), s)


def resolved(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes (with owner) and the label of each: its own owner where nothing links."""
    if labels is None:
        return nodes.withColumn("label", F.col("owner"))
    return nodes.join(labels.withColumnRenamed("node", "owner"), "owner", "left").withColumn("label", F.coalesce("label", "owner"))
