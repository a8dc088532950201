"""Document fingerprints by I-Match: of a text's distinct terms those within a band of inverse document frequency are
kept, and hashed over several randomised subsets of that lexicon.

A subset of rate 1 / 2^b holds the terms of which b bits of a seeded hash are zero; there are COPIES subsets for each
of RATES, so texts of a few terms and of thousands both have subsets with a handful of theirs. A subset's hash is the
sum of its distinct terms' hashes, which, as that of their sorted list, is the same in whatever order they come, but
without holding the list in one place. All steps are DataFrame operations; document frequencies are counted over all
rows. Two texts are near from a likeness of NEAR on: one of the subsets agrees.

The lexicon is broadcast only if it has at most BROADCAST terms; beyond that it is joined by a shuffle.

Defined results: null is empty; a text without terms in the band is hashed over all its terms, one whose terms in the
band are in no subset over those in the band, and one without terms has an empty fingerprint; equal texts have equal
fingerprints; whole texts count, however long; documents follow each other by (id, hash of the text), null ids first,
the first after the last; rows with equal id and text have the same result each; an empty table gives an empty result;
extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written

#: The band of log(N / df) / log(N).
BAND = (0.25, 0.85)
RATES = (2, 4, 6, 8, 10)
COPIES = 8
#: Subsets with a member that a rate must have to be heard beside the densest rate.
LEAST = 5
BROADCAST = 1_000_000
#: Likeness from which two texts are near.
NEAR = 0.125
_BITS = (1 << 40) - 1


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++"), F.lit(0)))


def lexicon(docs: DataFrame, text: str = "text", band=BAND) -> DataFrame:
    """Hashes of the terms whose document frequency lies in the band."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col(text))).alias("t")).select(F.xxhash64("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    most, least = n ** (1 - band[0]), n ** (1 - band[1])
    return written(counts.filter((F.col("df") >= least) & (F.col("df") <= most)).select("term"), "lexicon")


def _slots() -> list[tuple[int, int]]:
    return [(b, c) for b in RATES for c in range(COPIES)]


def _sums(times: Column, also: Column | None = None, tag: str = "") -> list[Column]:
    """For each subset the sum of its members' hashes, and one over all terms; times: how often each row is counted.

    also: a further condition on the rows; tag goes before the names.
    """
    t = F.col("term")
    value = F.xxhash64(t, F.lit(77)).bitwiseAND(F.lit(_BITS))
    value = value if also is None else F.when(also, value)
    draws = [F.xxhash64(t, F.lit(c)) for c in range(COPIES)]
    out = [F.sum(F.when(F.col("inside") & (draws[c].bitwiseAND(F.lit((1 << b) - 1)) == 0), value)).alias(f"{tag}s{b}_{c}") for b, c in _slots()]
    return [*out, F.sum(F.when(F.col("inside"), value)).alias(f"{tag}within"), F.sum(value).alias(f"{tag}whole")]


def _print(times: str, tag: str = "") -> Column:
    """The fingerprint from the sums: array<bigint>, a value for each subset, null if it has no member."""
    within, whole = F.col(f"{tag}within"), F.col(f"{tag}whole")
    none = F.coalesce(*[F.col(f"{tag}s{RATES[0]}_{c}") for c in range(COPIES)]).isNull()  # a member at another rate is one at the first
    value = lambda c: F.when(within.isNull(), whole).when(none, within).otherwise(F.col(f"{tag}{c}"))
    return F.transform(F.array(*[value(f"s{b}_{c}") for b, c in _slots()]), lambda v: F.call_function("div", v, F.col(times)))


def _marked(rows: DataFrame, lex: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term and inside: a row for each distinct term of each row, or one with no term."""
    x = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("t")).select(*keys, F.when(F.col("t").isNotNull(), F.xxhash64("t")).alias("term"))
    marked = lex.select("term", F.lit(True).alias("inside"))
    if lex.count() <= BROADCAST:
        marked = F.broadcast(marked)
    return x.join(marked, "term", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def fingerprints(rows: DataFrame, lex: DataFrame, keys: list[str], times: str, text: str = "text") -> DataFrame:
    """keys and print (array<bigint>: a value for each subset, null if it has no member) of each row; rows alike in
    their keys have equal texts and are ``times`` many."""
    x = _marked(rows, lex, keys, text).groupBy(*keys).agg(*_sums(F.col(times)))
    return x.select(*keys, _print(times).alias("print"))


def likeness(a: Column, b: Column) -> Column:
    """Of the rates, the largest share of subsets that agree among those with a member in either text; 1 if all agree.

    Besides the first, the densest, only rates with LEAST such subsets count: one term is no evidence.
    """
    shares = []
    for k in range(len(RATES)):
        x, y = (F.slice(v, k * COPIES + 1, COPIES) for v in (a, b))
        both = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e))
        either = F.size(F.filter(F.zip_with(x, y, lambda p, q: p.isNotNull() | q.isNotNull()), lambda e: e))
        shares.append(F.when(either >= (LEAST if k else 1), both / either).otherwise(F.lit(0.0)))
    return F.when(as_text(a) == as_text(b), F.lit(1.0)).otherwise(F.greatest(*shares))


def as_text(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda v: F.coalesce(F.lower(F.hex(v)), F.lit("-"))), ".")


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (id, h, n) -> for each distinct (id, h): times, n, next (nid, nh) and previous (pid, ph, pn) in order.

    Only ids and lengths are moved: range partitions are numbered, each is a window, and their ends are joined up by a
    window over one row for each partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = written(docs.groupBy("id", "h").agg(F.count("*").alias("times"), F.max("n").alias("n")), "ids")
    x = written(ids.repartitionByRange(parts, "id", "h").withColumn("_p", F.spark_partition_id()), "ranges")
    row = F.struct("id", "h", "n")
    ends = x.groupBy("_p").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    order, everything = Window.orderBy("_p"), Window.partitionBy()
    ends = ends.select("_p", F.coalesce(F.lead("first").over(order), F.min("first").over(everything)).alias("after"), F.coalesce(F.lag("last").over(order), F.max("last").over(everything)).alias("before"))
    w = Window.partitionBy("_p").orderBy("id", "h")
    x = x.select("*", F.lead(row).over(w).alias("next"), F.lag(row).over(w).alias("prev")).join(ends, "_p")
    x = x.withColumns({"next": F.coalesce("next", "after"), "prev": F.coalesce("prev", "before")})
    return x.select("id", "h", "times", "n", F.col("next.id").alias("nid"), F.col("next.h").alias("nh"), F.col("prev.id").alias("pid"), F.col("prev.h").alias("ph"), F.col("prev.n").alias("pn"))


def edited(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, h, text, edited, times, n, nid, nh: a text whose last quarter is the beginning of the next document's.

    Whole texts move once; of the next one only as much as is needed.
    """
    t = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    map_ = written(neighbours(t.select("id", "h", F.length("text").alias("n"))), "neighbours")
    here = t.alias("t").join(map_.alias("m"), F.col("t.id").eqNullSafe(F.col("m.id")) & (F.col("t.h") == F.col("m.h"))).select("t.text", "m.*")
    ahead = here.select(F.col("pid").alias("aid"), F.col("ph").alias("ah"), F.expr("substring(text, 1, pn div 4)").alias("ahead"))
    if not map_.filter("times > 1").isEmpty():
        ahead = ahead.distinct()
    x = here.join(ahead, F.col("id").eqNullSafe(F.col("aid")) & (F.col("h") == F.col("ah")))
    return x.select("id", "h", "text", F.expr("concat(substring(text, 1, n - n div 4), ahead)").alias("edited"), "times", "n", "nid", "nh")


def compare_edited(docs: DataFrame, text: str = "text", id_col: str = "doc_id", band=BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs."""
    lex = lexicon(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), "text", band)
    x = edited(docs, text, id_col)
    versions = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v")
    keys = ["id", "h", "times", "n", "nid", "nh", "sha"]
    rows = x.withColumn("sha", F.sha2("edited", 256)).select(*keys, versions).select(*keys, "v.kind", "v.text")
    sums = [c for k in (0, 1) for c in _sums(F.col("times"), F.col("kind") == k, f"v{k}_")]
    both = _marked(rows, lex, [*keys, "kind"], "text").groupBy(*keys).agg(*sums)
    pair = written(both.select(*keys, _print("times", "v0_").alias("own"), _print("times", "v1_").alias("changed")), "prints")
    after = pair.select(F.col("id").alias("bid"), F.col("h").alias("bh"), F.col("own").alias("following"))
    y = pair.join(after, F.col("nid").eqNullSafe(F.col("bid")) & (F.col("nh") == F.col("bh")))
    y = y.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return y.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
