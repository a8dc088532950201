"""Mixing sources to target weights as a time-varying curriculum.

Each source has a target of words (its share by weight of a total, at most ``cap`` times its own size) and a
schedule of relative weight over the training time 0 to 1. The schedule is integrated to the source's cumulative
demand; a document's place in its source's stream, inverted through that integral, is its training position.
All steps are DataFrame operations. A source may hold any share of the rows: its running sums are taken over
hash-ordered buckets of the source, then over the buckets' totals.

Defined results: null text has size 0; whole texts are counted, however long; null source is a source of its own, last;
a source without words has target 0 and nothing is taken; rows with equal ids are rows of their own, ordered by size, and
repeated rows fill their source's stream one after the other; an empty table gives an empty result. The columns are
doc_id, text and source; extra ones, whatever their names, are left out of ``mix`` unless named by ``keep``, and stay as
they are in ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import unused, written

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2.0
#: Relative weight at the start and the end of training, by the source's place in the cycle of weights.
SCHEDULES = ((2.0, 1.0), (1.0, 1.0), (0.5, 1.5))
BUCKETS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total=TOTAL, cap=CAP) -> DataFrame:
    """sizes (source, source_size): a row for each source -> also slot, weight and target.

    A level l fills each source up to min(l * weight, cap * size); the level at which all together hold ``total``
    times the sum of sizes is found from running sums over the sources in order of the level that fills them. The
    windows have no key: their rows are the sources, not the documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy("fills_at", "slot")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    slot = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("slot") % len(weights) + 1).cast("int"))
    x = sizes.withColumn("slot", slot).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    x = x.withColumn("fills_at", F.col("most") / F.col("weight"))
    demand = F.lit(float(total)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    x = x.withColumn("level", demand / F.sum("weight").over(after))
    x = x.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "slot"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most")))
    return x.select("source", "source_size", "slot", "weight", target.alias("target"))


def _position(u: Column, slot: Column, schedules) -> Column:
    """The time at which the share u of a source's demand is used up: the inverse of the schedule's integral."""
    out = None
    for k, (a, b) in enumerate(schedules):
        t = u if a == b else (F.sqrt(F.lit(a * a) + F.lit(float(b * b - a * a)) * u) - F.lit(a)) / F.lit(b - a)
        hit = slot % len(schedules) == k
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, total=TOTAL, cap=CAP, schedules=SCHEDULES, seed: int = 0, keep=()) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken,
    positions (array<double>, one for each time that the document is taken), and the columns of ``keep``, an
    expression list of small columns that come along.

    A source's stream is its documents by hash of their id, repeated; a copy is taken while its middle lies within
    the target, so what is taken of a source is within one document of its target, and no document is taken more
    than ceil(cap) times.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key"), *keep), "sizes")
    names = [c for c in rows.columns if c not in ("doc_id", "source", "size", "_key")]
    bucket = F.shiftright(F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"), 2)
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sums.select("source", "_bucket", "_sum", start.alias("_start")), "starts")
    goal = targets(starts.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, total, cap)
    starts = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s._bucket", "s._start", "g.source_size", "g.slot", "g.target")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._bucket") == F.col("s._bucket"))
    x = x.alias("r").join(starts.alias("s"), on).select("r.*", "s.source_size", "s.slot", "s.target", (F.col("s._start") + F.col("r._in")).alias("_from"))
    middles = [(F.lit(e) * F.col("source_size") + F.col("_from")) + F.col("size") / 2 for e in range(-int(-cap // 1))]
    used = F.filter(F.array(*middles), lambda m: (m <= F.col("target")) & (F.col("size") > 0))
    x = x.withColumn("_used", used)
    positions = F.transform("_used", lambda m: _position(m / F.col("target"), F.col("slot"), schedules))
    copies = F.size("_used").cast("long")
    return x.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), positions.alias("positions"), *names)


def by_position(mixed: DataFrame) -> DataFrame:
    """Rows of mix() range-sorted by their first position; what is not taken comes last, dealt by id."""
    first = F.try_element_at("positions", F.lit(1))
    return mixed.withColumn("first_position", first).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with each document repeated as often as it is taken, range-sorted by training position.

    Rows that share id and text are one document here: each of them is repeated alike.
    """
    key = F.xxhash64("doc_id", "text")
    row, place, all_places = unused(docs, "_row"), unused(docs, "_position"), unused(docs, "_positions")
    plan = mix(docs, keep=[key.alias("_row")], **how).filter("copies > 0")
    plan = plan.groupBy(F.col("_row").alias(row)).agg(F.max("positions").alias(all_places))
    x = docs.withColumn(row, key).join(plan, row).withColumn(place, F.explode(all_places))
    return x.orderBy(place, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])
