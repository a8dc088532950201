"""Operators of quern.operators.reports on awkward rows, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quern.operators import reports


def values(df):
    return [tuple(r) for r in df.collect()]


def test_repeated_span(spark):
    start = "Dear customer, please "
    rows = [(1, start + "x. " + start + "see http://a.b"), (2, start + "x. " + start + "y"), (3, "short"), (4, ""), (5, None), (6, "http " + start + "x. " + start)]
    x = spark.createDataFrame(rows, "i int, t string").select("i", reports.repeated_span(F.col("t")).alias("s")).orderBy("i")
    got = {r.i: r.s and tuple(r.s) for r in x.collect()}
    for i, t in rows:
        j = t.find(t[:20], 20) if t else -1
        k = t.rfind("http") if t else -1
        assert got[i] == (None if j < 0 else (j, k if k > j else len(t)))


def test_proper_noun(spark):
    rows = [("Anna", "Anna wrote. anna"), ("anna", "Anna wrote to Anna"), ("Anna", "ANNA"), ("Anna", "Hannah"), ("ñu", "Ñu y Ñu"), ("a.b", "axb A.b"), ("x", None)]
    got = values(spark.createDataFrame(rows, "w string, t string").select(reports.proper_noun(F.col("w"), F.col("t"))))
    assert [g[0] for g in got][:6] == [False, True, False, False, True, True]
    assert not got[6][0]


def test_picks(spark):
    rows = [(1, "g", "a"), (2, "g", "a"), (3, "g", None), (4, "g", None), (5, "g", "b"), (6, "g", "b"), (7, "h", "a"), (8, "h", "a"), (9, "h", "a"), (10, "h", "a"), (11, "i", "a"), (12, None, "a")]
    x = spark.createDataFrame(rows, "i int, g string, s string")
    got = {(r.g, r.i) for r in reports.picks(x, "g", "s", [F.col("i")], 3).collect()}
    assert got == {("g", 1), ("g", 2), ("g", 3), ("h", 7), ("h", 8), ("h", 9), ("i", 11), (None, 12)}
    got = {r.i: r.turn for r in reports.picks(x.filter("g = 'g'"), "g", "s", [F.col("i")], 4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 5: 4}
    assert reports.picks(x.limit(0), "g", "s", [F.col("i")], 3).count() == 0


def test_answers(spark):
    x = spark.createDataFrame([(1, " A ", "2 - no"), (2, None, "5")], "id int, `C1. one` string, `[E1. two]` string")
    assert reports.only_column(x, r"^C1\. ") == "C1. one"
    with pytest.raises(ValueError):
        reports.only_column(x, "o")
    assert values(x.select(reports.scale_point(F.col("`[E1. two]`")))) == [(2,), (5,)]
    with pytest.raises(Exception, match="not on the scale"):
        x.select(reports.scale_point(F.col("`C1. one`"))).collect()
    y = x.withColumnRenamed("C1. one", "q1").select("id", "q1")
    assert sorted(values(reports.marked(y, "id", {"q1": "A"})), key=str) == [(1, "q1", "A", 1), (2, "q1", None, 0)]


def test_faithfulness(spark):
    rows = [(1, "aa b c d e", ["aa"]), (2, "", ["aa"]), (3, None, ["aa"]), (4, "aa b", []), (5, "Aa aa", ["aa"]), (6, "b c", ["zz"])]
    x = spark.createDataFrame(rows, "i int, t string, r array<string>")
    got = {r.i: (r.comprehensiveness, r.sufficiency) for r in reports.faithfulness(x, "t", "r", lambda t: F.length(t).cast("double")).collect()}
    assert got == {1: (3.0, 8.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (0.0, 0.0), 6: (0.0, -2.0)}


def test_names_means_and_counts(spark):
    one = spark.range(1)
    assert values(one.select(reports.run_name(F.lit("__a b/c!")), reports.run_name(F.lit("///")))) == [("a_b_c", "run")]
    m = lambda v, k: reports.masked_mean(F.lit(v).cast("array<double>"), F.lit(k).cast("array<boolean>"))
    assert values(one.select(m([1.0, 3.0], [True, True]), m([1.0, 3.0], [False, False]), m([1.0, 3.0], [False, True]))) == [(2.0, 0.0, 3.0)]
    x = spark.createDataFrame([(1, 60.0, 40.0, 0.0, 0.5, 0.0), (0, 50.0, 0.0, 50.0, 0.0, 0.01), (None, 90.0, 5.0, 5.0, None, None)], "p int, t double, s double, n double, fs double, fn double")
    got = {r.predicted if "predicted" in r else r.p: tuple(r)[1:] for r in reports.report_counts(x.filter("p IS NOT NULL"), "p", "t", "s", "n", "fs", "fn").collect()}
    assert got == {None: (2, 1, 1, 2, 2, 0, 1, 0), 1: (1, 1, 0, 1, 1, 0, 1, 0), 0: (1, 0, 1, 1, 1, 0, 0, 0)}


def test_maps_and_lists(spark):
    x = spark.createDataFrame([(1, {"a": "9", "z": "1"}), (2, {}), (3, None)], "i int, m map<string,string>")
    got = {r.i: r.m for r in x.select("i", reports.with_defaults(F.col("m"), {"a": "0", "b": "2"}).alias("m")).collect()}
    assert got == {1: {"a": "9", "b": "2", "z": "1"}, 2: {"a": "0", "b": "2"}, 3: {"a": "0", "b": "2"}}
    one = spark.range(1)
    assert [tuple(e) for e in one.select(reports.factors_of_map(F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(2.0)))).first()[0]] == [("a", 2.0), ("b", 1.0)]
    with pytest.raises(Exception, match="differ in number"):
        one.select(reports.factors_of_arrays(F.array(F.lit("a")), F.array(F.lit(1.0), F.lit(2.0)))).collect()
