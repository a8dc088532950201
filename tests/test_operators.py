import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern import tables
from quern.functions import text as tx
from quern.functions import urls as ux
from quern.operators import corpus, dedup, explain, history, metrics, models, sampling
from quern.sources import mail, sinks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("a", "b", "p"), [(16, 3, 0.004425), (11, 16, 0.442068), (0, 2, 0.5), (11, 19, 0.200488), (0, 0, 1.0)])
def test_mcnemar(spark, a, b, p):
    assert one(spark, metrics.binomial_two_sided(F.lit(a), F.lit(b)).alias("p")).p == pytest.approx(p, abs=1e-6)


def test_source_family(spark):
    names = ["SpamAssassin", "Spam_X", "PhishMMF_a", "Kaggle", "Kaggle_X", "Fedora", None]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(corpus.source_family(F.col("s")).alias("f")).collect()
    assert [r.f for r in got] == ["SpamAssassin", "Spam_Genuine_Mail", "PhishMMF", "Kaggle", "Kaggle_Phishing_Email", "Fedora", "Unknown"]


def test_html_presence(spark):
    cases = {"<kre@munnari.OZ.AU>": 0, "a < b > c": 0, "<br/>": 1, "<P CLASS=x>": 1, "<foo>": 0, None: 0}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", ux.has_html(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == cases


def test_url_functions(spark):
    r = one(spark, ux.trim_url(F.lit('http://bit.ly/x">aqui</a>')).alias("a"), ux.trim_url(F.lit("http://a.b/c).")).alias("b"), ux.host(F.lit("www.bit.ly/abc")).alias("h"), ux.bare_host(ux.host(F.lit("www.bit.ly/abc"))).isin(*ux.SHORTENERS).alias("s"))
    assert (r.a, r.b, r.h, r.s) == ("http://bit.ly/x", "http://a.b/c", "www.bit.ly", True)


def test_entropy_and_legibility(spark):
    assert one(spark, tx.entropy(F.lit("192.0.2.10")).alias("e")).e == pytest.approx(2.2464393446710154)
    got = spark.createDataFrame([(w,) for w in ("account", "x", "bcdfg", "a1b2c3d4", "a" * 21)], "w string").select(tx.legible(F.col("w")).alias("l")).collect()
    assert [r.l for r in got] == [True, False, False, False, False]


def test_set_jaccard(spark):
    e = F.array().cast("array<string>")
    r = one(spark, explain.set_jaccard(e, e).alias("a"), explain.set_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("b"))
    assert r.a == 1.0 and r.b == pytest.approx(1 / 3)


def test_presence(spark):
    got = spark.createDataFrame([(v,) for v in (None, "", " ", "x")], "v string").select(tx.present(F.col("v"), "string").alias("p")).collect()
    assert [r.p for r in got] == [False, False, False, True]


def test_balance_quotas(spark):
    """The published budget and minimum quota, and shares told plainly for sources of unlike sizes."""
    one = spark.createDataFrame([(17729, 10888)], "p long, k long").select(sampling.negative_budget(F.col("p"), F.col("k"), 0.4).alias("b")).first()
    assert one.b == 15705
    even = sampling.source_quotas(spark.createDataFrame([(c, 723, one.b, 9916) for c in "abcd"], "source string, n long, budget long, spent long")).collect()
    assert {r.source: r.take for r in even} == dict.fromkeys("abcd", 723)
    sizes, budget, spent = {"a": 30, "b": 5000, "c": 900, "d": 2, "e": 4000}, 3000, 400
    got = {r.source: r.take for r in sampling.source_quotas(spark.createDataFrame([(c, n, budget, spent) for c, n in sizes.items()], "source string, n long, budget long, spent long")).collect()}
    assert got["a"] == 30 and got["d"] == 2  # 260 each at first; then 1788 are left, and 640, 3740 and 4740 remain
    assert got["b"] == 260 + 1788 * 4740 // 9120 and got["c"] == 260 + (1788 - 929) * 640 // 9120 and got["e"] == 260 + (1788 - 929 - 60) * 3740 // 9120
    assert sampling.source_quotas(spark.createDataFrame([], "source string, n long, budget long, spent long")).collect() == []


def test_balance_takes_left_over_rows_of_all_modalities(spark):
    """Negatives with all modalities beyond the positives' number stay in the pool of their source."""
    rows = [(k, "a", 1, k < 5) for k in range(40)] + [(100 + k, "b", 0, True) for k in range(100)] + [(300, "z", 0, False)]
    got = sampling.balance(spark.createDataFrame(rows, "id long, s string, y int, tri boolean"), "id", "s", "y", "tri", "z", "seed").collect()
    taken = [r for r in got if r.s == "b"]
    # budget 60 - 1; 5 go with the positives, 27 are the source's even share, and 23 its part, at most 40 % of the budget
    assert len(taken) == 5 + 27 + 23 and len({r.id for r in got}) == len(got) == 40 + 1 + len(taken)


def test_places_in_hash_order(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 > 0, "x"))
    got = sampling.ranked(df, ["g"], "id", "s", "place").withColumn("k", sampling.rank_key(F.col("id"), "s")).collect()
    for g in ("x", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and len(own) == (2000 if g else 1000)


def test_token_kinds(spark):
    want = {"--!": "punctuation", "12:30,5/7-8": "figure", "привет": "other alphabet", "smtp": "abbreviation", "ABCDE": "abbreviation", "abcdef": "encoded", "cm9kcml": "encoded", "éa": "encoded", "é1": "other alphabet", "10%": "encoded"}
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", tx.token_kind(F.col("w")).alias("k")).collect()
    assert {r.w: r.k for r in got} == want
    legible = {"über": True, "ñññ": False, "brr": False, "öl": False, "mail-x": True, "a": False}
    got = spark.createDataFrame([(w,) for w in legible], "w string").select("w", tx.legible(F.col("w")).alias("k")).collect()
    assert {r.w: r.k for r in got} == legible


def test_urls_of_either_case(spark):
    got = spark.createDataFrame([("see HTTP://A.example/x and WWW.b.example, or https://c.example",)], "t string").select(ux.extract_urls(F.col("t")).alias("u")).first().u
    assert got == ["HTTP://A.example/x", "WWW.b.example,", "https://c.example"]


def test_campaigns(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "f"), (2, long, "f"), (3, long, "g"), (4, "a b c d", "f"), (5, "a b c d", "f"), (6, None, "f")]
    got = dedup.campaigns(spark.createDataFrame(rows, "id long, t string, fam string"), "t", "id", "fam").collect()
    assert {r.id: r.cluster for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_campaigns_lose_no_link(spark):
    """40 pairs at 45/55 link, 40 at 40/60 don't, and families stay apart; the banded form loses pairs, and says so."""
    rows, want = [], {}
    for p in range(80):
        w = [f"w{p}x{k}" for k in range(54)]
        changed = [f"{x}É" if k == 20 or (p >= 40 and k == 30) else x for k, x in enumerate(w)]
        rows += [(3 * p, " ".join(w).upper(), "f"), (3 * p + 1, "\n".join(changed), "f"), (3 * p + 2, " ".join(w), "g" if p % 2 else None)]
        want |= {3 * p: 3 * p, 3 * p + 1: 3 * p + (p >= 40), 3 * p + 2: 3 * p + 2}
    rows += [(1000, "a b c d", "f"), (1001, "a b c d", "f"), (1002, None, "f")]
    want |= {i: i for i in (1000, 1001, 1002)}
    df = spark.createDataFrame(rows, "id long, t string, fam string")
    true = dedup.verified_campaigns(df, "t", "id", "fam")
    assert {r.id: r.cluster for r in true.collect()} == want and Counter((r.id, r.fam) for r in true.collect()) == Counter((i, f) for i, _, f in rows)
    banded = dedup.campaigns(df, "t", "id", "fam")
    label = {r.id: r.cluster for r in banded.collect()}
    both = sum(label[3 * p] == label[3 * p + 1] for p in range(40))
    got = {r.family: r for r in dedup.agreement(banded, true, "id", "fam").collect()}
    assert (got["f"].true_pairs, got["f"].both_pairs, got["f"].recall) == (40, both, both / 40) and 0 < both < 40
    assert got["g"].true_pairs == got[None].true_pairs == 0 and got["g"].recall is None
    with pytest.raises(RuntimeError):
        dedup.campaigns(df, "t", "id", "fam", rounds=1)


def test_campaigns_write_prefixes_of_sets_alone(spark, tmp_path, monkeypatch):
    """The tables on the way stay, together, below the eight bytes a shingle that one copy of the sets takes."""
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = [(p, " ".join(f"w{p}x{k}" for k in range(2000)), "f") for p in range(100)] + [(100, " ".join(f"w0x{k}" for k in range(1900)), "f")]
    df = spark.createDataFrame(rows, "id long, t string, fam string")
    sizes, write = [], tables.Scratch.written

    def written(self, *of):
        out = write(self, *of)
        sizes.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        return out

    monkeypatch.setattr(tables.Scratch, "written", written)
    assert {r.id: r.cluster for r in dedup.verified_campaigns(df, "t", "id", "fam").collect()} == {p: p % 100 for p in range(101)}
    assert max(sizes) < 8 * 101 * 1996


def test_intermediate_writes_send_small_batches(spark):
    """Whole texts go to Python a thousand rows at most at a time, and the session's setting is as before."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, s = spark.conf.get(name), tables.Scratch(spark)
    got = [r.n for r in s.written(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    s.drop()
    assert sum(got) == 5000 and max(got) <= 1000 and spark.conf.get(name) == before


def test_banded_campaigns_keep_their_result_alone(spark, tmp_path, monkeypatch):
    """Bands are those of minima taken text by text, and the tables on the way are deleted."""
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = [(1, "one two three four five six seven", "f"), (2, "ONE two three four five six seven", "f"), (3, "a b", "f"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, t string, fam string")
    assert {r.id: r.cluster for r in dedup.campaigns(df, "t", "id", "fam").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert len(list(tmp_path.iterdir())) == 1
    hashes = [r.h for r in df.filter("id = 1").select(F.explode(tx.shingles(F.col("t"))).alias("w")).select(F.xxhash64("w").alias("h")).collect()]
    least = [min(one(spark, F.xxhash64(F.lit(h).cast("long"), F.lit(seed)).alias("m")).m for h in hashes) for seed in range(3)]
    want = one(spark, F.xxhash64(F.lit("f"), F.lit(0), F.xxhash64(F.lit(0), *[F.lit(m).cast("long") for m in least])).alias("k")).k
    got = {(r.id, r.key) for r in dedup.band_keys(df, "t", "id", "fam", rows=3, bands=1).collect()}
    assert got == {(1, want), (2, want)}


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "id long, t string")
    once = dedup.keep_first_text(df, "t", "id")
    assert sorted(r.id for r in once.collect()) == [1, 3] == sorted(r.id for r in dedup.keep_first_text(once, "t", "id").collect())


def test_group_split_keeps_clusters_whole(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 37).alias("c"), (F.col("id") % 2).alias("s"))
    x = sampling.group_split(df, "c", "s", "id", "t")
    assert x.count() == 500 and sampling.crossing(x, "c", "split").isEmpty()


def test_overfit(spark):
    df = spark.createDataFrame([(1, 0, 0.6, 0.5), (1, 1, 0.4, 0.4), (1, 2, 0.3, 0.45)], "r int, e int, t double, v double")
    assert history.first_overfit(df, "r", "e", "t", "v").first().after_epoch == 1


def test_wordpieces(spark):
    df = spark.createDataFrame([(1, k, t, w) for k, (t, w) in enumerate([("[CLS]", 0.1), ("ver", 0.2), ("##ify", 0.3), ("now", 0.4), ("[SEP]", 0.5)])], "i int, k int, t string, w double")
    got = explain.merge_wordpieces(df, "i", "k", "t", "w").orderBy("position").collect()
    assert [(r.word, round(r.weight, 6)) for r in got] == [("verify", 0.5), ("now", 0.4)]


def test_mail(spark, tmp_path):
    body = '<p>Su cuenta sera suspendida.</p> <a href="http://192.0.2.10/verificar">Verificar ahora</a><form action="http://192.0.2.10/robar"><input></form>'
    head = "From: a@b.example\nTo: c@d.example\nSubject: Aviso\nAuthentication-Results: mx.example.com; spf=fail; dkim=none; dmarc=fail\nContent-Type: text/html\n\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.eml").write_text(head + body)
    (tmp_path / "in" / "two.mbox").write_text("From x\n" + head + body + "\nFrom y\n" + head + "short")
    (tmp_path / "in" / "empty.mbox").write_text("")
    (tmp_path / "in" / "old.gz").write_text("no")
    got = mail.read_mail(spark, str(tmp_path / "in"))
    assert got.count() == 3
    rows = mail.mail_table(got, "test", 1).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r.spf_result, r.dkim_result, r.dmarc_result, r.sent_date) == ("fail", "none", "fail", None)
    assert (r.has_html, r.num_links, r.has_form, r.has_ip_link, r.word_count) == (1, 1, 1, 1, 6)
    assert r.clean_text == "Su cuenta sera suspendida. Verificar ahora"
    assert r.url_max_length == 27 and r.url_max_digit_ratio == pytest.approx(7 / 23) and r.url_domain_max_entropy == pytest.approx(2.2464393446710154)


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"Body": "hello there", "Metadata": {"From": "a"}}\n\n{"Body": "", "body": "second", "sender": "b"}\n{"content": {"body": "third"}}\n{"broken": \n')
    got = mail.read_json_lines(spark, str(tmp_path / "x.jsonl"))
    assert [r.body for r in got.filter("valid").collect()] == ["hello there", "second", "third"]
    s = mail.line_statistics(got).first()
    assert (s.lines, s.invalid) == (4, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, source string")
    with pytest.raises(sinks.Incomplete):
        sinks.write_corpus(df, str(tmp_path / "c"), "source", {"a", "z"})
    sinks.write_corpus(df, str(tmp_path / "c"), "source", {"a", "b"})
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    assert sinks.content_fingerprint(df, ["id"]) == sinks.content_fingerprint(df.repartition(3).orderBy("source"), ["id"])
    bad = spark.createDataFrame([("m", 1, 1, math.nan)], "model string, id long, y_true int, y_proba double")
    with pytest.raises(Exception, match="invalid prediction"):
        sinks.write_predictions(bad, str(tmp_path / "p"))


def test_models(spark):
    from quern.operators import models

    df = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "free prize click now").otherwise("meeting notes for monday").alias("t"), (F.col("id") % 2 == 0).cast("int").alias("y"), (F.col("id") % 4).cast("double").alias("n"), (F.col("id") % 3).alias("g"))
    m = models.fit(models.variant("text", "t", ["n"], ["n"], "y", 1 << 10), df, "y")
    assert metrics.confusion(models.predict(m, df, "text", "id", "y")).first().f1 == 1.0


def test_too_many_folds_raise(spark):
    df = spark.range(8).select("id", (F.col("id") % 4).alias("source"), F.lit(1).alias("y"))
    with pytest.raises(ValueError, match="more than 3 folds"):
        models.by_fold(None, df, "source", "x", "id", "y", most=3)
    with pytest.raises(ValueError, match="no fold"):  # one class only
        models.by_fold(None, df, "source", "x", "id", "y", most=4)


def test_streams(spark, tmp_path):
    from quern.streaming import monitor

    schema = "run string, k int, v double, t string, ts timestamp"
    rows = spark.sql("SELECT 'r' AS run, cast(id AS int) AS k, double(CASE WHEN id = 0 THEN 9 ELSE 1 END) AS v, IF(id < 3, 'same', 'other') AS t, timestamp_seconds(1000 + id) AS ts FROM range(6)")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    for name, df, mode in (("first", monitor.first_seen(source(), "t", "ts"), "append"), ("best", monitor.best_so_far(source(), "run", "k", "v", 3), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("first").count() == 2
    assert spark.table("best").first().stop is True


def test_log_intervals(spark, tmp_path):
    from quern.sources import logs

    (tmp_path / "q.log").write_text("noise\n[2024-01-01 10:00:00] e0_x\n[2024-01-01 11:05:00] e0_x terminado\n[2024-01-01 12:00:00] e1_y\n[2024-01-01 12:00:30] e1_y FALLÓ (1)\n[2024-01-01 13:00:00] e2_z\n")
    got = {r.name: (r.seconds, r.failed, r.h) for r in logs.intervals(logs.read_log(spark, str(tmp_path / "q.log"))).withColumn("h", logs.human_duration(F.col("seconds"))).collect()}
    assert got == {"e0_x": (3900, False, "1 h 5 min"), "e1_y": (30, True, "30 s"), "e2_z": (None, False, None)}


def test_samples(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1900, "big").otherwise("small").alias("g"))
    got = {r.g: r.n for r in sampling.equal_mass(df, "g", "id", 1000, "s").groupBy("g").agg(F.sum("times").alias("n")).collect()}
    assert 400 < got["big"] < 600 and 400 < got["small"] < 600
    r = one(spark, sampling.shuffled_options(F.array(*[F.lit(c) for c in "abcd"]), F.lit("a"), F.lit("q")).alias("o")).o
    assert sorted(r) == list("abcd") and r[0] != "a"


def test_equal_mass_of_rare_groups(spark):
    """Groups of one row: means of 100 and 2,000 draws are reached, and small means draw as the plain sum does."""

    df = spark.range(200).select("id", F.col("id").cast("string").alias("g"))
    for mean in (100, 2000):
        got = np.array([r.times for r in sampling.equal_mass(df, "g", "id", 200 * mean, "s").collect()])
        assert len(got) == 200 and abs(got.mean() - mean) < 5 * (mean / 200) ** 0.5 and got.std() == pytest.approx(mean**0.5, rel=0.25)
    one = spark.range(1000).select("id", F.lit("g").alias("g"), (F.pmod(F.xxhash64("id", F.lit("s")), F.lit(1 << 40)) + 0.5).alias("u"))
    for r in sampling.equal_mass(one, "g", "id", 2000, "s").collect():
        c, p, n = math.exp(-2), math.exp(-2), 0
        while r.u / (1 << 40) > c:
            n += 1
            p *= 2 / n
            c += p
        assert r.times == n


def test_equivalence(spark):
    df = spark.range(400).select("id", (F.col("id") < 200).cast("int").alias("y"), F.when(F.col("id") < 200, 0.9).otherwise(0.1).alias("a"), F.when(F.col("id").between(100, 199), 0.9).otherwise(0.1).alias("b"))
    same = metrics.within(df, "a", "a", "y").first()
    assert (same.low, same.high, same.equivalent) == (0.0, 0.0, True)
    r = metrics.within(df, "a", "b", "y").first()
    assert 0.2 < r.low < 1 / 3 < r.high < 0.45 and not r.equivalent
    assert tuple(metrics.within(df.filter("y = 1"), "a", "b", "y").first()) == (None, None, None)
    assert metrics.within(df.limit(0), "a", "b", "y").count() == 0


def test_bootstrap_against_resampled_rows(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), rng.random(300)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.9)], "model string, y_true int, y_proba double")
    f1 = lambda y, h: 2 * (y & h).sum() / max(2 * (y & h).sum() + (y ^ h).sum(), 1)
    h = (p >= 0.5).astype(int)
    drawn = []
    for _ in range(4000):
        i = rng.integers(0, 300, 300)
        drawn.append(f1(y[i], h[i]))
    got = {r.model: r for r in metrics.bootstrap_f1(df).collect()}
    assert got["m"].observed == pytest.approx(f1(y, h)) and got["m"].draws == 2000
    assert [got["m"].low, got["m"].high] == pytest.approx(np.percentile(drawn, [2.5, 97.5]), abs=0.012)
    assert got["one"].draws == 0 and got["one"].low is None and got["one"].width is None
