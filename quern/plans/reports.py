"""Registered queries over reports, picks and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import explain, metrics, models, reports
from quern.operators.sampling import rank_key
from quern.plans.queries import P, _r, predictions, query, read

#: Words that a report's reader knows already, and beginnings of words that count as signals: of the test tables' prose.
STOP, SIGNAL = ["the", "and", "that"], "^(th|er|an)"
_STOP = ", ".join(f"'{w}'" for w in STOP)
_BARE = "regexp_replace({w}, '[-'']', '', 'g')"


def _legible(w: str) -> str:
    b = _BARE.format(w=w)
    return f"(length({w}) BETWEEN 2 AND 20 AND length({b}) > 0 AND length(regexp_replace({b}, '[^\\p{{L}}]', '', 'g')) * 10 >= length({b}) * 6 AND regexp_matches(lower({w}), '[aeiouáéíóú]'))"


def _content(w: str) -> str:
    return f"({_legible(w)} AND regexp_matches({w}, '^\\p{{L}}{{3,}}$') AND {w} NOT IN ({_STOP}))"


_TOKENS = r"list_filter(regexp_split_to_array({t}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_WIDE = f"{P}, wide AS (SELECT id, max(y_proba) FILTER (model = 'alpha') AS a, max(y_proba) FILTER (model = 'beta') AS b, max(y_proba) FILTER (model = 'gamma') AS c FROM predictions GROUP BY id)"


def _wide(spark, sf_dir):
    """Scores of the three models by id: stand-ins for the weights of three modalities."""
    return predictions(spark, sf_dir).groupBy("id").agg(*[F.max(F.when(F.col("model") == m, F.col("y_proba"))).alias(c) for m, c in (("alpha", "a"), ("beta", "b"), ("gamma", "c"))])


@query(f"WITH {_WIDE}, x AS (SELECT (a >= 0.5)::INT AS predicted, a * 100 AS t, b * 20 AS s, c * 20 AS n, a - b AS fs, a - c AS fn FROM wide) SELECT predicted, count(*) AS n, count_if(s > 0)::BIGINT AS structure, count_if(x.n > 0)::BIGINT AS network, count_if(s + x.n >= 5)::BIGINT AS at_least_5, count_if(s + x.n >= 20)::BIGINT AS at_least_20, count_if(greatest(s, x.n) > t)::BIGINT AS dominant, count_if(fs > 0.01::DOUBLE)::BIGINT AS falls_structure, count_if(fn > 0.01::DOUBLE)::BIGINT AS falls_network FROM x GROUP BY GROUPING SETS ((), (predicted))")
def report_counts(spark, sf_dir):
    x = _wide(spark, sf_dir).select((F.col("a") >= 0.5).cast("int").alias("predicted"), (F.col("a") * 100).alias("t"), (F.col("b") * 20).alias("s"), (F.col("c") * 20).alias("w"), (F.col("a") - F.col("b")).alias("fs"), (F.col("a") - F.col("c")).alias("fn"))
    return reports.report_counts(x, "predicted", "t", "s", "w", "fs", "fn")


@query("SELECT event_type, round(avg(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k, round(avg(try_cast(json_extract_string(props, '$.missing.path') AS DOUBLE)), 6) AS none FROM events GROUP BY event_type")
def path_means(spark, sf_dir):
    return reports.path_means(read(spark, sf_dir, "events"), "event_type", "props", {"k": "$.k", "none": "$.missing.path"})


@query(f"WITH f AS (SELECT len(text) % 7 AS kind, {_TOKENS.format(t='lower(text)')} AS f FROM benchmark) SELECT kind, count(*) AS reports, sum(len(f))::BIGINT AS cited, sum(len(list_filter(f, lambda w: {_legible('w')})))::BIGINT AS legible, count_if(len(f) = len(list_filter(f, lambda w: {_legible('w')})))::BIGINT AS all_legible FROM f GROUP BY kind")
def legibility(spark, sf_dir):
    x = read(spark, sf_dir, "benchmark").select((F.length("text") % 7).cast("long").alias("kind"), tx.tokens(F.lower("text")).alias("f"))
    return reports.legibility(x, "f", "kind")


@query("SELECT user_id, count_if(event_type NOT IN ('error', 'view'))::BIGINT AS processed, count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'view')::BIGINT AS skipped, count(event_type) AS total, round(coalesce(count_if(event_type NOT IN ('error', 'view')) / nullif(count(event_type), 0)::DOUBLE, 0), 4) AS success_rate FROM events GROUP BY user_id")
def outcomes(spark, sf_dir):
    t = F.col("event_type")
    return reports.outcomes(read(spark, sf_dir, "events"), "user_id", F.when(t == "error", "errors").when(t == "view", "skipped").when(t.isNotNull(), "processed"))


@query(f"WITH {P} SELECT model, first(id ORDER BY y_proba DESC, id) AS surest, first(id ORDER BY abs(y_proba - 0.6::DOUBLE), id) AS middle, count(*) AS candidates FROM predictions WHERE y_proba >= 0.5 GROUP BY model")
def extreme_picks(spark, sf_dir):
    return reports.extremes(predictions(spark, sf_dir), "model", "id", "y_proba")


@query(f"WITH {P}, c AS (SELECT model, y_true AS actual, (y_proba >= 0.5)::INT AS predicted, count(*) AS n FROM predictions GROUP BY ALL) SELECT *, n / (sum(n) OVER (PARTITION BY model))::DOUBLE AS share FROM c")
def cell_shares(spark, sf_dir):
    return reports.cell_shares(predictions(spark, sf_dir), "model", "y_proba", "y_true")


@query(f"WITH {P} SELECT model, round(avg(pow(y_proba - y_true, 2)), 9) AS loss, avg(((y_proba >= 0.5)::INT = y_true)::INT) AS accuracy FROM predictions GROUP BY model")
def weighted_loss(spark, sf_dir):
    p, y = F.col("y_proba"), F.col("y_true")
    right = ((p >= 0.5).cast("int") == y).cast("int")
    batches = predictions(spark, sf_dir).groupBy("model", (F.col("id") % 32).alias("batch")).agg(F.avg(F.pow(p - y, F.lit(2))).alias("loss"), F.sum(right).alias("right"), F.count("*").alias("size"))
    return _r(reports.weighted_loss(batches, "model", "loss", "right", "size"), loss=9)


@query(f"WITH {P}, m AS (SELECT lang, avg(pow(y_proba - y_true, 2)) AS m FROM predictions JOIN documents ON id = doc_id WHERE model = 'alpha' AND lang IS NOT NULL GROUP BY lang), g AS (SELECT lang, exp(0.5::DOUBLE * coalesce(m, 0)) AS w FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) LEFT JOIN m USING (lang)) SELECT lang, round(w / sum(w) OVER (), 9) AS weight FROM g")
def group_weights(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang").filter("lang IS NOT NULL")
    x = predictions(spark, sf_dir).filter("model = 'alpha'").join(d, "id").withColumn("loss", F.pow(F.col("y_proba") - F.col("y_true"), F.lit(2)))
    return _r(reports.group_weights(x, "lang", "loss", d.select("lang").distinct().withColumn("weight", F.lit(1.0)), 0.5), weight=9)


_FACTORS = f"""c AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({_TOKENS.format(t='lower(text)')}) AS w FROM benchmark) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, w) AS rank FROM c),
f AS (SELECT item_id, sum(n)::BIGINT AS confidence, list(w ORDER BY rank) AS f FROM r WHERE rank <= 6 GROUP BY item_id)"""


def _factors(spark, sf_dir):
    """A report of each text: its six most frequent words, and how often these stand in it."""
    w = read(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.tokens(F.lower("text"))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    x = explain.top_factors(w, "item_id", "w", "n", 6).groupBy("item_id").agg(F.sum("n").alias("confidence"), F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("f"))
    return x.withColumn("f", F.transform("f", lambda z: z["w"]))


@query(f"WITH {_FACTORS}, g AS (SELECT item_id, confidence, len(list_filter(f[1:3], lambda w: regexp_matches(w, '{SIGNAL}')))::INT AS signals, (3 * len(list_filter(f[1:3], lambda w: regexp_matches(w, '{SIGNAL}'))) + len(list_filter(f[1:5], lambda w: regexp_matches(w, '{SIGNAL}'))) + len(list_filter(f[1:5], lambda w: {_content('w')})) + len(list_filter(f[1:5], lambda w: {_legible('w')})) + 8)::INT AS points FROM f WHERE len(f) >= 3 AND len(list_distinct(f)) = len(f) AND len(list_filter(f[1:3], lambda w: {_content('w')})) = 3) SELECT *, row_number() OVER (ORDER BY points DESC, signals DESC, confidence DESC, item_id)::INT AS place FROM g")
def clarity_ranking(spark, sf_dir):
    return reports.clarity(_factors(spark, sf_dir), "item_id", "f", "confidence", SIGNAL, STOP)


@query(f"WITH {_FACTORS} SELECT item_id, len(f) >= 3 AND len(list_distinct(f)) = len(f) AND len(list_filter(f[1:3], lambda w: {_legible('w')})) = 3 AND regexp_matches(f[1], '^\\p{{L}}{{3,}}$') AND f[1] NOT IN ({_STOP}) AS readable FROM f")
def readable_reports(spark, sf_dir):
    return _factors(spark, sf_dir).select("item_id", reports.readable(F.col("f"), STOP).alias("readable"))


@query("WITH x AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('panel|' || doc_id::VARCHAR), doc_id) AS n FROM documents), f AS (SELECT * FROM x WHERE n < 4), l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY EXISTS (SELECT 1 FROM f WHERE f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source), n) AS k FROM x r WHERE n >= 4) SELECT doc_id, lang, source, n::INT AS turn FROM f UNION ALL SELECT doc_id, lang, source, 4 FROM l WHERE k = 1")
def panel_picks(spark, sf_dir):
    return reports.picks(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", [rank_key(F.col("doc_id"), "panel"), F.col("doc_id")], 4)


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'cold|hot') THEN 1 WHEN regexp_matches(lower(p_name), 'small|large') THEN 0 END AS label FROM part")
def labels_of_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", reports.label_of_name(F.upper("p_name"), ["cold", "hot"], ["small", "large"]).alias("label"))


@query("WITH a AS (SELECT c_custkey, c_mktsegment AS c1, (c_nationkey % 5 + 1)::VARCHAR AS c2 FROM customer) SELECT c_custkey, 'c1' AS question, c1 AS answer, (coalesce(c1, '') = 'BUILDING')::INT AS right FROM a UNION ALL SELECT c_custkey, 'c2', c2, (coalesce(c2, '') = '3')::INT FROM a")
def marked_answers(spark, sf_dir):
    x = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_mktsegment")).alias("c1"), (F.col("c_nationkey") % 5 + 1).cast("string").alias("c2"))
    return reports.marked(x, "c_custkey", {"c1": "BUILDING", "c2": "3"})


@query("WITH x AS (SELECT doc_id, length(text) AS n, strpos(substr(text, 21), substr(text, 1, 20)) + 19 AS j, strpos(reverse(text), 'ptth') AS b FROM documents WHERE length(text) > 20) SELECT doc_id, j::INT AS start, (CASE WHEN b > 0 AND n - b - 3 > j THEN n - b - 3 ELSE n END)::INT AS stop FROM x WHERE j >= 20")
def repeated_spans(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", reports.repeated_span(F.col("text")).alias("s")).filter("s IS NOT NULL").select("doc_id", "s.start", "s.stop")


_T = _TOKENS.format(t="text")
_SCORE = "1 / (1 + exp(-(length({t}) / 100.0::DOUBLE - 1)))"


@query(f"WITH w AS (SELECT item_id, text, {_T} AS w FROM benchmark), r AS (SELECT *, list_transform(list_sort(list_transform(w, lambda v, i: {{'n': -length(v), 'i': i, 'v': lower(v)}}))[1:greatest(1, floor(len(w) * 0.2::DOUBLE)::INT)], lambda z: z.v) AS top FROM w), k AS (SELECT *, coalesce(nullif(array_to_string(list_filter(w, lambda v: NOT list_contains(top, lower(v))), ' '), ''), '[UNK]') AS without, coalesce(nullif(array_to_string(list_filter(w, lambda v: list_contains(top, lower(v))), ' '), ''), '[UNK]') AS alone FROM r) SELECT item_id, CASE WHEN len(w) > 0 THEN round({_SCORE.format(t='text')} - {_SCORE.format(t='without')}, 6) END AS comprehensiveness, CASE WHEN len(w) > 0 THEN round({_SCORE.format(t='text')} - {_SCORE.format(t='alone')}, 6) END AS sufficiency FROM k")
def faithfulness(spark, sf_dir):
    longest = F.array_sort(F.transform(tx.tokens(F.col("text")), lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v"))))
    x = read(spark, sf_dir, "benchmark").select("item_id", "text", F.transform(longest, lambda z: z["v"]).alias("ranked"))
    score = lambda t: 1 / (1 + F.exp(-(F.length(t) / 100.0 - 1)))
    return reports.faithfulness(x, "text", "ranked", score).select("item_id", "comprehensiveness", "sufficiency")


@query("SELECT vec_id, round(coalesce(list_sum(list_filter(embedding, lambda v: v > 0)::DOUBLE[]), 0) / greatest(len(list_filter(embedding, lambda v: v > 0)), 1), 6) AS pooled FROM embeddings")
def masked_means(spark, sf_dir):
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(reports.masked_mean(F.transform(e, lambda v: v.cast("double")), F.transform(e, lambda v: v > 0)), 6).alias("pooled"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'run') AS name FROM pages")
def run_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", reports.run_name(F.col("url")).alias("name"))


@query("SELECT p_brand, min(p_name) AS p_name FROM part WHERE NOT regexp_matches(p_name, 'cold|small') GROUP BY p_brand")
def plain_runs(spark, sf_dir):
    return reports.plain_run(read(spark, sf_dir, "part"), "p_brand", "p_name", ["cold", "small"])


#: Display names, all that there are.
NAMES = {"error": "Error", "signup": "Sign-up"}


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('error', 'signup')")
def unnamed_features(spark, sf_dir):
    names = spark.createDataFrame(list(NAMES.items()), "event_type string, name string")
    return reports.unnamed(read(spark, sf_dir, "events").filter("event_type IS NOT NULL"), names, "event_type")


@query("WITH f AS (SELECT source, count(*) AS n, count_if(toxic = 1)::BIGINT AS p, count_if(toxic = 0)::BIGINT AS q FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, n, (p > 0)::INT + (q > 0)::INT AS classes, round(p / nullif(p + q, 0)::DOUBLE, 4) AS prevalence, p > 0 AND q > 0 AND (SELECT sum(p) FROM f) > p AND (SELECT sum(q) FROM f) > q AS evaluable FROM f")
def fold_report(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return models.fold_report(x, "source", "toxic")


@query()
def equivalence_interval(spark, sf_dir):
    return metrics.within(_wide(spark, sf_dir).join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")), "id"), "a", "b", "y")


@query(f"WITH {P}, c AS (SELECT model, 2 * count_if(y_true = 1 AND y_proba >= 0.5) / (2 * count_if(y_true = 1 AND y_proba >= 0.5) + count_if((y_true = 1) <> (y_proba >= 0.5)))::DOUBLE AS f1 FROM predictions GROUP BY model) SELECT model, round(f1, 9) AS f1, published, abs(f1 - published) <= 0.1::DOUBLE AS agrees FROM c LEFT JOIN (VALUES ('alpha', 0.65::DOUBLE), ('beta', 0.99::DOUBLE)) p(model, published) USING (model)")
def reproduced(spark, sf_dir):
    f1 = metrics.confusion(predictions(spark, sf_dir)).select("model", "f1")
    return _r(reports.reproduced(f1, spark.createDataFrame([("alpha", 0.65), ("beta", 0.99)], "model string, f1 double"), "model", "f1", 0.1), f1=9)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.unit'), 'ms') AS unit FROM events")
def with_defaults(spark, sf_dir):
    m = reports.with_defaults(F.from_json("props", "map<string,string>"), {"k": "0", "unit": "ms"})
    return read(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["unit"].alias("unit"))


@query("SELECT c_custkey, 'balance' AS name, c_acctbal AS weight FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer")
def factor_lists(spark, sf_dir):
    x = read(spark, sf_dir, "customer")
    f = reports.factors_of_arrays(F.array(F.lit("nation"), F.lit("balance")), F.array(F.col("c_nationkey").cast("double"), "c_acctbal"))
    return x.select("c_custkey", F.inline(f))
