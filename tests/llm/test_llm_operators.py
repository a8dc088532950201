"""The operators of quern.llm on awkward tables and against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import jaccard, language, licenses, media, mixing, pieces, prints, queries, suffixes, urlrules, warc
from quern.llm.common import fresh_path, released

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner string, key int, size double, _part string, _row int, _gone int, component_id string, ids string, h int, score string"
WORDS = [f"w{k}" for k in range(300)]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "o", 1, 2.0, "p", 3, 4, "c", "i", 5, "s")


@pytest.fixture(scope="module")
def texts():
    base = prose(1)
    near = base.split()
    near[30] = "changed"
    return {
        1: None, 2: "", 3: " \t\n ", 4: base, 5: " ".join(near), 6: base, 7: prose(2) + " " + base, 8: "one two", 9: "ONE  two", 10: "é" * 120 + "日本語テキスト" * 30, 11: prose(3, 20_000), 12: "The " * 500, 13: prose(4) + "\n" + "Licensed under CC BY-NC 4.0.",
        14: "a\x00b " * 40, 15: "x" * 60_000, 16: "123 456", 17: "😀 " * 80, 18: base[:200],
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [row(i, t, None if i == 7 else "en", None if i % 5 == 0 else "ab"[i % 2]) for i, t in texts.items()]
    return spark.createDataFrame(rows + [rows[3], row(None, "no id here at all, really none"), row(20, prose(9), "fr")], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 -------------------------------------------------------------------------------------------------------------------
def test_language(spark, docs, empty):
    m = language.fit(docs)
    assert m.langs == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, m).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 16, 17))
    assert got[4][0] == got[11][0] == "en" and 0 <= got[11][1] <= 1
    assert language.predict(empty, m).count() == 0
    none = language.fit(empty)
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    kept = language.recognised(docs, m)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 16, 17})


def test_language_backoff():
    rows = np.log(np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]]))
    m = language.Model(["aa", "bb"], {"known": 0}, [{}, {"q": 2}, {"xy": 1}], rows)
    p = language.Predictor(m)
    assert [x[0] for x in p(["known", "zxyz", "q", "KNOWN", "12"])] == ["aa", "bb", "aa", "aa", "und"]
    for w in ("xyq", "q", "nothing"):
        p([w])
        assert np.allclose(p.table[p.rows[w]], language.backoff(m, w))


def test_language_of_few_words(spark):
    """A language with few rows keeps its words beside one with very many, and ties go to the first."""
    r = random.Random(4)
    many = [f"{a}{b}" for a in "bcdfgklm" for b in ("ab", "ed", "if", "og", "um")]
    few = ["qirx", "xuzq", "zyqx", "qyzz"]
    rows = [(k, " ".join(r.choice(many) + r.choice(many) for _ in range(300)), "big") for k in range(60)] + [(100 + k, " ".join(r.choice(few) for _ in range(5)), "rare") for k in range(3)]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=400)
    assert sum(1 for w in few if w in m.words) == len(few) and len(m.words) <= 400 + len(few)
    p = language.Predictor(m)
    assert p(["qirx zyqx xuzq"])[0][0] == "rare" and p(["bab ded kif"])[0][0] == "big"
    tied = language.Model(["aa", "bb"], {"x": 0}, [{}], np.zeros((1, 2)))
    assert language.Predictor(tied)(["x x"]) == [("aa", 0.5)]


def test_language_held_out(spark):
    """Accuracy on documents that the fit does not see, and scores told plainly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    m = language.fit(docs.filter(language.training_rows()))
    held = docs.filter(~language.training_rows())
    got = language.predict(held, m).join(held, "doc_id").filter("lang is not null and lang_pred <> 'und'")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n > 200 and right / n >= 0.98
    for r in got.orderBy("doc_id").limit(20).collect():
        words = [w for w in re.findall(r"[^\W\d_]+", r.text.lower())]
        total = sum(m.table[m.words[w]] if w in m.words else language.backoff(m, w) for w in words)
        e = np.exp((total - total.max()) / max(1.0, len(words) ** 0.5))
        assert r.lang_pred == m.langs[int(np.argmax(total))] and r.score == pytest.approx(e.max() / e.sum())
    kept = language.recognised(docs.filter("lang is not null"), m)
    assert kept.count() / docs.filter("lang is not null").count() > 0.97
    assert language.recognised(docs, m, accepted=["xx"]).count() == 0


# -- 2 -------------------------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    cases = {
        "http://a.COM/en/1": ("a.com", "/en/1", "com/en/", "block"), "http://x.example.com/en/70?q#f": ("x.example.com", "/en/70", "example.com/en/7", "allow"), "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"), "http://y.net/de/9": ("y.net", "/de/9", "net/de/", "allow"), "http://b.org?x=/es/": ("b.org", "", None, "allow"), "b.org/es/": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "http://b.org/EN/": ("b.org", "/EN/", None, "allow"), "http://u/es/": ("u", "/es/", None, "allow"), "x://casino.example/ads/1": ("casino.example", "/ads/1", None, "block"), "http://org/es/": ("org", "/es/", "org/es/", "block"),
    }
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(cases)], "page_id int, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df).collect()}
    assert got == cases
    assert urlrules.judge(df.limit(0)).count() == 0


def test_url_rules_keep_columns(spark):
    """The caller's columns stay, whatever their names, and a long URL is read to its end."""
    names = ["url", "host", "Path", "rule", "verdict", "pattern", "n_candidates", "_whole", "_tokens", "_found", "_best"]
    long_ = "http://x.net/" + "a" * 100_000 + "/ads/1"
    got = urlrules.judge(spark.createDataFrame([(long_, *map(str, range(10)))], ", ".join(f"`{c}` string" for c in names))).first().asDict()
    assert (got["host"], got["verdict"], got["pattern"], got["url"]) == ("x.net", "block", "/ads/", long_)
    assert [got[c] for c in ("host_", "Path_", "rule_", "verdict_", "pattern_", "n_candidates_", "_whole", "_tokens", "_found", "_best")] == [str(k) for k in range(10)]
    own = urlrules.judge(spark.createDataFrame([("http://org/es/", 1)], "host string, k int"), url="host").first()
    assert (own.host, own.host_, own.verdict) == ("org", "http://org/es/", "block")


# -- 3 -------------------------------------------------------------------------------------------------------------------
def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(sets):
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard(docs, empty, texts):
    texts = texts | {20: prose(9)}
    sets = brute_sets(texts)
    want = brute_components(sets)
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()} | {None: (3, None)}
    assert want[5] == want[6] == 4 and want[9] == 8
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i in texts if want[i] == i] + [None])


def test_jaccard_chains(spark):
    """Families of edits in which neighbours link and ends don't, with many copies."""
    r, texts, i = random.Random(5), {}, 0
    for f in range(12):
        w = prose(100 + f, r.choice([6, 9, 14, 30, 80, 200])).split()
        for _ in range(r.choice([2, 6, 15])):
            texts[i], i = " ".join(w), i + 1
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(WORDS)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = brute_components(brute_sets(texts))
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(df).collect()} == want


def test_jaccard_long_family(spark):
    """Edits of a text of 20,000 words, whose sketches have thousands of words, and a family just below the threshold."""
    r, base = random.Random(8), prose(77, 20_000).split()
    texts = {k: prose(k, 300) for k in range(5)}
    for k in range(10, 16):
        w = list(base)
        for _ in range(200 * (k - 10)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts[k] = " ".join(w)
    own = prose(78, 120).split()
    for k in range(20, 80):
        w = list(own)
        for at in r.sample(range(0, 120, 5), 3):
            w[at] = f"edit{k}-{at}"
        texts[k] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = brute_components(brute_sets(texts))
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(df).collect()} == want
    assert len({want[k] for k in range(10, 16)}) < 6 and len({want[k] for k in range(20, 80)}) > 1


def test_jaccard_clashing_ids(spark):
    """Rows with one id and different texts: a copy goes, a clean text stays, and neither has the other's links."""
    near = prose(31).split()
    near[30] = "changed"
    rows = [(1, prose(31)), (2, prose(32)), (7, prose(31)), (7, prose(33)), (7, prose(33)), (8, " ".join(near)), (8, prose(34)), (9, prose(34)), (9, None), (9, ""), (6, prose(35)), (6, prose(35) + " end"), (None, prose(31))]
    df = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)
    kept = [sorted(((r.doc_id, r.text) for r in jaccard.first_of_each(df.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 7
    six = [t for i, t in kept[0] if i == 6]
    assert six in ([prose(35)], [prose(35) + " end"])
    assert {(i, t or "") for i, t in kept[0] if i != 6} == {(1, prose(31)), (2, prose(32)), (7, prose(33)), (8, prose(34)), (9, ""), (None, prose(31))}
    of = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert of == Counter({(None, 1): 1, (1, 1): 1, (2, 2): 1, (7, 1): 1, (7, 7): 2, (8, 1): 1, (8, 8): 1, (9, 8): 1, (9, 9): 2, (6, 6): 2})


# -- 4 -------------------------------------------------------------------------------------------------------------------
def test_pieces(docs, empty, texts):
    e = pieces.encode(docs, k=3)
    back = pieces.decode(e).collect()
    assert {r.doc_id for r in back} == set(texts) | {None, 20}
    for r in back:
        assert r.text == (texts | {20: prose(9), None: "no id here at all, really none"})[r.doc_id] or not r.text and not texts[r.doc_id]
    seen = Counter((r.doc_id, tuple(r.ids)) for r in back if r.doc_id != 4)
    assert max(seen.values()) == 1
    assert {(r.doc_id, r.sample): tuple(r.ids) for r in back} == {(r.doc_id, r.sample): tuple(r.ids) for r in pieces.encode(docs.repartition(7), k=3).collect()}
    assert pieces.encode(empty).count() == pieces.round_trip(empty).count() == 0
    one, two = (sorted(map(tuple, x.collect()), key=str) for x in (pieces.round_trip(docs, k=3), pieces.decode(e, texts=False)))
    assert one == two


def all_segmentations(text, vocab):
    """Every way to write the text in pieces, told plainly: tuple of ids -> probability."""
    surface, raw, zero, use = vocab
    ids = [i for i, u in enumerate(use) if u]
    weight = {surface[i]: (i, 1.0 / (rank + pieces.FLAT)) for rank, i in enumerate(ids)}
    out = {}

    def walk(rest, done, w):
        if not rest:
            out[done] = w
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                i, x = weight[rest[:n]]
                walk(rest[n:], (*done, i), w * x)

    walk(" " + text, (), 1.0)
    total = sum(out.values())
    return {k: w / total for k, w in out.items()}


@pytest.mark.parametrize("text", ["ver the", "in  to", "aaab"])
def test_pieces_against_all_segmentations(text):
    """Probabilities, first samples, pairs without replacement, and inclusion scores, which must weigh to 1."""
    import math

    vocab = pieces.vocabulary(pieces.model_path())
    want, lat = all_segmentations(text, vocab), pieces.Lattices(vocab)
    n, k, first, pair, weighed = 4000, 3, Counter(), Counter(), Counter()
    for own in pieces.encode_texts(lat, list(range(n)), [text] * n, k, 0):
        got = [tuple(ids.tolist()) for ids, _, _ in own]
        assert len(set(got)) == k and all(math.exp(p) == pytest.approx(want[g]) for g, (_, p, _) in zip(got, own, strict=True))
        first[got[0]] += 1
        pair[got[0], got[1]] += 1
        for g, (_, _, score) in zip(got, own, strict=True):
            weighed[g] += math.exp(-score) / n
    assert math.fsum(want.values()) == pytest.approx(1)
    for g, p in sorted(want.items(), key=lambda x: -x[1])[:3]:
        assert first[g] / n == pytest.approx(p, abs=0.035)
        assert weighed[g] == pytest.approx(1, abs=0.12)
    for (a, b), c in pair.most_common(2):
        assert c / n == pytest.approx(want[a] * want[b] / (1 - want[a]), abs=0.035)
    assert sum(want[g] * w for g, w in weighed.items()) == pytest.approx(1, abs=0.06)


def test_pieces_of_few_segmentations():
    """A text with fewer than k gives them all, and their scores are certain."""
    vocab = pieces.vocabulary(pieces.model_path())
    lat = pieces.Lattices(vocab)
    want = all_segmentations("a", vocab)
    own = next(pieces.encode_texts(lat, [5], ["a"], 9, 0))
    assert {tuple(x.tolist()) for x, _, _ in own} == set(want) and all(s == 0.0 for _, _, s in own)


def test_pieces_long_run():
    """No cut within a run without spaces: pieces cross every place, and the masses of a long run stay in range."""
    vocab = pieces.vocabulary(pieces.model_path())
    lat, voc = pieces.Lattices(vocab), pieces.Vocabulary(vocab)
    text = "international" * 3000
    own = next(pieces.encode_texts(lat, [1], [text], 2, 0))
    assert [voc.decode(x) for x, _, _ in own] == [text.encode()] * 2
    piece = next(i for i, s in enumerate(vocab[0]) if s == "international") if "international" in vocab[0] else None
    sizes = np.array([len(s) for s in vocab[0]])
    ends = np.cumsum(sizes[own[0][0]])
    assert (ends % 48 == 0).mean() < 0.1 and np.isfinite([p for _, p, _ in own]).all()
    assert piece is None or piece in own[0][0] or (sizes[own[0][0]] > 6).any()
    # a single chunk's lattice gives the probabilities of all segmentations, whatever its length
    short = all_segmentations("internat", vocab)
    x, p, _ = next(pieces.encode_texts(lat, [3], ["internat"], 1, 0))[0]
    assert np.exp(p) == pytest.approx(short[tuple(x.tolist())])


# -- 5 -------------------------------------------------------------------------------------------------------------------
def test_media(docs, empty, texts):
    got = {r.doc_id: r for r in media.read(media.store(docs)).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.WRITERS[r.media_type](payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and payload in stored
        assert len(payload) % 576 == 0 and r.payload_bytes > 0 and r.media_type in media.WRITERS
    assert media.read(media.store(empty)).count() == 0


def test_steps_give_memory_back(spark, monkeypatch):
    """What a step has freed is the system's again when it ends, and the pipeline's steps over whole texts are such."""
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024

    after = []

    def step(batches):
        many = [bytes(3000) for _ in range(60_000)]
        after.append(bytes(3000))  # stays, above all that
        many.clear()
        yield from batches

    before = held()
    assert list(released(step)(iter([1, 2]))) == [1, 2] and held() < before + 60
    steps, send = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a: (steps.append(f), send(self, f, *a))[1])
    docs = spark.createDataFrame([(1, prose(1), "en", "a"), (2, prose(2), "en", "a")], "doc_id long, text string, lang string, source string")
    suffixes.without_repeats(docs), jaccard.buckets(docs), pieces.round_trip(docs, by_document=True), language.recognised(docs, language.fit(docs))
    assert len(steps) == 5 and {f.__qualname__.split(".")[0] for f in steps} == {"released"}


def test_lattices_at_hand_are_bounded(monkeypatch):
    """A task keeps a million edges at most from one batch to the next; how many does not change what is drawn."""
    lat, r = pieces.Lattices(pieces.vocabulary(pieces.model_path())), random.Random(5)
    texts = ["".join(r.choice("aeiou stnrl") for _ in range(2000)) for _ in range(280)]
    want = []
    for k in range(0, 280, 70):
        want += pieces.encode_texts(lat, list(range(k, k + 70)), texts[k : k + 70], 2, 0)
        assert lat.n_edges <= 1_000_000
    monkeypatch.setattr(pieces, "HELD", 0)
    monkeypatch.setattr(pieces, "BATCH", 1 << 14)
    got = list(pieces.encode_texts(pieces.Lattices(pieces.vocabulary(pieces.model_path())), list(range(280)), texts, 2, 0))
    assert [[(x.tolist(), p, s) for x, p, s in row] for row in got] == [[(x.tolist(), p, s) for x, p, s in row] for row in want]


def test_media_in_bounded_batches(spark, docs, empty):
    """Storing holds some rows' media at a time and gives them all; a round trip is one step of Python."""
    texts = [None, "", *("x" * (k % 900) for k in range(1500)), "y" * 3_000_000, *("z" * 500_000 for _ in range(40))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    got = list(media._storing("doc_id", "x")(iter([batch, batch.slice(0, 0), batch.slice(7, 300)])))
    assert [i for b in got for i in b.column(0).to_pylist()] == [*range(len(texts)), *range(7, 307)]
    assert [n for b in got for n in b.column(1).to_pylist()] == [len(t or "") for t in (*texts, *texts[7:307])]
    assert all(b.num_rows <= media.ROWS and (b.num_rows == 1 or b.slice(0, b.num_rows - 1).column(3).nbytes < 2 * media.HOLD) for b in got)
    once, apart = media.round_trip(docs), media.read(media.store(docs))
    assert once.schema == apart.schema and sorted(map(str, once.collect())) == sorted(map(str, apart.collect())) and media.round_trip(empty).count() == 0
    assert str(queries.op5_media_columns(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1


def test_media_carving():
    import struct

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"
    payload = b"BM text RIFF " + png + b" P5\n and " + gif + b"\xff\xd8\xff"
    payload += b"\xff" * (-len(payload) % 576)
    a = media.automaton()
    for kind, write in media.WRITERS.items():
        m = write(payload)
        found = media.sniff(m, a)
        assert found[0][1] == kind and m[found[0][2][1] : found[0][2][2]] == payload
        assert [(k, m[s : f[0]]) for s, k, f in found[1:]] == [("image/png", png), ("image/gif", gif)]
        assert media.sniff(m[:-3], a)[:1] != found[:1]
    assert media.sniff(png[:-1], a) == [] and media.sniff(b"", a) == []


# -- 6 -------------------------------------------------------------------------------------------------------------------
def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, docs, empty, texts):
    more = {100: "cc by cc by, CC-BY. xcc by", 101: "General Public LICENSE all rights reserved all rights-reserved", 102: "é cc byé cc by", 103: "Lesser general public license; MIT License"}
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in (texts | more).items():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[103].labels == "gpl,lgpl,mit"
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "polish", "granted"),
    [("MIT", "mit", True), ("MIT OR GPL-2.0-only", "mit gpl-2.0-only or", True), ("MIT AND GPL-2.0-only", "mit gpl-2.0-only and", False), ("(MIT OR GPL-3.0) AND Apache-2.0 */", "mit gpl-3.0 or apache-2.0 and", True),
     ("GPL-2.0+ WITH Classpath-exception-2.0 OR ISC", "gpl-2.0+ classpath-exception-2.0 with isc or", True), ("AND MIT", None, None), ("", None, None), ("MIT AND", "mit", True), ("MIT OR (ISC", "mit", True)],
)
def test_license_expressions(text, polish, granted):
    got = licenses.parse(text)
    assert got == (polish.split() if polish else None)
    if got:
        assert licenses.granted(got) is granted
    found = licenses.scan_text(f"# SPDX-License-Identifier: {text}\n", licenses.automaton())
    assert found["permitted"] is granted


def test_license_tags_of_one_line():
    tag = "SPDX-License-Identifier:"
    found = licenses.scan_text(f"/* {tag} MIT */ code(); /* {tag} GPL-3.0-only OR {tag} ISC */ {tag}", licenses.automaton())
    assert found["expressions"] == ["mit", "gpl-3.0-only", "isc"] and found["permitted"] is False and found["labels"] == "gpl-3.0-only,isc,mit"
    many = licenses.scan_text(" ".join(f"{tag} x-{k} a{tag} no SPDX-License-Identifiers: no" for k in range(3000)), licenses.automaton())
    assert many["expressions"] == [f"x-{k}" for k in range(3000)]


# -- 7 -------------------------------------------------------------------------------------------------------------------
def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                covered[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((i, len(b), sum(covered), len(re.findall(rb"\x01+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffixes(docs, empty, texts):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = sorted(tuple(r) for r in suffixes.without_repeats(docs, digests=True).filter("doc_id is not null").collect())
    assert got == brute_repeats(rows)
    whole = suffixes.without_repeats(docs)
    assert whole.columns == docs.columns and whole.count() == docs.count()
    assert suffixes.without_repeats(empty).count() == suffixes.without_repeats(empty, digests=True).count() == 0


def test_suffixes_edges(spark, monkeypatch):
    """Shared passages at all offsets, periodic texts, rows with equal ids, and batches of a few runs."""
    monkeypatch.setattr(suffixes, "BATCH", 16)
    monkeypatch.setattr(suffixes, "PIECE", 4096)
    monkeypatch.setattr(suffixes, "HOLD", 20_000)
    r = random.Random(3)
    passage = "".join(r.choice("abcdef ") for _ in range(400))
    rows = []
    for i in range(120):
        a, n = r.randrange(300), r.choice([20, 49, 50, 51, 99, 100])
        own = "".join(r.choice("abcdef ") for _ in range(r.choice([0, 10, 300])))
        rows.append((i // 2 if i % 10 == 1 else i, own + passage[a : a + n] + own[:30] + ("ab" * 40 if i % 9 == 0 else "")))
    rows.append((500, passage * 30))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(x) for x in suffixes.without_repeats(df, digests=True).collect()) == brute_repeats(rows)


# -- 8 -------------------------------------------------------------------------------------------------------------------
def test_prints(spark, docs, empty):
    got = prints.compare_edited(docs).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert Counter(ids) == Counter(i for i, _ in rows if i is not None)
    texts = dict(rows)
    follow = sorted(i for i in set(texts) if i is not None)
    for r in got:
        t = texts[r.doc_id]
        assert r.n_chars == len(t) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None and r.doc_id != follow[-1]:
            after = texts[follow[follow.index(r.doc_id) + 1]]
            q = len(t) // 4
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[4] == by[6] and by[1] == by[2]
    assert prints.compare_edited(empty).count() == 0
    alone = prints.compare_edited(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0


def test_prints_against_plain_version(spark):
    """Fingerprints and likenesses told plainly, from the terms' hashes and the lexicon, and recall of edited texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in prints.compare_edited(docs).collect()}
    follow = sorted(rows)
    edit = {i: rows[i][: len(rows[i]) - len(rows[i]) // 4] + rows[follow[(k + 1) % len(follow)]][: len(rows[i]) // 4] for k, i in enumerate(follow)}
    of = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    df = Counter(w for t in rows.values() for w in of(t))
    n = len(rows)
    lex = {w for w, c in df.items() if n ** (1 - prints.BAND[1]) <= c <= n ** (1 - prints.BAND[0])}
    words = sorted(set(df) | {w for t in edit.values() for w in of(t)})
    term = F.xxhash64("w")
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64(term, F.lit(77)).alias("v"), *[F.xxhash64(term, F.lit(c)).alias(f"d{c}") for c in range(prints.COPIES)]).collect()
    h = {r.w: (r.v & ((1 << 40) - 1), [r[f"d{c}"] for c in range(prints.COPIES)]) for r in hashed}

    def fingerprint(t):
        own = of(t)
        inside = own & lex
        out = []
        for b in prints.RATES:
            for c in range(prints.COPIES):
                member = sorted(h[w][0] for w in inside if h[w][1][c] & ((1 << b) - 1) == 0)
                out.append(sum(member) if member else None)
        if all(x is None for x in out[: prints.COPIES]):
            some = inside or own
            out = [sum(h[w][0] for w in some) if some else None] * len(out)
        return out

    def likeness(a, b):
        if a == b:
            return 1.0
        shares = [0.0]
        for k in range(len(prints.RATES)):
            x, y = (v[k * prints.COPIES : (k + 1) * prints.COPIES] for v in (a, b))
            both = sum(p is not None and p == q for p, q in zip(x, y, strict=True))
            either = sum(p is not None or q is not None for p, q in zip(x, y, strict=True))
            if either >= (prints.LEAST if k else 1):
                shares.append(both / either)
        return max(shares)

    text = lambda p: ".".join("-" if v is None else f"{v:x}" for v in p)
    own = {i: fingerprint(t) for i, t in rows.items()}
    for k, i in enumerate(follow):
        changed, r = fingerprint(edit[i]), got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (text(own[i]), text(changed))
        assert (r.near_edited, r.near_next) == (pytest.approx(likeness(own[i], changed)), pytest.approx(likeness(own[i], own[follow[(k + 1) % n]])))
    more = prints.compare_edited(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert more.agg(F.avg((F.col("near_edited") >= prints.NEAR).cast("int"))).first()[0] >= 0.9


def test_prints_of_few_terms(spark):
    """Texts of one term differ, and one term that two long texts share does not make them equal."""
    words = spark.createDataFrame([(k, w, 1) for k, w in enumerate(WORDS)], "id int, text string, times int")
    lex = prints.lexicon(words.select("text"), band=(0, 1))
    own = [tuple(r.print) for r in prints.fingerprints(words, lex, ["id", "times"], "times").collect()]
    assert len(own) == len(set(own)) == len(WORDS)
    rest = [None] * (prints.COPIES * (len(prints.RATES) - 2))
    a, b = [*range(8), *range(10, 18), *rest[1:], 99], [*range(20, 28), *range(30, 38), *rest[1:], 99]
    same, few = [*range(8), *range(30, 38), *rest], [1, None, 2, *rest, *[None] * 13]
    x = spark.createDataFrame([(a, b), (a, same), (few, [1, None, 3, *rest, *[None] * 13]), (few, few)], "a array<long>, b array<long>")
    assert [r[0] for r in x.coalesce(1).select(prints.likeness(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.5, 1.0]


# -- 9 -------------------------------------------------------------------------------------------------------------------
def pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/é ü\n", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "<b>é</b>" * 50_000), (6, "u", "\x1f WARC/1.1 \r\n\r\n"), (6, "u", "\x1f WARC/1.1 \r\n\r\n"), (None, "u", "no id")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)


@pytest.mark.parametrize("split", [64, 1000, 4 << 20])
def test_warc(spark, split):
    df = pages(spark)
    files = warc.write(df, fresh_path(spark, "test"))
    got = warc.read(files, split).collect()
    assert sorted((r.page_id or -1) for r in got) == [-1, 1, 2, 3, 4, 5, 6, 6] and all(r.intact for r in got)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None)}
    want = {r.page_id: (r.html or "").encode() for r in df.collect()}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(want[r.page_id]), warc.digest(want[r.page_id]))
        assert r.record_type == "revisit" or bytes(r.payload) == want[r.page_id]


def test_warc_false_magic(spark, tmp_path):
    """Magic bytes that begin no member, within members that are stored and not packed."""
    import gzip
    import io

    noise = b"".join(gzip.compress(b"no record") + warc.MAGIC * 3 for _ in range(20))
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: %d\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + noise
    data = b"".join(gzip.compress(head % (k, len(block)) + block + b"\r\n\r\n", compresslevel=0) for k in range(5))

    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    for size in (50, 333, len(data)):
        ids = [warc.fields(r)["page_id"] for at in range(0, len(data), size) for _, r in warc.records_of(File(), len(data), at, min(len(data), at + size))]
        assert ids == list(range(5))
    assert io and spark.read.schema("path string, bytes long, records long").parquet(str(_empty(spark, tmp_path))).count() == 0
    assert warc.read(warc.write(pages(spark).limit(0), fresh_path(spark, "test"))).count() == 0


def _empty(spark, tmp_path):
    p = tmp_path / "e"
    spark.createDataFrame([], "path string, bytes long, records long").write.parquet(str(p))
    return p


# -- 10 ------------------------------------------------------------------------------------------------------------------
def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(empty).count() == 0 and mixing.by_position(mixing.mix(empty)).count() == 0
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        assert r.target <= 2 * r.source_size
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs.repartition(6)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in got}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns


def test_mix_targets(spark):
    """Water-filling against a loop that reshares what is above."""
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 3000, "e": 0, None: 70}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * 2, strict=True))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            break
        want |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    assert got == pytest.approx(want | share)


def test_positions_invert_the_schedule(spark):
    a, b = 2.0, 1.0
    for u in (0.0, 0.3, 1.0):
        t = spark.range(1).select(mixing._position(F.lit(u), F.lit(0), [(a, b)]).alias("t")).first().t
        assert (a * t + (b - a) * t * t / 2) / ((a + b) / 2) == pytest.approx(u)
