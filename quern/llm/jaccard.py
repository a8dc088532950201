"""N-gram Jaccard join by parity sketches: every link between sets of word shingles with similarity 4/5 or more.

A set's sketch of P words: each token is XORed, by its hash, into one of P 64-bit words. A token of both sets changes
both sketches alike, so the number of words that differ is at most the size of the symmetric difference. Sets of a and
b tokens with similarity 4/5 or more differ in at most (a + b) / 9 tokens; in a band of sizes below U that is at most
D = 2 (U - 1) // 9, so of P > D words at least P - D agree: a join on (band, place, word) finds every pair. Of a set's
w words that hold tokens at least w - D agree, so a set with fewer partners' words than that has no link.

Copies share one owner, a hash of the set; owners, not documents, are joined. A bucket is the owners with one sketch
word at one place; how buckets lead to links and components, all of them exact, is told in ``quern.operators.links``:
an owner that shares fewer words than a link needs goes; members of a bucket are met by one of them (stars) until this
merges little; then members of different components are met, a bound on sketches of single bits before any set is
fetched. No step makes all pairs of a group of copies. A map task meets the members of a bucket by their first one at
once and sends only that on, so a hot bucket sends one entry from each task. What is broadcast is measured first.

Defined results: null and empty texts, or texts of white space, have n_shingles 0 and link with nothing; a text with
fewer words than a shingle is one shingle; sets, not ids, are the nodes of components, so rows with equal ids and
different sets are apart unless these link; a row with a null id (or one that is no whole number) has a null id, and as
component the smallest id that links with it, null if there is none; repeated rows give equal rows; an empty table gives
an empty result; whole texts count, however long, in slices; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.common import Scratch, estimated_bytes, mix64, release, released, small, unused
from quern.llm.shingles import Hasher
from quern.operators.links import SKETCH, WORDS, connected, resolved

RATIO = 1.25
U64 = np.uint64


def band_edges(most: int = 1 << 40) -> np.ndarray:
    """First size of each band; all sizes of a band and the one below lie within a factor of RATIO squared."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO) + 1))
    return np.array(edges)


EDGES = band_edges()


def widths(band: int) -> tuple[int, int]:
    """(D, P): tokens in which linked sets of the band can differ, and words of its sketches."""
    most = int(EDGES[band + 1]) - 1
    d = 2 * most // 9
    return d, d + 1 + most // 20 + (2 if d else 0)


def bands_of(n: int) -> list[int]:
    """The bands in which a set of n tokens meets its partners: its own, and the next if that holds partners.

    A larger partner b has 4 b <= 5 n.
    """
    own = int(np.searchsorted(EDGES, n, "right")) - 1
    return [own, own + 1] if 4 * int(EDGES[own + 1]) <= 5 * n else [own]


def sketch(tokens: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, words) of the words that hold tokens; tokens are sorted hashes, places their high bits."""
    place = ((tokens >> U64(32)) * U64(p)) >> U64(32)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], np.bitwise_xor.reduceat(mix64(tokens ^ U64(0xA5A5A5A55A5A5A5A)), first)


def keys_of(tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, least number of keys shared with any linked set of that band, keys)."""
    for band in bands_of(len(tokens)):
        d, p = widths(band)
        place, words = sketch(tokens, p)
        least = len(place) - d
        if least < 1:  # the empty words may be those that agree
            empty = np.setdiff1d(np.arange(p, dtype=U64), place)
            place, words = np.concatenate([place, empty]), np.concatenate([words, np.zeros(len(empty), U64)])
            least = p - d
        yield band, least, mix64(words ^ mix64(place + U64((band << 32) + 1)))


def owner_of(tokens: np.ndarray) -> int:
    """The set's hash, never 0 unless the set is empty."""
    if not len(tokens):
        return 0
    h = mix64(tokens).sum(dtype=U64, keepdims=True) * U64(2) + U64(len(tokens) * 2 + 1)
    return int(mix64(h).astype(np.int64)[0]) or 1


def salted(tokens: np.ndarray, salt: int) -> np.ndarray:
    """A set's tokens as they are in the group of that salt: sets of different groups share none."""
    return np.sort(mix64(tokens ^ mix64(np.array([salt], np.int64).view(U64))))


def set_rows(docs: DataFrame, text: str, id_col: str, within: str | None) -> DataFrame:
    """doc, text and, if sets link within groups only, the group's salt."""
    groups = [F.xxhash64(F.col(f"`{within}`")).alias("salt")] if within else []
    return docs.select(F.col(f"`{id_col}`").try_cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), *groups)


def sets_of(h: Hasher, b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Token sets of a batch with text and maybe salt."""
    sets = h.sets(b.column("text").to_pylist())
    return map(salted, sets, b.column("salt").to_pylist()) if "salt" in b.schema.names else sets


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_)))


# -- entries of buckets on their way: key, owner, band, least, and whether the bucket has met a second owner -------------
_ENTRY = np.dtype([("key", "<u8"), ("owner", "<i8"), ("least", "<u2"), ("band", "u1"), ("met", "u1")])
#: Of the buckets with the same members in a share 1 / DENSE of the keys one is kept, with their number.
DENSE = 64
#: What is known of a row: place (its id, or a hash of its text if it has none), owner, size, whether it has an id.
_DOC = np.dtype([("place", "<i8"), ("owner", "<i8"), ("n", "<i8"), ("named", "?")])
#: Entries that a task holds before it sends them.
HOLD = 1_000_000


def packed(e: np.ndarray) -> bytes:
    """By columns, owners once for each run of theirs."""
    first, n = runs(e["owner"])
    return b"".join((np.array([len(e), len(first)], "<u4").tobytes(), e["owner"][first].tobytes(), n.astype("<u4").tobytes(), e["key"].tobytes(), e["least"].tobytes(), e["band"].tobytes(), e["met"].tobytes()))


def unpacked(b: bytes) -> np.ndarray:
    n, k = np.frombuffer(b, "<u4", 2).tolist()
    e, at = np.empty(n, _ENTRY), 8
    owner, times = np.frombuffer(b, "<i8", k, at), np.frombuffer(b, "<u4", k, at + 8 * k)
    e["owner"], at = np.repeat(owner, times), at + 12 * k
    for c in ("key", "least", "band", "met"):
        e[c] = np.frombuffer(b, _ENTRY[c], n, at)
        at += n * _ENTRY[c].itemsize
    return e


def met(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what goes on, what is settled): of the distinct entries of a bucket the first goes on; if there are more, all
    are settled as members of a bucket with several owners, and the first is marked."""
    e = e[np.argsort(e["key"], kind="stable")]
    first, n = runs(e["key"])
    many = np.repeat(n > 1, n)
    sub = e[many]
    sub = sub[np.lexsort((-sub["met"].astype(np.int8), sub["owner"], sub["key"]))]
    new = np.concatenate([[True], (sub["key"][1:] != sub["key"][:-1]) | (sub["owner"][1:] != sub["owner"][:-1])]) if len(sub) else np.zeros(0, bool)
    sub = sub[new]
    first, n = runs(sub["key"])
    lead = np.zeros(len(sub), bool)
    lead[first] = True
    several = np.repeat(n > 1, n)
    out = sub[several]
    sub["met"] |= several
    return np.concatenate([e[~many], sub[lead]]), out


def placed(rows: DataFrame) -> DataFrame:
    """set_rows with place: the id, or a hash of the text where there is none."""
    return rows.withColumn("place", F.coalesce("doc", F.xxhash64("text")))


def buckets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, within: str | None = None) -> DataFrame:
    """Rows of two kinds: place, owner, n, named for each row of docs, and members (key, owner, band, least, times) with
    n = -1 of buckets with several owners, some of them more than once."""
    n_slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(docs) // (10 << 20)))

    def send(entries: list[np.ndarray], of_docs: list[tuple[int, int, int, bool]]) -> Iterator[pa.RecordBatch]:
        go, settled = met(np.concatenate(entries)) if entries else (np.zeros(0, _ENTRY), np.zeros(0, _ENTRY))
        d = np.array(of_docs, _DOC)
        out = {}
        for kind, rows, by in ((0, go, go["key"]), (1, settled, settled["owner"].view("<u8")), (2, d, mix64(d["place"].astype("<u8")))):
            # the slice comes from the key's high bits, for owners by way of a further mix
            to = (((mix64(by) >> U64(32)) * U64(n_slices)) >> U64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            if kind == 0:
                order = np.lexsort((go["owner"], to))
            first, n = runs(to[order])
            for a, m in zip(first.tolist(), n.tolist(), strict=True):
                part = rows[order[a : a + m]]
                out[int(to[order[a]]), kind] = part.tobytes() if kind == 2 else packed(part)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out], pa.int32()), pa.array(list(out.values()), pa.binary())], names=["slice", "kind", "blob"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, seen, entries, of_docs, held = Hasher(width), set(), [], [], 0
        for b in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            named, places = b.column("doc").is_valid().to_pylist(), b.column("place").to_pylist()
            for i, known, tokens in zip(places, named, sets_of(h, b), strict=True):
                owner = owner_of(tokens)
                of_docs.append((i, owner, len(tokens), known))
                if len(tokens) and owner not in seen:
                    seen.add(owner)
                    for band, least, keys in keys_of(tokens):
                        e = np.zeros(len(keys), _ENTRY)
                        e["key"], e["owner"], e["least"], e["band"] = keys, owner, min(least, 65535), band
                        entries.append(e)
                        held += len(e)
                if held >= HOLD:
                    yield from send(entries, of_docs)
                    entries, of_docs, held, seen = [], [], 0, set()
        if of_docs:
            yield from send(entries, of_docs)

    def gather(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        parts = {k: [unpacked(x) for q, x in zip(kinds, blobs, strict=True) if q == k] for k in (0, 1)}
        go, rows = met(np.concatenate(parts[0])) if parts[0] else (np.zeros(0, _ENTRY), np.zeros(0, _ENTRY))
        rows, times = thinned(rows)
        alone = go[(go["met"] > 0) & ~np.isin(go["key"], rows["key"])]  # met by others within a map task only
        settled = np.concatenate([alone, *parts[1]])
        rows, times = np.concatenate([rows, settled]), np.concatenate([times, np.ones(len(settled), np.int64)])
        d = np.concatenate([np.zeros(0, _DOC), *(np.frombuffer(x, _DOC) for q, x in zip(kinds, blobs, strict=True) if q == 2)])
        none, zero = np.zeros(len(d), np.int64), np.zeros(len(rows), np.int64)
        del parts, go, alone, settled
        release()
        return pa.table({
            "place": np.concatenate([zero, d["place"]]), "named": np.concatenate([zero > 0, d["named"]]), "n": np.concatenate([zero - 1, d["n"]]), "owner": np.concatenate([rows["owner"], d["owner"]]),
            "key": np.concatenate([rows["key"].astype(np.int64), none]), "band": np.concatenate([rows["band"].astype(np.int64), none]), "least": np.concatenate([rows["least"].astype(np.int64), none]), "times": np.concatenate([times, none]),
        })

    x = placed(set_rows(docs, text, id_col, within)).mapInArrow(released(spread, 1), "slice int, kind int, blob binary").groupBy("slice")
    return x.applyInArrow(gather, "place long, named boolean, n long, owner long, key long, band long, least long, times long")


def thinned(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members sorted by key -> the same without buckets that repeat another's members, and how often each counts.

    Buckets of which some members are elsewhere stay as they are.
    """
    first, n = runs(rows["key"])
    if not len(first):
        return rows, np.zeros(0, np.int64)
    whole = np.maximum.reduceat(rows["met"], first) == 0
    place = (mix64(rows["key"][first]) >> U64(32)) * U64(DENSE) >> U64(32)
    sign = mix64(np.add.reduceat(mix64(rows["owner"].view("<u8")), first) ^ mix64(place * U64(1024) + rows["band"][first]))
    sign = np.where(whole, sign, rows["key"][first])
    _, at, times = np.unique(sign, return_index=True, return_counts=True)
    kept = np.zeros(len(first), np.int64)
    kept[at] = times
    per_row = np.repeat(kept, n)
    return rows[per_row > 0], per_row[per_row > 0]


# -- tokens of candidates --------------------------------------------------------------------------------------------
def token_sets(docs: DataFrame, wanted: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, within: str | None = None) -> DataFrame:
    """wanted (place, owner): owner, its sorted tokens, their number n, and s0 to s15, the sketch of their single bits.

    Other rows of the place have other owners, and go.
    """
    x = placed(set_rows(docs, text, id_col, within)).join(small(wanted), "place")
    x = x.select("owner", *[c for c in x.columns if c in ("text", "salt")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(width)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                c = b.slice(a, 512)
                own = [(o, t.astype(np.int64)) for o, t in zip(c.column(0).to_pylist(), sets_of(h, c), strict=True) if owner_of(t) == o]
                s = [t for _, t in own]
                cut = np.concatenate([[0], np.cumsum([len(t) for t in s])])
                bits = np.zeros((len(s), WORDS * 64), np.uint8)
                for k, t in enumerate(s):
                    bits[k] = np.bincount(t & (WORDS * 64 - 1), minlength=WORDS * 64) & 1
                words = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in own], pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *s]))), pa.array(np.diff(cut), pa.int64()), *(pa.array(words[:, k]) for k in range(WORDS))], names=["owner", "tokens", "n", *SKETCH])

    return x.mapInArrow(released(run), "owner long, tokens array<long>, n long, " + ", ".join(f"{c} long" for c in SKETCH))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, within: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; rows link only with equal values of within."""
    out = linked_rows(docs, text, id_col, width, within)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("head.doc").alias("component_id"))


def linked_rows(docs: DataFrame, text: str, id_col: str, width: int, within: str | None = None) -> DataFrame:
    """doc, owner, n and head for each row of docs; head is the smallest (doc, owner) of its component, null if no row
    of it has an id. The result is a written table; all tables on the way to it are deleted."""
    s = Scratch(docs.sparkSession)
    found = s.written(buckets(docs, text, id_col, width, within), "buckets")
    of_docs = found.filter("n >= 0").select(F.when(F.col("named"), F.col("place")).alias("doc"), "place", "owner", "n")
    classes = of_docs.filter("n > 0").groupBy("owner").agg(F.min("doc").alias("doc"), F.min("place").alias("place"))

    def sets_of(owners: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = s.written(classes.join(small(s.written(owners, "able")), "owner").select("place", "owner"), "wanted")
        sets = s.written(token_sets(docs, wanted, text, id_col, width, within), "sets")
        # rows with equal places and equal sets
        sets = s.written(sets.dropDuplicates(["owner"]), "sets") if sets.count() > wanted.count() else sets
        return sets, sets.drop("tokens")

    labels = connected(found.filter("n < 0").select("key", "owner", "band", "least", "times"), sets_of, s)
    owners = resolved(classes, labels)
    heads = owners.groupBy("label").agg(F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "owner"))).alias("head"))
    named = owners.join(heads, "label").select("owner", "head")
    alone = F.when(F.col("doc").isNotNull(), F.struct("doc", "owner"))
    out = of_docs.join(named, "owner", "left").select("doc", "owner", "n", F.coalesce("head", alone).alias("head"))
    out = Scratch(docs.sparkSession).written(out, "linked")
    s.drop()
    return out


def with_owner(docs: DataFrame, column: str, text: str, width: int) -> DataFrame:
    """docs with the owner of each row's set."""
    of_text = [f.name.lower() for f in docs.schema.fields].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(width)
        for b in batches:
            yield b.append_column(column, pa.array([owner_of(t) for t in h.sets(b.column(of_text).to_pylist())], pa.int64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, LongType())]))


def first_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5) -> DataFrame:
    """The rows of docs, all columns as they are, without those that link, by way of others or not, with a smaller id.

    Rows without an id stay. Rows with equal ids are told apart by their sets: of those with equal sets the first by
    all columns stays, and of those that link the one with the smallest owner.
    """
    s = Scratch(docs.sparkSession)
    found = linked_rows(docs, text, id_col, width).filter("doc is not null").select("doc", "owner", (F.struct("doc", "owner") != F.col("head")).alias("goes"))
    mark = unused(docs, "_gone")
    number = F.col(f"`{id_col}`").try_cast("long")
    gone = found.filter("goes").select(F.col("doc").alias(mark), F.col("owner").alias(f"{mark}_owner")).distinct()
    clashing = s.written(found.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias(mark)), "clashing")
    if clashing.isEmpty():
        return docs.join(small(s.written(gone.select(mark), "gone")), number == F.col(mark), "left_anti")
    clash = small(clashing)
    alone = docs.join(clash, number == F.col(mark), "left_anti")
    alone = alone.join(small(s.written(gone.select(mark).join(clash, mark, "left_anti"), "gone")), number == F.col(mark), "left_anti")
    own, whole = unused(docs, "_owner"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    each = with_owner(docs.join(clash, number == F.col(mark), "left_semi"), own, text, width)
    each = each.join(small(s.written(gone.join(clash, mark, "left_semi"), "gone")), (number == F.col(mark)) & (F.col(own) == F.col(f"{mark}_owner")), "left_anti")
    first = each.groupBy(number.alias("i"), F.col(own).alias("o")).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return alone.unionByName(first.select("row.*"))
