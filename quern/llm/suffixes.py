"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts in a document with a smaller id.

Places of a text that can match are found by anchors: of the GRAM-byte grams in a window of LENGTH bytes the one with
the least hash (the first of equals) is the window's anchor. Equal windows have equal anchors at the same place, so
windows are dealt out by their anchor: each run of windows with one anchor goes, as one piece of text, to the anchor's
slice. The suffixes of a slice are those that start at anchors.

In a slice, documents come in batches by id. A batch's sparse suffix array is sorted, merge-scanned against the levels
of a logarithmic index family for long matches (equal suffixes with equal left contexts match as a whole; those that
share the anchor only are compared window by window), and what is new becomes a level; levels of like size merge, so
there are about log2(batches) levels and each suffix is merged as often. Batches come in order of ids, thus what a
level holds is always of a smaller document, or of the same one.

Within a map task a run that several documents share is sent once, for the smallest of them, so a hot passage sends
one piece from each task. Memory of a task is bounded by PIECE, HOLD and the slice's share of repeated text.

Runs that are equal by a 64-bit hash of their bytes count as equal within a map task; all others are compared by bytes.

Defined results: null is empty; texts shorter than LENGTH stay whole; whole texts count, however long, in pieces; rows
with equal ids (so repeated rows too) never remove bytes of one another; of equal strings the one in the smallest id
stays wherever it stands; a null id counts as the largest; matches never cross documents; an empty table gives an empty
result; extra columns, whatever their names, stay as they are, and are left out of digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import estimated_bytes, mix64, release, released, unused, written

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM  # places before an anchor at which a window can start
PIECE = 1 << 18
HOLD = 6 << 20
BATCH = 1 << 15
#: Rows whose texts are Python strings at once.
ROWS = 256
U64 = np.uint64
_LAST = (1 << 63) - 1
#: A run of windows with one anchor: document (by its place in a list), first window, windows, anchor's place in it.
_RUN = np.dtype([("doc", "<u4"), ("pos", "<u4"), ("n", "u1"), ("rel", "u1")])
_SPANS = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")])


class Cutter:
    """Cuts a piece of concatenated texts into runs."""

    def __init__(self):
        n = PIECE + LENGTH
        base = 0x9E3779B97F4A7C15
        self.values = mix64(np.arange(256, dtype=U64) + U64(0x2545F491))
        self.powers = np.cumprod(np.full(n, base, U64), dtype=U64)
        self.inverse = np.cumprod(np.full(n, pow(base, -1, 1 << 64), U64), dtype=U64)

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data: texts one after the other, ends: their ends. For each run: text, first byte in data, windows, anchor's
        place from there, slice hash and content hash."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
        at = lambda k: np.ndarray((n,), "<u8", padded, k, (1,))
        h = at(0) * U64(0x9FB21C651E98DF25) ^ (at(8) * U64(0xD6E8FEB86659FD93) >> U64(9))
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        v = (h >> U64(32) << U64(32)) | np.arange(n, dtype=U64)
        m, width = v, 1
        while 2 * width <= SPAN + 1:
            m = np.minimum(m[:-width], m[width:]) if len(m) > width else m[:0]
            width *= 2
        rest = SPAN + 1 - width
        m = np.minimum(m[:-rest], m[rest:]) if rest and len(m) > rest else m if not rest else m[:0]
        starts = np.concatenate([[0], ends[:-1]])
        windows = np.maximum(0, ends - starts - LENGTH + 1)
        first = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
        p = first + np.arange(len(first))
        text = np.repeat(np.arange(len(ends)), windows)
        anchor = (m[p] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(p) else np.zeros(0, np.int64)
        begin, count = p[new], np.diff(np.append(new, len(p)))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.values[data] * self.powers[:n], dtype=U64)])
        content = mix64((sums[begin + count + LENGTH - 1] - sums[begin]) * self.inverse[begin] + count.astype(U64))
        return text[new], begin, count, anchor[new] - begin, mix64(h[anchor[new]]), content


def _take(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some stretches, one after the other."""
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    return data[np.repeat(begin - first, size) + np.arange(int(size.sum()))]


def _planes(x: np.ndarray) -> bytes:
    """Small numbers, byte by byte of their four: they compress better so."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _spans(doc, tag, start, end) -> np.ndarray:
    out = np.empty(len(start), _SPANS)
    out["doc"], out["tag"], out["start"], out["end"] = doc, tag, start, end
    return out


def _by_doc(spans: np.ndarray, n_parts: int) -> Iterator[tuple[int, bytes]]:
    to = part_of(spans["doc"], n_parts)
    order = np.argsort(to, kind="stable")
    spans, to = spans[order], to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
    for a, b in zip(cut, np.append(cut[1:], len(to)) if len(cut) else [], strict=True):
        yield int(to[a]), spans[a:b].tobytes()


def part_of(doc: np.ndarray, n_parts: int) -> np.ndarray:
    return (((mix64(np.ascontiguousarray(doc).view("<u8")) >> U64(32)) * U64(n_parts)) >> U64(32)).astype(np.int64)


def cut_texts(n_slices: int, n_parts: int, tagged: bool) -> Callable:
    """Map side: (id, text) -> (slice, blob of runs) and, as slice -1 - part, spans that are settled within the task."""
    import zstandard

    def flush(held: list, docs: list[int], tags: list[int]) -> pa.RecordBatch:
        doc_ids, doc_tags = np.array(docs, np.int64), np.array(tags, np.uint32)
        data = np.concatenate([h[0] for h in held])
        shift = np.cumsum([0] + [len(h[0]) for h in held])[:-1]
        run = np.concatenate([h[1] for h in held])
        begin = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=True)])
        where, content = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        # of runs with equal content those of the smallest document go on, the others are settled
        order = np.lexsort((doc_ids[run["doc"]], content))
        c = content[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        least = np.repeat(doc_ids[run["doc"][order[first]]], np.diff(np.append(first, len(c))))
        later = np.zeros(len(run), bool)
        later[order] = doc_ids[run["doc"][order]] > least
        done = run[later]
        spans = _spans(doc_ids[done["doc"]], doc_tags[done["doc"]], done["pos"], done["pos"] + done["n"] + np.uint32(LENGTH - 1))
        run, begin, where = run[~later], begin[~later], where[~later]
        to = (((where >> U64(32)) * U64(n_slices)) >> U64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(n_slices + 1))
        slices, blobs, z = [], [], zstandard.ZstdCompressor(level=3)
        for s in np.flatnonzero(np.diff(edges)):
            own = order[edges[s] : edges[s + 1]]
            r = run[own]
            used, index = np.unique(r["doc"], return_inverse=True)
            ids = doc_ids[used]
            raw = b"".join((np.array([len(r), len(used)], "<u4").tobytes(), np.diff(ids, prepend=0).tobytes(), doc_tags[used].tobytes(), _planes(np.diff(index, prepend=0)), _planes(r["pos"]), r["n"].tobytes(), r["rel"].tobytes(), _take(data, begin[own], r["n"].astype(np.int64) + LENGTH - 1).tobytes()))
            slices.append(int(s))
            blobs.append(z.compress(raw))
        for part, b in _by_doc(spans, n_parts):
            slices.append(-1 - part)
            blobs.append(b)
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, docs, tags, size = Cutter(), [], [], [], 0
        piece: list[tuple[int, int, bytes]] = []  # document, its first byte there, bytes

        def cut() -> None:
            data = np.frombuffer(b"".join(x[2] for x in piece), np.uint8)
            text, begin, count, rel, where, content = cutter.runs(data, np.cumsum([len(x[2]) for x in piece]))
            r = np.empty(len(text), _RUN)
            starts = np.cumsum([0] + [len(x[2]) for x in piece])[:-1]
            r["doc"] = np.array([x[0] for x in piece])[text]
            r["pos"] = np.array([x[1] for x in piece])[text] + begin - starts[text]
            r["n"], r["rel"] = count, rel
            held.append((data, r, begin, where, content))
            piece.clear()

        in_piece = 0
        for b in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH:
                    continue
                docs.append(_LAST if i is None else i)
                tags.append(zlib.crc32(raw) if tagged else 0)
                for at in range(0, len(raw) - LENGTH + 1, PIECE - LENGTH):
                    x = raw[at : at + PIECE - 1]
                    if in_piece + len(x) > PIECE:
                        cut()
                        in_piece = 0
                    piece.append((len(docs) - 1, at, x))
                    in_piece += len(x)
                    size += len(x)
                    if size >= HOLD:
                        cut()
                        yield flush(held, docs, tags)
                        held, docs, tags, size, in_piece = [], docs[-1:], tags[-1:], 0, 0
        if piece:
            cut()
        if held:
            yield flush(held, docs, tags)

    return run


class Level:
    """A sorted sparse suffix array: keys (suffix from the anchor, then the left context backwards), and their places."""

    def __init__(self, keys: np.ndarray, place: np.ndarray):
        self.keys, self.place = keys, place

    def merged(self, other: Level) -> Level:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")  # of two sorted stretches: a merge
        return Level(keys[order], np.concatenate([self.place, other.place])[order])


class Family:
    """The logarithmic index family of a slice, over runs (doc, n, rel) and their bytes."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, rel: np.ndarray, data: np.ndarray, begin: np.ndarray):
        self.doc, self.n, self.rel, self.data, self.begin = doc, n.astype(np.int64), rel.astype(np.int64), data, begin
        self.padded = np.concatenate([np.zeros(SPAN, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        self.levels: list[Level] = []
        self.matched = np.zeros((len(doc), SPAN + 1), bool)  # by run and window: starts in a smaller document too

    def keys(self, runs: np.ndarray) -> np.ndarray:
        size = self.n[runs] + LENGTH - 1
        anchor = self.begin[runs] + self.rel[runs]
        k = np.zeros((len(runs), LENGTH + SPAN + 2), np.uint8)
        right = np.arange(LENGTH)[None, :] < (size - self.rel[runs])[:, None]
        k[:, :LENGTH] = sliding_window_view(self.padded, LENGTH)[anchor + SPAN] * right
        left = np.arange(1, SPAN + 1)[None, :] <= self.rel[runs][:, None]
        k[:, LENGTH:-2] = sliding_window_view(self.padded, SPAN)[anchor][:, ::-1] * left
        k[:, -2], k[:, -1] = self.rel[runs], size
        return k.view(f"S{k.shape[1]}").ravel()

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of some runs: run, number, content."""
        run = np.repeat(runs, self.n[runs])
        first = np.concatenate([[0], np.cumsum(self.n[runs])[:-1]]) if len(runs) else np.zeros(0, np.int64)
        k = np.arange(len(run)) - np.repeat(first, self.n[runs])
        w = sliding_window_view(self.data, LENGTH)[self.begin[run] + k] if len(run) else np.zeros((0, LENGTH), np.uint8)
        return run, k, np.ascontiguousarray(w).view(f"S{LENGTH}").ravel()

    def compare(self, mine: np.ndarray, theirs: np.ndarray) -> None:
        """Marks windows of mine that stand in a run, mine or theirs, of a smaller document."""
        run, k, content = self.windows(np.unique(np.concatenate([mine, theirs])))
        order = np.lexsort((self.doc[run], content)) if len(run) else []
        run, k, content = run[order], k[order], content[order]
        if not len(run):
            return
        first = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        least = np.repeat(self.doc[run[first]], np.diff(np.append(first, len(run))))
        hit = self.doc[run] > least
        self.matched[run[hit], k[hit]] = True

    def add(self, runs: np.ndarray) -> None:
        """A batch, whose documents are not smaller than those of the batches before."""
        keys = self.keys(runs)
        order = np.lexsort((self.doc[runs], keys))
        keys, runs = keys[order], runs[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        owner = np.repeat(first, np.diff(np.append(first, len(keys))))
        later = self.doc[runs] > self.doc[runs[owner]]
        self.matched[runs[later]] = True
        keys, heads = keys[first], runs[first]
        held = np.zeros(len(keys), bool)
        anchors = keys.astype(f"S{GRAM}")
        mine, theirs = [], []
        for level in self.levels:
            at = np.searchsorted(level.keys, keys)
            same = level.keys[np.minimum(at, len(level.keys) - 1)] == keys
            smaller = same & (self.doc[level.place[np.minimum(at, len(level.keys) - 1)]] < self.doc[heads])
            full = smaller[np.searchsorted(first, owner)]
            self.matched[runs[full]] = True
            held |= same
            # others that share the anchor
            theirs_anchor = level.keys.astype(f"S{GRAM}")
            low, high = np.searchsorted(theirs_anchor, anchors), np.searchsorted(theirs_anchor, anchors, "right")
            near = (high > low) & ~smaller
            mine.append(heads[near])
            low, high = np.unique(low[near]), np.unique(high[near])  # anchors' ranges are disjoint, so these pair up
            theirs.append(level.place[_take(np.arange(len(level.place)), low, high - low)] if len(low) else low)
        edge = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        several = np.repeat(np.diff(np.append(edge, len(anchors))) > 1, np.diff(np.append(edge, len(anchors))))
        mine.append(heads[several])
        self.compare(np.concatenate(mine), np.concatenate(theirs) if theirs else heads[:0])
        # a batch's runs that equal their head, in the same document, share its windows' marks
        same_doc = ~later
        self.matched[runs[same_doc]] |= self.matched[runs[owner[same_doc]]]
        if not held.all():
            self.levels.append(Level(keys[~held], heads[~held]))
        while len(self.levels) > 1 and len(self.levels[-2].keys) <= 2 * len(self.levels[-1].keys):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))


def _opened(raw: bytes) -> tuple[np.ndarray, ...]:
    """A blob of runs: document, tag, first window, windows and anchor's place of each, and their bytes."""
    k, d = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8
    ids, at = np.cumsum(np.frombuffer(raw, "<i8", d, at)), at + 8 * d
    tags, at = np.frombuffer(raw, "<u4", d, at), at + 4 * d
    index, at = np.cumsum(_from_planes(raw, k, at)), at + 4 * k
    return ids[index], tags[index], _from_planes(raw, k, at), np.frombuffer(raw, "u1", k, at + 4 * k), np.frombuffer(raw, "u1", k, at + 5 * k), np.frombuffer(raw, "u1", -1, at + 6 * k)


def _anchors(rel: np.ndarray, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of the grams at the anchors of runs."""
    words = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    a = begin + rel
    return mix64(words[a]) ^ words[a + 8] * U64(0x9E3779B97F4A7C15)


def match_slice(n_parts: int) -> Callable:
    """Reduce side: the blobs of a slice -> spans of bytes to remove, by part of the documents.

    Only anchors that several documents have can match, so blobs are opened twice: first for their anchors and documents
    alone, then for the runs at such anchors; a slice's text is never held whole.
    """
    import zstandard

    def gather(table: pa.Table) -> pa.Table:
        z, blobs = zstandard.ZstdDecompressor(), table.column("blob")
        anchor, doc = [], []
        for blob in blobs:
            d, _, _, n, rel, data = _opened(z.decompress(blob.as_py()))
            size = n.astype(np.int64) + LENGTH - 1
            doc.append(d), anchor.append(_anchors(rel, np.cumsum(size) - size, data))
        cuts = np.cumsum([len(d) for d in doc])[:-1]
        doc, anchor = np.concatenate(doc), np.concatenate(anchor)
        order = np.argsort(anchor, kind="stable")
        s, d = anchor[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        shared = np.zeros(len(doc), bool)
        shared[order] = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(np.append(first, len(s))))
        del anchor, order, s, d, first, doc
        parts = []
        for blob, on in zip(blobs, np.split(shared, cuts), strict=True):
            if on.any():
                d, t, at, n, rel, data = _opened(z.decompress(blob.as_py()))
                size = n.astype(np.int64) + LENGTH - 1
                parts.append((d[on], t[on], at[on], n[on], rel[on], _take(data, (np.cumsum(size) - size)[on], size[on])))
        if not parts:
            return pa.table({"part": pa.array([], pa.int32()), "spans": pa.array([], pa.binary())})
        doc, tag, pos, n, rel, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        size = n.astype(np.int64) + LENGTH - 1
        begin, keep = np.cumsum(size) - size, np.argsort(doc, kind="stable")
        doc, tag, pos, n, rel, begin = (x[keep] for x in (doc, tag, pos, n, rel, begin))
        family = Family(doc, n, rel, data, begin)
        for k in range(0, len(doc), BATCH):
            family.add(np.arange(k, min(k + BATCH, len(doc))))
        hit = family.matched & (np.arange(SPAN + 1)[None, :] < n[:, None])
        edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        run, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        spans = _spans(doc[run], tag[run], pos[run] + low, pos[run] + high + LENGTH - 1)
        out = list(_by_doc(spans, n_parts))
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "spans": pa.array([x[1] for x in out], pa.binary())})

    return gather


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches covered by the spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def without_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """docs with the repeated bytes cut out of their texts (a character that loses a byte goes as a whole), or with
    digests the id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    part = unused(docs, "_part")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(docs)
    n_slices, n_parts = max(partitions, -(-size // (3 << 20))), max(partitions, -(-size // (6 << 20)))
    number = F.col(f"`{id_col}`").cast("long")
    tagged = not docs.groupBy(number.alias("i")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    sent = docs.select(number.alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(released(cut_texts(n_slices, n_parts, tagged), 1), "slice int, blob binary")

    def reduce(table: pa.Table) -> pa.Table:
        s = table.column("slice")[0].as_py()
        if s < 0:
            return pa.table({"part": pa.array([-1 - s] * len(table), pa.int32()), "spans": table.column("blob").cast(pa.binary())})
        out = match_slice(n_parts)(table)
        release()
        return out

    spans = written(sent.groupBy("slice").applyInArrow(reduce, "part int, spans binary"), "spans")
    wanted = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")) if digests else docs
    names, text_at, id_at = wanted.columns, wanted.columns.index(text), wanted.columns.index(id_col)

    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array([_LAST if i is None else int(i) for i in b.column(id_at).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part_of(ids, n_parts), pa.int32())], names=[*names, part])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        s = np.concatenate([np.zeros(0, _SPANS), *(np.frombuffer(x, _SPANS) for x in right.column("spans").to_pylist())])
        s = s[np.lexsort((s["tag"], s["doc"]))]
        out, rows = [], []
        for i, t in zip(left.column(id_at).to_pylist(), left.column(text_at).to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            number = _LAST if i is None else int(i)
            a, b = np.searchsorted(s["doc"], number), np.searchsorted(s["doc"], number, "right")
            own = s[a:b] if not tagged else s[a:b][s["tag"][a:b] == zlib.crc32(raw)]
            low, high = merged(own["start"].astype(np.int64), own["end"].astype(np.int64))
            cuts = np.concatenate([[0], np.column_stack([low, high]).ravel(), [len(raw)]]).tolist()
            kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
            if digests:
                rows.append((len(raw), len(raw) - len(kept), len(low), hashlib.sha256(kept).hexdigest()))
            else:
                out.append(t if t is None or not len(low) else kept.decode("utf-8", "ignore"))
        release()
        if digests:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.table([left.column(id_at), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return left.set_column(text_at, text, pa.array(out, pa.string())).select(names)

    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    dealt = wanted.mapInArrow(released(with_part), f"{schema}, `{part}` int")
    out = f"`{id_col}` {kinds[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else schema
    return dealt.groupBy(part).cogroup(spans.groupBy("part")).applyInArrow(cut, out)
