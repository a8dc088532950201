"""Media columns: payloads kept as small media files, read back by signature sniffing.

An Aho-Corasick pass over the stored bytes locates magic bytes; the validator of each format confirms structure and
lengths. What stands at the start corrects the declared type; what is found further in is carved out as embedded.

Defined results: a null text is an empty payload; bytes without any valid signature keep their declared type and
have no payload; of overlapping finds the one that starts first counts, then the longer; equal bytes, equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 576
#: Rows and bytes of media that stand in Python at once; a single longer medium stands alone.
ROWS = 256
HOLD = 4 << 20


# -- writing -------------------------------------------------------------------------------------------------------
def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples."""
    pad = b"\0" * (len(payload) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def to_bmp(payload: bytes) -> bytes:
    """8-bit grey pixels, rows of BLOCK from the top."""
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    start = 14 + 40 + len(palette)
    info = struct.pack("<IiiHHIIiiII", 40, BLOCK, -(len(payload) // BLOCK), 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return struct.pack("<2sIHHI", b"BM", start + len(payload), 0, 0, start) + info + palette + payload


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (BLOCK, len(payload) // BLOCK) + payload


WRITERS = {"audio/wav": to_wav, "image/bmp": to_bmp, "image/x-portable-graymap": to_pgm}


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's length in bytes, and its bytes filled up with 255 to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


# -- validators: (bytes, start) -> (end, payload start, payload end, facts) or None -----------------------------------
Found = tuple[int, int, int, str]


def check_wav(b: bytes, at: int) -> Found | None:
    if b[at + 8 : at + 12] != b"WAVE" or at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, facts, data = at + 12, "", None
    while p + 8 <= end:
        tag, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return None
        if tag == b"fmt " and n >= 16:
            kind, ch, rate, _, _, bits = struct.unpack_from("<HHIIHH", b, p + 8)
            facts = f"pcm{bits} ch{ch} {rate}Hz" if kind == 1 else f"kind{kind}"
        elif tag == b"data":
            data = (p + 8, p + 8 + n)
        p += 8 + n + n % 2
    return (end, *data, facts) if facts and data and p == end else None


def check_bmp(b: bytes, at: int) -> Found | None:
    if at + 54 > len(b):
        return None
    n, r1, r2, start, head, w, h, planes, bits, packing = struct.unpack_from("<IHHIIiiHHI", b, at + 2)
    if r1 or r2 or head != 40 or planes != 1 or packing or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h or at + n > len(b):
        return None
    row = (w * bits + 31) // 32 * 4
    if start < 54 or start + row * abs(h) != n:
        return None
    return at + n, at + start, at + n, f"{w}x{abs(h)}x{bits}"


def check_pgm(b: bytes, at: int) -> Found | None:
    parts = b[at : at + 64].split(b"\n", 3)
    if len(parts) < 4 or parts[0] != b"P5" or parts[2] != b"255":
        return None
    size = parts[1].split(b" ")
    if len(size) != 2 or not all(x.isdigit() for x in size):
        return None
    start = at + 3 + len(parts[1]) + 1 + 4
    end = start + int(size[0]) * int(size[1])
    return (end, start, end, f"{int(size[0])}x{int(size[1])}x8") if start < end <= len(b) else None


def check_png(b: bytes, at: int) -> Found | None:
    p, facts, first = at + 8, "", True
    while p + 12 <= len(b):
        n, tag = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and tag != b"IHDR" or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        if first:
            w, h, depth = struct.unpack_from(">IIB", b, p + 8)
            facts, first = f"{w}x{h}x{depth}", False
        p += 12 + n
        if tag == b"IEND":
            return p, at, p, facts
    return None


def check_gif(b: bytes, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1, at, p + 1, f"{w}x{h}"
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            own = b[p + 9]
            p = blocks(p + 10 + (3 << (own & 7) + 1 if own & 128 else 0) + 1)
        else:
            return None
    return None


def check_jpeg(b: bytes, at: int) -> Found | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if not 0xC0 <= mark <= 0xFE or 0xD0 <= mark <= 0xD9 or n < 2:
            return None
        p += 2 + n
        if mark == 0xDA:  # entropy-coded data up to a marker that isn't stuffing or a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2, at, p + 2, "jpeg"
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return None
    return None


def check_pdf(b: bytes, at: int) -> Found | None:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    end = b.find(b"%%EOF", at)
    return (end + 5, at, end + 5, b[at + 5 : at + 8].decode("latin-1")) if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


#: Magic bytes, the type that they announce, and its validator.
SIGNATURES: dict[bytes, tuple[str, Callable[[bytes, int], Found | None]]] = {
    b"RIFF": ("audio/wav", check_wav), b"BM": ("image/bmp", check_bmp), b"P5\n": ("image/x-portable-graymap", check_pgm), b"\x89PNG\r\n\x1a\n": ("image/png", check_png),
    b"GIF87a": ("image/gif", check_gif), b"GIF89a": ("image/gif", check_gif), b"\xff\xd8\xff": ("image/jpeg", check_jpeg), b"%PDF-": ("application/pdf", check_pdf),
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, (kind, check) in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    a.make_automaton()
    return a


def sniff(media: bytes, a) -> list[tuple[int, str, Found]]:
    """(start, type, found) of each valid medium; those inside the payload of the first one come after it."""
    hits = []
    for last, (n, kind, check) in a.iter(media.decode("latin-1")):
        if found := check(media, last - n + 1):
            hits.append((last - n + 1, kind, found))
    hits.sort(key=lambda x: (x[0], -x[2][0]))
    out, free = hits[:1] if hits and hits[0][0] == 0 else [], 0
    for h in hits[len(out) :]:
        if h[0] >= free:
            out.append(h)
            free = h[2][0]
    return out


def facts_of(payload: bytes) -> str:
    v = np.frombuffer(payload, np.uint8)
    return f"mean={v.sum(dtype=np.int64) // max(1, len(v))},low={int(v.min()) if len(v) else 0},high={int(v.max()) if len(v) else 0}"


# -- DataFrames ------------------------------------------------------------------------------------------------------
def _storing(id_col: str, declared: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) -> id, n_bytes, declared_type, media, in batches of at most ROWS rows that end once they hold HOLD bytes."""
    writers = list(WRITERS.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media, held, first = [], [], 0, 0
            for k, t in enumerate(b.column(1), 1):
                n, payload = payload_of(t.as_py())
                sizes.append(n)
                media.append(writers[zlib.crc32(payload) % len(writers)](payload))
                held += len(media[-1])
                if held >= HOLD or len(media) == ROWS or k == b.num_rows:
                    columns = [pa.array(sizes, pa.int64()), pa.array([declared] * len(sizes), pa.string()), pa.array(media, pa.binary())]
                    ids = b.column(0).slice(first, k - first)
                    sizes, media, held, first = [], [], 0, k
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=[id_col, "n_bytes", "declared_type", "media"])

    return run


_FOUND = pa.schema([("media_type", pa.string()), ("facts", pa.string()), ("carved", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])


def _reading(id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, n_bytes, declared_type, media -> id, n_bytes and what the media hold, one medium at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            rows = []
            for declared, stored in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                media = stored.as_py() or b""
                hits = sniff(media, a)
                whole = hits[0] if hits and hits[0][0] == 0 else None
                payload = media[whole[2][1] : whole[2][2]] if whole else b""
                carved = [{"offset": s, "length": f[0] - s, "type": k} for s, k, f in (hits[1:] if whole else hits)]
                rows.append({"media_type": whole[1] if whole else declared, "facts": (whole[2][3] + "," if whole else "") + facts_of(payload), "carved": carved, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()})
            cols = pa.RecordBatch.from_pylist(rows, schema=_FOUND)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols.columns], names=[id_col, "n_bytes", *_FOUND.names])

    return run


def _found(kind: str, id_col: str) -> str:
    return f"`{id_col}` {kind}, n_bytes long, media_type string, facts string, carved array<struct<offset:long,length:long,type:string>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def store(docs: DataFrame, text: str = "text", id_col: str = "doc_id", declared: str = "application/octet-stream") -> DataFrame:
    """docs' ids with media columns: n_bytes, declared_type, media (bytes). The format follows from the payload's hash."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(_storing(id_col, declared), f"`{id_col}` {kind}, n_bytes long, declared_type string, media binary")


def read(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: corrected type, payload, carved media; the payload's digests come with it."""
    kind = stored.schema[id_col].dataType.simpleString()
    return stored.select(F.col(f"`{id_col}`"), "n_bytes", "declared_type", "media").mapInArrow(_reading(id_col), _found(kind, id_col))


def round_trip(docs: DataFrame, text: str = "text", id_col: str = "doc_id", declared: str = "application/octet-stream") -> DataFrame:
    """What ``read`` finds in what ``store`` writes, in one step of a task: the media columns stay in its Python."""
    storing, reading = _storing(id_col, declared), _reading(id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(lambda batches: reading(storing(batches)), _found(kind, id_col))
