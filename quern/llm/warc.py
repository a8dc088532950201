"""WARC archives: a writer with one gzip member for each record, and a splittable reader.

Reading tasks get byte ranges of the files. A task looks for gzip's magic bytes in its range, takes a place as a
member only if what it decodes to begins with a WARC header, and owns the records whose first byte lies in its range;
it reads past the end of the range to finish the last one.

Defined results: a null page is an empty payload; a null id has no id header and reads back as null; of records with
equal payloads of at least ``least`` bytes the one with the largest id is the response and the others are revisits
(rows that share that id are all responses); an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, written

LEVEL = 2
SPLIT = 4 << 20
MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 20


# -- records -----------------------------------------------------------------------------------------------------------
def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """A record in a gzip member of its own."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if row_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{row_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def fields(record: bytes) -> dict:
    """What a decoded record says; payload only for responses, whose digest is taken anew from the bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda k: int(h[k][10:-1]) if k in h else None
    out = {"page_id": number("WARC-Record-ID"), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "refers_to": number("WARC-Refers-To")}
    block = rest[: int(h["Content-Length"])]
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload), "intact": digest(payload) == h["WARC-Payload-Digest"][5:]}
    return out | {"payload": None, "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"][5:], "intact": True}


# -- writing -----------------------------------------------------------------------------------------------------------
def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, path: str, least: int = 0, level: int = LEVEL) -> DataFrame:
    """Writes pages (page_id, url, html) below path, a file for each task; returns the committed files (path, bytes, records).

    A task writes under a name of its attempt and renames at the end; only files of attempts that Spark counted are
    returned, so a lost or doubled attempt leaves nothing that is read.
    """
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    x = x.withColumn("_sha", F.when(F.octet_length("html") >= least, F.unhex(F.sha1("html"))))
    keepers = x.groupBy("_sha").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).filter("_n > 1 and _sha is not null").select("_sha", "_keeper")
    x = x.join(keepers, "_sha", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_keeper")), F.col("_keeper"))
    names = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = TaskContext.get()
        fs, base = _fs(path)
        fs.create_dir(base, recursive=True)
        name = f"warc-{c.partitionId():06d}-{c.taskAttemptId()}.warc.gz"
        n, records = 0, 0
        with fs.open_output_stream(f"{base}/{name}.open") as out:
            for b in batches:
                for i, url, html, to in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    m = member(i, url, html.encode("utf-8", "surrogatepass"), to, level)
                    out.write(m)
                    n, records = n + len(m), records + 1
        fs.move(f"{base}/{name}.open", f"{base}/{name}")
        if records:
            yield pa.RecordBatch.from_pylist([{"path": f"{path}/{name}", "bytes": n, "records": records}], schema=names)

    return written(x.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, "path string, bytes long, records long"), "warc-files")


# -- reading -----------------------------------------------------------------------------------------------------------
class _Window:
    """Bytes of a file from a start on, fetched as far as asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, b""

    def upto(self, end: int) -> bool:
        """Whether bytes up to end (or the file's end) could be fetched beyond those at hand."""
        have = self.start + len(self.data)
        end = min(end, self.size)
        if end > have:
            self.data += self.file.read_at(end - have, have)
        return end > have

    def drop(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start :], at


def records_of(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, decoded record) of the members that start in [start, end)."""
    w, at = _Window(file, start, size), start
    while at < end:
        w.upto(at + _STEP)
        k = w.data.find(MAGIC, at - w.start)
        if k < 0:
            at = max(at + 1, w.start + len(w.data) - len(MAGIC) + 1)
            if w.start + len(w.data) >= size:
                return
            w.drop(at)
            continue
        at = w.start + k
        if at >= end:
            return
        w.drop(at)
        w.upto(at + _STEP)
        z, parts, fed, good = zlib.decompressobj(31), [], 0, True
        try:
            head = b""
            while not z.eof:
                if fed == len(w.data) and not w.upto(at + fed + _STEP):
                    good = False
                    break
                piece = w.data[fed : fed + (4096 if not head else _STEP)]
                fed += len(piece)
                parts.append(z.decompress(piece))
                if not head and parts[-1]:
                    head = parts[-1]
                    if head[:5] != b"WARC/"[: len(head)]:
                        good = False
                        break
        except zlib.error:
            good = False
        if not good or not head.startswith(b"WARC/"):
            at += 1
            w.drop(at)
            continue
        yield at, b"".join(parts)
        at += fed - len(z.unused_data)
        w.drop(at)


OUT = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean, path string, offset long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("path", pa.string()), ("offset", pa.int64())])


def read(files: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """A row for each record of files (path, bytes)."""
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                fs, base = _fs(path)
                rows, held = [], 0
                with fs.open_input_file(base) as f:
                    for at, record in records_of(f, size, start, min(size, start + split)):
                        x = fields(record) | {"path": path, "offset": at}
                        if not payloads:
                            x["payload"] = None
                        rows.append(x)
                        held += len(record)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return ranges.repartition(n).mapInArrow(run, OUT)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, split: int = SPLIT) -> DataFrame:
    """pages through archives in the shared folder and back."""
    return read(write(pages, fresh_path(spark, "warc"), least), split, payloads=False)
