"""Raw mail: .eml and mbox files, and JSON lines, as canonical rows."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import urls as ux
from quern.operators.corpus import body_features, canonical

#: What a walk over a collection leaves out.
SKIPPED = (".bz2", ".gz", ".zip", ".tar")
SCHEMA = "path string, number int, subject string, sender string, sent_date timestamp, body_plain string, body_html string, received_origin_ip string, spf_result string, dkim_result string, dmarc_result string, error string"


def _decoded(part) -> str:
    raw = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset() or "utf-8", "utf-8"):
        try:
            return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def verdicts(message) -> dict[str, str | None]:
    """First spf, dkim and dmarc result over the authentication headers, ARC ones by their hop; then Received-SPF."""
    hop = lambda h: int(m[1]) if (m := re.search(r"\bi=(\d+)", h)) else 99
    heads = [str(h) for h in message.get_all("Authentication-Results", [])] + sorted((str(h) for h in message.get_all("ARC-Authentication-Results", [])), key=hop)
    out: dict[str, str | None] = {}
    for kind in ("spf", "dkim", "dmarc"):
        found = next((m[1].lower() for h in heads if (m := re.search(rf"\b{kind}=([A-Za-z]+)", h))), None)
        if found is None and kind == "spf" and (own := message.get("Received-SPF")):
            found = (re.findall(r"[A-Za-z]+", str(own)) or [None])[0]
        out[f"{kind}_result"] = found.lower() if found else None
    return out


def sent_at(message, now: datetime | None = None) -> datetime | None:
    """The stamp after the last ';' of the last Received header, else Date; before 1971 or after this year: none."""
    year = (now or datetime.now(UTC)).year
    received = message.get_all("Received", [])
    for stamp in ([str(received[-1]).rpartition(";")[2]] if received else []) + [str(message.get("Date") or "")]:
        try:
            when = email.utils.parsedate_to_datetime(stamp.strip())
        except (ValueError, TypeError, IndexError):
            continue
        when = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
        return when if 1971 <= when.year <= year else None
    return None


def fields(raw: bytes) -> dict:
    """A message's fields; of several parts of a type the first counts."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    plain = html = None
    for part in m.walk():
        kind = part.get_content_type()
        if kind == "text/plain" and plain is None:
            plain = _decoded(part)
        elif kind == "text/html" and html is None:
            html = _decoded(part)
    received = m.get_all("Received", [])
    origin = re.search(r"\[((?:\d{1,3}\.){3}\d{1,3})\]", str(received[-1])) if received else None
    when = sent_at(m)
    return {"subject": str(m["Subject"]) if m["Subject"] is not None else None, "sender": str(m["From"]) if m["From"] is not None else None, "sent_date": when.replace(tzinfo=None) if when else None, "body_plain": plain, "body_html": html, "received_origin_ip": origin[1] if origin else None, "error": None} | verdicts(m)


def split_mbox(raw: bytes) -> list[bytes]:
    """Messages of an mbox: each begins with a line 'From '."""
    cut = [m.start() for m in re.finditer(rb"(?m)^From ", raw)]
    return [raw[a:b].partition(b"\n")[2] for a, b in zip(cut, [*cut[1:], len(raw)], strict=True)]


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """A row for each message below path: .eml-like files hold one, files that begin with 'From ' are mboxes.

    Empty and packed files are left out. Files are read by tasks, whole; a message that can't be parsed has an error.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0")
    files = files.filter(~F.lower(name).rlike("(" + "|".join(re.escape(s) for s in SKIPPED) + ")$") & (name != "cmds")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                raw = bytes(content)
                for k, one in enumerate(split_mbox(raw) if raw.startswith(b"From ") else [raw]):
                    try:
                        rows.append({"path": p, "number": k} | fields(one))
                    except Exception as e:  # a broken message must not end the scan
                        rows.append({"path": p, "number": k, "error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            out["sent_date"] = pd.to_datetime(out["sent_date"])
            yield out

    return files.mapInPandas(run, SCHEMA)


def html_text(html: Column) -> Column:
    """The text of markup: scripts, styles, comments and tags go, common entities are read, white space collapses."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for k, v in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mail_table(messages: DataFrame, source: str, label: int) -> DataFrame:
    """Canonical rows of read_mail(): bodies of six characters or more, features from the body by the common path."""
    body = F.coalesce("body_html", "body_plain")
    clean = F.when(F.col("body_html").isNotNull(), html_text(F.col("body_html"))).otherwise(F.trim(F.regexp_replace("body_plain", r"\s+", " ")))
    x = messages.withColumns({"body_raw": body, "clean_text": clean}).filter((F.length(F.trim("body_raw")) >= 6) & (F.length("clean_text") >= 6))
    x = body_features(x).withColumns({"source_dataset": F.lit(source), "label": F.lit(label), "word_count": tx.word_count(F.col("clean_text")), "processing_status": F.lit("ok")})
    x = x.withColumn("email_id", tx.content_id(F.col("source_dataset"), F.col("body_raw"), F.col("sender"), F.col("subject"), F.col("sent_date"), F.col("path")))
    return canonical(x)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON of several shapes -> file, valid, body, sender, subject, date; blank lines are left out."""
    x = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_name").alias("file"), "value")
    x = x.withColumn("valid", F.try_parse_json("value").isNotNull())
    first = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("value", p), F.lit("")) for p in paths])
    return x.select("file", "valid", first("$.Body", "$.body", "$.content.body", "$.text").alias("body"), first("$.Metadata.From", "$.sender").alias("sender"), first("$.Metadata.Subject", "$.subject").alias("subject"), first("$.Metadata.Date", "$.date").alias("date"))


def line_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~F.col("valid")).alias("invalid"), (F.count_if(~F.col("valid")) * 100 / F.count("*")).alias("invalid_pct"))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Quoted CSV with backslash escapes and line ends within fields; malformed rows go."""
    return spark.read.options(header=True, quote='"', escape="\\", multiLine=True, mode="DROPMALFORMED", encoding=encoding).csv(path)
