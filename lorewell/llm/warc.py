"""WARC archives with revisit resolution (operator 2).

Headers (key, payload digest, size) are grouped by digest. Of equal payloads of `least` bytes or more, the record
with the greatest key is the response and the others become revisit records, which hold a fresh header and no
payload. Only headers are shuffled by digest; payloads are dealt by key, so one payload that many rows share spreads over all
tasks. Reading gives each record's header and, for responses, the payload; revisits find their response
again by digest.

Null payloads are empty; a null key is written without a key header and sorts below all others; a null URL leaves its header
out. Rows that share key and payload have the same role: of repeated rows of the greatest key all are responses. An empty table
writes no file. A payload of any length is one record, held whole by one task at a time; columns beside the three named ones are
left out, whatever their names. Files hold one gzip
member a record and are renamed into place when whole, so lost or repeated tasks leave no partial archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, one_each, shared_path, spread_join, table, written
from .token_output import _commit, _open

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NONE = -(1 << 63)
_FILES = "path string, records long, bytes long"
_RECORDS = "key long, url string, record_type string, record_id string, refers_to_id string, date string, digest string, payload_bytes long, payload binary"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def _line(name: str, value: str) -> bytes:
    value = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)
    return f"{name}: {value}\r\n".encode()


def record(key: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool, original_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the response's place and digest in place of the payload."""
    block = _HTTP if revisit else _HTTP + payload
    shown = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = [b"WARC/1.1\r\n", _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", record_id(key, digest)), _line("WARC-Date", date)]
    if url is not None:
        head.append(_line("WARC-Target-URI", url))
    if key is not None:
        head.append(_line("WARC-Source-Key", str(key)))
    head.append(_line("WARC-Payload-Digest", shown))
    if revisit:
        head += [_line("WARC-Profile", _PROFILE), _line("WARC-Refers-To", record_id(original, digest)), _line("WARC-Refers-To-Date", date)]
        if original_url is not None:
            head.append(_line("WARC-Refers-To-Target-URI", original_url))
    head += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", str(len(block))), b"\r\n"]
    return b"".join([*head, block, b"\r\n\r\n"])


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches, root: str, date: str, most: int):
    ctx = TaskContext.get()
    part, attempt, done, k, out = ctx.partitionId(), ctx.taskAttemptId(), [], 0, None

    def close():
        nonlocal out
        f, tmp, path, s, n, size = out
        s.close()
        _commit(f, tmp, path)
        done.append((f"{root}/{path.rsplit('/', 1)[1]}", n, size))
        out = None

    for b in batches:
        for key, url, html, digest, original, revisit, ourl in zip(*(c.to_pylist() for c in b.columns)):
            if out is None:
                f, path = _open(f"{root}/part-{part:06d}-{k:05d}.warc.gz")
                k += 1
                f.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = [f, f"{path}.{attempt}.tmp", path, f.open_output_stream(f"{path}.{attempt}.tmp", compression=None), 0, 0]
            data = _gzip(record(key, url, (html or "").encode(), digest, original, revisit, ourl, date))
            out[3].write(data)
            out[4] += 1
            out[5] += len(data)
            if out[5] >= most:
                close()
    if out:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "bytes"])


def write_archives(pages: DataFrame, root: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, file_bytes: int = 1 << 27, date: str | None = None) -> DataFrame:
    """Writes deduplicated archives under `root`; gives their (path, records, bytes)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    key, url, html = F.col(f"`{key_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    digest = F.sha1(F.encode(html, "UTF-8"))
    heads = pages.select(F.coalesce(key, F.lit(_NONE)).alias("k"), url.alias("u"), digest.alias("digest"), F.octet_length(html).alias("size"))
    large = heads.filter(F.col("size") >= least)
    firsts = large.groupBy("digest").agg(F.max("k").alias("original"), F.min("k").alias("lo"), F.max_by("u", "k").alias("ourl"), F.count(F.lit(1)).alias("n")).filter("lo < original").drop("lo")
    roles = spread_join(large.select("k", "digest"), firsts, ["digest"], pages.count()).filter("k < original").distinct()
    rows = pages.select(F.coalesce(key, F.lit(_NONE)).alias("k"), key.alias("key"), url.alias("url"), html.alias("html"), digest.alias("digest"))
    full = rows.join(roles, ["k", "digest"], "left").select("key", "url", F.when(F.col("original").isNull(), F.col("html")).alias("html"), "digest", "original", F.col("original").isNotNull().alias("revisit"), "ourl")
    return full.mapInArrow(lambda it: _write(it, root, date, file_bytes), _FILES)


def members(stream, chunk: int = 1 << 20):
    """The content of each gzip member of a stream."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if parts:
                    raise OSError("archive ends inside a record")
                return
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
        elif not any(parts):
            parts = [b""]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out = {}
    for x in lines[1:]:
        name, _, value = x.partition(":")
        out[name.strip().lower()] = value.strip()
    return out, rest[: int(out["content-length"])]


def _read(batches, payloads: bool):
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for b in batches:
        for path in b.column(0).to_pylist():
            f, p = _open(path)
            rows, size = [], 0
            with f.open_input_stream(p, compression=None) as s:
                for data in members(s):
                    h, block = parse(data)
                    kind = h["warc-type"]
                    declared = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and hashlib.sha1(payload).hexdigest() != declared:
                        raise OSError(f"{path}: payload and digest of {h['warc-record-id']} differ")
                    key = h.get("warc-source-key")
                    rows.append((None if key is None else int(key), h.get("warc-target-uri"), kind, h["warc-record-id"], h.get("warc-refers-to"), h["warc-date"], declared, None if payload is None else len(payload), payload if payloads else None))
                    size += len(data) if payloads else 256
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a record of the archives in `files.path`: header fields and, for responses, the payload (checked against its digest)."""
    return one_each(files.select("path"), "path").mapInArrow(lambda it: _read(it, payloads), _RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with `refers_to`, the key of a revisit's response, and `payload_bytes` also for revisits.

    Responses are reduced to one for each digest before the join, so that only header rows of revisits meet there.
    """
    at = records.filter("record_type = 'response'").groupBy("digest", F.col("record_id").alias("refers_to_id")).agg(F.max("key").alias("found"), F.max("payload_bytes").alias("size"))
    back = records.filter("record_type = 'revisit'").drop("payload_bytes").join(at, ["digest", "refers_to_id"], "left")
    back = back.withColumn("payload_bytes", F.col("size")).withColumn("refers_to", F.col("found")).drop("size", "found")
    return records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(back)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, at = written(write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "archives")), "archive-files")
    heads, _ = written(read_archives(files, payloads=False), "archive-headers")
    drop(spark, at)
    return resolve_revisits(heads).select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}
SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN original > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original > page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND payload_bytes >= 1000
"""
}
