"""WARC archives: a writer of one gzip member per record and a sequential reader.

The reader never holds more than one record: it feeds an incremental zlib decompressor with chunks,
takes the header block up to the empty line, frames the content by ``Content-Length``, and verifies
the block and payload digests. Archives are files of bounded size in the shared folder; a task writes
under a temporary name and renames, so a repeated task leaves no half-written archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, shared_dir

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "null"


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP head and leaves the payload out."""
    name = NO_ID if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{b32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(stream, chunk: int = 1 << 18):
    """Decompressed gzip members of a stream, one after another, fed chunk by chunk."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            data = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def read_records(stream):
    """(headers, block) of every record, framed by Content-Length and verified."""
    for raw in members(stream):
        end = raw.index(b"\r\n\r\n")
        lines = raw[:end].split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(x.decode().split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError(f"{head['WARC-Record-ID']}: content length doesn't frame the block")
        if "sha1:" + b32_sha1(block) != head["WARC-Block-Digest"]:
            raise ValueError(f"{head['WARC-Record-ID']}: block digest differs")
        yield head, block


def parse(head: dict, block: bytes) -> dict:
    """A page of a record; the payload's digest is verified, a revisit's is as declared."""
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.decode().split(": ", 1) for x in block[:cut].split(b"\r\n")[1:] if x)
    payload, digest = block[cut:], head["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http["Content-Length"])
    if head["WARC-Type"] == "response" and (len(payload) != size or b32_sha1(payload) != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: payload digest differs")
    ident = lambda x: None if x is None or x == f"<urn:page:{NO_ID}>" else int(x[10:-1])
    return {
        "page_id": ident(head["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": head["WARC-Type"],
        "refers_to": ident(head.get("WARC-Refers-To")),
        "url": head.get("WARC-Target-URI"),
        "payload": payload if head["WARC-Type"] == "response" else None,
    }


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write every row to an archive in the shared folder; returns ``path``, ``records``, ``bytes``.

    Payloads are equal by length and SHA-256; the records' digests are SHA-1, as the format asks.
    Of rows with equal payloads of at least ``revisit_bytes`` bytes the smallest id is a response and
    others are revisits of it. Null html is an empty payload, a null url leaves the header out; rows
    that repeat the smallest id are responses too; a null id revisits the smallest id if there is one.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    own = [key.alias("_key"), F.sha2(body, 256).alias("d"), F.octet_length(body).alias("n")]
    light = materialize(pages.select(F.col(id_col).cast("long").alias("id"), *own).where(F.col("n") >= revisit_bytes))
    first = light.groupBy("d", "n").agg(F.min("id").alias("refers"), F.count("*").alias("c")).where("c > 1 AND refers IS NOT NULL")
    # Each row is judged on its own payload: rows of one id, or without one, may differ in it.
    again = light.join(first, ["d", "n"]).where("NOT id <=> refers").groupBy("_key", "d", "n").agg(F.min("refers").alias("refers"))
    again = materialize(again)
    rows = pages.select(*own, F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.join(broadcast_if_small(again), ["_key", "d", "n"], "left").select("id", "url", "html", "refers")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        out, path, records, size = None, "", 0, 0

        def close():
            out.close()
            files.move(path + ".part", path)
            return pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}])

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path + ".part", compression=None)
                data = warc_record(r["id"], r["url"], r["html"].encode(), r["refers"])
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    # Only archives that this table names count: what a lost task wrote under another name is ignored.
    return materialize(rows.mapInArrow(write, "path string, records bigint, bytes bigint").withColumn("folder", F.lit(folder)))


def read_warc(archives: DataFrame) -> DataFrame:
    """Pages of the archives that ``path`` and ``folder`` name, read sequentially, one task a file."""

    def read(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for r in b.to_pylist():
                files, _ = fs.FileSystem.from_uri(r["folder"])
                rows, size = [], 0
                with files.open_input_stream(r["path"], compression=None) as f:
                    for head, block in read_records(f):
                        rows.append(parse(head, block))
                        size += len(block)
                        if size > 8 << 20 or len(rows) > 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, archives.count())
    return archives.repartition(min(n, 10_000), "path").mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(encode(h)) AS x, octet_length(encode(h)) AS n FROM p),
m AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT d.page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN d.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN m ON d.h = m.h
"""
