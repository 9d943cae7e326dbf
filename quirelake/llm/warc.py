"""WARC archives of any size of record, written and read as tables of chunks.

A payload larger than `chunk_bytes` becomes rows (record, chunk number, bytes) inside Spark; a writer task streams
them into one gzip member per record, keeping an incremental digest, so that no task holds a record as a whole.
Reading gives the same chunk table back. Each task writes one file under a name of its own attempt, and only the
files in the committed manifest count, so lost executors and repeated attempts do no harm.

Defined results: a null payload is empty; payloads of at least `least` bytes that occur more than once are stored
once, with the largest page_id, and the other rows are revisits of it (rows that share this page_id are all
responses; a null page_id is smaller than any other); a null url leaves the target out; an empty table gives no
archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import Scratch, file_system, one_each, read
from quirelake.llm.suffix_dedup import arrow, batch

CHUNK = 1 << 20
LEAST = 1000
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "uri string, records long, bytes long"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, chunk_no long, payload_bytes long, last boolean, chunk binary"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, its size and digest, record_type, refers_to. Payloads meet by digest and size only; the
    largest page_id of each is a sum with map-side combination."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    best = rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("response"), F.count("*").alias("times")).where("times > 1")
    out = rows.join(best, ["sha", "n"], "left")
    again = F.col("times").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return out.select("page_id", "url", "payload", "n", "sha", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"))


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per chunk of each record, in order; a revisit and an empty payload have one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("n")).otherwise(0)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((stored - 1) / chunk_bytes))))
    cut = F.substr("payload", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return rows.withColumn("chunk_no", at).select("page_id", "url", "n", "sha", "record_type", "refers_to", "chunk_no", F.when(F.col("record_type") == "response", cut).otherwise(F.lit(b"")).alias("chunk"))


def head(page_id, url, n: int, sha: str, kind: str, refers_to) -> bytes:
    """WARC header and HTTP header of a record whose payload has n bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha)).decode())
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (n if kind == 'response' else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


def write(chunks: DataFrame, scratch: Scratch, level: int = 1) -> DataFrame:
    """Write archives of chunk rows that stand in order inside their partitions; returns the manifest."""
    base = scratch.at

    def writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(base)
        path, out, records_, packer, sha, left = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, None, None, 0
        want = ""
        for b in batches:
            for page_id, url, n, digest, kind, refers, no, chunk in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(path, compression=None)
                if no == 0:
                    if left:
                        raise ValueError("a record lacks chunks")
                    packer, sha, left, want = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), n if kind == "response" else 0, digest
                    out.write(packer.compress(head(page_id, url, n, digest, kind, refers)))
                    records_ += 1
                sha.update(chunk)
                left -= len(chunk)
                out.write(packer.compress(chunk))
                if left == 0:
                    if kind == "response" and sha.hexdigest() != want:
                        raise ValueError("a record's chunks don't match its digest")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield batch(arrow(MANIFEST), uri=[f"{base}/{path.rpartition('/')[2]}"], records=[records_], bytes=[size])

    return scratch.save(chunks.mapInArrow(writer, MANIFEST), "manifest")


def parse(stream: BinaryIO, chunk_bytes: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """(headers, chunk number, bytes, last) of each record's payload, without holding a record. HTTP headers join
    the record's under names with the prefix http-."""

    def plain() -> Iterator[bytes]:
        unpack, more = zlib.decompressobj(31), b""
        while raw := more or stream.read(chunk_bytes):
            yield unpack.decompress(raw, chunk_bytes)
            more = unpack.unconsumed_tail
            if unpack.eof:
                more, unpack = unpack.unused_data, zlib.decompressobj(31)
        yield unpack.flush()

    blocks, held = plain(), b""

    def until(mark: bytes) -> bytes | None:
        nonlocal held
        while mark not in held:
            block = next(blocks, None)
            if block is None:
                return None
            held += block
        out, _, held = held.partition(mark)
        return out

    def fields(text: bytes, prefix: str = "") -> dict[str, str]:
        pairs = (x.partition(": ") for x in text.decode("utf-8", "replace").split("\r\n")[1:])
        return {prefix + k.lower(): v for k, _, v in pairs}

    while (top := until(b"\r\n\r\n")) is not None:
        headers = fields(top)
        http = until(b"\r\n\r\n")
        headers |= fields(http, "http-")
        left, no = int(headers["content-length"]) - len(http) - 4, 0
        while True:
            take = min(left, chunk_bytes)
            parts = [held[:take]]
            held, need = held[take:], take - min(take, len(held))
            while need:
                block = next(blocks)
                parts.append(block[:need])
                held, need = block[need:], need - min(need, len(block))
            left -= take
            yield headers, no, b"".join(parts), left == 0
            no += 1
            if not left:
                break
        while len(held) < 4:
            held += next(blocks)
        held = held[4:]


def chunk_table(manifest: DataFrame, payload: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """The archives' records as rows of chunks. payload_bytes and payload_digest are those of the chunks so far, at
    the last one those of the full payload (of a revisit: as its header states them)."""

    def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(CHUNKS)
        number = lambda urn: None if urn in (None, "<urn:page:None>") else int(urn[10:-1])
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = file_system(uri)
                rows: list[tuple] = []
                size, n, sha = 0, 0, None
                with fs.open_input_stream(path, compression=None) as f:
                    for h, no, chunk, last in parse(f, chunk_bytes):
                        if no == 0:
                            n, sha = 0, hashlib.sha1()
                        n += len(chunk)
                        sha.update(chunk)
                        seen, digest = n, sha.hexdigest()
                        if last and h["warc-type"] == "revisit":
                            seen, digest = int(h["http-content-length"]), base64.b32decode(h["warc-payload-digest"][5:]).hex()
                        if payload or last:
                            rows.append((h["warc-record-id"], number(h["warc-record-id"]), h["warc-type"], number(h.get("warc-refers-to")), digest, no, seen, last, chunk if payload else None))
                            size += len(chunk) * payload + 100
                        if size > 8 << 20:
                            yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))
                            rows, size = [], 0
                if rows:
                    yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return one_each(manifest.select("uri"), "uri").mapInArrow(reader, CHUNKS)


def round_trip(pages: DataFrame, least: int = LEAST, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write a record per page, then read the archives back: one row per page."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write(chunked(records(pages, least), chunk_bytes), scratch)
    return chunk_table(manifest, payload=False, chunk_bytes=chunk_bytes).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


QUERIES = {"op3_warc_chunks": op3_warc_chunks}
ORACLE_SQL = {
    "op3_warc_chunks": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest from p),
r as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top, payload_bytes >= 1000 as large from q)
select page_id, payload_bytes, payload_digest,
  case when large and page_id <> top then 'revisit' else 'response' end as record_type,
  case when large and page_id <> top then top end as refers_to
from r"""
}
