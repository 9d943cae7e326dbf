"""Exact removal of long byte strings that occur more than once in a corpus, by suffix sorting of shards.

1. Each window of `length` bytes has a key (anchors.py), and each text is a short list of segments of windows
   with one key. Equal windows share their key, so a key is a shard of its own.
2. Counts per key are summed with map-side combination; keys seen once need no more work.
3. A key whose segments are all byte-identical is one suffix-array interval: all its windows repeat. The texts
   of the other keys' segments, each distinct one once and with its count, go to their shard, are suffix-sorted
   by induction (suffixes.py, spilling to disk), and windows whose common prefix with a neighbour reaches
   `length` are repeats.
4. Marks return to their documents by joins. No step gathers a key's members: sums are combined map-side and
   members learn the outcome by joins, whose skewed partitions Spark splits.

Defined results: a null text is empty (0 bytes); texts shorter than `length` lose nothing; equal windows in one
text count, overlapping ones too; rows with equal doc_id are separate texts; a null doc_id is kept as it is;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import anchors
from quirelake.llm.common import Scratch, column_bytes, covered, numbered, read, slices
from quirelake.llm.suffixes import repeated_starts

K = 32
SHARD_BYTES = 2 << 20

TOP = np.int64((1 << 63) - 1)  # stands for a second content: the segment may repeat itself
STATS = "key long, low long, high long, n long"
PARTS = "kind string, doc_id long, doc long, th long, key long, body long, first int, n int, blob binary, spans array<long>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the row in two numbers, and the text as bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), numbered(F.col("doc_id")).alias("doc"), F.xxhash64("doc_id", "text").alias("th"), F.col("text").cast("binary").alias("text"))


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def kept_row(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """(length, removed bytes, removed runs, digest of what is left)."""
    sha, at = hashlib.sha256(), 0
    for s, e in spans:
        sha.update(text[at:s])
        at = e
    sha.update(text[at:])
    return len(text), sum(e - s for s, e in spans), len(spans), sha.hexdigest()


def repeated_bytes(docs: DataFrame, length: int = 200, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): what is left after removing all repeated `length`-byte strings."""
    if length < k:
        raise ValueError(f"length must be at least {k}")
    spark, rows = docs.sparkSession, keyed(docs)
    scratch = Scratch(spark, "suffixes")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column(0))
            for i, j in slices(offs, anchors.PART):
                _, key, body, _, _, loop = anchors.byte_segments(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, k, loops=True)
                if len(key):
                    order = np.argsort(key)
                    key, body, loop = key[order], body[order], loop[order]
                    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    yield batch(arrow(STATS), key=key[cut], low=np.minimum.reduceat(body, cut), high=np.maximum.reduceat(np.where(loop, TOP, body), cut), n=np.add.reduceat(1 + loop, cut))

    keys = rows.select("text").mapInArrow(stats, STATS).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed"))
    keys = scratch.save(keys, "keys")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column(2))
            doc, th = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j in slices(offs, anchors.PART):
                row, key, _, _, _ = anchors.segments(anchors.BYTES[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], length, k)
                if len(key):
                    pair = np.unique(np.stack([row, key]), axis=1)
                    yield batch(arrow("key long, doc long, th long"), key=pair[1], doc=doc[i + pair[0]], th=th[i + pair[0]])

    marks = rows.select("doc", "th", "text").mapInArrow(members, "key long, doc long, th long").join(keys, "key")
    marks = marks.groupBy("doc", "th").agg(F.collect_set(F.when(~F.col("mixed"), F.col("key"))).alias("whole"), F.collect_set(F.when(F.col("mixed"), F.col("key"))).alias("part"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(PARTS)
        for b in batches:
            data, offs = column_bytes(b.column("text"))
            for i, j in slices(offs, anchors.PART):
                own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                cols = {c: b.column(c).slice(i, j - i) for c in ("doc_id", "doc", "th", "whole", "part")}
                row, key, first, count, _ = anchors.segments(anchors.BYTES[own], at, length, k)
                hit = anchors.flagged(row, key, cols["whole"])
                spans = anchors.unions(row[hit], (first - at[row])[hit], (first - at[row] + count)[hit] + length - 1, j - i)
                split = np.flatnonzero(anchors.flagged(row, key, cols["part"]))
                raw, with_part = own.tobytes(), np.zeros(j - i, bool)
                with_part[row[split]] = True
                if len(split):
                    texts = [raw[a:e] for a, e in zip(first[split].tolist(), (first + count)[split] + length - 1, strict=True)]
                    doc, th = (cols[c].to_numpy(zero_copy_only=False) for c in ("doc", "th"))
                    yield batch(schema, kind=["part"] * len(split), doc=doc[row[split]], th=th[row[split]], key=key[split], body=np.array([anchors.body_hash(x) for x in texts], np.uint64).view(np.int64), first=(first - at[row])[split], n=count[split], blob=texts)
                    kept = np.flatnonzero(with_part)
                    yield batch(schema, kind=["text"] * len(kept), doc_id=cols["doc_id"].take(pa.array(kept)), doc=doc[kept], th=th[kept], blob=[raw[at[r] : at[r + 1]] for r in kept], spans=[[x for y in spans[r] for x in y] for r in kept])
                done = np.flatnonzero(~with_part)
                if len(done):
                    n, removed, runs, sha = zip(*(kept_row(raw[at[r] : at[r + 1]], spans[r]) for r in done.tolist()), strict=True)
                    yield batch(schema, kind=["done"] * len(done), doc_id=cols["doc_id"].take(pa.array(done)), n_bytes=list(n), n_removed=list(removed), n_spans=list(runs), kept_sha256=list(sha))

    found = scratch.save(rows.join(marks, ["doc", "th"], "left").mapInArrow(marked, PARTS), "found", by="kind")
    scratch.drop("keys")
    part = found.where("kind = 'part'")
    distinct = part.groupBy("key", "body").agg(F.count("*").alias("n"), F.first("blob").alias("blob"))

    def sort_shard(keys: list[int], bodies: list[int], times: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        size = sum(map(len, blobs)) + len(blobs)
        text, valid, at, starts = np.full(size, 1, np.int16), np.zeros(size, bool), 0, []
        for x in blobs:
            text[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int16) + 2
            valid[at : at + len(x) - length + 1] = True
            starts.append(at)
            at += len(x) + 1
        repeat = repeated_starts(text, length, valid)
        spans = []
        for s, x, n in zip(starts, blobs, times, strict=True):
            own = np.flatnonzero(repeat[s : s + len(x)]) if n == 1 else np.arange(len(x) - length + 1)
            spans.append([v for y in covered(own, own + length) for v in y])
        keep = [i for i, x in enumerate(spans) if x]
        return batch(arrow("key long, body long, spans array<long>"), key=[keys[i] for i in keep], body=[bodies[i] for i in keep], spans=[spans[i] for i in keep])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sort whole keys together, up to so many bytes; rows come ordered by key."""
        held: list[tuple] = []
        size = 0
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("key", "body", "n", "blob")), strict=True):
                if held and held[-1][0] != x[0]:
                    if size >= shard_bytes:
                        yield sort_shard(*map(list, zip(*held, strict=True)))
                        held, size = [], 0
                held.append(x)
                size += len(x[3])
        if held:
            yield sort_shard(*map(list, zip(*held, strict=True)))

    sorted_ = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(shards, "key long, body long, spans array<long>")
    lists = part.select("doc", "th", "key", "body", "first").join(sorted_, ["key", "body"])
    lists = lists.select("doc", "th", F.transform("spans", lambda x: x + F.col("first")).alias("spans")).groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("more"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, more in zip(*(b.column(c).to_pylist() for c in ("blob", "spans", "more")), strict=True):
                x = np.array([*(spans or []), *(more or [])], np.int64).reshape(-1, 2)
                out.append(kept_row(text or b"", covered(x[:, 0], x[:, 1])))
            n, removed, runs, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield batch(arrow(RESULT), doc_id=b.column("doc_id"), n_bytes=list(n), n_removed=list(removed), n_spans=list(runs), kept_sha256=list(sha))

    rest = found.where("kind = 'text'").select("doc_id", "doc", "th", "blob", "spans").join(lists, ["doc", "th"], "left").mapInArrow(finished, RESULT)
    done = found.where("kind = 'done'").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(scratch.save(rest, "rest"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
