"""Removal of later copies of long word sequences, by compaction of a sparse de Bruijn graph of word k-mers.

1. Nodes are anchor k-mers: each window of `width` words takes the least-hashed k-mer inside it (anchors.py). The
   edges through a node are the segments of words around it; neighbouring windows with one node are already one
   edge, so a text is a short path of edges.
2. Compaction by joins: a node through which only one distinct segment passes does not branch, so that segment is
   a repeated path as a whole. The node's smallest document is found by a sum with map-side combination, and the
   other documents' copies fall without a look at their words.
3. At branching nodes the distinct segments are followed window by window: each window's words are compared in
   full and its first source coordinate (document, word) decides.

Defined results: a null text has no words; texts shorter than `width` words lose nothing; a window that starts
earlier in the same text counts; rows with equal doc_id rank by a hash of their row, and equal rows have equal rank,
so neither is earlier than the other, while each may repeat itself; a null doc_id comes before all others; an empty table gives an empty result; other
columns are ignored.
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
from quirelake.llm.suffix_dedup import arrow, batch

K = 4
TOP = np.int64((1 << 63) - 1)  # stands for a second content: the segment may repeat itself
STATS = "key long, low long, high long, doc long, th long, n long"
PARTS = "kind string, doc_id long, doc long, th long, key long, body long, first long, n int, blob binary, spans array<long>, n_words long, n_removed long, kept_sha256 string"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_row(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    left, at = [], 0
    for s, e in spans:
        left += words[at:s]
        at = e
    left += words[at:]
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def repeated_words(docs: DataFrame, width: int = 20, k: int = K) -> DataFrame:
    """One row per row of docs (doc_id, text): what is left after removing windows of words that started earlier."""
    if width < k:
        raise ValueError(f"width must be at least {k}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), numbered(F.col("doc_id")).alias("doc"), F.xxhash64("doc_id", "text").alias("th"), F.col("text").cast("binary").alias("text"))
    scratch = Scratch(spark, "paths")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column(2))
            ids, ths = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j in slices(offs, anchors.PART):
                _, _, at, hashes = anchors.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row, key, body, _, _, loop = anchors.word_segments(hashes, at, width, k, loops=True)
                if len(key):
                    order = np.lexsort((ths[i + row], ids[i + row], key))  # the first of a key has its least rank
                    key, body, loop, row = key[order], body[order], loop[order], i + row[order]
                    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    yield batch(arrow(STATS), key=key[cut], low=np.minimum.reduceat(body, cut), high=np.maximum.reduceat(np.where(loop, TOP, body), cut), doc=ids[row[cut]], th=ths[row[cut]], n=np.add.reduceat(1 + loop, cut))

    nodes = rows.select("doc", "th", "text").mapInArrow(stats, STATS).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("doc", "th")).alias("start"), F.sum("n").alias("n")).where("n > 1")
    nodes = scratch.save(nodes.select("key", "start", (F.col("low") != F.col("high")).alias("branches")), "nodes")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column(2))
            ids, ths = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j in slices(offs, anchors.PART):
                _, _, at, hashes = anchors.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row, key, _, _, _ = anchors.segments(hashes, at, width, k)
                if len(key):
                    pair = np.unique(np.stack([row, key]), axis=1)
                    yield batch(arrow("key long, doc long, th long"), key=pair[1], doc=ids[i + pair[0]], th=ths[i + pair[0]])

    marks = rows.select("doc", "th", "text").mapInArrow(members, "key long, doc long, th long").join(nodes, "key")
    rank = F.struct("doc", "th")
    marks = marks.groupBy("doc", "th").agg(*(F.collect_set(F.when(on, F.col("key"))).alias(name) for name, on in (("later", ~F.col("branches") & (rank > F.col("start"))), ("again", ~F.col("branches") & (rank == F.col("start"))), ("part", F.col("branches")))))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(PARTS)
        for b in batches:
            ids, nums, ths, later, again, part = (b.column(c) for c in ("doc_id", "doc", "th", "later", "again", "part"))
            data, offs = column_bytes(b.column("text"))
            for r in range(b.num_rows):
                own = data[offs[r] : offs[r + 1]]
                raw = own.tobytes()
                words, spans, split = raw.split(), [], False
                if part[r].is_valid:
                    _, _, at, hashes = anchors.words(own, np.array([0, len(own)]))
                    _, key, body, first, count, _ = anchors.word_segments(hashes, at, width, k)
                    hit = np.isin(key, later[r].values.to_numpy(zero_copy_only=False))
                    twice = np.isin(key, again[r].values.to_numpy(zero_copy_only=False))
                    if twice.any():  # the first of equal segments stays
                        seen = np.ones(len(key), bool)
                        seen[np.unique(key, return_index=True)[1]] = False
                        hit |= twice & seen
                    spans = covered(first[hit], first[hit] + count[hit] + width - 1)
                    split = len(part[r].values) > 0
                if split:
                    hit = np.flatnonzero(np.isin(key, part[r].values.to_numpy(zero_copy_only=False)))
                    m = len(hit)
                    yield batch(schema, kind=["text"], doc_id=ids.slice(r, 1), doc=nums.slice(r, 1), th=ths.slice(r, 1), blob=[raw], spans=[[x for y in spans for x in y]])
                    yield batch(schema, kind=["part"] * m, doc=[nums[r].as_py()] * m, th=[ths[r].as_py()] * m, key=key[hit], body=body[hit], first=first[hit], n=count[hit], blob=[b" ".join(words[a : a + c + width - 1]) for a, c in zip(first[hit].tolist(), count[hit].tolist(), strict=True)])
                else:
                    n, removed, sha = kept_row(words, spans)
                    yield batch(schema, kind=["done"], doc_id=ids.slice(r, 1), n_words=[n], n_removed=[removed], kept_sha256=[sha])

    found = scratch.save(rows.join(marks, ["doc", "th"], "left").mapInArrow(marked, PARTS), "found", by="kind")
    scratch.drop("nodes")
    part = found.where("kind = 'part'")
    distinct = part.groupBy("key", "body").agg(F.min(F.struct("doc", "th", "first")).alias("at"), F.first("blob").alias("blob")).select("key", "body", "at.doc", "at.th", "at.first", "blob")
    FOLLOWED = "key long, body long, doc long, th long, first long, spans array<long>"

    def follow(group: list[tuple]) -> list[tuple]:
        """Windows of the segments of one node that start earlier elsewhere, as places in their segment."""
        seen: dict[bytes, tuple[int, int, int]] = {}
        cuts = []
        for _, _, doc, th, first, blob in group:
            words = blob.split(b" ")
            own = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
            cuts.append(own)
            for i, w in enumerate(own):
                at = (doc, th, first + i)
                if seen.setdefault(w, at) > at:
                    seen[w] = at
        out = []
        for (key, body, doc, th, first, _), own in zip(group, cuts, strict=True):
            late = np.array([i for i, w in enumerate(own) if seen[w] < (doc, th, first + i)], np.int64)
            out.append((key, body, doc, th, first, [v for y in covered(late, late + width) for v in y]))
        return out

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "body", "doc", "th", "first", "spans")

        def flush(rows_: list[tuple]) -> pa.RecordBatch:
            return batch(arrow(FOLLOWED), **dict(zip(names, map(list, zip(*rows_, strict=True)), strict=True)))

        group: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("key", "body", "doc", "th", "first", "blob")), strict=True):
                if group and group[-1][0] != x[0]:
                    out += follow(group)
                    group = []
                    if len(out) > 20000:
                        yield flush(out)
                        out = []
                group.append(x)
        out += follow(group) if group else []
        if out:
            yield flush(out)

    paths = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(followed, FOLLOWED)
    paths = paths.withColumnsRenamed({"doc": "doc0", "th": "th0", "first": "first0"})
    lead = (F.col("doc") == F.col("doc0")) & (F.col("th") == F.col("th0")) & (F.col("first") == F.col("first0"))
    whole = F.array(F.lit(0).cast("long"), (F.col("n") + width - 1).cast("long"))
    lists = part.select("doc", "th", "key", "body", "first", "n").join(paths, ["key", "body"]).select("doc", "th", F.transform(F.when(lead, F.col("spans")).otherwise(whole), lambda x: x + F.col("first")).alias("spans"))
    lists = lists.groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("more"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, more in zip(*(b.column(c).to_pylist() for c in ("blob", "spans", "more")), strict=True):
                x = np.array([*(spans or []), *(more or [])], np.int64).reshape(-1, 2)
                out.append(kept_row((text or b"").split(), covered(x[:, 0], x[:, 1])))
            n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
            yield batch(arrow(RESULT), doc_id=b.column("doc_id"), n_words=list(n), n_removed=list(removed), kept_sha256=list(sha))

    rest = found.where("kind = 'text'").select("doc_id", "doc", "th", "blob", "spans").join(lists, ["doc", "th"], "left").mapInArrow(finished, RESULT)
    done = found.where("kind = 'done'").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(scratch.save(rest, "rest"))


def op2_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(read(spark, sf_dir, "documents"))


QUERIES = {"op2_debruijn_dedup": op2_debruijn_dedup}
ORACLE_SQL: dict[str, str] = {}
