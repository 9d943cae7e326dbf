"""Near copies by the Jaccard similarity of word shingles: SimHash and generalised pigeonhole, verified on the shingles.

Texts are sets of five-word shingles. Two sets of similarity s have a cosine of at least 2s / (1 + s), so at 0.8 two
SimHash fingerprints differ in at most some 15 % of their bits: ten bits of 64, and pairs of 64-bit fingerprints within
a threshold that loses none of these grow with the square of the table. So fingerprints are wide and meet in groups of
their bits (`simhash.wide_lists`); pairs at 0.8 meet in none with probability LOSS (computed). Equal word sequences are
one node. Inside a distinct list of candidates every pair that is not linked yet is compared on all its shingles, so
links are never made by fingerprints alone. Components come from star contraction.

Defined results: words are runs of non-space bytes, ASCII letters in lower case; a text of fewer words than a shingle
is one shingle of its own; texts without words, null among them, are copies of each other; rows with equal doc_id are
separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.anchors import PART
from quirelake.llm.common import U64, Scratch, column_bytes, mixed, slices, span_hashes, word_spans
from quirelake.llm.components import components
from quirelake.llm.simhash import CHECKS, majorities, wide_lists, wide_plan
from quirelake.llm.suffix_dedup import arrow, batch
from quirelake.llm.winnowing import LOWER, grams

WORDS = 5
LEAST = 0.8
SHARE = float(np.arccos(2 * LEAST / (1 + LEAST)) / np.pi)  # of bits that differ at LEAST
LOSS = 1e-6
PRINTS = "doc_id long, th long, node long, fp array<long>"


def shingled(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, offsets of rows among them, hash of each row's word sequence)."""
    low = LOWER[data]
    starts, ends = word_spans(low, offs)
    hashes, at = span_hashes(low, starts, ends), np.searchsorted(starts, offs)
    size = np.diff(at)
    place = np.arange(len(hashes), dtype=U64) - np.repeat(at[:-1], size).astype(U64)
    total = np.r_[U64(0), np.cumsum(mixed(hashes + mixed(place + U64(1))), dtype=U64)]
    whole = mixed(total[at[1:]] - total[at[:-1]] + size.astype(U64))
    row = np.repeat(np.arange(len(size)), size)
    every = grams(hashes, words)
    own = row[: len(every)]
    inside = np.arange(len(every)) + words <= at[own + 1]
    few = np.flatnonzero((size > 0) & (size < words))
    row, out = np.r_[own[inside], few], np.r_[mixed(every[inside]), whole[few]]
    order = np.argsort(row, kind="stable")
    return out[order], np.searchsorted(row[order], np.arange(len(size) + 1)), whole


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) with each row's hashes sorted and once."""
    out = hashes.copy()
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[i:j].sort()
    new = np.r_[True, out[1:] != out[:-1]][: len(out)]
    new[at[:-1][np.diff(at) > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][at]


def printed(words: int):
    """A function of batches (doc_id, th, text) that gives PRINTS, fp of so many words; empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column("text"))
            for i, j in slices(offs, PART):
                hashes, at, whole = shingled(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                hashes, at = distinct(hashes, at)
                some = np.flatnonzero(np.diff(at))
                fps = [[] for _ in range(j - i)]
                if len(some):
                    for r, v in zip(some.tolist(), majorities(hashes, np.r_[at[some], len(hashes)], words).view(np.int64), strict=True):
                        fps[r] = v
                own = b.slice(i, j - i)
                yield batch(arrow(PRINTS), doc_id=own.column("doc_id"), th=own.column("th"), node=whole.view(np.int64), fp=fps)

    return run


def alike(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted arrays of distinct shingles have this similarity."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def most_bits(words: int) -> int:
    """Bits of so many words in which two texts of similarity LEAST may differ: 3/16, as sets of four and five shingles
    do (larger ones less), and four times the spread of that."""
    return int(64 * words * 3 / 16 + 4 * (64 * words * 39 / 256) ** 0.5)


def bucket_links(sets: list[np.ndarray], fps: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of a list whose fingerprints (fps[word, member]) are near and that are alike."""
    label, most, out = np.arange(len(sets)), most_bits(len(fps)), []
    for i in range(1, len(sets)):
        near = sum(np.bitwise_count(x[:i] ^ x[i]).astype(np.int32) for x in fps) <= most
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i] and alike(sets[j], sets[i], least):
                label[label == label[j]] = label[i]
                out.append((j, i))
    return out


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node, fp, text) in order of buckets -> links (a, b)."""

    def links() -> pa.RecordBatch:
        pairs = bucket_links(sets, np.ascontiguousarray(np.array(fps).view(U64).T))
        return batch(arrow("a long, b long"), a=[nodes[i] for i, _ in pairs], b=[nodes[j] for _, j in pairs])

    last, nodes, fps, sets = None, [], [], []
    for b in batches:
        data, offs = column_bytes(b.column("text"))
        buckets, ids = b.column("bucket").to_pylist(), b.column("node").to_pylist()
        prints = b.column("fp").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        for i, j in slices(offs, PART):
            hashes, at, _ = shingled(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            hashes, at = distinct(hashes, at)
            for r in range(i, j):
                if buckets[r] != last:
                    if len(nodes) > 1:
                        yield links()
                    last, nodes, fps, sets = buckets[r], [], [], []
                nodes.append(ids[r])
                fps.append(prints[r])
                sets.append(hashes[at[r - i] : at[r - i + 1]])
    if len(nodes) > 1:
        yield links()


def stars(lists: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """lists (nodes) with the pairs among them as stars: a node with all later ones whose whole fingerprints are near, so
    that a text is sent to few places."""
    bits = F.expr("aggregate(zip_with(fp, other, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    pairs = lists.where("size(nodes) = 2").select(F.col("nodes")[0].alias("node"), F.col("nodes")[1].alias("b"))
    near = pairs.join(nodes, "node").join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("other")), "b").where(bits <= most)
    out = near.groupBy("node").agg(F.concat(F.array("node"), F.sort_array(F.collect_list("b"))).alias("nodes"))
    return lists.where("size(nodes) > 2").unionByName(out.select("nodes"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, th (a key of the row) and root (one of its component) of each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "shingles")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("th"), F.col("text").cast("binary").alias("text"))
    words, m, need = wide_plan(rows.count(), SHARE, LOSS)
    prints = scratch.save(rows.mapInArrow(printed(words + CHECKS), PRINTS), "prints")
    nodes = scratch.save(prints.where("size(fp) > 0").groupBy("node").agg(F.min_by("fp", "th").alias("fp")), "nodes")
    lists = wide_lists(nodes, scratch, words, m, need, most_bits(CHECKS))
    buckets = stars(lists, nodes, most_bits(words + CHECKS)).select(F.xxhash64("nodes").alias("bucket"), "nodes")
    members = scratch.save(buckets.select("bucket", F.explode("nodes").alias("node")), "members")
    wanted = members.select("node").distinct().join(prints.groupBy("node").agg(F.min("th").alias("th")), "node")
    texts = rows.select("th", "text").join(wanted, "th").dropDuplicates(["node"]).select("node", "text").join(nodes, "node")
    dealt = members.join(texts, "node").repartition("bucket").sortWithinPartitions("bucket")
    roots = components(dealt.select("bucket", "node", "fp", "text").mapInArrow(verified, "a long, b long"), scratch).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return prints.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
