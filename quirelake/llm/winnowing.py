"""Benchmark decontamination by winnowing.

A text's k-gram hashes are winnowed: of each w neighbours the least is kept, so two texts that share k + w - 1 words
share a fingerprint. Documents and benchmark meet in an equi-join on fingerprints; Spark broadcasts the benchmark's
side only where its written size is under the session's threshold. Candidate documents get the texts of their items,
and every window is compared word by word (extension of hits), so results are exact.

Items shorter than a window are one window of their own; each length class present gets its own (k, w), so that its
shortest item is still guaranteed.

Defined results: null and empty texts have no words and are never contaminated; items without words never occur;
rows with equal doc_id are separate texts; rows with equal item_id count as one item, which occurs if any of them
does; rows with a null item_id are no items; an empty benchmark leaves all documents clean; an empty documents table gives
an empty result; other columns are kept away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.anchors import PART
from quirelake.llm.common import Scratch, column_bytes, mixed, numbered, read, rolled, slices, span_hashes, window_min, word_spans
from quirelake.llm.suffix_dedup import arrow, batch

WINDOW = 13
#: (fewest words, most words, k): items of so many words are fingerprinted by k-grams
CLASSES = ((1, 1, 1), (2, 3, 2), (4, 7, 4), (8, 12, 8), (13, None, 8))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, th long"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.zeros(256, bool)  # ASCII but for digits and letters
GAP[:128] = True
GAP[48:58] = GAP[97:123] = False


def split(data: np.ndarray, offs: np.ndarray):
    """(lower-cased bytes, word starts, ends, offsets of rows among the words)."""
    low = LOWER[data]
    starts, ends = word_spans(low, offs, GAP)
    return low, starts, ends, np.searchsorted(starts, offs)


def fingerprints(hashes: np.ndarray, at: np.ndarray, k: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of winnowed k-grams; all texts that share `shortest` words share one."""
    w = shortest - k + 1
    least = window_min(rolled(hashes, k), w)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    ok = at[row + 1] - np.arange(len(least)) >= shortest
    return row[ok], least[ok]


def printed(classes: list[tuple[int, int]], own: bool):
    """Arrow function (id, text) -> (fp, id), where id is a number or a struct of numbers. classes: (index into CLASSES, shortest item); own: for items, which are
    only in their own class, else for documents, which are in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b.column(1))
            ids = {"id": b.column(0)} if own else {f.name: x for f, x in zip(b.column(0).type, b.column(0).flatten(), strict=True)}
            schema = arrow("fp long, " + ", ".join(f"{n} long" for n in ids))
            ids = {n: x.to_numpy(zero_copy_only=False) for n, x in ids.items()}
            for i, j in slices(offs, PART):
                low, starts, ends, at = split(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                hashes, size = span_hashes(low, starts, ends), np.diff(at)
                for c, shortest in classes:
                    fewest, most, k = CLASSES[c]
                    row, fp = fingerprints(hashes, at, k, shortest)
                    if own:
                        keep = (size[row] >= fewest) & (size[row] <= (most or 1 << 60))
                        row, fp = row[keep], fp[keep]
                    if len(fp):
                        pair = np.unique(np.stack([row, mixed(fp + np.uint64(c)).view(np.int64)]), axis=1)
                        yield batch(schema, fp=pair[1], **{n: x[i + pair[0]] for n, x in ids.items()})

    return run


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = column_bytes(b.column(0))
        yield batch(arrow("n long"), n=np.diff(split(data, offs)[3]))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbours, for any n."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
    return out


def hits(text: bytes, items: list[tuple[list[int], bytes]]) -> tuple[np.ndarray, set[int]]:
    """(places of words hit, ids of items that occur); items come with their lists of ids."""

    def prepared(x: bytes):
        raw = np.frombuffer(x, np.uint8)
        low, starts, ends, _ = split(raw, np.array([0, len(raw)]))
        raw = low.tobytes()
        return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], span_hashes(low, starts, ends)

    words, hashes = prepared(text)
    hit, found, places = np.zeros(len(words), bool), set(), {}
    for ids, x in items:
        own, own_hashes = prepared(x)
        n = min(WINDOW, len(own))
        if not n or n > len(words):
            continue
        if n not in places:
            g = grams(hashes, n)
            order = np.argsort(g, kind="stable")
            places[n] = g[order], order
        g, order = places[n]
        want = grams(own_hashes, n)
        left, right = np.searchsorted(g, want, "left"), np.searchsorted(g, want, "right")
        for i in np.flatnonzero(right > left).tolist():
            for p in order[left[i] : right[i]].tolist():
                if words[p : p + n] == own[i : i + n]:
                    hit[p : p + n] = True
                    found.update(ids)
    return hit, found


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = column_bytes(b.column("text"))
        n_words = np.concatenate([np.diff(split(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[3]) for i, j in slices(offs, PART)]) if b.num_rows else np.zeros(0, int)
        n_hit, found = [0] * b.num_rows, [[] for _ in range(b.num_rows)]
        with_items = np.flatnonzero(b.column("items").is_valid().to_numpy(zero_copy_only=False))
        for r in with_items.tolist():
            hit, ids = hits(data[offs[r] : offs[r + 1]].tobytes(), [(x["item_ids"], x["text"]) for x in b.column("items")[r].as_py()])
            n_hit[r], found[r] = int(hit.sum()), sorted(ids)
        sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in found]
        bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words.tolist(), strict=True)]
        yield batch(arrow(RESULT), doc_id=b.column("doc_id"), n_words=n_words, n_hit=n_hit, n_items=[len(x) for x in found], items_sha256=sha, contaminated=bad, items=found, th=b.column("th"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with its words inside windows of the benchmark (item_id, text); th is a key
    of the row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnow")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), numbered(F.col("doc_id")).alias("doc"), F.xxhash64("doc_id", "text").alias("th"), F.col("text").cast("binary").alias("text"))
    # equal item texts are compared once, for all their ids
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("text").cast("binary").alias("text")).agg(F.collect_set(F.col("item_id").cast("long")).alias("item_ids"))
    items = scratch.save(items.withColumn("item", F.monotonically_increasing_id()), "texts")
    sizes = items.select("text").mapInArrow(counts, "n long").where("n > 0")
    which = F.coalesce(*(F.when((F.col("n") >= a) & (F.col("n") <= (b or 1 << 40)), F.lit(c)) for c, (a, b, _) in enumerate(CLASSES)))
    classes = [(r.c, min(r.least, WINDOW)) for r in sizes.groupBy(which.alias("c")).agg(F.min("n").alias("least")).orderBy("c").collect()]  # at most one row a class
    item_prints = scratch.save(items.select("item", "text").mapInArrow(printed(classes, True), "fp long, id long").distinct().withColumnRenamed("id", "item"), "items")
    prints = rows.select(F.struct("doc", "th").alias("id"), "text").mapInArrow(printed(classes, False), "fp long, doc long, th long")
    met = prints.join(item_prints, "fp").select("doc", "th", "item").distinct()
    met = met.join(items, "item").groupBy("doc", "th").agg(F.collect_list(F.struct("item_ids", "text")).alias("items"))
    return rows.join(scratch.save(met, "met"), ["doc", "th"], "left").mapInArrow(judged, RESULT)


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows."""
    bad = decontaminated(docs, benchmark).where("contaminated").select(numbered(F.col("doc_id")).alias("_doc"), F.col("th").alias("_row")).distinct()
    rows = docs.withColumns({"_doc": numbered(F.col("doc_id")), "_row": F.xxhash64("doc_id", "text")})
    return rows.join(bad, ["_doc", "_row"], "left_anti").select(*docs.columns)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items", "th")


QUERIES = {"op6_winnowing": op6_winnowing}
ORACLE_SQL = {
    "op6_winnowing": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bw as (select distinct item_id, least(13, len(w)) as n, unnest([array_to_string(w[i + 1:i + least(13, len(w))], ' ') for i in range(greatest(1, len(w) - 12))]) as k from b where len(w) > 0),
lens as (select distinct n from bw),
dw as (select r, lens.n, unnest(range(len(w) - lens.n + 1)) as p, unnest([array_to_string(w[i + 1:i + lens.n], ' ') for i in range(len(w) - lens.n + 1)]) as k from d, lens where len(w) >= lens.n),
m as (select distinct r, p, dw.n, item_id from dw join bw using (n, k)),
h as (select r, count(distinct p + o) as n_hit from m, range(13) as x(o) where o < n group by r),
i as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from m group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join i using (r)"""
}
