"""SimHash fingerprints, and links between near fingerprints by the generalised pigeonhole principle.

The 64 bits are divided into m groups with thresholds t_1..t_m that add up to T - m + 1: two fingerprints that differ
in at most T bits differ in at most t_i bits of some group i (a group with t_i = -1 is never probed). Bits that go
together stand in one group. Counts of group values over all distinct fingerprints give the number of candidates of
each threshold, and dynamic programming picks the thresholds with the least total of candidates and probes. Each
fingerprint is then stored under its group value and probed under all values within t_i of it; candidates are
verified on all 64 bits.

Copies have one fingerprint and are one node. A bucket gives a spanning forest of its links, not all its pairs; a
large bucket is divided again and again by the same principle on its other bits. Components come from star contraction.

Pairs that differ in a share of their bits, and not in a few, are met by wide fingerprints: words of 64 bits, each
divided into groups like the above. Counts of all group values are again the costs, and the same programme picks which
groups are probed (threshold 0) and which never (-1). With p of them probed, pairs that differ in fewer than p bits of
these groups meet for certain; others miss all p groups with probability (1 - (1 - share)^bits)^p, and p is chosen for
this to be at most `loss` (computed for independent bits). Members of a bucket are compared on further words.

Defined results: a null or empty text has fingerprint zero and links like any other; component_id is the least
non-null doc_id of the component; rows with equal doc_id keep their own fingerprints; an empty table gives an empty
result; other columns are kept away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import U64, Scratch, mixed, numbered, portions, random_words, read
from quirelake.llm.components import components
from quirelake.llm.suffix_dedup import arrow, batch

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)  # [byte, bit]
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
BRUTE = 256
LANES = U64(0x0101010101010101)  # one bit of each byte
CHECKS = 3  # words of a wide fingerprint that are only compared
MATRIX = 1024  # members of a bucket that are compared at once
ROUND = 32  # groups whose buckets are shuffled at once


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, f = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    if len(words) < shingle:
        h = np.array([f(joined, SEED)], np.uint64)
    else:
        n = len(words) - shingle + 1
        h = np.fromiter((f(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    rows = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(rows[:, j], minlength=256) @ BITS_OF for j in range(8)])
    return int(POWERS[2 * ones > len(h)].sum())


def fingerprinted(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th (a key of the row), fp (signed 64 bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in portions(y, "text")):
            fps = [fingerprint(x or b"", shingle) for x in b.column("text").to_pylist()]
            yield batch(arrow("doc_id long, th long, fp long"), doc_id=b.column("doc_id"), th=b.column("th"), fp=np.array(fps, np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("th"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def bit_counts(fps: DataFrame, words: int = 1) -> np.ndarray:
    """[word, bit, bit]: in how many rows of fps (fp: an array of words) both bits are set. Counts are over all rows."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, 64, 64), np.int64)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, words)
            for w in range(words):
                bits = np.unpackbits(np.ascontiguousarray(x[:, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total[w] += (bits.T @ bits).astype(np.int64)
        yield batch(arrow("at int, n long"), at=np.arange(words * 4096), n=total.ravel())

    both = np.zeros(words * 4096)
    rows = fps.select("fp").mapInArrow(pairs, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 4096 rows a word
    both[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return both.reshape(words, 64, 64)


def divided(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m groups; bits that agree or disagree most often go together."""
    one = np.diag(both)
    cov = both / n - np.outer(one, one) / n / n
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(sd, sd))
    left, groups = list(range(64)), []
    for g in range(m):
        size = len(left) // (m - g)
        own = [max(left, key=lambda b: tie[b, left].sum())]
        while len(own) < size:
            own.append(max((b for b in left if b not in own), key=lambda b: tie[b, own].sum()))
        left = [b for b in left if b not in own]
        groups.append(sorted(own))
    return groups


def bit_groups(fps: DataFrame, m: int) -> list[list[int]]:
    """The 64 bits in m groups, by counts over all rows."""
    return divided(bit_counts(fps.select(F.array("fp").alias("fp")))[0], max(1, fps.count()), m)


def _mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def candidates(fps: DataFrame, groups: list[list[int]]) -> list[list[float]]:
    """For each group, the cost of thresholds -1, 0, 1, ...: candidates and probes, counted over all fingerprints."""
    n, squares = fps.count(), {}
    rows = None
    for g, bits in enumerate(groups):
        own = fps.select(F.lit(g).alias("g"), F.explode(F.array(F.lit(-1), *(F.lit(b) for b in bits))).alias("b"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v"))
        rows = own if rows is None else rows.unionByName(own)
    without = F.when(F.col("b") >= 0, F.col("v").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, greatest(b, 0))")))).otherwise(F.col("v"))
    pairs = rows.select("g", "b", without.alias("v")).groupBy("g", "b", "v").agg(F.count("*").alias("n")).groupBy("g", "b").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("n"))
    for r in pairs.collect():  # one row a bit, and one a group
        squares[r.g, r.b] = r.n
    out = []
    for g, bits in enumerate(groups):
        same = squares.get((g, -1), 0.0)
        near = same + sum(squares.get((g, b), 0.0) - same for b in bits)
        probes = [0, n, n * (1 + len(bits)), n * (1 + len(bits) + len(bits) * (len(bits) - 1) // 2)]
        far = near * max(2.0, near / max(1.0, same)) if same else near * len(bits)
        out.append([0.0, same + probes[1], near + probes[2], far + probes[3]])
    return out


def thresholds(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds of least cost that add up to total - m + 1, by dynamic programming."""
    m = len(cost)
    need = total - m + 1 + m  # with every threshold raised by one
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for own in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picks) in best[-1].items():
            for t, x in enumerate(own):
                if s + t <= need and (s + t not in new or c + x < new[s + t][0]):
                    new[s + t] = (c + x, [*picks, t - 1])
        best.append(new)
    return best[-1][need][1]


def near_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints; exact. A large set divides by most + 1 groups of bits, of which
    at least one agrees in any pair that differs in at most `most` bits; the parts divide further by their other bits."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    def compare(at: np.ndarray, bits: list[int]) -> None:
        """All links among fps[at], which agree in all but `bits`."""
        own = fps[at]
        if len(bits) <= most:
            for j in at[1:].tolist():
                link(int(at[0]), j)
            return
        if len(at) <= BRUTE:
            for i in range(len(at) - 1):
                for j in np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= most).tolist():
                    link(int(at[i]), int(at[i + 1 + j]))
            return
        divided = []
        for g in range(most + 1):
            part = bits[g :: most + 1]
            values = own & np.uint64(sum(1 << b for b in part))
            order = np.argsort(values, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0, True])
            rest = [b for b in bits if b not in part]
            if len(cut) == 2:  # all agree here, so the other bits hold all differences
                return compare(at, rest)
            divided.append((order, cut, rest))
        for order, cut, rest in divided:
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    compare(at[order[a:b]], rest)

    compare(np.arange(len(fps)), list(range(64)))
    return out


def linked(fps: DataFrame, most: int = 3, m: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that differ in at most `most` bits; enough of them to connect
    all that any such links connect."""
    groups = bit_groups(fps, m)
    picks = thresholds(candidates(fps, groups), most)
    stored = None
    for g, (bits, t) in enumerate(zip(groups, picks, strict=True)):
        if t < 0:
            continue
        flips = [0] + [_mask([b]) for b in bits] * (t >= 1) + [_mask([a, b]) for i, a in enumerate(bits) for b in bits[:i]] * (t >= 2)
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        own = fps.select(F.lit(g).alias("g"), F.explode(F.array(*(F.lit(x) for x in flips))).alias("flip"), "fp", value.alias("v")).select("g", F.col("v").bitwiseXOR(F.col("flip")).alias("v"), "fp", (F.col("flip") == 0).alias("home"))
        stored = own if stored is None else stored.unionByName(own)
    rows = stored.repartition("g", "v").sortWithinPartitions("g", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
            at_home, away = fp[home], fp[~home]
            if len(fp) < 2 or not len(at_home):
                return []
            if len(at_home) * len(away) > BRUTE * BRUTE:  # links among visitors are links as well
                return [(int(fp[i]), int(fp[j])) for i, j in near_links(fp.view(np.uint64), most)]
            forest = near_links(at_home.view(np.uint64), most)
            out = [(int(at_home[i]), int(at_home[j])) for i, j in forest]
            tree = list(range(len(at_home)))
            for i, j in forest:
                a, b = tree[i], tree[j]
                tree = [a if x == b else x for x in tree]
            near = np.argwhere(np.bitwise_count(away.view(np.uint64)[:, None] ^ at_home.view(np.uint64)) <= most)
            seen = set()
            for i, j in near.tolist():
                if (i, tree[j]) not in seen:  # one link of a visitor to each tree
                    seen.add((i, tree[j]))
                    out.append((int(away[i]), int(at_home[j])))
            return out

        def links(g: np.ndarray, v: np.ndarray, fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
            cut = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (g[1:] != g[:-1]), True])
            out = []
            for a, b in zip(cut[:-1][np.diff(cut) > 1].tolist(), cut[1:][np.diff(cut) > 1].tolist(), strict=True):
                out += bucket(fp[a:b], home[a:b])
            return out

        def made(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            out = links(*map(np.concatenate, zip(*parts, strict=True))) if parts else []
            if out:
                a, z = zip(*out, strict=True)
                yield batch(arrow("a long, b long"), a=list(a), b=list(z))

        held: list[list[np.ndarray]] = []  # the last bucket seen, which may go on
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "v", "fp", "home")]
            g, v = cols[:2]
            if not len(v):
                continue
            first, last = np.flatnonzero((g != g[0]) | (v != v[0])), np.flatnonzero((v != v[-1]) | (g != g[-1]))
            if held and (held[-1][0][-1], held[-1][1][-1]) == (g[0], v[0]):
                at = int(first[0]) if len(first) else len(v)
                held.append([c[:at] for c in cols])
                if at == len(v):
                    continue
            else:
                at = 0
            yield from made(held)
            end = int(last[-1]) + 1 if len(last) else 0
            if end > at:
                yield from made([[c[at:end] for c in cols]])
            held = [[c[max(at, end) :] for c in cols]]
        yield from made(held)

    return rows.mapInArrow(run, "a long, b long")


def majorities(hashes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Wide fingerprints [row, word] of rows that all have hashes, hashes[at[r]:at[r + 1]], mixed anew for each word: a
    bit is 1 if set in over half of them. Bytes of a word count one bit each, in runs of at most 255 hashes."""
    size = np.diff(at)
    runs = -(-size // 255)
    first = np.r_[0, np.cumsum(runs)]
    starts = np.repeat(at[:-1], runs) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], runs))
    out = np.empty((len(size), words), U64)
    for w, salt in enumerate(random_words(words, 13)):
        h = mixed(hashes + salt)
        ones = np.empty((len(starts), 8, 8), np.uint8)
        for s in range(8):
            ones[:, :, s] = np.add.reduceat(h >> U64(s) & LANES, starts).view(np.uint8).reshape(-1, 8)
        total = ones.reshape(-1, 64).astype(np.int32)
        if len(starts) > len(size):
            total = np.add.reduceat(total, first[:-1], axis=0)
        out[:, w] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view(U64)[:, 0]
    return out


def wide_plan(n: int, share: float, loss: float) -> tuple[int, int, int]:
    """(words, groups of each, groups to probe) for n fingerprints: some 2^8 of unlike ones share a group's value."""
    m = -(-64 // min(32, max(4, n.bit_length() - 8)))
    meet = (1 - share) ** -(-64 // m)
    need = math.ceil(math.log(loss) / math.log1p(-meet))
    return -(-need // m), m, need


def wide_groups(prints: DataFrame, words: int, m: int, need: int) -> list[tuple[int, list[int]]]:
    """(word, bits) of the groups to probe, those of least cost."""
    n = prints.count()
    both = bit_counts(prints.select(F.slice("fp", 1, words).alias("fp")), words)
    groups = [(w, bits) for w in range(words) for bits in divided(both[w], max(1, n), m)]
    values = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), _value(w, bits).alias("v")) for g, (w, bits) in enumerate(groups)))).alias("x")
    counts = prints.select(values).groupBy("x.g", "x.v").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("n"))
    pairs = {r.g: r.n for r in counts.collect()}  # one row a group
    picks = thresholds([[0.0, n + pairs.get(g, 0.0)] for g in range(len(groups))], need - 1)
    return [x for x, t in zip(groups, picks, strict=True) if t == 0]


def _value(word: int, bits: list[int]) -> Column:
    return F.element_at("fp", word + 1).bitwiseAND(F.lit(_mask(bits)))


def near_lists(checks: np.ndarray, most: int) -> list[list[int]]:
    """Lists of the members of a bucket (checks[word, member]) that hold all pairs that differ in at most `most` bits:
    pairs where there are few, else all that are in any; of a large bucket, what such pairs connect."""
    n = checks.shape[1]
    if n <= MATRIX:
        far = sum(np.bitwise_count(c[:, None] ^ c) for c in checks)
        i, j = np.nonzero(np.triu(far <= most, 1))
        own = np.unique(np.r_[i, j])
        return np.c_[i, j].tolist() if len(i) <= len(own) else [own.tolist()]
    left, out = np.arange(n), []
    while len(left):
        own, todo, left = [], [int(left[0])], left[1:]
        while todo:
            own.append(todo.pop())
            near = sum(np.bitwise_count(c[left] ^ c[own[-1]]) for c in checks) <= most
            todo += left[near].tolist()
            left = left[~near]
        if len(own) > 1:
            out.append(sorted(own))
    return out


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in order of the first one, in portions that cut none of its values."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def wide_lists(prints: DataFrame, scratch: Scratch, words: int, m: int, need: int, most: int) -> DataFrame:
    """nodes (sorted arrays): for prints (node, fp: `words` words and CHECKS more, as by wide_plan), lists that hold all
    pairs that meet in a probed group and differ in at most `most` bits of the last CHECKS words."""
    groups = wide_groups(prints, words, m, need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, *checks in whole_buckets(batches):
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            some = np.flatnonzero(np.diff(cut) > 1)
            all_checks, out = np.array(checks).view(U64), []
            for a, b in zip(cut[some].tolist(), cut[some + 1].tolist(), strict=True):
                own = node[a:b]
                out += [np.sort(own[x]) for x in near_lists(all_checks[:, a:b], most)]
            if out:
                yield batch(arrow("nodes array<long>"), nodes=out)

    found = None
    for r in range(0, len(groups), ROUND):
        keys = F.explode(F.array(*(F.xxhash64(F.lit(r + g), _value(w, bits)) for g, (w, bits) in enumerate(groups[r : r + ROUND])))).alias("key")
        rows = prints.select(keys, "node", *(F.element_at("fp", words + 1 + c).alias(f"c{c}") for c in range(CHECKS)))
        own = scratch.save(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "nodes array<long>").distinct(), f"met-{r}")
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of each row; th is a key of the row, root one of its component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprinted(docs, shingle), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(linked(nodes.select("fp"), most), scratch).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("fp", "root", "component_id")
    return prints.join(nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "th", "root")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without all but one row of each component (doc_id, th, root): that of the least doc_id (null last), then of
    the least key. Rows meet by doc_id and key together."""
    first = groups.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("first")).select(numbered(F.col("first.doc_id")).alias("_doc"), F.col("first.th").alias("_row"))
    rows = docs.withColumns({"_doc": numbered(F.col("doc_id")), "_row": F.xxhash64("doc_id", "text")})
    return rows.join(first, ["_doc", "_row"], "left_semi").dropDuplicates(["_doc", "_row"]).select(*docs.columns)


def op7_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op7_simhash_gph": op7_simhash_gph}
ORACLE_SQL: dict[str, str] = {}
