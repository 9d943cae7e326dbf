"""Token id files: fixed-size blocks of ids, transposed into byte or bit planes, each packed with zstandard.

Documents are dealt to files by ranges of doc_id, so files in order hold all ids in ascending doc_id order. A file is

    magic | plane | plane | ... | documents | index | index length (8 bytes) | magic

The index gives, for each block, its place, its number of ids and its planes' packed sizes, so any run of ids can
be read by itself. Each task writes a file under a name of its own attempt; only files in the committed manifest
count, which also gives every file its first id's number.

Tokens come from the tokenizers library. As its byte-level splitting never joins text across a space before a
visible character, a text's ids are those of its pieces in turn; Arrow finds the distinct pieces of a portion, and
each is encoded once per worker, whose store of pieces is bounded in bytes. Texts with one of the file's added tokens
in them, and all texts under other splitting rules, are encoded whole.

Defined results: a null text is empty and gets the end id alone; a null doc_id stands first; rows with equal
doc_id follow in the order of their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import Scratch, column_bytes, file_system, one_each, portions, read
from quirelake.llm.suffix_dedup import arrow, batch

BLOCK = 1 << 16
MAGIC = b"QPLANES1"
STORE = 160 << 20  # bytes of pieces, about, that a worker keeps
LONG = 256  # longer pieces are not kept
JOIN = 1 << 16  # bytes of new pieces that are encoded as one text
FILE_BYTES = 256 << 20  # stored bytes of input a file, about
MANIFEST = "part long, uri string, n_docs long, n_ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes that can begin a visible character; those that white space or a format mark may begin with are left out.
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = VISIBLE[0xC3:0xE1] = VISIBLE[0xE4:0xEF] = VISIBLE[0xF0:0xF5] = True
#: Kinds of bytes: 1 letter, 2 digit, 3 apostrophe, 4 other mark, 5 white space (all ASCII); 0 any other.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 4
KIND[0x30:0x3A], KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x27] = 2, 1, 1, 3
KIND[[9, 10, 11, 12, 13, 32]] = 5
#: [kind, next kind]: whether the splitting rule always ends a token's text between them.
SPLIT = np.zeros((6, 6), bool)
SPLIT[1, 2:] = SPLIT[2, [1, 3, 4, 5]] = SPLIT[4, [1, 2, 5]] = SPLIT[3, 5] = True


#: A piece's last character that is, or may be, white space outside ASCII.
BLANK_END = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1(?:\x9a|\xa0).|\xe2[\x80\x81].|\xe3\x80\x80|\xef\xbb\xbf)\Z", re.S)


def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte (or bit) planes of a block of 32-bit ids, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, i].tobytes() for i in range(4)]
    return [np.packbits((ids.astype(np.uint32) >> np.uint32(i)) & np.uint32(1)).tobytes() for i in range(32)]


def unplaned(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)).view("<u4").reshape(-1)
    out = np.zeros(n, np.uint32)
    for i, p in enumerate(parts):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(i)
    return out


class Writer:
    """Writes one file; holds one block of ids, and 16 bytes for each document."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = 3):
        import zstandard

        self.out, self.block, self.bits = out, block, bits
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.index, self.ids, self.counts = [], [], []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all their ids in turn."""
        self.ids += doc_ids
        self.counts += counts.tolist()
        while len(ids):
            part, ids = ids[: self.block - self.n_held], ids[self.block - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.block:
                self.flush()

    def flush(self) -> None:
        packed = [self.pack(p) for p in planes(np.concatenate(self.held), self.bits)]
        self.index.append([self.at, self.n_held, [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)
        self.held, self.n_held = [], 0

    def close(self) -> tuple[int, int]:
        """(documents, ids) written."""
        if self.n_held:
            self.flush()
        null = [i for i, x in enumerate(self.ids) if x is None]
        docs = self.pack(np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        self.out.write(docs)
        index = self.pack(json.dumps({"blocks": self.index, "documents": [self.at, len(docs), len(self.ids)], "null": null}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return len(self.ids), sum(self.counts)


class Reader:
    """Random access to a file: `documents()` and the ids of any block."""

    def __init__(self, f):
        import zstandard

        self.f, self.unpack = f, zstandard.ZstdDecompressor().decompress
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(self.unpack(f.read_at(n, size - 16 - n)))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        at, size, n = self.index["documents"]
        both = np.frombuffer(self.unpack(self.f.read_at(size, at)), "<i8")
        ids = both[:n].tolist()
        for i in self.index["null"]:
            ids[i] = None
        return ids, both[n:]

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["blocks"][k]
        raw = memoryview(self.f.read_at(sum(sizes), at))
        ends = np.cumsum(sizes).tolist()
        return unplaned([self.unpack(raw[e - s : e]) for s, e in zip(sizes, ends, strict=True)], n)

    def per_document(self) -> Iterator[np.ndarray]:
        """Each document's ids, with one block and one document in memory."""
        k, held = 0, np.zeros(0, np.uint32)
        for n in self.documents()[1].tolist():
            parts = [held[:n]]
            held, need = held[n:], n - min(n, len(held))
            while need:
                block = self.block(k)
                k += 1
                parts.append(block[:need])
                held, need = block[need:], need - min(need, len(block))
            yield np.concatenate(parts)


class Encoder:
    """ids of texts by the tokenizers library. Where the file's rules split text before a space and a visible character,
    texts are cut there and each distinct piece is encoded once; texts under other rules are encoded whole."""

    def __init__(self, path: str, most: int = STORE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        with open(path, "rb") as f:
            spec = json.load(f)
        rule, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.splits = rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and rule.get("use_regex", True) and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.size = np.zeros(self.library.get_vocab_size(), np.int64)  # bytes of each token
        for token, i in self.library.get_vocab().items():
            self.size[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.pool, self.start, self.count, self.held = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        got = [e.ids for e in self.library.encode_batch([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        return np.array([x for y in got for x in y], self.kind), np.array([len(x) for x in got], np.int64)

    def together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As alone(), of pieces that a line feed never joins: they are one text of lines, and the tokens' sizes tell
        where each piece ends."""
        text = b"\n".join(pieces)
        ids = np.array(self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.kind)
        ends, sizes = np.cumsum(self.size[ids]), np.fromiter(map(len, pieces), np.int64, len(pieces))
        want = np.cumsum(sizes + 1) - 1
        last = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != len(text) or (ends[last] != want).any() or (ends[last[:-1] + 1] != want[:-1] + 1).any():
            return self.alone(pieces)
        keep = np.ones(len(ids), bool)
        keep[last[:-1] + 1] = False
        return ids[keep], np.diff(last, prepend=-1) - np.r_[0, np.ones(len(pieces) - 1, np.int64)]

    def slots(self, known: pa.Array, marked: bool) -> np.ndarray:
        """Places of distinct pieces in the store, which takes up what is new. marked: some may hold an added token."""
        if self.held > self.most:
            self.clear()
        pieces, get = known.to_pylist(), self.slot.get
        out = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        data, offs = column_bytes(known)
        pad = np.r_[data, np.uint8(0)]
        one, two, end = pad[offs[:-1]], pad[np.minimum(offs[:-1] + 1, len(data))], pad[offs[1:] - 1]
        joins = (VISIBLE[one] | (one == 32) & VISIBLE[two] & (np.diff(offs) > 1)) & ((end > 32) & (end < 127) | (end > 127))
        for i in np.flatnonzero(joins & (end > 127) & (out < 0)).tolist():
            joins[i] = not BLANK_END.search(pieces[i])
        if marked:
            joins &= ~np.fromiter((any(m in p for m in self.marks) for p in pieces), bool, len(pieces))
        odd = np.flatnonzero((out < 0) & ~joins).tolist()
        made, order, run, size = [], [], [], 0
        for i in [*np.flatnonzero((out < 0) & joins).tolist(), None]:
            if run and (i is None or size > JOIN):
                made.append(self.together([pieces[j] for j in run]))
                order += run
                run, size = [], 0
            if i is not None:
                run.append(i)
                size += len(pieces[i])
        if odd:
            made.append(self.alone([pieces[i] for i in odd]))
            order += odd
        if made:
            counts = np.concatenate([c for _, c in made])
            at = len(self.start)
            self.start = np.r_[self.start, len(self.pool) + np.cumsum(counts) - counts]
            self.count = np.r_[self.count, counts]
            self.pool = np.concatenate([self.pool, *(ids for ids, _ in made)])
            out[order] = np.arange(at, at + len(order))
            for k, i in enumerate(order, at):
                if len(pieces[i]) <= LONG:
                    self.slot[pieces[i]] = k
            self.held += sum(map(len, pieces)) + 150 * len(order) + self.pool.itemsize * int(counts.sum())
        return out

    def column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, number of ids of each text) of a binary column."""
        data, offs = column_bytes(texts)
        first = np.zeros(len(data) + 1, bool)
        first[offs[:-1]] = True
        cut, marked = np.zeros(len(data), bool), False
        if self.splits and len(data):
            kind = KIND[data]
            cut[1:] = SPLIT[kind[:-1], kind[1:]]
            cut[:-1] |= (data[:-1] == 32) & VISIBLE[data[1:]] & ~first[1:-1]
            for m in self.marks:  # an added token ends a stretch of white space, so its texts stay whole
                for r in np.flatnonzero(pc.match_substring(texts, m.decode()).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
                    cut[offs[r] : offs[r + 1]], marked = False, True
        starts = np.flatnonzero(cut | first[:-1])
        edges = pa.py_buffer(np.r_[starts, len(data)].astype(np.int32))
        known = pa.Array.from_buffers(pa.binary(), len(starts), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        slot = self.slots(known.dictionary, marked)[known.indices.to_numpy()]
        n = self.count[slot]
        total = np.r_[0, np.cumsum(n)]
        counts = np.diff(total[np.searchsorted(starts, offs)]) + 1
        ends = np.cumsum(counts) - 1
        inner = np.ones(int(counts.sum()), bool)
        inner[ends] = False
        ids = np.full(len(inner), end_id, "<u4")
        ids[inner] = self.pool[np.repeat(self.start[slot] - total[:-1], n) + np.arange(total[-1])]
        return ids, counts

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, counts = self.column(pa.array([t.encode() for t in texts], pa.binary()), 0)
        ends = np.cumsum(counts)
        return [ids[e - n : e - 1] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 2, block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Encode and write all documents; returns the manifest, in which `part` orders the files. tokenizer: a path, the
    same on every machine."""
    base, spark = scratch.at, docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files read
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, stored // FILE_BYTES))
    rows = rows.repartitionByRange(parts, F.asc("doc_id")).sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(base)
        encode, name, out, w, part = encoder(tokenizer), uuid.uuid4().hex, None, None, 0
        for b in batches:
            if w is None and b.num_rows:
                part = b.column("part")[0].as_py()
                out = fs.open_output_stream(f"{root}/{name}.planes")
                w = Writer(out, block, bits)
            for own in portions(b, "text"):
                ids, counts = encode.column(own.column("text"), end_id)
                w.add(own.column("doc_id").to_pylist(), counts, ids)
        if w is not None:
            n_docs, n_ids = w.close()
            out.close()
            yield batch(arrow(MANIFEST), part=[part], uri=[f"{base}/{name}.planes"], n_docs=[n_docs], n_ids=[n_ids])

    return scratch.save(rows.mapInArrow(writer, MANIFEST), "manifest")


def documents(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: the number of ids before it, its number of ids, their crc32."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file

    def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, at in zip(b.column("uri").to_pylist(), b.column("at").to_pylist(), strict=True):
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    own = Reader(f)
                    ids, counts = own.documents()
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own.per_document()]
                start = at + np.r_[0, np.cumsum(counts)[:-1]]
                yield batch(arrow(RESULT), doc_id=ids, start=start, n_tokens=counts, ids_crc32=crc)

    return one_each(manifest.select("uri", "part", before.alias("at")), "part").mapInArrow(reader, RESULT)


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return documents(write(read(spark, sf_dir, "documents"), Scratch(spark, "planes"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op4_token_planes": op4_token_planes}
ORACLE_SQL: dict[str, str] = {}
