"""Subword encoding and decoding with SentencePiece vocabularies: a BPE model's own merges, or a max-plus parallel scan.

The query and the pipeline return the public BPE model's own ids (`Merges`): texts are cut where no piece can cross, and
the sentencepiece library merges each distinct run of a portion once. The scan below reads any vocabulary as a unigram
lattice, whose heaviest segmentation is not what a BPE model gives.

A text's best segmentation is the heaviest path through its pieces. In the semiring (max, +) a chunk of text is a
matrix: entry (s, e) is the best weight of covering the chunk when a piece from before covers its first s characters
and its own last piece reaches e characters beyond its end. Matrices combine associatively. A giant text is cut into
chunks; their matrices are made in parallel, combined, the state at each cut is chosen, and every chunk is traced back
by itself. Most cuts can be put where no piece crosses (before a space mark that follows another character); there
the only state is 0, and inside a chunk such places divide the work into short runs. Plain runs are solved by the
sentencepiece library's own unigram search over the same weights, each distinct run of a portion once; sums over a run
stay exact in its 32-bit floats, over a whole text they would not.

Weights are the vocabulary's scores, but pieces of the reserved least score get the least proper score less one, so
that all sums stay exact integers; characters without a piece are covered at a lower weight and written as bytes.

Defined results: a null or empty text has no pieces; of equally heavy segmentations inside a run the one with the
longest last piece wins, then the next to last, and so on; decoding gives the text back, except that a literal space
mark (U+2581) comes back as a space; rows with equal doc_id are separate texts; a null doc_id is kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import Scratch, portions, read
from quirelake.llm.suffix_dedup import arrow, batch

MARK = "▁"
CHUNK = 1 << 16
KEPT = 100_000  # most runs whose pieces a worker keeps
KEPT_BYTES = 64 << 20  # and about how many bytes of them
LONGEST_KEPT = 256  # longer runs are not kept
LONG_RUN = 64  # longer runs are not given to the library
NEVER = -(1 << 60)
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces and weights of a SentencePiece model file; encodes and decodes."""

    def __init__(self, path: str, kept: int = KEPT):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models with identity normalisation and a leading space mark")
        kinds = pb.ModelProto.SentencePiece
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        floor = min(s for _, _, s in normal if s > -1e8)
        self.pieces = {p: (i, int(s) if s > -1e8 else int(floor) - 1) for p, i, s in normal}
        if any(int(s) != s for _, _, s in normal):
            raise ValueError("only models with whole scores")
        self.unknown = int(floor) - 11
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        if len(self.byte) < 256:
            raise ValueError("only models with all byte pieces")
        self.longest = max(map(len, self.pieces))
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(p) for p in self.pieces):
            raise ValueError("only models whose pieces have the space mark in front")
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in proto.pieces]
        self.most, self.store = kept, {}
        self.library = self.loaded(proto)
        self.weight = np.zeros(len(proto.pieces), np.int64)
        for i, w in self.pieces.values():
            self.weight[i] = w
        for x, i in self.byte.items():
            self.weight[i] = 0 if 128 <= x < 192 else self.unknown  # a character counts once, by its first byte

    def loaded(self, proto):
        """The library's unigram search over the same weights."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        kinds = pb.ModelProto.SentencePiece
        proto.trainer_spec.model_type = 1  # unigram
        for p in proto.pieces:
            if p.piece in self.pieces and p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                p.score = self.pieces[p.piece][1]
        return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def steps(self, text: str, i: int):
        """(end, weight, ids) of each piece that starts at i."""
        found = False
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            got = self.pieces.get(text[i:j])
            if got:
                found |= j == i + 1
                yield j, got[1], (got[0],)
        if not found:
            yield i + 1, self.unknown, tuple(self.byte[b] for b in text[i].encode("utf-8", "surrogatepass"))

    def best(self, run: str) -> tuple[int, tuple[int, ...]]:
        """(weight, ids) of one run, from state 0 to state 0."""
        n, pieces, longest = len(run), self.pieces, self.longest
        weight, back = [NEVER] * (n + 1), [None] * (n + 1)
        weight[0] = 0
        for i in range(n):
            at = weight[i]
            found = False
            for j in range(i + 1, min(n, i + longest) + 1):
                got = pieces.get(run[i:j])
                if got:
                    if j == i + 1:
                        found = True
                    if at + got[1] > weight[j]:
                        weight[j], back[j] = at + got[1], (i, got[0])
            if not found and at + self.unknown > weight[i + 1]:
                weight[i + 1], back[i + 1] = at + self.unknown, (i, -1)
        out, j = [], n
        while j:
            i, k = back[j]
            out.append((k,) if k >= 0 else tuple(self.byte[b] for b in run[i].encode("utf-8", "surrogatepass")))
            j = i
        return weight[n], tuple(x for y in reversed(out) for x in y)

    def known(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of each distinct run, as 32-bit numbers."""
        new = set(runs) - self.store.keys()
        if len(self.store) + len(new) > self.most:
            self.store.clear()
            new = set(runs)
        plain = [r for r in new if 1 < len(r) <= LONG_RUN and r[0] == MARK and MARK not in r[1:]]
        for r, ids in zip(plain, self.library.encode([r[1:] for r in plain], num_threads=1), strict=True):
            self.store[r] = np.array(ids, "<u4").tobytes()
        for r in new.difference(plain):
            self.store[r] = np.array(self.best(r)[1], "<u4").tobytes()
        return self.store

    def joined(self, text: str) -> bytes:
        runs = RUN.findall(text)
        return b"".join(map(self.known(runs).__getitem__, runs))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [RUN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        of = self.known([r for c in cut for r in c]).__getitem__
        return [np.frombuffer(b"".join(map(of, c)), "<u4") for c in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]

    # chunks of giant texts

    def cuts(self, text: str, chunk: int) -> list[int]:
        """Places that divide a marked text into chunks of about this length, where a piece can't cross if there is
        such a place within a chunk's length."""
        out, safe = [0], re.compile(f"(?<=[^{MARK}]){MARK}")
        while len(text) - out[-1] > chunk:
            m = safe.search(text, out[-1] + chunk, min(len(text), out[-1] + 2 * chunk))
            out.append(m.start() if m else out[-1] + chunk)
        return [*out, len(text)]

    def _ends(self, chunk: str, ahead: str, first: int) -> list:
        """Forward pass with a vector of weights, one for each state at the start: (weights at each place, back)."""
        text, n, states = chunk + ahead, len(chunk), self.longest
        weight = np.full((n + states, states), NEVER, np.int64)
        for s in range(min(states, n + states)):
            weight[s, s] = 0
        for i in range(first, n):
            for j, w, _ in self.steps(text, i):
                if j < n + states:
                    weight[j] = np.maximum(weight[j], weight[i] + w)
        return weight

    def transfer(self, chunk: str, ahead: str) -> np.ndarray:
        """The chunk's matrix (state at its start, state at its end). Runs between safe places have one state, so the
        matrix is made of the part before the first, the runs, and the part after the last."""
        safe = [m.start() + 1 for m in re.finditer(f"[^{MARK}]{MARK}", chunk)]
        safe = [i for i in safe if i >= self.longest]
        if not safe:
            weight = self._ends(chunk, ahead, 0)
            return weight[len(chunk) : len(chunk) + self.longest].T.copy()
        a, b = safe[0], safe[-1]
        head = self._ends(chunk[:a], "", 0)[a]
        middle = int(self.weight[np.frombuffer(self.joined(chunk[a:b]), "<u4")].sum())
        tail = self._ends(chunk[b:], ahead, 0)[len(chunk) - b :, 0][: self.longest]
        out = head[:, None] + middle + tail[None, :]
        out[(head[:, None] < NEVER // 2) | (tail[None, :] < NEVER // 2)] = NEVER
        return out

    def trace(self, chunk: str, ahead: str, start: int, end: int) -> tuple[int, ...]:
        """ids of the pieces that begin in the chunk, between a state at its start and one at its end."""
        text, n = chunk + ahead[:end], len(chunk) + end
        if start == 0 and end == 0:
            return tuple(np.frombuffer(self.joined(chunk), "<u4").tolist())
        weight, back = [NEVER] * (n + 1), [None] * (n + 1)
        if start <= n:
            weight[start] = 0
        for i in range(start, len(chunk)):
            if weight[i] == NEVER:
                continue
            for j, w, ids in self.steps(chunk + ahead, i):
                if j <= n and weight[i] + w > weight[j]:
                    weight[j], back[j] = weight[i] + w, (i, ids)
        out, j = [], n
        while j > start:
            j, ids = back[j]
            out.append(ids)
        return tuple(x for y in reversed(out) for x in y)


class Merges(Vocabulary):
    """A BPE model's own encoding. Merges make pieces only, so none crosses a place whose two characters stand side by
    side in no piece; runs are such parts of a text, and so are the chunks of a giant text."""

    def loaded(self, proto):
        import sentencepiece

        if proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models")
        self.held, self.long = 0, []
        self.met = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        proto.normalizer_spec.add_dummy_prefix = False  # runs come with their marks
        return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def known(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of each distinct run. What stays in the store between portions is bounded in number and bytes."""
        distinct = set(runs)
        if len(self.store) + len(distinct) > self.most or self.held > KEPT_BYTES:
            self.store.clear()
            self.held = 0
        for r in self.long:
            self.store.pop(r, None)
        new = list(distinct - self.store.keys())
        for r, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            self.store[r] = np.array(ids, "<u4").tobytes()
            self.held += len(r) + len(self.store[r]) + 150
        self.long = [r for r in new if len(r) > LONGEST_KEPT]
        return self.store

    def cuts(self, text: str, chunk: int) -> list[int]:
        """Places that divide a marked text into chunks of at least this length, where no merge can cross."""
        out = [0]
        while len(text) - out[-1] > chunk:
            at = next((i for i in range(out[-1] + chunk, len(text)) if text[i - 1 : i + 1] not in self.met), None)
            if at is None:
                break
            out.append(at)
        return [*out, len(text)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def states(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut of the heaviest path from state 0 to state 0."""
    before = [np.r_[0, np.full(len(matrices[0]) - 1, NEVER)]]
    for m in matrices:
        before.append(np.maximum((before[-1][:, None] + m).max(axis=0), NEVER))
    out = [0]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(int((before[k] + matrices[k][:, out[-1]]).argmax()))
    return [0, *out[::-1]]


_LOADED: dict[tuple[str, bool], Vocabulary] = {}


def vocabulary(path: str, merges: bool = False) -> Vocabulary:
    if (path, merges) not in _LOADED:
        _LOADED[path, merges] = (Merges if merges else Vocabulary)(path)
    return _LOADED[path, merges]


def encoded(docs: DataFrame, model: str, chunk: int = CHUNK, decode: bool = False, merges: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of each row of docs (doc_id, text). model: a path, the same on every machine. decode:
    also the text that the ids give back, made by the same worker. merges: the BPE model's own ids."""
    scratch = Scratch(docs.sparkSession, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    giant = F.char_length("text") > 2 * chunk

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, merges)
        for b in batches:
            for own in portions(b, "text", 1 << 20):
                ids = v.encode_all(own.column("text").to_pylist())
                offs = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                cols = {"doc_id": own.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))}
                if decode:
                    cols["text"] = pa.array([v.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, merges)
        for b in batches:
            for uid, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
                t = MARK + text.replace(" ", MARK)
                cuts = v.cuts(t, chunk)
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    yield batch(arrow("uid string, doc_id long, k long, chunk string, ahead string"), uid=[uid], doc_id=[doc_id], k=[k], chunk=[t[a:z]], ahead=[t[z : z + v.longest]])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, merges)
        for b in batches:
            m = [v.transfer(c, a).ravel() for c, a in zip(b.column("chunk").to_pylist(), b.column("ahead").to_pylist(), strict=True)]
            yield batch(arrow("uid string, k long, m array<long>"), uid=b.column("uid"), k=b.column("k"), m=m)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = vocabulary(model).longest
        for b in batches:
            for uid, ms in zip(b.column("uid").to_pylist(), b.column("ms").to_pylist(), strict=True):
                s = states([np.array(x["m"], np.int64).reshape(n, n) for x in sorted(ms, key=lambda x: x["k"])])
                yield batch(arrow("uid string, k long, start long, end long"), uid=[uid] * (len(s) - 1), k=range(len(s) - 1), start=s[:-1], end=s[1:])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, merges)
        for b in batches:
            ids = [v.trace(*x) for x in zip(*(b.column(c).to_pylist() for c in ("chunk", "ahead", "start", "end")), strict=True)]
            yield batch(arrow("uid string, doc_id long, k long, ids array<long>"), uid=b.column("uid"), doc_id=b.column("doc_id"), k=b.column("k"), ids=ids)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, merges)
        for b in batches:
            ids = [np.frombuffer(v.joined(c), "<u4").tolist() for c in b.column("chunk").to_pylist()]
            yield batch(arrow("uid string, doc_id long, k long, ids array<long>"), uid=b.column("uid"), doc_id=b.column("doc_id"), k=b.column("k"), ids=ids)

    out = rows.where(~giant).mapInArrow(small, "doc_id long, ids array<int>" + ", text string" * decode)
    # equal rows are told apart by their number; the rows are written before it is used again
    large = rows.where(giant).withColumn("uid", F.expr("uuid()"))
    chunks = scratch.save(large.mapInArrow(pieces, "uid string, doc_id long, k long, chunk string, ahead string"), "chunks")
    dealt = chunks.repartition("uid", "k")
    if merges:
        parts = dealt.select("uid", "doc_id", "k", "chunk").mapInArrow(joined, "uid string, doc_id long, k long, ids array<long>")
    else:
        picks = dealt.select("uid", "k", "chunk", "ahead").mapInArrow(matrices, "uid string, k long, m array<long>")
        picks = picks.groupBy("uid").agg(F.collect_list(F.struct("k", "m")).alias("ms")).mapInArrow(chosen, "uid string, k long, start long, end long")
        parts = dealt.join(picks, ["uid", "k"]).mapInArrow(traced, "uid string, doc_id long, k long, ids array<long>")
    whole = parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = whole.select("doc_id", F.flatten("parts.ids").cast("array<int>").alias("ids"))
    return out.unionByName(decoded(whole, model, merges) if decode else whole)


def decoded(rows: DataFrame, model: str, merges: bool = False) -> DataFrame:
    """doc_id, ids, text of each row (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, merges)
        for b in batches:
            texts = [v.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(rows: DataFrame, model: str, merges: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 of each row (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, merges)
        for b in batches:
            ids = [x.values.to_numpy(zero_copy_only=False) for x in b.column("ids")]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            sha = [hashlib.sha256(v.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            yield batch(arrow("doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string"), doc_id=b.column("doc_id"), n_pieces=[len(x) for x in ids], ids_crc32=crc, decoded_sha256=sha)

    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(read(spark, sf_dir, "documents"), model_path(), merges=True), model_path(), merges=True)


QUERIES = {"op8_piece_scan": op8_piece_scan}
ORACLE_SQL: dict[str, str] = {}
