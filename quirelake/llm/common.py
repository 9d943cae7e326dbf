"""What the corpus operators share: scratch tables on shared storage, Arrow columns as byte arrays, hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (local tests) a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quirelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def lean(spark: SparkSession) -> SparkSession:
    """Arrow batches of texts of 8 MB instead of the default 64, which count several times in JVM and Python; a value
    that someone chose stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, "8m")
    return spark


class Scratch:
    """Written tables that cut lineage. A table outlives lost executors, as it lies in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = lean(spark)
        self.at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self.path = lambda sub="": jvm.org.apache.hadoop.fs.Path(self.at + sub)
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path())
        self.fs.deleteOnExit(self.path())

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write, then read back; the shuffle files of the written query go at once."""
        conf, clean = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(clean, "false")
        conf.set(clean, "true")
        try:
            out = df.write.mode("overwrite").option("compression", "zstd")
            (out.partitionBy(by) if by else out).parquet(f"{self.at}/{name}")
        finally:
            conf.set(clean, before)
        out = self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of the finished query
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.path(f"/{name}"), True)


def one_each(manifest: DataFrame, order: str) -> DataFrame:
    """The rows of a manifest of files, about one a task: a count of tasks that is given is not lowered at run time."""
    return manifest.repartitionByRange(max(1, manifest.count()), order)


def file_system(uri: str):
    """(file system, path) of a shared folder, for files that are not Spark tables."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


NULL_ID = -(1 << 63)


def numbered(doc_id: Column) -> Column:
    """doc_id as a number that is never null, for joins."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a binary column without a copy; null is empty."""
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most so many bytes, or of a single longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def portions(b: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most so many bytes in a text column, or of one longer row: what becomes Python
    objects at a time stays small."""
    sizes = np.nan_to_num(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    for i, j in slices(np.r_[0, np.cumsum(sizes)], most):
        yield b.slice(i, j - i)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


BYTE_WORD = random_words(256, 7)
STEP = U64(0xD1342543DE82EF95)  # odd, so that it has an inverse modulo 2**64


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k elements (k a power of two) of an array of 64-bit words, by doubling."""
    m, mul = 1, int(STEP)
    while m < k:
        x = x[:-m] * U64(mul) + x[m:] if len(x) > m else x[:0]
        m, mul = 2 * m, mul * mul % (1 << 64)
    return mixed(x)


def window_min(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """Least (or by np.maximum greatest) of each w neighbours."""
    n, span, cur = len(x), 1, x
    if n < w:
        return x[:0]
    while 2 * span <= w:
        cur = pick(cur[:-span], cur[span:])
        span *= 2
    return pick(cur[: n - w + 1], cur[w - span : w - span + n - w + 1]) if span < w else cur


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = pow(int(STEP), -1, 1 << 64)
        for key, base in (("up", int(STEP)), ("down", inverse)):
            out = np.ones(size, U64)
            out[1:] = U64(base)
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_WORD[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, breaks: np.ndarray | None = None, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of bytes that are no space; a run never crosses one of the sorted breaks."""
    gap = space[data]
    edge = np.zeros(len(data) + 1, bool)
    first = ~gap
    first[1:] &= gap[:-1]
    edge[: len(data)] = first
    last = np.zeros(len(data) + 1, bool)
    last[1:] = ~gap
    last[1 : len(data)] &= gap[1:]
    if breaks is not None and len(data):
        inner = breaks[(breaks > 0) & (breaks < len(data))]
        cut = inner[~gap[inner] & ~gap[inner - 1]]
        edge[cut] = True
        last[cut] = True
    return np.flatnonzero(edge), np.flatnonzero(last)


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open intervals; touching ones join."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{table}.parquet")
