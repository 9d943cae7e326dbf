"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters (anything else is a blank), as shares of a text's n-grams
times their inverse document frequency. Document frequencies cover all learning rows. Weights are trained by
follow-the-regularised-leader with elastic-net penalties on `sample` learning rows (those of least hash; the bound on
what the driver gets is sample * 2**BITS numbers), and a temperature is fitted on a fifth of them. Prediction is one
pass without a shuffle: shares are linear, so a text's score is the mean of its n-grams' weights.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing could be learned;
a null doc_id counts as the empty string in the fold rule; equal texts get equal predictions; an empty table gives an
empty result; other columns are kept away. Columns lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quirelake.llm.common import lean, portions, read
from quirelake.llm.suffix_dedup import arrow, batch

BITS = 15
ORDERS = (1, 2, 3)
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
GAIN = 40.0  # brings shares of n-grams to the scale of the learning rate
PART = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, hashed n-grams, their text, has a letter) of runs of texts; text numbers count from the first."""
    table, at = _letters(), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PART):
            size += len(texts[end])
            end += 1
        own = texts[at:end]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        chars = table[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)]
        row = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        hashed, rows = [], []
        h = np.zeros(len(chars), np.uint32)
        for n in ORDERS:
            m = len(chars) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + (chars[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            f = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            inside = row[:m] == row[n - 1 :]
            hashed.append((f >> np.uint32(32 - BITS))[inside])
            rows.append(row[:m][inside])
        letters = np.bincount(row[chars != 32], minlength=len(own)) > 0
        yield at, np.concatenate(hashed) if hashed else np.zeros(0, np.uint32), np.concatenate(rows) if rows else np.zeros(0, np.int32), letters
        at = end


class Model:
    """Weights, classes and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature
        self.table = (weights * idf[:, None] * GAIN).astype(np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, has a letter) of each text."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        for at, f, row, has in features(texts):
            n = np.bincount(row, minlength=len(has))
            for c in range(len(self.langs)):
                total = np.bincount(row, self.table[:, c][f], minlength=len(has))
                out[at : at + len(has), c] = total / np.maximum(1, n)
            letters[at : at + len(has)] = has
        return out + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        logits, letters = self.scores([t or "" for t in texts])
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1), 0.0).tolist()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, bias, temperature) from rows of (features, shares, class); every fifth row is for the temperature."""
    d = len(idf) + 1  # the last is the bias
    z, n = np.zeros((d, classes)), np.zeros((d, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    prepared = [(np.append(f, d - 1), np.append(s * idf[f] * GAIN, 1.0), c) for f, s, c in rows]
    learn = [x for i, x in enumerate(prepared) if i % 5 or len(rows) < 10]
    for _ in range(EPOCHS):
        for f, x, c in learn:
            w = weights(f)
            g = softmax(x @ w)
            g[c] -= 1
            grad = x[:, None] * g
            sigma = (np.sqrt(n[f] + grad * grad) - np.sqrt(n[f])) / ALPHA
            z[f] += grad - sigma * w
            n[f] += grad * grad
    all_w = weights(np.arange(d))
    held = [x for i, x in enumerate(prepared) if i % 5 == 0] or prepared
    logits = np.array([x @ all_w[f] for f, x, _ in held])
    truth = np.array([c for *_, c in held])
    grid = np.exp(np.linspace(-2.0, 2.5, 91))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return all_w[:-1], all_w[-1], float(grid[int(np.argmin(loss))])


def trained(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs (text, lang): all rows for document frequencies, `sample` rows for the weights."""
    lean(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_ = np.zeros(1 << BITS, np.int64), 0
        for b in (x for y in batches for x in portions(y, "text")):
            for _, f, row, has in features(b.column("text").to_pylist()):
                seen = np.unique(row.astype(np.int64) << BITS | f)
                total += np.bincount(seen & ((1 << BITS) - 1), minlength=1 << BITS)
                docs_ += len(has)
        at = np.flatnonzero(total)
        yield batch(arrow("f int, n long"), f=np.append(at, -1), n=np.append(total[at], docs_))

    df, count = np.zeros(1 << BITS), 0
    for r in rows.mapInArrow(frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # at most 2**BITS + 1 rows
        if r.f < 0:
            count = r.n
        else:
            df[r.f] = r.n
    idf = np.log((1 + count) / (1 + df)) + 1
    hashed = rows.withColumn("h", F.xxhash64("text", "lang"))
    edge = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in portions(y, "text")):
            langs, hs = b.column("lang"), b.column("h")
            for at, f, row, has in features(b.column("text").to_pylist()):
                cut = np.searchsorted(np.sort(row, kind="stable"), np.arange(len(has) + 1))
                f = f[np.argsort(row, kind="stable")]
                for i in range(len(has)):
                    own, times = np.unique(f[cut[i] : cut[i + 1]], return_counts=True)
                    if has[i]:
                        yield batch(arrow("h long, lang string, f array<long>, n array<long>"), h=hs.slice(at + i, 1), lang=langs.slice(at + i, 1), f=[own.astype(np.int64)], n=[times])

    got = hashed.where(F.col("h") <= edge).dropDuplicates(["h"]).mapInArrow(vectors, "h long, lang string, f array<long>, n array<long>").orderBy("h").toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    made = []
    for lang, f, n in zip(got["lang"].to_pylist(), got["f"], got["n"], strict=True):
        counts = n.values.to_numpy().astype(float)
        made.append((f.values.to_numpy(), counts / counts.sum(), langs.index(lang)))
    if not made:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    return Model(langs, idf, *fit(made, len(langs), idf))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added, from column text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS * languages numbers
    fields = [f.name for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    docs = docs.select(*fields)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in portions(y, "text")):
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def fold(docs: DataFrame):
    """crc32 of the doc_id's text modulo 3."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 3


def op10_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = trained(docs.where(fold(docs) != 1))
    rows = docs.select("doc_id", (fold(docs) == 1).alias("held_out"), "text")
    return predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_ftrl_language": op10_ftrl_language}
ORACLE_SQL: dict[str, str] = {}
