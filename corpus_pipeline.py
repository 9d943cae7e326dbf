"""From raw documents to token ids: each stage works on all that its predecessor kept.

Nulls, empty and very long texts, repeated rows and empty tables are handled as the stages' operators state; columns
of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import language, piece_scan, private_data, shingles, simhash, winnowing
from quirelake.llm.common import Scratch, read

LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts of no learned language, or of an unsure one, go."""
    columns = docs.columns
    model = language.trained(docs.where(language.fold(docs) != 1))
    return language.predicted(docs, model).where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select(*columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup at a similarity of 0.8 on five-word shingles: the document with the least doc_id of each group stays."""
    return simhash.one_of_each(docs, shingles.near_copies(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return winnowing.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span is replaced by the name of its kind."""
    return private_data.redacted(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword encoding and decoding: doc_id, ids, and the text that they give back."""
    return piece_scan.encoded(docs, piece_scan.model_path(), decode=True, merges=True)


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("private_data", redact), ("pieces", tokenise)]

#: SQL can't express trained models, components or segmentations; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
