"""Small sinks and record shapes: contents lists as CSV, bundles as JSON, per-document stores, override maps, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.folds import repaired
from quirelake.sources.files import replace_partitions

# The mark that tells a spreadsheet program of UTF-8, scores of sections without a contents list.
BOM = "﻿"
KEEP_AT = 2.0
FAMILIES_OUT = ("contents", "illustrations", "bibliography", "index", "appendix")


def contents_csv(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One CSV text per group, with a byte order mark and a header; rows in order. Fields are quoted where they need it."""
    def field(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(F.regexp_like(v, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    line = F.concat_ws(",", *map(field, columns))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(*key).agg(F.concat(F.lit(BOM + ",".join(columns) + "\r\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\r\n"))), "")).alias("csv"))


def bundle_json(files: DataFrame, key: list[str]) -> DataFrame:
    """One JSON object per book from its files (name, content), names in order."""
    entries = F.array_sort(F.collect_list(F.struct("name", "content")))
    return files.groupBy(*key).agg(F.to_json(F.map_from_entries(entries)).alias("bundle"))


def split_store(spark: SparkSession, tables: dict[str, DataFrame], catalog: str, path: str, by: str) -> None:
    """One store as a catalogue table and tables partitioned by document: doing it twice changes nothing, and each document's
    partition moves into place once it is whole."""
    for name, df in tables.items():
        if name == catalog:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            replace_partitions(df, f"{path}/{name}", [by])


def override_groups(overrides: DataFrame, key: list[str]) -> DataFrame:
    """Overrides (key, scope, target_id, payload) as a map from scope to a map from target to payload; the last seq wins."""
    last = overrides.where("trim(coalesce(scope, '')) <> '' and trim(coalesce(target_id, '')) <> ''").groupBy(*key, "scope", "target_id").agg(F.max_by("payload", "seq").alias("payload"))
    inner = last.groupBy(*key, "scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target_id", "payload")))).alias("m"))
    return inner.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scope", F.to_json("m").alias("j"))))).alias("overrides"))


def repaired_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with shifted text mended, and whether anything changed."""
    out = pages.withColumn("_new", repaired(F.col(text)))
    return out.withColumn("mended", ~F.col("_new").eqNullSafe(F.col(text))).withColumn(text, F.col("_new")).drop("_new")


def encoding_pattern(c: Column) -> Column:
    """How many characters of a text are letters, digits, white space, other ASCII, accented Latin, Chinese or Japanese, private or
    control, and others."""
    t = T.plain(c)
    n = lambda p: F.regexp_count(t, F.lit(p))
    kinds = {"letters": "[A-Za-z]", "digits": "[0-9]", "spaces": r"\s", "marks": r"[!-/:-@\[-`{-~]", "latin": "[À-ɏ]", "cjk": r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]", "odd": r"[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0b\x0e-\x1f]"}
    found = F.struct(*(n(p).alias(k) for k, p in kinds.items()))
    return T.let(found, lambda x: F.struct(*(x[k].alias(k) for k in kinds), (F.char_length(t) - sum((x[k] for k in kinds), F.lit(0))).alias("others")))


def fallback_sections(sections: DataFrame, key: list[str]) -> DataFrame:
    """Sections of a book without a contents list, scored as chapters: sections (key, section_no, title, start_role, span, visual, top_title,
    font, strength). Titles of other parts, on pages that are no body, or that are sentences without strong evidence are
    rejected with a reason; 2.0 keeps one; if none is kept the best of a book is."""
    title, strong = T.squeezed(F.col("title")), F.col("visual") | F.col("top_title") | F.col("font") | (F.col("strength") >= 1)
    reason = F.when(title == "", "invalid_title").when(F.col("start_role").isin("noise", "other"), "partition_conflict").when(F.col("start_role") == "note", "note_partition").when(T.is_notes_heading(title), "note_heading").when(T.title_family(title).isin(*FAMILIES_OUT), "non_body_family").when(T.is_sentence_like(title) & ~strong, "sentence_like")
    span = F.when(F.col("span") >= 4, 1.2).when(F.col("span") == 3, 0.5).when(F.col("top_title") | F.col("visual"), -0.8).otherwise(-1.8)
    score = F.when(F.col("visual"), 3.0).otherwise(0.0) + F.when(F.col("top_title"), 1.8).otherwise(0.0) + F.when(F.col("font"), 1.2).otherwise(0.0) + F.when(F.col("top_title") & (F.col("strength") >= 1), 1.2).otherwise(0.0) + span + F.col("strength")
    out = sections.withColumn("reject_reason", reason).withColumn("score", F.when(F.col("reject_reason").isNull(), F.round(score, 4)))
    best = out.groupBy(*key).agg(F.max(F.coalesce(F.col("score") >= KEEP_AT, F.lit(False))).alias("_any"), F.max_by("section_no", F.struct(F.coalesce("score", F.lit(-99.0)), -F.col("section_no"))).alias("_best"))
    out = out.join(best, key)
    return out.withColumn("kept", F.coalesce(F.col("score") >= KEEP_AT, F.lit(False)) | (~F.col("_any") & (F.col("section_no") == F.col("_best")))).drop("_any", "_best")


def owning_sections(sections: DataFrame, key: list[str]) -> DataFrame:
    """Each section with the last kept section at or before it, as its chapter. A window over one book's sections."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("chapter_no", F.last(F.when(F.col("kept"), F.col("section_no")), ignorenulls=True).over(w))
