"""File sources and sinks: layout JSON, contents and glossary lists, workbook rows, manifests; partition overwrite,
zip bundles, revision logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import text as T

BLOCK = "struct<block_label: string, block_content: string, block_order: int, block_bbox: array<double>>"
PAGE = f"struct<prunedResult: struct<width: int, height: int, parsing_res_list: array<{BLOCK}>>, markdown: struct<text: string>>"
LAYOUT = f"layoutParsingResults array<{PAGE}>, pages array<{PAGE}>, results array<{PAGE}>, prunedResult struct<width: int, height: int, parsing_res_list: array<{BLOCK}>>, markdown struct<text: string>"


def layout_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of layout JSON files: a list of pages, or an object that holds them under one of three names. Blocks are
    ordered by their order, then top, then left; text is sanitised; indent is the least left edge plus ten."""
    raw = spark.read.schema(LAYOUT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    own = F.struct(F.col("prunedResult"), F.col("markdown"))
    listed = F.coalesce("layoutParsingResults", "pages", "results", F.array(own))
    p = raw.withColumn("_in_file", F.monotonically_increasing_id()).select("file", "_in_file", F.posexplode(listed).alias("page_no", "p"))
    key = lambda b: F.struct(F.coalesce(b["block_order"], F.lit(1_000_000_000)), F.coalesce(F.get(b["block_bbox"], F.lit(1)), F.lit(0.0)), F.coalesce(F.get(b["block_bbox"], F.lit(0)), F.lit(0.0)))
    keyed = F.array_sort(F.transform(F.coalesce("p.prunedResult.parsing_res_list", F.array()), lambda b: F.struct(key(b).alias("k"), b.alias("b"))))
    blocks = F.transform(keyed, lambda x: F.struct(T.sanitised(x["b"]["block_content"]).alias("text"), F.get(x["b"]["block_bbox"], F.lit(0)).alias("x"), x["b"]["block_bbox"].alias("bbox"), x["b"]["block_label"].alias("label"), T.is_meta(x["b"]["block_content"]).alias("is_meta"), T.heading_level(x["b"]["block_content"]).alias("heading_level")))
    out = p.select("file", "page_no", F.col("p.prunedResult.width").alias("width"), F.col("p.prunedResult.height").alias("height"), F.coalesce("p.markdown.text", F.lit("")).alias("markdown"), blocks.alias("blocks"))
    foot = lambda b: b["label"].isin("footnote", "footer_note")
    return out.select("file", "page_no", "width", "height", "markdown", F.filter("blocks", lambda b: ~foot(b)).alias("blocks"), F.filter("blocks", foot).alias("note_blocks"), F.when(F.size("blocks") > 1, F.array_min(F.transform("blocks", lambda b: b["x"])) + 10).alias("indent"))


def without_running_heads(pages: DataFrame, book: list[str], top: float = 0.12, bottom: float = 0.08) -> DataFrame:
    """Pages without blocks of the head and foot zones whose text recurs on at least a quarter of the book's pages, and
    three; texts are counted by sums, and known ones go by an equi-join."""
    b = pages.select(*book, "page_no", "height", F.posexplode("blocks").alias("i", "b"))
    middle = (F.get("b.bbox", F.lit(1)) + F.get("b.bbox", F.lit(3))) / 2
    zone = (middle < top * F.col("height")) | (middle > (1 - bottom) * F.col("height"))
    b = b.withColumn("t", F.lower(T.squeezed(F.col("b.text")))).withColumn("zone", F.coalesce(zone, F.lit(False)) & (F.char_length("b.text") <= 120))
    n = pages.groupBy(*book).agg(F.count("*").alias("n"))
    often = b.where("zone and char_length(t) >= 2").groupBy(*book, "t").agg(F.count("*").alias("c")).join(n, book).where("n >= 3 and c >= greatest(3, floor(0.25 * n))").select(*book, "t", F.lit(True).alias("often"))
    short = (F.char_length("t") < 50) & ~F.regexp_like("t", F.lit("[.;:?!]$"))
    fixed = F.regexp_like("t", F.lit(r"^[0-9]{1,4}$|^[0-9]{1,4}\s+\w|\w.*[0-9]{1,4}$"))
    kept = b.join(often, [*book, "t"], "left").where(~(F.col("zone") & (F.coalesce("often", F.lit(False)) | short | fixed)))
    blocks = kept.groupBy(*book, "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("_blocks"))
    return pages.join(blocks, [*book, "page_no"], "left").withColumn("blocks", F.coalesce("_blocks", F.slice("blocks", 1, 0))).drop("_blocks").where("size(blocks) > 0 or size(note_blocks) > 0")


def contents_list(spark: SparkSession, path: str) -> DataFrame:
    """title, depth, book_page of comma-separated contents files; head rows and rows without a page go."""
    rows = spark.read.schema("title string, depth string, page string").option("encoding", "UTF-8").csv(path)
    rows = rows.select(F.regexp_replace(F.trim("title"), "^﻿", "").alias("title"), F.coalesce(F.trim("depth").try_cast("int"), F.lit(0)).alias("depth"), F.trim("page").try_cast("int").alias("book_page"))
    return rows.where("book_page is not null and book_page > 0 and title <> ''")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, target of comma-separated glossaries; head rows and incomplete rows go."""
    rows = spark.read.schema("term string, target string").csv(path)
    rows = rows.select(F.regexp_replace(F.trim("term"), "^﻿", "").alias("term"), F.trim("target").alias("target"))
    return rows.where("term <> '' and target <> '' and lower(term) not in ('term', 'source', 'original', '原文', '术语')")


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, value of the first sheet of spreadsheet workbooks."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
                    sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
                    for c in ElementTree.fromstring(z.read(sheet)).iter(f"{space}c"):
                        ref = c.get("r", "A1")
                        col = 0
                        for ch in re.sub("[^A-Z]", "", ref):
                            col = col * 26 + ord(ch) - 64
                        v = c.find(f"{space}v")
                        value = "".join(t.text or "" for t in c.iter(f"{space}t")) if c.get("t") == "inlineStr" else v.text if v is not None else ""
                        rows.append((name, int(re.sub("[^0-9]", "", ref)), col - 1, shared[int(value)] if c.get("t") == "s" else value))
                f, r, c_, v_ = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"file": list(f), "row": pa.array(r, pa.int32()), "col": pa.array(c_, pa.int32()), "value": list(v_)}, schema=pa.schema([("file", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row int, col int, value string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Books of a manifest file."""
    book = "struct<slug: string, folder: string, `group`: string, doc_name: string, doc_id: string, include_in_default_batch: boolean, expected_page_count: int>"
    return spark.read.schema(f"books array<{book}>").option("multiLine", True).json(path).select(F.inline("books"))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that df has rows for; each moves into place once it is whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def delete_phases(spark: SparkSession, path: str, key: str, value: str, from_phase: int) -> None:
    """Drop the partitions of one document from a phase on; the table is partitioned by (key, phase)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(root) if fs.exists(root) else []:
        phase = s.getPath().getName()
        if phase.startswith("phase=") and int(phase[6:]) >= from_phase:
            fs.delete(s.getPath(), True)


def append_revisions(df: DataFrame, path: str) -> None:
    """Add rows to a log that is never rewritten; its newest row per key is the state."""
    df.write.mode("append").parquet(path)


def bundles(files: DataFrame, book: str) -> DataFrame:
    """One zip per book of its files (name, content): safe relative names in order, equal bytes for equal input."""

    def run(p):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(p["name"], p["content"], strict=True)):
                if not name.startswith("/") and ".." not in name.split("/"):
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        return pd.DataFrame({book: [p[book].iloc[0]], "zip": [out.getvalue()]})

    return files.groupBy(book).applyInPandas(run, f"{book} {files.schema[book].dataType.simpleString()}, zip binary")


def json_or(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, or a default where it is missing or broken."""
    return F.coalesce(F.from_json(text, schema), default)
