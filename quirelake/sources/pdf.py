"""What PDF files give, by pluggable readers, and contents lists from their bookmarks and links.

No PDF library is assumed: a reader is a function from a file's bytes to rows of one of the contracts below. It runs inside
mapInPandas on binary files, a file at a time; a lost executor repeats its own files only. What can be said of the rows in
terms of tables (contents from bookmarks or links, labels, chunks, picked pages) is said here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

#: Contracts of readers and model calls: name to the columns of the rows that they give.
CONTRACTS = {
    "text_items": "page_no int, x double, y double, width double, height double, font string, size double, text string",
    "bookmarks": "position int, level int, title string, file_idx int",
    "links": "file_idx int, x double, y double, target int, line string",
    "labels": "file_idx int, label string",
    "images": "file_idx int, png binary",
    "single_pages": "file_idx int, pdf binary",
    "layout": "file_idx int, layout string",
}
CHUNK_PAGES, FRONT_SHARE, FRONT_LEAST, LEAST_LINKS, ASCENDING, INDENT = 90, 0.3, 20, 3, 0.6, 15.0


def rows(spark: SparkSession, path: str, contract: str, reader: Callable[[bytes], list[dict]], pages: list[int] | None = None) -> DataFrame:
    """file and the contract's columns of each PDF file at a path. pages: only these; a reader that takes a second
    argument gets them and need not read others."""
    kind = CONTRACTS[contract]
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import inspect

        wants = len(inspect.signature(reader).parameters) > 1
        for p in batches:
            for path_, content in zip(p["path"], p["content"], strict=True):
                got = reader(bytes(content), pages) if wants else reader(bytes(content))
                out = pd.DataFrame(got, columns=names)
                out.insert(0, "file", path_)
                yield out

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {kind}")
    page = "page_no" if "page_no" in names else "file_idx"
    return out.where(F.col(page).isin(*pages)) if pages else out


def chunks(files: DataFrame, size: int = CHUNK_PAGES) -> DataFrame:
    """Page ranges of files (file, n_pages) that are sent apart."""
    starts = F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(size))
    return files.where("n_pages > 0").select("file", F.posexplode(starts).alias("chunk", "first"), "n_pages").select("file", "chunk", "first", F.least(F.col("first") + size, F.col("n_pages")).alias("end"))


def bookmark_contents(bookmarks: DataFrame) -> DataFrame:
    """title, depth and file_idx of bookmarks in order; without titles or pages they go."""
    return bookmarks.where("trim(coalesce(title, '')) <> '' and file_idx >= 0").select("file", "position", T.squeezed(F.col("title")).alias("title"), (F.col("level") - 1).alias("depth"), "file_idx")


def link_contents(links: DataFrame, files: DataFrame) -> DataFrame:
    """A contents list from the links of front pages: pages (the first 30 %, twenty at least) with half the most links of a page or
    more, whose targets mostly ascend; the first link of each target; its line without the page number; indented lines are
    one deeper."""
    front = links.join(files.select("file", "n_pages"), "file").where(F.col("file_idx") < F.least(F.col("n_pages"), F.greatest(F.lit(FRONT_LEAST), F.floor(F.col("n_pages") * FRONT_SHARE))))
    per_page = front.groupBy("file", "file_idx").agg(F.count("*").alias("_n"), F.min("x").alias("_left"))
    most = per_page.groupBy("file").agg(F.max("_n").alias("_most")).where(f"_most >= {LEAST_LINKS}")
    own = front.join(per_page, ["file", "file_idx"]).join(most, "file").where(F.col("_n") >= F.greatest(F.lit(LEAST_LINKS), F.col("_most") * 0.5)).where("target >= 0")
    beside = F.lag("target").over(Window.partitionBy("file", "file_idx").orderBy("y", "x", "target"))
    rising = own.withColumn("_up", F.when(beside.isNotNull(), F.col("target") >= beside)).groupBy("file", "file_idx").agg(F.count_if("_up").alias("_ups"), F.count("_up").alias("_pairs"), F.count("*").alias("_m"))
    own = own.join(rising.where(f"_m >= {LEAST_LINKS} and _ups >= {ASCENDING} * greatest(1, _pairs)"), ["file", "file_idx"])
    title = T.squeezed(F.regexp_replace(T.squeezed(F.col("line")), r"\s+[0-9]+\s*$", ""))
    own = own.withColumns({"title": title, "depth": F.when(F.col("x") > F.col("_left") + INDENT, 1).otherwise(0)}).where("title <> '' and not title rlike '^[0-9]+$'")
    first = own.groupBy("file", "target").agg(F.min(F.struct("file_idx", "y", "x", "title", "depth")).alias("f"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("f.file_idx", "f.y", "f.x"))
    return first.select("file", place.alias("visual_order"), "f.title", "f.depth", F.col("target").alias("file_idx"))


def page_targets(links: DataFrame, file_idx: int) -> DataFrame:
    """The link targets of one page in visual order."""
    w = Window.partitionBy("file").orderBy("y", "x", "target")
    return links.where((F.col("file_idx") == file_idx) & (F.col("target") >= 0)).select("file", F.row_number().over(w).alias("visual_order"), "target", "line")


def aligned_labels(labels: DataFrame, files: DataFrame) -> DataFrame:
    """A label for each page of a file; empty where the file has none."""
    every = files.select("file", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("file_idx"))
    return every.join(labels.groupBy("file", "file_idx").agg(F.min("label").alias("label")), ["file", "file_idx"], "left").na.fill("", ["label"])
