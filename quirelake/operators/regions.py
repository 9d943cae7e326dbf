"""Regions of notes: runs of note pages, their scope and owner, ids; owners of endnotes; chapter bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.ordering import as_of, first_of

# Reasons at which a hinted run of notes stops.
STOP_REASONS = ("bibliography", "index", "appendix", "illustrations", "rear_toc_tail", "rear_author_blurb", "rear_sparse_other")


def hinted_roles(pages: DataFrame, key: list[str]) -> DataFrame:
    """pages (key, page_no, page_role, reason, confidence, hint: first page of endnotes or null) with the hint applied:
    from that page on body, other and front matter become notes, until a page of back matter behind a page of notes."""
    w = Window.partitionBy(*key).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.col("page_no") >= F.col("hint"), F.lit(False)) & F.coalesce(F.col("hint") > 0, F.lit(False))
    stops = behind & (F.col("page_role") == "other") & F.col("reason").isin(*STOP_REASONS)
    turns = F.col("page_role").isin("body", "other", "front_matter")
    # a note has been seen as soon as any page behind the hint is one or becomes one, which a stopping page itself may do
    rows = pages.withColumns({"_behind": behind, "_stops": stops, "_turns": turns}).withColumn("_seen", F.coalesce(F.max(F.col("_behind") & (F.col("_turns") | (F.col("page_role") == "note"))).over(w), F.lit(False)))
    rows = rows.withColumn("_stopped", F.coalesce(F.max(F.col("_stops") & F.col("_seen")).over(w), F.lit(False)))
    new = F.col("_behind") & F.col("_turns") & ~F.col("_stopped") & ~(F.col("_stops") & F.col("_seen"))
    out = rows.withColumns({"page_role": F.when(new, "note").otherwise(F.col("page_role")), "reason": F.when(new, "endnotes_start_page_hint").otherwise(F.col("reason")), "confidence": F.when(new, F.greatest("confidence", F.lit(0.90))).otherwise(F.col("confidence"))})
    return out.drop("_behind", "_stops", "_turns", "_seen", "_stopped")


def endnote_runs(pages: DataFrame, chapters: DataFrame, key: list[str]) -> DataFrame:
    """Runs of endnote pages: pages (key, page_no, chapter_no, is_note, has_blocks, heading, first_marker). A run ends at a gap, at a
    page with footnote blocks, and where its scope or chapter changes; scope is book behind the last chapter."""
    last = chapters.groupBy(*key).agg(F.max("end_page").alias("_last"), F.min("start_page").alias("_first"))
    rows = pages.where("is_note and not has_blocks").join(last, key, "left").where("page_no >= coalesce(_first, 0)")
    rows = rows.withColumn("scope", F.when(F.col("page_no") > F.coalesce("_last", F.lit(0)), "book").otherwise("chapter")).withColumn("_owner", F.when(F.col("scope") == "chapter", F.col("chapter_no")))
    w = Window.partitionBy(*key).orderBy("page_no")
    same = (F.col("page_no") - F.lag("page_no").over(w) == 1) & (F.col("scope") == F.lag("scope").over(w)) & F.col("_owner").eqNullSafe(F.lag("_owner").over(w))
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    first = lambda c: F.coalesce(F.min_by(c, "page_no"), F.lit(""))
    return rows.groupBy(*key, "_run", "scope", F.col("_owner").alias("chapter_no")).agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.array_sort(F.collect_list("page_no")).alias("pages"), first("heading").alias("heading_text"), first("first_marker").alias("first_marker")).drop("_run")


def promoted(regions: DataFrame, chapters: DataFrame, key: list[str]) -> DataFrame:
    """Chapter regions behind the last chapter become the book's, without a chapter."""
    last = chapters.groupBy(*key).agg(F.max("end_page").alias("_last"))
    up = (F.col("scope") != "book") & (F.col("page_start") > F.coalesce("_last", F.lit(0)))
    return regions.join(last, key, "left").withColumns({"promoted": up, "scope": F.when(up, "book").otherwise(F.col("scope")), "chapter_no": F.when(~up, F.col("chapter_no"))}).drop("_last")


def split_by_headings(regions: DataFrame, headings: DataFrame, key: list[str]) -> DataFrame:
    """Book regions (key, region_id, pages, chapter_no) cut before each page but the first whose heading (key, page_no, chapter_no)
    is a chapter's; a part belongs to the heading's chapter."""
    rows = regions.select(*key, "region_id", F.col("chapter_no").alias("_own"), F.posexplode("pages").alias("_i", "page_no")).join(headings.select(*key, "page_no", F.col("chapter_no").alias("_named")), [*key, "page_no"], "left")
    w = Window.partitionBy(*key, "region_id").orderBy("_i")
    rows = rows.withColumn("_part", F.sum(F.when((F.col("_i") > 0) & F.col("_named").isNotNull(), 1).otherwise(0)).over(w))
    out = rows.groupBy(*key, "region_id", "_part").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.count("*").alias("n_pages"), F.min_by("_named", "_i").alias("_named"), F.first("_own").alias("_own"))
    return out.select(*key, "region_id", (F.col("_part") + 1).alias("part"), "page_start", "page_end", "n_pages", F.coalesce("_named", "_own").alias("chapter_no"), F.col("_named").isNotNull().alias("rebound"))


def with_ids(regions: DataFrame, key: list[str]) -> DataFrame:
    """Serial ids in the order of pages, kind, scope and chapter."""
    w = Window.partitionBy(*key).orderBy("page_start", "page_end", "note_kind", "scope", F.coalesce(F.col("chapter_no").cast("string"), F.lit("")))
    tag = lambda c, yes, a, b: F.when(F.col(c) == yes, a).otherwise(b)
    name = F.concat_ws("-", F.lit("nr"), tag("note_kind", "footnote", "fn", "en"), tag("scope", "chapter", "ch", "bk"), F.lpad(F.row_number().over(w).cast("string"), 4, "0"), F.coalesce(F.col("chapter_no").cast("string"), F.lit("none")))
    return regions.withColumn("region_id", name)


def first_endnote_pages(regions: DataFrame, key: list[str]) -> DataFrame:
    return regions.where("note_kind = 'endnote' and scope = 'chapter' and chapter_no is not null").groupBy(*key, "chapter_no").agg(F.min("page_start").alias("start_page"))


def fallback_owners(items: DataFrame, chapters: DataFrame, key: list[str]) -> DataFrame:
    """items (key, item_id, region_id, page_no, owner) with an owner for each: its own, the chapter that holds the page,
    the nearest one before, else the first; `mode` says which."""
    starts = chapters.select(*key, F.col("start_page").alias("_start"), F.col("chapter_no").alias("_chapter"), F.col("end_page").alias("_end"))
    out = as_of(items, starts, key, "page_no", "_start", ["_chapter", "_end"])
    first = first_of(chapters.select(*key, "chapter_no", "start_page"), key, [F.col("start_page")]).select(*key, F.col("chapter_no").alias("_first"))
    out = out.join(first, key, "left")
    mode = F.when(F.col("owner").isNotNull(), "own").when(F.col("_chapter").isNotNull() & (F.col("page_no") <= F.col("_end")), "page").when(F.col("_chapter").isNotNull(), "prior").otherwise("first")
    return out.withColumns({"mode": mode, "owner": F.coalesce("owner", "_chapter", "_first")}).drop("_chapter", "_end", "_first")


def region_owners(items: DataFrame, key: list[str]) -> DataFrame:
    """The most frequent owner of a region's items, with its share; of equally frequent ones the first chapter."""
    counts = items.where("owner is not null").groupBy(*key, "region_id", "owner").agg(F.count("*").alias("_n"))
    out = counts.groupBy(*key, "region_id").agg(F.max_by("owner", F.struct(F.col("_n"), -F.col("owner"))).alias("owner"), F.max("_n").alias("_m"), F.sum("_n").alias("_all"))
    return out.select(*key, "region_id", "owner", F.round(F.col("_m") / F.col("_all"), 4).alias("share"))


def binding_summary(regions: DataFrame, items: DataFrame, chapters: DataFrame, key: list[str]) -> DataFrame:
    """Regions without a chapter of the book, and items without an owner."""
    known = chapters.select(*key, F.col("chapter_no").alias("owner"), F.lit(1).alias("_known")).distinct()
    free = lambda df, name: df.join(known, [*key, "owner"], "left").groupBy(*key).agg(F.count_if(F.col("_known").isNull()).alias(name))
    return free(regions, "unbound_regions").join(free(items, "unassigned_items"), key, "full").na.fill(0, ["unbound_regions", "unassigned_items"])


def stream_summary(items: DataFrame, key: list[str], most: Column | int = 100) -> DataFrame:
    """Endnotes by chapter and way of projection, with chapters of `most` or more flagged."""
    out = items.groupBy(*key, "owner").agg(F.count("*").alias("n"), *(F.count_if(F.col("mode") == m).alias(m) for m in ("own", "page", "prior", "first")))
    return out.withColumn("large", F.col("n") >= most)


def body_markers(anchors: DataFrame, note_pages: DataFrame, key: list[str]) -> DataFrame:
    """The set of markers of each chapter's body, without pages of notes."""
    return anchors.join(note_pages.select(*key, "page_no"), [*key, "page_no"], "left_anti").groupBy(*key, "chapter_no").agg(F.array_sort(F.collect_set("marker")).alias("markers"))


def alignment_summary(regions: DataFrame, key: list[str]) -> DataFrame:
    """Of the chapter regions of endnotes: how many have their first marker right, and which chapters don't."""
    own = regions.where("note_kind = 'endnote' and scope = 'chapter'")
    wrong = F.array_sort(F.collect_set(F.when(~F.col("aligned"), F.col("chapter_no"))))
    return own.groupBy(*key).agg(F.count("*").alias("regions"), F.count_if("aligned").alias("aligned"), wrong.alias("misaligned_chapters"))


def renumbered(items: DataFrame, key: list[str]) -> DataFrame:
    """Footnotes of books that have nothing else, numbered from one in each chapter in order of page and place."""
    w = Window.partitionBy(*key, "chapter_no").orderBy("page_no", "item_id")
    return items.withColumn("number", F.row_number().over(w))
