"""Page roles: an ordered list of rules, then continuation over neighbouring pages, then overrides.

Rules are boolean columns over one page and the first that holds wins, as coalesce() stops there. What goes on from
page to page is a running window over flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

# Patterns of archive stamps, legal lines, year ranges, contents lines, citations, index entries, pictures.
ARCHIVE = r"(?i)(digitized by the internet archive|the quick brown fox)"
LEGAL = r"(?i)\b(?:isbn|all rights reserved|printed in|copyright|code de la propriété intellectuelle)\b|^©"
FRONT_LINES = r"(?i)^a dissertation$|^presented to the faculty$|^of .*university$|^in candidacy for the degree$|^doctor of philosophy$|^copyright\b|^all rights reserved$|^library of congress\b|^printed in\b|^isbn\b|^©|^code de la propriété intellectuelle\b"
YEAR_RANGE = r"(?:\(|\b)([0-9]{4})\s*-\s*([0-9]{4})(?:\)|\b)"
CONTENTS_LINE = r"^\s*(?:[0-9]+(?:\.[0-9]+)*|[A-Za-z]?[0-9]+(?:\.[0-9]+)*)[.)]?\s+.+?\s+[0-9]+\s*$"
FIGURE_LINE = r"(?i)^\s*(?:fig(?:ure)?\.?|table|appendix)\s*[A-Za-z0-9.\-]*\s+.+?\s+[0-9]+\s*$"
DOTS = r"\.{3,}\s*(?:[0-9]{1,4})?\s*$"
NOTE_LINE = r"^\s*[0-9]{1,4}[A-Za-z]?\s*[.,)\]]\s*(.*\S.*)?$"
AUTHOR = r"(?:^|[.;]\s+)(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ'’\-]+,)"
CITATION = r"(?i)\b(?:Paris|Gallimard|Vrin|Press|University Press|trad\.?|pp\.|vol\.|n°|coll\.|Éditions?|Mercure de France|Cahiers du Sud|Rivages|Belin|Flammarion|Archimbaud)\b"
YEAR = r"\b(?:1[6-9][0-9]{2}|20[0-9]{2})\b"
INDEX_ENTRY = r"(?m)^\s*[A-ZÀ-ÖØ-Þ][^:\n]{1,120}:\s*[0-9]{1,4}"
PICTURE = r"(?i)(?:©|cm\b|mus[ée]e|biblioth[eè]que|gravure|huile|lithograph|dessin|eau-forte|collection)"


def page_lines(text: Column) -> Column:
    """Trimmed lines without tags; blank ones stay out."""
    bare = F.transform(F.split(F.regexp_replace(T.plain(text), "<[^>]+>", " "), "\n", -1), T.squeezed)
    return F.filter(bare, lambda x: x != "")


def holding(lines: Column, pattern: str) -> Column:
    """Number of lines in which a pattern occurs."""
    return F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(pattern))))


def within(page_no: Column, total: Column, least: int, share: float) -> Column:
    return page_no <= F.greatest(F.lit(least), F.floor(total * share))


def in_tail(page_no: Column, total: Column) -> Column:
    return (total >= 40) & (page_no >= F.greatest(F.lit(1), total - F.greatest(F.lit(12), F.floor(total * 0.04))))


def rule_chain(text: Column, page_no: Column, total: Column, heading: Column) -> Column:
    """struct(role, confidence, reason) of a page by the first rule that holds."""
    ls = page_lines(text)
    hit = lambda cond, role, confidence, reason: F.when(cond, F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason")))
    family = T.title_family(heading)
    other = family.isin("contents", "illustrations", "bibliography", "index", "appendix")
    head24 = F.slice(ls, 1, 24)
    return F.coalesce(
        hit(within(page_no, total, 6, 0.03) & F.regexp_like(text, F.lit(ARCHIVE)), "noise", 0.98, "archive_noise"),
        hit(within(page_no, total, 20, 0.08) & (F.size(head24) >= 8) & (holding(head24, YEAR_RANGE) >= 3), "other", 0.97, "early_course_listing"),
        hit(within(page_no, total, 20, 0.08) & (holding(F.slice(ls, 1, 20), LEGAL) >= 2), "front_matter", 0.95, "copyright_front_matter"),
        hit(within(page_no, total, 25, 0.08) & ~T.is_notes_heading(heading) & (((heading != "") & other) | (holding(head24, CONTENTS_LINE) + holding(head24, FIGURE_LINE) >= 4)), "other", 0.96, "early_other_list"),
        hit(in_tail(page_no, total) & (F.size(ls) >= 3) & (holding(F.slice(ls, 1, 40), DOTS) >= 6), "other", 0.95, "rear_toc_tail"),
        hit(in_tail(page_no, total) & (F.size(ls) == 0), "other", 0.90, "rear_sparse_other"),
        hit((heading != "") & T.is_notes_heading(heading), "note", 0.88, "notes_heading"),
        hit(within(page_no, total, 18, 0.08) & (holding(F.slice(ls, 1, 12), FRONT_LINES) >= 1), "front_matter", 0.92, "title_page"),
        hit((heading != "") & (family == "front_matter"), "front_matter", 0.90, "title_family"),
        hit((heading != "") & other, "other", 0.94, family),
        hit((page_no <= 2) & (F.trim(text) == ""), "noise", 0.60, "blank_front_page"),
        F.struct(F.lit("body").alias("role"), F.when(heading != "", 0.72).otherwise(0.62).alias("confidence"), F.lit("default_body").alias("reason")),
    )


def note_continuation(text: Column, page_no: Column, total: Column) -> Column:
    """Whether a page goes on with numbered notes."""
    ls = page_lines(text)
    n = holding(ls, NOTE_LINE)
    first = F.regexp_like(F.coalesce(F.get(ls, F.lit(0)), F.lit("")), F.lit(NOTE_LINE))
    return ~within(page_no, total, 8, 0.03) & (n >= 2) & (first | (F.size(ls) - n <= 1) | (n >= F.greatest(F.lit(4), F.floor(F.size(ls) / 2))))


def family_continuation(text: Column, family: Column) -> Column:
    flat = F.array_join(page_lines(text), " ")
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    bibliography = ((count(flat, AUTHOR) >= 2) & (count(flat, YEAR) >= 2)) | ((count(flat, CITATION) >= 3) & (count(flat, YEAR) >= 3))
    return F.when(family == "bibliography", bibliography).when(family == "index", count(text, INDEX_ENTRY) >= 2).when(family == "illustrations", (count(flat, r"\b[0-9]{1,3}\.\s+\S") >= 2) & (count(flat, PICTURE) >= 2)).otherwise(False)


def page_roles(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """df (book, page_no, total, text, heading) with role, confidence and reason after continuation and overrides
    (book, page_no, override)."""
    w = Window.partitionBy("book").orderBy("page_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    r = df.withColumn("r", rule_chain(F.col("text"), F.col("page_no"), F.col("total"), F.col("heading"))).select(*df.columns, "r.role", "r.confidence", "r.reason")
    # a run of front matter ends at the first body page with a heading
    early = F.col("page_no") <= F.greatest(F.lit(20), F.floor(F.col("total") * 0.08))
    mark = F.when(F.col("role") == "front_matter", "in").when((F.col("role") == "body") & (F.col("heading") != ""), "out")
    r = r.withColumn("run", F.last(mark, ignorenulls=True).over(so_far))
    more = early & (F.col("role") == "body") & (F.col("heading") == "") & (F.col("run") == "in")
    # a family of back matter goes on until a page that doesn't continue it
    seed = F.when((F.col("role") == "other") & F.col("reason").isin("bibliography", "index", "illustrations"), F.col("reason"))
    r = r.withColumn("seed", F.when((F.col("total") <= 20) | (F.col("page_no") >= F.greatest(F.lit(20), F.floor(F.col("total") * 0.6))), seed))
    r = r.withColumn("family", F.last("seed", ignorenulls=True).over(so_far))
    r = r.withColumn("goes_on", F.col("seed").isNotNull() | family_continuation(F.col("text"), F.col("family")))
    r = r.withColumn("since", F.count_if(F.col("seed").isNotNull()).over(so_far))
    inside = Window.partitionBy("book", "since").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("tail", (F.col("since") > 0) & F.col("seed").isNull() & F.bool_and("goes_on").over(inside))
    notes = F.col("role").isin("body", "front_matter") & note_continuation(F.col("text"), F.col("page_no"), F.col("total"))
    role = F.when(notes, "note").when(F.col("tail"), "other").when(more, "front_matter").otherwise(F.col("role"))
    confidence = F.when(notes, F.greatest(F.col("confidence"), F.lit(0.90))).when(F.col("tail"), F.greatest(F.col("confidence"), F.lit(0.93))).when(more, F.greatest(F.col("confidence"), F.lit(0.78))).otherwise(F.col("confidence"))
    reason = F.when(notes, "note_continuation").when(F.col("tail"), F.concat("family", F.lit("_continuation"))).when(more, "front_matter_continuation").otherwise(F.col("reason"))
    out = r.select(*df.columns, role.alias("role"), confidence.alias("confidence"), reason.alias("reason"))
    if overrides is not None:
        out = out.join(overrides, ["book", "page_no"], "left")
        given = F.col("override").isNotNull()
        out = out.select(*df.columns, F.coalesce("override", "role").alias("role"), F.when(given, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(given, "manual_override").otherwise(F.col("reason")).alias("reason"))
    return out
