"""Contents lists cleaned and anchored: duplicate rows, semantic roles, links, heading evidence, heading graph.

Rows of a contents list meet by equi-joins on book, page and key; nothing compares all rows of a book with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.ordering import first_of

# Titles of contents lists, number prefixes, roles that stand without a page, evidence scores.
CONTAINER = r"(?i)^(table|table of contents|table des mati[eè]res|contents?|sommaire|toc|目录|目錄|目次|목차|차례|inhalt|inhaltsverzeichnis|[ií]ndice|contenido|sum[aá]rio|sommario|содержание|оглавление|inhoud|inhoudsopgave|المحتويات|الفهرس|index)$"
PREFIX = r"^\s*([0-9]+|[ivxlcdmIVXLCDM]+)[.):]\s+"
PURE_NUMBER = r"^\s*([0-9]+|[ivxlcdmIVXLCDM]+)[.)]?\s*$"
STAND_ALONE = ("container", "endnotes", "post_body", "back_matter", "front_matter")
NAVIGABLE = ("chapter", "section", "post_body")
SOURCE_SCORES = {"composite": 320, "doc_title": 300, "markdown_heading": 220, "block": 180, "font_band": 160}
LOCAL, WIDE, NEARBY = (-1, 2), (-6, 10), 12


def title_key(c: Column) -> Column:
    return T.title_key(c)


def is_summary(c: Column) -> Column:
    """A title that is a text: 18 words, 120 characters, or 12 words with a sentence mark."""
    t = F.trim(T.plain(c))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (words >= 18) | (F.char_length(t) >= 120) | ((words >= 12) & F.regexp_like(t, F.lit("[.:;!?]")))


def kept_rows(rows: DataFrame) -> DataFrame:
    """Rows (title, printed_page, file_idx, role) without empty titles and, where neither page is known and the role does not stand
    alone, without titles of contents lists and texts."""
    t = T.squeezed(F.col("title"))
    loose = F.col("printed_page").isNull() & F.col("file_idx").isNull() & ~F.coalesce(F.col("role").isin(*STAND_ALONE), F.lit(False))
    return rows.withColumn("title", t).where((t != "") & ~(loose & (F.regexp_like(t, F.lit(CONTAINER)) | is_summary(t))))


def with_link_targets(rows: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, visual_order, file_idx) whose missing file_idx comes from the link (key, visual_order, target) at the same place."""
    links = targets.groupBy(*key, "visual_order").agg(F.max("target").alias("_target"))
    return rows.join(links, [*key, "visual_order"], "left").withColumn("file_idx", F.coalesce("file_idx", "_target")).drop("_target")


def offset_summary(rows: DataFrame, key: list[str]) -> DataFrame:
    """How many rows a reader can jump to, and how many of them have a page."""
    need = F.col("role").isin(*NAVIGABLE)
    out = rows.groupBy(*key).agg(F.count_if(need).alias("navigable"), F.count_if(need & F.col("file_idx").isNotNull()).alias("ready"))
    return out.withColumn("unresolved", F.col("navigable") - F.col("ready"))


def _marked(rows: DataFrame, hit: DataFrame, key: list[str], name: str) -> DataFrame:
    return rows.join(hit.select(*key, "row_id").distinct().withColumn(name, F.lit(True)), [*key, "row_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def composite_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, row_id, title, parent, page_no, role) with `suppressed`: a chapter row whose title joins its parent's
    title and a sibling's on the same page."""
    own = rows.where("role = 'chapter' and page_no > 0 and trim(parent) <> ''").withColumns({"_k": title_key(F.col("title")), "_p": title_key(F.col("parent"))}).where("_k <> '' and _p <> ''")
    joined = own.where(F.contains("_k", F.col("_p")))
    single = own.where(~F.contains("_k", F.col("_p"))).select(*key, "page_no", "_p", F.col("_k").alias("_s"))
    hit = joined.join(single, [*key, "page_no", "_p"]).where(F.contains("_k", F.col("_s")) & (F.col("_k") != F.col("_s")))
    return _marked(rows, hit, key, "suppressed")


def split_headings(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with `title` and `suppressed`: a numbered row whose bare title begins a longer row of the same page takes the bare title, and
    the longer rows fall."""
    bare = T.squeezed(F.regexp_replace("title", PREFIX, ""))
    chapters = rows.where("role = 'chapter' and page_no > 0")
    short = chapters.where(F.regexp_like("title", F.lit(PREFIX))).select(*key, "page_no", F.col("row_id").alias("_short"), bare.alias("_bare")).where("_bare <> ''")
    met = chapters.join(short, [*key, "page_no"]).where((F.col("row_id") != F.col("_short")) & F.startswith(T.squeezed(F.col("title")), F.concat("_bare", F.lit(" "))))
    out = _marked(rows, met, key, "suppressed")
    out = _marked(out, met.select(*key, F.col("_short").alias("row_id")), key, "_merged")
    return out.withColumn("title", F.when(F.col("_merged"), T.squeezed(F.regexp_replace("title", PREFIX, ""))).otherwise(F.col("title"))).drop("_merged")


def numeric_root_noise(rows: DataFrame, key: list[str], gap: int = NEARBY) -> DataFrame:
    """rows with `suppressed`: a root row that is a bare number, has two or more children that are all bare numbers, and
    stands within `gap` pages of a root row with words. Pages meet by bins."""
    number = lambda c: F.regexp_like(c, F.lit(PURE_NUMBER))
    children = rows.where("trim(parent) <> ''").groupBy(*key, T.squeezed(F.col("parent")).alias("_t")).agg(F.count("*").alias("_n"), F.count_if(number(F.col("title"))).alias("_d")).where("_n >= 2 and _n = _d")
    roots = rows.where("role = 'chapter' and trim(parent) = ''")
    bare = roots.where(number(F.col("title"))).withColumn("_t", T.squeezed(F.col("title"))).join(children, [*key, "_t"])
    bins = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("page_no") - gap) / gap), F.floor((F.col("page_no") + gap) / gap))))
    worded = roots.where(~number(F.col("title"))).select(*key, F.col("page_no").alias("_page"), F.floor(F.col("page_no") / gap).alias("_bin"))
    hit = bins(bare).join(worded, [*key, "_bin"]).where(F.abs(F.col("page_no") - F.col("_page")) <= gap)
    return _marked(rows, hit, key, "suppressed")


def title_variants(c: Column) -> Column:
    """The key of a title without its number, under which variants of it meet."""
    return title_key(F.regexp_replace(T.squeezed(c), PREFIX, ""))


def merged_trees(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two contents trees (key, title, parent, depth, page_no, visual_order) as one: rows are the same where title without number and
    parent agree; the longer title, the lesser depth, a known page and the earlier place win."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    both = both.withColumns({"_k": title_variants(F.col("title")), "_p": title_variants(F.col("parent"))}).where("_k <> ''")
    out = both.groupBy(*key, "_k", "_p").agg(
        F.max_by(T.squeezed(F.col("title")), F.struct(F.char_length("title"), -F.col("_side"), F.col("title"))).alias("title"), F.max("parent").alias("parent"), F.min("depth").alias("depth"),
        F.min_by("page_no", F.struct(F.isnull("page_no"), F.col("_side"), F.col("page_no"))).alias("page_no"), F.min(F.struct("visual_order", "_side"))["visual_order"].alias("visual_order"), F.count_distinct("_side").alias("sides"),
    )
    return out.drop("_k", "_p")


def semantic_role(title: Column, role: Column, level: Column, chapter_level: Column, page_role: Column) -> Column:
    """The role of a contents row: what it was given, else by family, shape, page and level."""
    t = T.squeezed(title)
    low, given = F.lower(t), F.lower(F.regexp_replace(T.plain(role), "-", "_"))
    family = T.title_family(t)
    like = lambda p: F.regexp_like(low, F.lit(p))
    notes = like(r"^(notes?|endnotes?|notes to pages?.*)$")
    excluded = family.isin("contents", "illustrations", "bibliography", "index", "appendix", "front_matter")
    front = like(r"^(acknowledg(e)?ments?|remerciements?|list of abbreviations|liste des abr[eé]viations|list of illustrations|liste des illustrations)")
    chapter = like(r"^(chapter|chapitre|lecture|lesson|le[cç]on)\s+[0-9ivxlcdm]+") | F.regexp_like(t, F.lit(r"^[0-9]+[.)]\s+\S"))
    part = like(r"^(part|partie|book|livre)\s+([0-9]+|[ivxlcdm]+|one|two|three|four|five)")
    capitals = F.char_length(F.regexp_replace(t, r"\P{Lu}", "")) >= 0.7 * F.char_length(F.regexp_replace(t, r"\P{L}", ""))
    book = (page_role == "front_matter") & (level <= chapter_level)
    return (
        F.when(t == "", "unknown").when(given == "container", "part").when(given == "endnotes", "endnotes")
        .when((given == "back_matter") & like(r"^(appendix|appendices|annex(es)?)([^a-z]|$)") & ~page_role.isin("note", "noise"), "post_body")
        .when(given.isin("chapter", "section", "post_body", "back_matter", "front_matter"), given)
        .when(excluded & notes, "endnotes").when(excluded & front, "front_matter").when(excluded, "back_matter")
        .when(part, "part").when(notes, "endnotes").when(chapter, "chapter")
        .when(book & capitals & (F.size(F.split(t, " ")) <= 8), "book_title").when(book, "front_matter")
        .when(level > chapter_level, "section").when(level == chapter_level, "chapter")
        .when(like(r"^(introduction|conclusion|epilogue|afterword|prologue)([^a-z]|$)"), "chapter").when(page_role.isin("body", "front_matter"), "section").otherwise("unknown")
    )


def titles_by_page(rows: DataFrame, key: list[str], offset: int = 0) -> DataFrame:
    """The title of each page that a contents row names; the last row of a page wins."""
    page = F.when(F.coalesce("book_page", F.lit(0)) > 0, F.col("book_page")).otherwise(F.col("file_idx") + 1) + offset
    named = rows.withColumn("page_no", page).where(F.col("page_no") - offset > 0)
    return named.groupBy(*key, "page_no").agg(F.max_by(F.trim(T.plain(F.col("title"))), "visual_order").alias("title"))


def page_score(header: Column, excerpt: Column, links: Column, dots: Column, numbered: Column) -> Column:
    """How much a page looks like a contents list."""
    n = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    out = F.when(header == "toc", 6.0).when(header == "index", -7.0).otherwise(0.0) + F.when(excerpt == "toc", 2.5).when(excerpt == "index", -3.5).otherwise(0.0)
    out = out + F.least(n(links), F.lit(12)) * 0.35 + F.when(n(dots) >= 3, 1.5).when(n(dots) >= 1, 0.6).otherwise(0.0) + F.when(n(numbered) >= 4, 1.0).when(n(numbered) >= 2, 0.5).otherwise(0.0)
    blank = (header == "other") & (excerpt == "other") & (n(links) + n(dots) + n(numbered) == 0)
    return F.round(out - F.when(blank, 0.5).otherwise(0.0), 4)


def width_ratio(width: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), width / total)))


def align_hint(x: Column, width: Column, total: Column) -> Column:
    """center, left or right of a line in its page, by the place of its box."""
    known = x.isNotNull() & width.isNotNull() & (total > 0)
    middle = F.abs(x + width / 2 - total / 2) <= F.greatest(F.lit(40.0), total * 0.08)
    return F.when(known & middle, "center").when(known & (x <= total * 0.18), "left").when(known & (x + width >= total * 0.82), "right").otherwise("unknown")


def level_hint(source: Column, label: Column, top: Column, markdown_level: Column) -> Column:
    """The level that a heading's source speaks for; 0 for none."""
    first = F.when(top, 1).otherwise(2)
    return F.when(source == "visual_toc", 1).when(source == "note_heading", 0).when((source == "block") & (label == "doc_title"), first).when((source == "block") & (label == "paragraph_title"), 2).when(source == "markdown_heading", F.greatest(F.lit(1), F.coalesce(markdown_level, F.lit(1)))).when(source == "font_band", first).otherwise(0)


def evidence(c) -> Column:
    """Score of a heading candidate (columns source, label, family, level_hint, top, weight, align, confidence)."""
    source = F.when(c("source") == "composite", SOURCE_SCORES["composite"]).when((c("source") == "block") & (c("label") == "doc_title"), SOURCE_SCORES["doc_title"])
    for name in ("markdown_heading", "block", "font_band"):
        source = source.when(c("source") == name, SOURCE_SCORES[name])
    family = F.when(c("family").isin("chapter", "book"), 60).when(c("family") == "section", 12).otherwise(0)
    level = F.when(c("level_hint") == 1, 36).when(c("level_hint") >= 2, 10).otherwise(0)
    style = F.when(c("top"), 20).otherwise(0) + F.when(c("weight") == "heavy", 16).when(c("weight") == "bold", 10).otherwise(0) + F.when(c("align") == "center", 12).otherwise(0)
    return source.otherwise(80) + family + level + style + F.round(c("confidence") * 10).cast("int")


def is_strong(c) -> Column:
    """Whether a candidate can anchor a chapter far from its target page."""
    signals = [c("family").isin("chapter", "book"), c("level_hint") == 1, c("top"), c("weight").isin("bold", "heavy"), c("align") == "center"]
    n = reduce(lambda a, b: a + b, (F.when(s, 1).otherwise(0) for s in signals))
    need = F.when(c("label") == "paragraph_title", 4).otherwise(3)
    return (c("source") == "composite") | ((c("source") == "block") & (c("label") == "doc_title")) | (c("source") == "markdown_heading") | (n >= need)


def best_headings(wanted: DataFrame, candidates: DataFrame, key: list[str], low: Column, high: Column, strong: bool = False) -> DataFrame:
    """wanted (key, row_id, title_key, target, before, after) with the best candidate (key, title_key, page_no, score, strong,
    confidence) of its title between two pages: in order of its neighbours first, then score, nearness, confidence,
    earlier page. An equi-join on titles, and a sum."""
    rows = wanted.withColumns({"_low": low, "_high": high})
    own = candidates.where("strong") if strong else candidates
    met = rows.where("title_key <> ''").join(own, [*key, "title_key"]).where("page_no between _low and _high")
    inside = ~((F.col("before") > 0) & (F.col("page_no") <= F.col("before"))) & ~((F.col("after") > 0) & (F.col("page_no") >= F.col("after")))
    rank = F.struct(F.when(inside, 1).otherwise(0), F.col("score"), -F.abs(F.col("page_no") - F.col("target")), F.round(F.col("confidence") * 100), -F.col("page_no"))
    best = met.groupBy(*key, "row_id").agg(F.max_by("page_no", rank).alias("found"))
    return rows.drop("_low", "_high").join(best, [*key, "row_id"], "left")


def heading_graph(rows: DataFrame, candidates: DataFrame, page_roles: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, row_id in order, title, target) anchored to pages, with the strategy.

    local_exact: a candidate of the same title from one page before to two after the target; expanded_exact: a strong one from six
    before to ten after, between the neighbours' anchors and before the next page that is no body; monotonic_target: the
    target itself where it stands between its neighbours; provisional: the target; unresolved: none. Neighbours are the
    rows beside, whose first-step anchors are known when a step begins; windows run over the rows of one contents list.
    """
    w = Window.partitionBy(*key).orderBy("row_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"title_key": title_key(F.col("title")), "before": F.lit(0), "after": F.coalesce(F.lead("target").over(w), F.lit(0))})
    t = F.col("target")
    out = best_headings(rows, candidates, key, F.greatest(F.lit(1), t + LOCAL[0]), t + LOCAL[1]).withColumnRenamed("found", "local")
    body = page_roles.where("page_role in ('body', 'front_matter')").select(*key, F.col("page_no").alias("target"), F.lit(True).alias("in_body"))
    out = out.join(body, [*key, "target"], "left").withColumn("anchor", F.coalesce("local", F.when(F.col("in_body"), t)))
    stops = page_roles.where("page_role not in ('body', 'front_matter')").groupBy(*key).agg(F.array_sort(F.collect_set("page_no")).alias("_stops"))
    out = out.join(stops, key, "left").withColumn("stop", F.array_min(F.filter(F.coalesce("_stops", F.array().cast("array<int>")), lambda p: p > t))).drop("_stops")

    def beside(df: DataFrame) -> DataFrame:
        return df.withColumns({"before": F.coalesce(F.max("anchor").over(past), F.lit(0)), "after": F.coalesce(F.lead(F.coalesce("anchor", "target")).over(w), F.lit(0))})

    open_ = F.col("local").isNull() & F.col("in_body")
    out = beside(out)
    high = F.least(t + WIDE[1], F.when(F.col("after") > 0, F.col("after") - 1), F.col("stop") - 1)
    wide = best_headings(out.where(open_).select(*key, "row_id", "title_key", "target", "before", "after", "stop"), candidates, key, F.greatest(F.col("before") + 1, t + WIDE[0]), high, strong=True)
    out = out.join(wide.select(*key, "row_id", F.col("found").alias("wide")), [*key, "row_id"], "left").withColumn("anchor", F.coalesce("wide", "anchor"))
    out = beside(out).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    ordered = (F.col("_n") >= 2) & ~((F.col("before") > 0) & (t <= F.col("before"))) & ~((F.col("after") > 0) & (t >= F.col("after")))
    strategy = F.when(F.col("local").isNotNull(), "local_exact").when(F.col("wide").isNotNull(), "expanded_exact").when(F.col("in_body") & ordered, "monotonic_target").when(F.col("in_body"), "provisional").otherwise("unresolved")
    return out.select(*key, "row_id", "title", "target", F.col("anchor"), strategy.alias("strategy"))


def trimmed_chapters(chapters: DataFrame, page_roles: DataFrame, key: list[str], back_matter: DataFrame) -> DataFrame:
    """chapters (key, chapter_no, title, pages) without pages that are no body or, but for titles kept on purpose, stand at
    or behind the start of back matter (key, start); chapters without a page go."""
    keep = F.regexp_like(F.lower(T.squeezed(F.col("title"))), F.lit("^(epilogue|afterword|conclusion|postface)"))
    rows = chapters.select(*key, "chapter_no", "title", F.explode("pages").alias("page_no")).join(page_roles.where("page_role in ('body', 'front_matter')"), [*key, "page_no"])
    rows = rows.join(back_matter.select(*key, F.col("start").alias("_start")), key, "left").where(keep | F.col("_start").isNull() | (F.col("page_no") < F.col("_start")))
    return rows.groupBy(*key, "chapter_no", "title").agg(F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"), F.array_sort(F.collect_list("page_no")).alias("pages"))


def reordered(files: DataFrame, contents: DataFrame, key: list[str]) -> DataFrame:
    """files (key, chapter_id, place) in the order of contents (key, chapter_id, toc_place), others behind them in their own
    order, numbered anew."""
    places = first_of(contents.select(*key, "chapter_id", "toc_place"), [*key, "chapter_id"], [F.col("toc_place")])
    w = Window.partitionBy(*key).orderBy(F.col("toc_place").asc_nulls_last(), "place", "chapter_id")
    return files.join(places, [*key, "chapter_id"], "left").withColumn("order", F.row_number().over(w))
