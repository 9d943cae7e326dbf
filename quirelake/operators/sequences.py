"""Note items in reading order: misread numbers mended, endnote pages found, sections scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import note_lines as L
from quirelake.functions.markers import FORMS, is_year, normal_marker

# Least notes and share of a page of endnotes, further forms of markers (pattern, priority, certainty).
LEAST_NOTES, LEAST_SHARE, JUMP = 3, 0.5, 20
MORE_FORMS = {
    "latex_symbol": (r"\$\s*\^\{\s*(\*{1,4})\s*\}\s*\$", 0, 1.0),
    "apostrophe": (r"['`]\s*([0-9]{1,4})\b", 3, 0.55),
    "after_bracket": (r"\](\*{1,4})", 5, 0.9),
    "after_quote": (r"»(\*{1,4})", 5, 0.9),
}
BARE = r"\s([0-9]{1,3})(?=[.,;:)\]}»]|\s+[-–—])"


def mended(numbers: Column) -> Column:
    """A region's note numbers in reading order with single outliers mended: array<struct<number, keep>>. Between n and n + 1
    an outlier (over 20 beyond the next, or below the one before) goes; between n and n + 2 it becomes n + 1; so do years."""
    at = lambda i: F.get(numbers, i)

    def one(x: Column, i: Column) -> Column:
        before, after = at(i - 1), at(i + 1)
        year = x.between(1500, 2100)
        drop = (after == before + 1) & (x != after) & ((x > after + JUMP) | (x <= before - 1) | year)
        fill = (after == before + 2) & (x != before + 1) & ((x > after + JUMP) | (x <= before) | year)
        inner = (i > 0) & (i < F.size(numbers) - 1)
        return F.struct(F.when(inner & fill, before + 1).otherwise(x).alias("number"), (~F.coalesce(inner & drop, F.lit(False))).alias("keep"))

    return F.transform(numbers, one)


def restarted(numbers: Column) -> Column:
    """Runs that fall back although the number after them goes on from the number before take the missing numbers. Folds from
    left to right over one region's numbers."""
    n = F.size(numbers)

    def run_end(i: Column) -> Column:
        breaks = F.filter(F.sequence(i, n - 1), lambda j: F.coalesce(F.get(numbers, j + 1) != F.get(numbers, j) + 1, F.lit(True)))
        return F.array_min(breaks)

    def step(acc: Column, i: Column) -> Column:
        before, now = F.get(acc["out"], i - 1), F.get(numbers, i)
        end = run_end(i)
        after = F.get(numbers, end + 1)
        fits = (i > acc["until"]) & (i > 0) & (now <= before) & (after == before + (end - i + 1) + 1)
        until = F.when(F.coalesce(fits, F.lit(False)), end).otherwise(acc["until"])
        shift = F.when(F.coalesce(fits, F.lit(False)), before + 1 - now).when(i > acc["until"], 0).otherwise(acc["shift"])
        return F.struct(F.concat(acc["out"], F.array(now + shift)).alias("out"), until.cast("int").alias("until"), shift.cast("int").alias("shift"))

    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("until"), F.lit(0).alias("shift"))
    return F.when(n < 3, numbers).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)["out"])


def unique_items(items: DataFrame, key: list[str]) -> DataFrame:
    """One item of each marker and page of a region: the longest text, then the first."""
    rest = [c for c in items.columns if c not in (*key, "page_no", "marker")]
    best = items.groupBy(*key, "page_no", "marker").agg(F.max_by(F.struct(*rest), F.struct(F.char_length("text"), -F.col("item_order"))).alias("_b"))
    return best.select(*key, "page_no", "marker", *(F.col(f"_b.{c}").alias(c) for c in rest)).select(*items.columns)


def region_items(scans: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Note items of regions (key, region_id, pages, note_kind) from note scans (key, page_no, items): of the region's kind, on its
    pages, in order, with numbers mended. A page in several regions gives its items to the first region."""
    owned = regions.select(*key, "region_id", "note_kind", F.explode("pages").alias("page_no"))
    owner = owned.groupBy(*key, "page_no", "note_kind").agg(F.min("region_id").alias("region_id"))
    rows = scans.select(*key, "page_no", F.explode("items").alias("i")).join(owner, [*key, "page_no"]).where("i.kind = note_kind")
    lists = rows.groupBy(*key, "region_id", "note_kind").agg(F.array_sort(F.collect_list(F.struct("page_no", F.col("i.order").alias("place"), F.col("i.number").alias("number"), F.col("i.marker").alias("marker"), F.col("i.text").alias("text")))).alias("a"))
    lists = lists.withColumn("n", mended(F.transform("a", lambda x: x["number"])))
    lists = lists.withColumn("a", F.filter(F.zip_with("a", "n", lambda x, m: F.struct(x["page_no"].alias("page_no"), x["place"].alias("place"), x["number"].alias("read"), m["number"].alias("number"), m["keep"].alias("keep"), x["marker"].alias("marker"), x["text"].alias("text"))), lambda x: x["keep"]))
    out = lists.select(*key, "region_id", "note_kind", F.posexplode("a").alias("at", "x"))
    tag = F.when(F.col("note_kind") == "footnote", "fn").otherwise("en")
    return out.select(*key, "region_id", "note_kind", F.concat_ws("-", tag, "region_id", F.lpad((F.col("at") + 1).cast("string"), 5, "0")).alias("note_item_id"), "x.page_no", F.when(F.col("x.number") > 0, F.col("x.number").cast("string")).otherwise(F.col("x.marker")).alias("marker"), "x.text", (F.col("x.read") != F.col("x.number")).alias("reconstructed"))


def collection_pages(pages: DataFrame, key: list[str]) -> DataFrame:
    """Pages of endnotes: pages (key, page_no, text, chapter_no, chapter_end). Enough numbered lines in share make one;
    weaker pages join a neighbour that is one, with a signal of notes, or near their chapter's end; single weak pages don't count.
    Each pass is an equi-join on the page beside."""
    lines = L.broken_lines(F.col("text"))
    numbered = F.size(F.filter(lines, lambda x: L.numbered_line(x).isNotNull()))
    rows = pages.select(*key, "page_no", "chapter_no", "chapter_end", numbered.alias("numbered"), F.size(lines).alias("n"), F.exists(lines, lambda x: F.regexp_like(F.lower(x), F.lit(r"^\s*(#+\s*)?(notes?|注释|脚注|尾注)([^a-z0-9]|$)"))).alias("signal"))
    share = F.col("numbered") / F.greatest(F.lit(1), F.col("n"))
    near_end = F.coalesce(F.col("page_no") >= F.col("chapter_end") - 1, F.lit(False))
    rows = rows.withColumns({"strong": (F.col("numbered") >= LEAST_NOTES) & (share >= LEAST_SHARE), "signalled": (F.col("numbered") >= 1) & F.col("signal"), "weak": (F.col("numbered") >= 1) & ((share >= LEAST_SHARE / 2) | near_end)})
    hit = F.col("strong") | F.col("signalled")
    beside = None
    for step in (-1, 1):
        own = rows.where(hit).select(*key, (F.col("page_no") + step).alias("page_no"))
        beside = own if beside is None else beside.unionByName(own)
    rows = rows.join(beside.distinct().withColumn("_beside", F.lit(True)), [*key, "page_no"], "left")
    return rows.where(hit | (F.col("weak") & F.col("_beside"))).select(*key, "page_no", "chapter_no", "numbered", F.when(F.col("strong"), "strong").when(F.col("signalled"), "signal").otherwise("joined").alias("why"))


def section_score(numbers: Column) -> Column:
    """How well a section's note numbers run: density of the distinct ones, less for a late start and for each fall."""
    u = F.array_sort(F.array_distinct(numbers))
    low, high = F.get(u, 0), F.element_at(u, -1)
    falls = F.size(F.filter(F.transform(numbers, lambda x, i: F.coalesce(x < F.get(numbers, i - 1), F.lit(False))), lambda x: x))
    return F.when(F.size(numbers) > 0, F.size(u) / F.greatest(F.lit(1), high - low + 1) - F.least(F.greatest(low - 1, F.lit(0)), F.lit(8)) * 0.08 - falls * 0.2)


def better_section(first: Column, second: Column, margin: float = 0.05) -> Column:
    """Which of two readings of a section counts: the second if it scores at least the first less a margin."""
    a, b = section_score(first), section_score(second)
    return F.when(b.isNull(), "first").when(a.isNull() | (b >= a - margin), "second").otherwise("first")


def endnote_index(items: DataFrame, key: list[str]) -> DataFrame:
    """Endnotes (key, chapter_no or null, number, text, page_no) as one entry per chapter and number, the best definition first;
    without a chapter they are the book's."""
    scope = F.when(F.col("chapter_no").isNull(), "book").otherwise("chapter")
    best = items.where("number > 0").groupBy(*key, "chapter_no", "number").agg(F.max_by("text", F.struct(F.char_length("text"), -F.col("page_no"))).alias("text"), F.min("page_no").alias("page_no"), F.count("*").alias("readings"))
    return best.withColumn("scope", scope)


def registry(index: DataFrame, key: list[str]) -> DataFrame:
    """Of each number of a book, in how many chapters it is used, and which come first."""
    return index.groupBy(*key, "number").agg(F.count("*").alias("chapters"), F.array_sort(F.collect_set("chapter_no")).alias("used_in")).withColumn("shared", F.col("chapters") > 1)


def groups(items: DataFrame, key: list[str]) -> DataFrame:
    """Structured notes grouped by chapter, else by their hint, else by the book."""
    name = F.coalesce(F.concat(F.lit("chapter:"), F.col("chapter_no").cast("string")), F.concat(F.lit("hint:"), F.nullif(F.trim(F.lower("hint")), F.lit(""))), F.lit("book"))
    return items.withColumn("group", name).groupBy(*key, "group").agg(F.count("*").alias("n"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.array_sort(F.collect_list("number")).alias("numbers"))


def placed_markers(c: Column) -> Column:
    """array<struct<start, end, priority, form, marker, certainty>> of all markers of a paragraph in all forms, years left
    out; of overlapping ones the form of higher priority stays, then the longer."""
    none = F.array().cast("array<struct<start:int,end:int,priority:int,form:string,marker:string,certainty:double>>")

    def places(pattern: str, priority: int, form: str, certainty: float) -> Column:
        gaps, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        marks = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.char_length(g) + F.char_length(h))

        def one(h: Column, i: Column) -> Column:
            end = F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)
            return F.struct((end - F.char_length(h)).alias("start"), end.alias("end"), F.lit(priority).alias("priority"), F.lit(form).alias("form"), normal_marker(F.get(marks, i)).alias("marker"), F.lit(certainty).alias("certainty"))

        return F.transform(hits, one)

    found = F.concat(*(places(p, n, f, s) for f, (p, n, s) in {**FORMS, **MORE_FORMS}.items()))
    bare = places(BARE, 6, "bare_digit", 0.6)
    before = lambda x: F.substr(c, F.lit(1), x["start"])
    bare = F.filter(F.transform(bare, lambda x: F.struct((x["end"] - F.char_length(x["marker"])).alias("start"), x["end"].alias("end"), x["priority"].alias("priority"), x["form"].alias("form"), x["marker"].alias("marker"), x["certainty"].alias("certainty"))), lambda x: L.bare_digit_context(before(x), F.substr(c, x["end"] + 1, F.char_length(c))))
    every = F.array_sort(F.filter(F.concat(found, bare), lambda x: (x["marker"] != "") & ~is_year(x["marker"])))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wins = (x["priority"] < last["priority"]) | ((x["priority"] == last["priority"]) & (x["end"] - x["start"] > last["end"] - last["start"]))
        kept = F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))
        return F.when(F.size(acc) == 0, F.array(x)).when(last["end"] <= x["start"], F.concat(acc, F.array(x))).when(wins, F.concat(kept, F.array(x))).otherwise(acc)

    return F.coalesce(F.aggregate(every, none, add), none)


def marker_summary(anchors: DataFrame, key: list[str]) -> DataFrame:
    """Anchors by how they came about."""
    return anchors.groupBy(*key).agg(F.count_if(~F.col("synthetic") & (F.col("certainty") >= 1)).alias("explicit"), F.count_if("synthetic").alias("synthetic"), F.count_if(~F.col("synthetic") & (F.col("certainty") < 1)).alias("uncertain"), F.count_if(F.coalesce(F.col("repaired_from"), F.lit("")) != "").alias("repaired"))


def style_counts(lines: DataFrame, key: list[str]) -> DataFrame:
    """How often each form of marker is used, and how many lines begin with a number, a bracket or a symbol."""
    x = lines.withColumn("m", placed_markers(F.coalesce("line", F.lit("")))).withColumn("start", F.when(L.symbol_line(F.col("line")).isNotNull(), "symbol").when(F.startswith(L.numbered_line(F.col("line"))["marker"], F.lit("[")), "bracket").when(L.numbered_line(F.col("line")).isNotNull(), "number"))
    forms = x.select(*key, F.explode(F.transform("m", lambda y: y["form"])).alias("style"))
    return forms.unionByName(x.where("start is not null").select(*key, F.concat(F.lit("label_"), F.col("start")).alias("style"))).groupBy(*key, "style").agg(F.count("*").alias("n"))


def ordered(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
