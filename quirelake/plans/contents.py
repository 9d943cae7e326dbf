"""Queries over contents rows, headings, note regions and owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import contents as C
from quirelake.operators import ordering as O
from quirelake.operators import regions as R
from quirelake.sources.books import anchors, chapters, contents, notes, pages, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body)
        return f

    return keep


#: Contents rows with numbered, joined and bare-number variants beside the plain ones.
ROWS = """tr as (select book, chapter_no, (chapter_no * 10 + i)::bigint as row_id, i, x.title as title, x.parent as parent, start_page + x.step as page_no, 'chapter' as role from (select *, string_split(title, ' ')[1] as word from ct),
 (select unnest(range(7)) as i), (select 1) one, lateral (select case i when 0 then {'title': title, 'parent': '', 'step': 0} when 1 then {'title': chapter_no || '. ' || word, 'parent': '', 'step': 0} when 2 then {'title': 'Part ' || title, 'parent': 'Part', 'step': 0}
  when 3 then {'title': title, 'parent': 'Part', 'step': 0} when 4 then {'title': chapter_no::varchar, 'parent': '', 'step': 1} when 5 then {'title': '1', 'parent': chapter_no::varchar, 'step': 1} else {'title': '2', 'parent': chapter_no::varchar, 'step': 2} end as x) y
 where i = 0 or (chapter_no % 3 = 0 and i = 1) or (chapter_no % 3 = 1 and i in (2, 3)) or (chapter_no % 3 = 2 and i >= 4))"""


def toc_rows(spark, d):
    n, t = F.col("chapter_no"), F.col("title")
    row = lambda i, title, parent, step: F.struct(F.lit(i).alias("i"), title.alias("title"), parent.alias("parent"), F.lit(step).alias("step"))
    no, none, part = n.cast("string"), F.lit(""), F.lit("Part")
    every = F.array(row(0, t, none, 0), row(1, F.concat(no, F.lit(". "), F.substring_index(t, " ", 1)), none, 0), row(2, F.concat(F.lit("Part "), t), part, 0), row(3, t, part, 0), row(4, no, none, 1), row(5, F.lit("1"), no, 1), row(6, F.lit("2"), no, 2))
    kept = F.filter(every, lambda x: (x["i"] == 0) | ((n % 3 == 0) & (x["i"] == 1)) | ((n % 3 == 1) & x["i"].isin(2, 3)) | ((n % 3 == 2) & (x["i"] >= 4)))
    rows = contents(spark, d).select("book", "chapter_no", "start_page", F.explode(kept).alias("x"))
    return rows.select("book", "chapter_no", (n.cast("long") * 10 + F.col("x.i")).alias("row_id"), F.col("x.i").alias("i"), "x.title", "x.parent", (F.col("start_page") + F.col("x.step")).alias("page_no"), F.lit("chapter").alias("role"))


KEY = "regexp_replace(translate(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '" + T.ACCENTS[0] + "', '" + T.ACCENTS[1] + "'), '[^0-9a-z]+', '', 'g')"


def key(c: str) -> str:
    return KEY.replace("{0}", c)


@query("toc_composites", "ct", f"with {ROWS}, k as (select *, {key('title')} as a, {key('parent')} as b from tr), o as (select * from k where parent <> '' and a <> '' and b <> '') select book, row_id, row_id in (select x.row_id from o x join o y using (book, page_no, b) where x.book = k.book and contains(x.a, x.b) and not contains(y.a, y.b) and contains(x.a, y.a) and x.a <> y.a) as suppressed from k")
def toc_composites(spark, d):
    return C.composite_duplicates(toc_rows(spark, d), ["book"]).select("book", "row_id", "suppressed")


PREFIX = "'^\\s*([0-9]+|[ivxlcdmIVXLCDM]+)[.):]\\s+'"


@query("toc_split_headings", "ct", f"with {ROWS}, s as (select book, page_no, row_id as short, trim(regexp_replace(regexp_replace(title, {PREFIX}, ''), '\\s+', ' ', 'g')) as bare from tr where regexp_matches(title, {PREFIX})), m as (select tr.book, row_id, short from tr join s using (book, page_no) where bare <> '' and row_id <> short and starts_with(trim(regexp_replace(title, '\\s+', ' ', 'g')), bare || ' ')) select book, row_id, case when row_id in (select short from m where m.book = tr.book) then trim(regexp_replace(regexp_replace(title, {PREFIX}, ''), '\\s+', ' ', 'g')) else title end as title, row_id in (select row_id from m where m.book = tr.book) as suppressed from tr")
def toc_split_headings(spark, d):
    return C.split_headings(toc_rows(spark, d), ["book"]).select("book", "row_id", "title", "suppressed")


NUMBER = "'^\\s*([0-9]+|[ivxlcdmIVXLCDM]+)[.)]?\\s*$'"


@query("toc_number_noise", "ct", f"with {ROWS}, c as (select book, trim(regexp_replace(parent, '\\s+', ' ', 'g')) as t, count(*) as n, count_if(regexp_matches(title, {NUMBER})) as k from tr where trim(parent) <> '' group by all), r as (select *, trim(regexp_replace(title, '\\s+', ' ', 'g')) as t from tr where parent = '') select book, row_id, row_id in (select a.row_id from r a join c using (book, t) join r b on a.book = b.book and abs(a.page_no - b.page_no) <= 12 where a.book = tr.book and regexp_matches(a.title, {NUMBER}) and n >= 2 and n = k and not regexp_matches(b.title, {NUMBER})) as suppressed from tr")
def toc_number_noise(spark, d):
    return C.numeric_root_noise(toc_rows(spark, d), ["book"]).select("book", "row_id", "suppressed")


ITEMS = f"{ROWS}, it as (select *, case when row_id % 3 = 0 then page_no end as printed_page, case when row_id % 4 = 0 then page_no - 1 end as file_idx, case chapter_no % 5 when 0 then 'container' when 1 then 'chapter' when 2 then 'section' when 3 then '' else 'endnotes' end as given, case when row_id % 17 = 0 then 'Contents' when row_id % 19 = 0 then title || '. ' || repeat('word ', 18) else title end as t2 from tr)"


def items(spark, d):
    n = F.col("chapter_no") % 5
    given = F.when(n == 0, "container").when(n == 1, "chapter").when(n == 2, "section").when(n == 3, "").otherwise("endnotes")
    title = F.when(F.col("row_id") % 17 == 0, "Contents").when(F.col("row_id") % 19 == 0, F.concat("title", F.lit(". "), F.repeat(F.lit("word "), 18))).otherwise(F.col("title"))
    rows = toc_rows(spark, d).withColumns({"printed_page": F.when(F.col("row_id") % 3 == 0, F.col("page_no")), "file_idx": F.when(F.col("row_id") % 4 == 0, F.col("page_no") - 1), "role": given})
    return rows.withColumn("title", title)


@query("toc_kept_rows", "ct", f"with {ITEMS}, q as (select *, trim(regexp_replace(t2, '\\s+', ' ', 'g')) as t from it), v as (select *, len(string_split(t, ' ')) as nw from q) select book, row_id, t as title from v where t <> '' and not (printed_page is null and file_idx is null and given not in ('container', 'endnotes') and (lower(t) = 'contents' or nw >= 18 or length(t) >= 120 or (nw >= 12 and regexp_matches(t, '[.:;!?]'))))")
def toc_kept_rows(spark, d):
    return C.kept_rows(items(spark, d)).select("book", "row_id", "title")


@query("toc_link_targets", "ct", f"with {ITEMS}, l as (select distinct book, row_id as visual_order, (page_no + 1) as target from tr where row_id % 2 = 0) select it.book, it.row_id, coalesce(file_idx, target) as file_idx from it left join l on l.book = it.book and l.visual_order = it.row_id")
def toc_link_targets(spark, d):
    rows = items(spark, d).withColumn("visual_order", F.col("row_id"))
    targets = toc_rows(spark, d).where("row_id % 2 = 0").select("book", F.col("row_id").alias("visual_order"), (F.col("page_no") + 1).alias("target"))
    return C.with_link_targets(rows, targets, ["book"]).select("book", "row_id", "file_idx")


@query("toc_offset_summary", "ct", f"with {ITEMS} select book, count_if(given in ('chapter', 'section')) as navigable, count_if(given in ('chapter', 'section') and file_idx is not null) as ready, count_if(given in ('chapter', 'section') and file_idx is null) as unresolved from it group by book")
def toc_offset_summary(spark, d):
    return C.offset_summary(items(spark, d), ["book"])


@query("toc_merged_trees", "ct", "with a as (select book, chapter_no, title, start_page from ct where chapter_no % 4 <> 0), b as (select book, chapter_no, chapter_no || '. ' || title as title, start_page from ct where chapter_no % 3 <> 0), u as (select book, chapter_no, title, 0 as side, start_page as page_no from a union all select book, chapter_no, title, 1, case when chapter_no % 2 = 0 then start_page + 1 end from b), k as (select *, " + key("regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), " + PREFIX + ", '')") + " as k from u) select book, max_by(trim(regexp_replace(title, '\\s+', ' ', 'g')), {'l': length(title), 's': -side, 't': title}) as title, min_by(page_no, {'n': page_no is null, 's': side, 'p': page_no}) as page_no, count(distinct side) as sides from k where k <> '' group by book, k")
def toc_merged_trees(spark, d):
    ct = contents(spark, d)
    tree = lambda title, page: ct.select("book", title.alias("title"), F.lit("").alias("parent"), F.lit(0).alias("depth"), page.alias("page_no"), F.col("chapter_no").alias("visual_order"), "chapter_no")
    first = tree(F.col("title"), F.col("start_page")).where("chapter_no % 4 <> 0").drop("chapter_no")
    second = tree(F.concat(F.col("chapter_no").cast("string"), F.lit(". "), F.col("title")), F.when(F.col("chapter_no") % 2 == 0, F.col("start_page") + 1)).where("chapter_no % 3 <> 0").drop("chapter_no")
    return C.merged_trees(first, second, ["book"]).select("book", "title", "page_no", "sides")


@query("toc_titles_by_page", "ct", f"with {ITEMS}, p as (select book, row_id, trim(t2) as t, case when coalesce(printed_page, 0) > 0 then printed_page else file_idx + 1 end + 2 as page_no from it) select book, page_no, max_by(t, row_id) as title from p where page_no > 2 group by all")
def toc_titles_by_page(spark, d):
    return C.titles_by_page(items(spark, d).withColumns({"book_page": F.col("printed_page"), "visual_order": F.col("row_id")}), ["book"], 2)


@query("toc_page_scores", "pg", "with f as (select book, page_no, doc_id, ['toc', 'index', 'other'][doc_id % 3 + 1] as h, ['other', 'toc', 'index'][doc_id % 3 + 1] as e, (doc_id % 15)::int as l, (doc_id % 5)::int as dots, (doc_id % 6)::int as nums from pg) select book, page_no, round(case h when 'toc' then 6.0 when 'index' then -7.0 else 0.0 end + case e when 'toc' then 2.5 when 'index' then -3.5 else 0.0 end + least(l, 12) * 0.35 + case when dots >= 3 then 1.5 when dots >= 1 then 0.6 else 0.0 end + case when nums >= 4 then 1.0 when nums >= 2 then 0.5 else 0.0 end - case when h = 'other' and e = 'other' and l + dots + nums = 0 then 0.5 else 0.0 end, 4)::double as score from f")
def toc_page_scores(spark, d):
    m = lambda k: (F.col("doc_id") % k).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), m(3) + 1)
    return pages(spark, d).select("book", "page_no", C.page_score(pick("toc", "index", "other"), pick("other", "toc", "index"), m(15), m(5), m(6)).alias("score"))


@query("heading_hints", "pg", "with f as (select book, page_no, doc_id, (doc_id * 37 % 900)::double as x, (doc_id * 13 % 500)::double as w, 900.0::double as t, ['visual_toc', 'note_heading', 'block', 'markdown_heading', 'font_band'][doc_id % 5 + 1] as s, case when doc_id % 2 = 0 then 'doc_title' else 'paragraph_title' end as l, doc_id % 3 = 0 as top, (doc_id % 4)::int as ml from pg) select book, page_no, greatest(0, least(1, w / t)) as ratio, case when abs(x + w / 2 - t / 2) <= greatest(40, t * 0.08) then 'center' when x <= t * 0.18 then 'left' when x + w >= t * 0.82 then 'right' else 'unknown' end as align, case when s = 'visual_toc' then 1 when s = 'note_heading' then 0 when s = 'block' and l = 'doc_title' then case when top then 1 else 2 end when s = 'block' then 2 when s = 'markdown_heading' then greatest(1, ml) else case when top then 1 else 2 end end as level from f")
def heading_hints(spark, d):
    n = F.col("doc_id")
    x, w, t = (n * 37 % 900).cast("double"), (n * 13 % 500).cast("double"), F.lit(900.0)
    source = F.element_at(F.array(*map(F.lit, ("visual_toc", "note_heading", "block", "markdown_heading", "font_band"))), (n % 5 + 1).cast("int"))
    label = F.when(n % 2 == 0, "doc_title").otherwise("paragraph_title")
    return pages(spark, d).select("book", "page_no", C.width_ratio(w, t).alias("ratio"), C.align_hint(x, w, t).alias("align"), C.level_hint(source, label, n % 3 == 0, (n % 4).cast("int")).alias("level"))


@query("reordered_files", "ct", "with f as (select book, 'c' || chapter_no as chapter_id, chapter_no * 7 % 11 as place from ct), t as (select book, 'c' || chapter_no as chapter_id, chapter_no as toc_place from ct where chapter_no % 3 <> 0) select f.book, f.chapter_id, row_number() over (partition by f.book order by toc_place nulls last, place, f.chapter_id)::int as \"order\" from f left join t using (book, chapter_id)")
def reordered_files(spark, d):
    name = F.concat(F.lit("c"), F.col("chapter_no").cast("string")).alias("chapter_id")
    files = contents(spark, d).select("book", name, (F.col("chapter_no") * 7 % 11).alias("place"))
    return C.reordered(files, contents(spark, d).where("chapter_no % 3 <> 0").select("book", name, F.col("chapter_no").alias("toc_place")), ["book"]).select("book", "chapter_id", "order")


ROLES = "pr as (select book, page_no, case when page_no % 13 = 0 then 'note' when page_no % 17 = 0 then 'other' else 'body' end as page_role from pg)"


def page_roles(spark, d):
    return pages(spark, d).select("book", "page_no", F.when(F.col("page_no") % 13 == 0, "note").when(F.col("page_no") % 17 == 0, "other").otherwise("body").alias("page_role"))


@query("trimmed_chapters", "ch", f"with {ROLES}, b as (select book, (max(total_pages) * 3 // 4)::int as start from ct group by book) select ch.book, chapter_no, title, min(page_no) as start_page, max(page_no) as end_page, count(*) as n_pages from ch join pr on ch.book = pr.book and page_no between start_page and end_page join b on b.book = ch.book where page_role in ('body', 'front_matter') and (regexp_matches(lower(trim(title)), '^(epilogue|afterword|conclusion|postface)') or page_no < start) group by ch.book, chapter_no, title")
def trimmed_chapters(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "title", F.sequence("start_page", "end_page").alias("pages"))
    back = contents(spark, d).groupBy("book").agg(F.floor(F.max("total_pages") * 3 / 4).cast("int").alias("start"))
    return C.trimmed_chapters(ch, page_roles(spark, d), ["book"], back).select("book", "chapter_no", "title", "start_page", "end_page", F.size("pages").cast("long").alias("n_pages"))


@query("heading_anchors", "", "")
def heading_anchors(spark, d):
    """Contents rows anchored to headings that stand up to nine pages beside them."""
    ct = contents(spark, d)
    n = F.col("chapter_no")
    col = lambda c: F.col(c)
    cand = ct.where("chapter_no % 4 <> 1").select("book", C.title_key(F.col("title")).alias("title_key"), (F.col("start_page") + n % 4 * 3 - 3).alias("page_no"), F.when(n % 2 == 0, "markdown_heading").otherwise("block").alias("source"), F.lit("paragraph_title").alias("label"), F.lit("chapter").alias("family"), (n % 3).alias("level_hint"), (n % 2 == 0).alias("top"), F.lit("bold").alias("weight"), F.lit("center").alias("align"), F.lit(0.8).alias("confidence"))
    cand = cand.withColumns({"score": C.evidence(col), "strong": C.is_strong(col)})
    return C.heading_graph(ct.select("book", F.col("chapter_no").alias("row_id"), "title", F.col("start_page").alias("target")), cand, page_roles(spark, d), ["book"])


# regions and owners


@query("hinted_page_roles", "pg", "with p as (select book, page_no, case when page_no % 13 = 0 then 'note' when page_no % 17 = 0 then 'other' else 'body' end as r, case when page_no % 34 = 0 then 'bibliography' else '' end as why, (max(page_no) over (partition by book) * 2 // 3)::int as hint from pg), b as (select *, page_no >= hint and hint > 0 as behind from p), s as (select *, coalesce(bool_or(behind) over (partition by book order by page_no rows between unbounded preceding and 1 preceding), false) as seen from b), t as (select *, behind and seen and r = 'other' and why = 'bibliography' as stop from s), u as (select *, coalesce(bool_or(stop) over (partition by book order by page_no rows between unbounded preceding and 1 preceding), false) as stopped from t) select book, page_no, case when behind and r <> 'note' and not stopped and not stop then 'note' else r end as page_role from u")
def hinted_page_roles(spark, d):
    rows = page_roles(spark, d).withColumns({"reason": F.when(F.col("page_no") % 34 == 0, "bibliography").otherwise(""), "confidence": F.lit(0.5)})
    hint = pages(spark, d).groupBy("book").agg(F.floor(F.max("page_no") * 2 / 3).cast("int").alias("hint"))
    return R.hinted_roles(rows.join(hint, "book"), ["book"]).select("book", "page_no", "page_role")


REGIONS = "e as (select pg.book, page_no, case when page_no % 10 >= 7 or page_no % 10 = 0 then true else page_no % 20 = 1 end as is_note, page_no % 29 = 0 as has_blocks, 'h' || page_no as heading from pg), c2 as (select book, chapter_no, start_page, end_page from ch where start_page <= total_pages * 0.8), l as (select book, max(end_page) as z, min(start_page) as a from c2 group by book), o as (select e.*, case when page_no > z then 'book' else 'chapter' end as scope, case when page_no <= z then (select max(chapter_no) from c2 where c2.book = e.book and page_no between start_page and end_page) end as chapter_no from e join l using (book) where is_note and not has_blocks and page_no >= a), n as (select *, case when page_no - lag(page_no) over w = 1 and scope = lag(scope) over w and chapter_no is not distinct from lag(chapter_no) over w then 0 else 1 end as new from o window w as (partition by book order by page_no)), g as (select *, sum(new) over (partition by book order by page_no) as run from n), rg as (select book, run, scope, chapter_no, min(page_no) as page_start, max(page_no) as page_end, count(*) as n_pages, min_by(heading, page_no) as heading_text from g group by all)"


def region_chapters(spark, d):
    return chapters(spark, d).where("start_page <= total_pages * 0.8").select("book", "chapter_no", "start_page", "end_page")


def regions(spark, d):
    m = F.col("page_no") % 10
    rows = pages(spark, d).select("book", "page_no", F.when((m >= 7) | (m == 0), True).otherwise(F.col("page_no") % 20 == 1).alias("is_note"), (F.col("page_no") % 29 == 0).alias("has_blocks"), F.concat(F.lit("h"), F.col("page_no").cast("string")).alias("heading"), F.lit("1").alias("first_marker"))
    ch = region_chapters(spark, d)
    rows = O.interval_join(rows, ch, ["book"], "page_no", "start_page", "end_page", how="left").drop("start_page", "end_page")
    return R.endnote_runs(rows, ch, ["book"])


@query("endnote_regions", "ch", f"with {REGIONS} select book, scope, chapter_no, page_start, page_end, n_pages, heading_text from rg")
def endnote_regions(spark, d):
    return regions(spark, d).select("book", "scope", "chapter_no", "page_start", "page_end", F.size("pages").cast("long").alias("n_pages"), "heading_text")


@query("region_ids", "ch", f"with {REGIONS} select book, page_start, 'nr-en-' || case when scope = 'chapter' then 'ch' else 'bk' end || '-' || lpad(row_number() over (partition by book order by page_start, page_end, scope, coalesce(chapter_no::varchar, ''))::varchar, 4, '0') || '-' || coalesce(chapter_no::varchar, 'none') as region_id from rg")
def region_ids(spark, d):
    return R.with_ids(regions(spark, d).withColumn("note_kind", F.lit("endnote")), ["book"]).select("book", "page_start", "region_id")


@query("first_endnote_pages", "ch", f"with {REGIONS} select book, chapter_no, min(page_start) as start_page from rg where scope = 'chapter' and chapter_no is not null group by all")
def first_endnote_pages(spark, d):
    return R.first_endnote_pages(regions(spark, d).withColumn("note_kind", F.lit("endnote")), ["book"])


@query("promoted_regions", "ch", f"with {REGIONS}, z as (select book, (max(end_page) * 0.5)::int as z from ch group by book) select rg.book, page_start, scope <> 'book' and page_start > z as promoted, case when page_start > z then 'book' else scope end as scope from rg join z using (book)")
def promoted_regions(spark, d):
    half = chapters(spark, d).select("book", F.bround(F.col("end_page") * 0.5, 0).cast("int").alias("end_page"))
    return R.promoted(regions(spark, d), half, ["book"]).select("book", "page_start", "promoted", "scope")


@query("split_regions", "ch", f"with {REGIONS}, i as (select book, run, page_no, row_number() over (partition by book, run order by page_no) - 1 as i, chapter_no as own, case when page_no % 4 = 0 then page_no // 4 end as named from g), p as (select *, sum(case when i > 0 and named is not null then 1 else 0 end) over (partition by book, run order by i) as part from i) select book, min(page_no) as page_start, max(page_no) as page_end, count(*) as n_pages, coalesce(min_by(named, i) filter (where i = m), max(own)) as chapter_no from (select *, min(i) over (partition by book, run, part) as m from p) group by book, run, part")
def split_regions(spark, d):
    rows = R.with_ids(regions(spark, d).withColumn("note_kind", F.lit("endnote")), ["book"])
    heads = pages(spark, d).where("page_no % 4 = 0").select("book", "page_no", F.expr("page_no div 4").cast("int").alias("chapter_no"))
    return R.split_by_headings(rows, heads, ["book"]).select("book", "page_start", "page_end", "n_pages", "chapter_no")


OWNERS = "it as (select nt.book, marker, note_page as page_no, marker // 10 as region_id, case when marker % 5 = 0 then 1 end as owner from nt), c3 as (select * from ch where chapter_no % 3 <> 1), f as (select book, min_by(chapter_no, start_page) as first from c3 group by book), ow as (select it.*, (select max_by(chapter_no, start_page) from c3 where c3.book = it.book and start_page <= page_no) as prior, (select max_by(end_page, start_page) from c3 where c3.book = it.book and start_page <= page_no) as e, first from it left join f using (book)), om as (select *, case when owner is not null then 'own' when prior is not null and page_no <= e then 'page' when prior is not null then 'prior' else 'first' end as mode, coalesce(owner, prior, first) as who from ow)"


def owned(spark, d):
    it = notes(spark, d).select("book", F.col("marker").alias("item_id"), F.col("note_page").alias("page_no"), F.expr("marker div 10").cast("int").alias("region_id"), F.when(F.col("marker") % 5 == 0, 1).alias("owner"))
    ch = chapters(spark, d).where("chapter_no % 3 <> 1").select("book", "chapter_no", "start_page", "end_page")
    return R.fallback_owners(it, ch, ["book"])


@query("endnote_owners", "nt ch", f"with {OWNERS} select book, marker as item_id, mode, who as owner from om")
def endnote_owners(spark, d):
    return owned(spark, d).select("book", "item_id", "mode", "owner")


@query("region_owners", "nt ch", f"with {OWNERS}, c as (select book, region_id, who, count(*) as n from om where who is not null group by all) select book, region_id, max_by(who, {{'n': n, 'w': -who}}) as owner, round(max(n) / sum(n)::double, 4) as share from c group by all")
def region_owners(spark, d):
    return R.region_owners(owned(spark, d), ["book"])


@query("endnote_streams", "nt ch", f"with {OWNERS} select book, who as owner, count(*) as n, count_if(mode = 'own') as own, count_if(mode = 'page') as page, count_if(mode = 'prior') as prior, count_if(mode = 'first') as \"first\", count(*) >= 100 as large from om group by all")
def endnote_streams(spark, d):
    return R.stream_summary(owned(spark, d), ["book"])


@query("chapter_bindings", "nt ch", f"with {OWNERS}, r as (select distinct book, region_id, who from om), k as (select distinct book, chapter_no from ch where chapter_no % 2 = 0) select book, count(distinct region_id || '-' || coalesce(r.who, 0)) filter (where k.chapter_no is null) as unbound_regions, (select count_if(k2.chapter_no is null) from om left join k k2 on k2.book = om.book and k2.chapter_no = om.who where om.book = r.book) as unassigned_items from r left join k on k.book = r.book and k.chapter_no = r.who group by r.book".replace("select book, count", "select r.book, count"))
def chapter_bindings(spark, d):
    rows = owned(spark, d)
    ch = chapters(spark, d).where("chapter_no % 2 = 0")
    return R.binding_summary(rows.select("book", "region_id", "owner").distinct(), rows.select("book", "owner"), ch, ["book"])


@query("body_marker_sets", "an ch", f"with {ROLES} select an.book, chapter_no, count(distinct marker) as n, min(marker) as low, max(marker) as high from an join ch on an.book = ch.book and page_no between start_page and end_page where page_no % 13 <> 0 group by all")
def body_marker_sets(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    rows = O.interval_join(anchors(spark, d), ch, ["book"], "page_no", "start_page", "end_page")
    got = R.body_markers(rows, page_roles(spark, d).where("page_role = 'note'"), ["book"])
    return got.select("book", "chapter_no", F.size("markers").cast("long").alias("n"), F.array_min("markers").alias("low"), F.array_max("markers").alias("high"))


@query("region_alignment", "ch", f"with {REGIONS} select book, count(*) as regions, count_if(page_start % 3 <> 0) as aligned, coalesce(list_sort(list(distinct chapter_no) filter (page_start % 3 = 0 and chapter_no is not null)), []) as misaligned_chapters from rg where scope = 'chapter' group by book")
def region_alignment(spark, d):
    return R.alignment_summary(regions(spark, d).withColumns({"note_kind": F.lit("endnote"), "aligned": F.col("page_start") % 3 != 0}), ["book"])


@query("renumbered_footnotes", "nt ch", "select nt.book, chapter_no, marker, row_number() over (partition by nt.book, chapter_no order by note_page, marker)::int as number from nt join ch on nt.book = ch.book and note_page between start_page and end_page")
def renumbered_footnotes(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    rows = O.interval_join(notes(spark, d).withColumn("page_no", F.col("note_page")), ch, ["book"], "page_no", "start_page", "end_page").withColumn("item_id", F.col("marker"))
    return R.renumbered(rows, ["book"]).select("book", "chapter_no", "marker", "number")
