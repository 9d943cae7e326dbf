"""Queries over chapters, notes and links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.operators import notes as N
from quirelake.operators import ordering as O
from quirelake.sources.books import anchors, chapters, contents, lines, notes, pages, sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body) if tables else body
        return f

    return keep


LINKS = "lk as (select an.book, an.marker, page_no, k, note_page, case when abs(note_page - page_no) <= 1 then 'matched' when note_page is null then 'orphan_anchor' else 'orphan_note' end as status from an left join nt using (book, marker))"
IN_CHAPTER = LINKS + ", lc as (select lk.*, chapter_no from lk join ch on lk.book = ch.book and lk.page_no between start_page and end_page)"


def links(spark, d):
    return N.linked(anchors(spark, d), notes(spark, d), ["book"])


def chapter_links(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    return O.interval_join(links(spark, d), ch, ["book"], "page_no", "start_page", "end_page")


@query("note_link_summary", "an nt", f"with {LINKS} select book, count(*) as n, count_if(status = 'matched') as matched, count_if(status = 'orphan_note') as orphan_note, count_if(status = 'orphan_anchor') as orphan_anchor, round(count_if(status = 'orphan_note') / nullif(count_if(status <> 'orphan_anchor'), 0)::double, 6) as fallback_ratio from lk group by book")
def note_link_summary(spark, d):
    return N.link_counts(links(spark, d), ["book"])


@query("note_link_rows", "an nt", f"with {LINKS} select book, status, count(*) as n from lk group by all")
def note_link_rows(spark, d):
    return links(spark, d).groupBy("book", "status").agg(F.count("*").alias("n"))


@query("link_quality_gate", "an nt", f"with {LINKS}, s as (select book, count_if(status = 'orphan_anchor') as o, count_if(status = 'orphan_note') / nullif(count_if(status <> 'orphan_anchor'), 0)::double as r from lk group by book) select book, o <= 10 as orphans_ok, coalesce(r, 0) <= 0.30 as fallback_ok, o <= 10 and coalesce(r, 0) <= 0.30 as passes from s")
def link_quality_gate(spark, d):
    c = N.link_counts(links(spark, d), ["book"])
    return c.select("book", (F.col("orphan_anchor") <= N.MOST_ORPHANS).alias("orphans_ok"), (F.coalesce("fallback_ratio", F.lit(0.0)) <= N.MOST_FALLBACK).alias("fallback_ok"), N.passes_quality(F.col("orphan_anchor"), F.col("fallback_ratio")).alias("passes"))


@query("chapter_of_page", "ch", "select pg.book, page_no, chapter_no from pg left join ch on pg.book = ch.book and page_no between start_page and end_page")
def chapter_of_page(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    return O.interval_join(pages(spark, d).select("book", "page_no"), ch, ["book"], "page_no", "start_page", "end_page", how="left").select("book", "page_no", "chapter_no")


@query("nearest_prior_chapter", "ct", "select pg.book, page_no, max_by(chapter_no, start_page) as chapter_no, max(start_page) as start_page from pg join (select * from ct where chapter_no % 3 <> 2) c on pg.book = c.book and start_page <= page_no group by pg.book, page_no")
def nearest_prior_chapter(spark, d):
    ct = contents(spark, d).where("chapter_no % 3 <> 2").select("book", "chapter_no", "start_page").withColumn("start", F.col("start_page"))
    out = O.as_of(pages(spark, d).select("book", "page_no"), ct, ["book"], "page_no", "start", ["chapter_no", "start_page"])
    return out.where("start_page is not null")


@query("chapter_ranges", "ct", "select book, chapter_no, start_page, coalesce(lead(start_page) over (partition by book order by start_page) - 1, total_pages) as end_page from ct")
def chapter_ranges(spark, d):
    return O.ranges_from_starts(contents(spark, d), ["book"], "start_page", "total_pages").select("book", "chapter_no", "start_page", F.col("end").alias("end_page"))


@query("chapter_contracts", "an nt ch", f"""with {IN_CHAPTER}, s as (select book, chapter_no, list_sort(list(distinct marker) filter (where note_page is not null)) as ns, count(distinct marker) as n_markers, count_if(status = 'matched') as m, count_if(status = 'orphan_anchor') as n_orphans from lc group by all),
c as (select *, coalesce(ns, []) as l, list_filter(range(1, len(ns)), lambda i: ns[i + 1] - ns[i] > 20 and ns[i + 1] - ns[i] > 0.5 * ns[i])[1] as cut from s), e as (select *, case when cut is null then l else l[1:cut] end as x from c)
select book, chapter_no, coalesce(list_min(l), 0) = 1 as starts_at_one, len(l) > 0 as "any", coalesce(list_max(x) - list_min(x) + 1, 0) = len(x) as no_gap, m = len(l) as all_matched, len(l) = n_markers as equal_counts, len(l) as n_notes, n_markers, n_orphans from e""")
def chapter_contracts(spark, d):
    return N.contracts(chapter_links(spark, d), ["book", "chapter_no"])


@query("chapter_marker_ranges", "an ch", "select an.book, chapter_no, min(marker) as low, max(marker) as high, count(*) as n from an join ch on an.book = ch.book and page_no between start_page and end_page group by all")
def chapter_marker_ranges(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    return O.interval_join(anchors(spark, d), ch, ["book"], "page_no", "start_page", "end_page").groupBy("book", "chapter_no").agg(F.min("marker").alias("low"), F.max("marker").alias("high"), F.count("*").alias("n"))


@query("marker_gaps", "nt", "with b as (select book, min(marker) a, max(marker) z from nt group by book), s as (select book, unnest(range(a, z + 1))::int as marker from b) select book, marker from s anti join nt using (book, marker)")
def marker_gaps(spark, d):
    return N.gaps(notes(spark, d), ["book"], "marker")


@query("marker_gap_fill", "nt", """with b as (select book, min(marker) a, max(marker) z from nt group by book), s as (select book, unnest(range(a, z + 1))::int as marker from b),
m as (select s.book, s.marker, nt.note_page, last_value(nt.note_page ignore nulls) over (partition by s.book order by s.marker rows between unbounded preceding and current row) as before, first_value(nt.note_page ignore nulls) over (partition by s.book order by s.marker rows between current row and unbounded following) as after from s left join nt using (book, marker))
select book, marker, before as page_low, after as page_high from m where note_page is null""")
def marker_gap_fill(spark, d):
    nt = notes(spark, d)
    bounds = nt.groupBy("book").agg(F.min("marker").alias("a"), F.max("marker").alias("z"))
    every = bounds.select("book", F.explode(F.sequence("a", "z")).alias("marker")).join(nt, ["book", "marker"], "left")
    w = Window.partitionBy("book").orderBy("marker")
    low = F.last("note_page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("note_page", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return every.withColumn("page_low", low).withColumn("page_high", high).where("note_page is null").select("book", "marker", "page_low", "page_high")


@query("orphan_anchors", "an nt", "select book, marker, page_no from an anti join nt using (book, marker)")
def orphan_anchors(spark, d):
    return anchors(spark, d).join(notes(spark, d), ["book", "marker"], "left_anti").select("book", "marker", "page_no")


@query("anchored_notes", "an nt", "select book, marker, note_page from nt semi join (select * from an where page_no % 2 = 0) x using (book, marker)")
def anchored_notes(spark, d):
    return notes(spark, d).join(anchors(spark, d).where("page_no % 2 = 0"), ["book", "marker"], "left_semi").select("book", "marker", "note_page")


LOCAL = "la as (select book, page_no, k, marker % 7 as marker from an), ln2 as (select book, note_page, marker % 7 as marker, marker as id from nt)"


def local_pairs(spark, d):
    """Notes and markers whose numbers restart, so that several candidates occur; candidates lie within one page."""
    a = anchors(spark, d).select("book", "page_no", "k", (F.col("marker") % 7).alias("marker"))
    b = notes(spark, d).select("book", "note_page", (F.col("marker") % 7).alias("marker"), F.col("marker").alias("id"))
    near = b.withColumn("page_no", F.explode(F.array(F.col("note_page") - 1, F.col("note_page"), F.col("note_page") + 1)))
    return near.join(a, ["book", "marker", "page_no"]).withColumn("distance", F.abs(F.col("page_no") - F.col("note_page")))


@query("nearest_unique_anchor", "an nt", f"with {LOCAL}, c as (select ln2.book, id, ln2.marker, page_no, k, abs(page_no - note_page) as distance from ln2 join la on ln2.book = la.book and ln2.marker = la.marker and abs(page_no - note_page) <= 1), r as (select *, rank() over (partition by book, id order by distance) as r, count(*) over (partition by book, id, distance) as c from c) select book, id, page_no, k, distance from r where r = 1 and c = 1")
def nearest_unique_anchor(spark, d):
    return N.nearest_unique(local_pairs(spark, d), ["book", "id"], "distance").select("book", "id", "page_no", "k", "distance")


@query("ambiguous_notes", "an nt", f"with {LOCAL}, c as (select ln2.book, id, count(*) as candidates, count(distinct page_no) as pages from ln2 join la on ln2.book = la.book and ln2.marker = la.marker and abs(page_no - note_page) <= 1 group by all) select * from c where candidates > 1")
def ambiguous_notes(spark, d):
    return local_pairs(spark, d).groupBy("book", "id").agg(F.count("*").alias("candidates"), F.count_distinct("page_no").alias("pages")).where("candidates > 1")


@query("greedy_note_pairs", "an nt", "with a as (select *, row_number() over (partition by book, marker % 40 order by page_no, k) as nth from an), b as (select *, row_number() over (partition by book, marker % 40 order by note_page, marker) as nth from nt) select b.book, b.marker as note, a.marker as anchor from b left join a on a.book = b.book and a.marker % 40 = b.marker % 40 and a.nth = b.nth")
def greedy_note_pairs(spark, d):
    a = anchors(spark, d).select("book", F.col("marker").alias("anchor"), (F.col("marker") % 40).alias("marker"), F.struct("page_no", "k").alias("page_no"))
    b = notes(spark, d).select("book", F.col("marker").alias("note"), (F.col("marker") % 40).alias("marker"), F.struct("note_page", F.col("marker").alias("m")).alias("note_page"))
    return N.greedy_pairs(b, a, ["book"]).select("book", "note", "anchor")


@query("chapter_alignment", "an nt ch", "")
def chapter_alignment(spark, d):
    return N.alignment(chapter_links(spark, d), ["book", "chapter_no"])


@query("chapter_alignment_status", "an nt ch", f"with {IN_CHAPTER}, s as (select book, chapter_no, list(marker order by page_no, marker) as a, coalesce(list(marker order by note_page, marker) filter (where note_page is not null), []) as b from lc group by all) select book, chapter_no, case when a = b then 'clean' when len(a) = len(b) then 'mismatches' else 'misaligned' end as alignment_status, len(a) as n_markers, len(b) as n_notes from s")
def chapter_alignment_status(spark, d):
    s = chapter_links(spark, d).groupBy("book", "chapter_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "marker"))), lambda x: x["marker"]).alias("a"), F.transform(F.array_sort(F.collect_list(F.when(F.col("note_page").isNotNull(), F.struct("note_page", "marker")))), lambda x: x["marker"]).alias("b"))
    return s.select("book", "chapter_no", F.when(F.col("a") == F.col("b"), "clean").when(F.size("a") == F.size("b"), "mismatches").otherwise("misaligned").alias("alignment_status"), F.size("a").cast("long").alias("n_markers"), F.size("b").cast("long").alias("n_notes"))


@query("link_overrides", "an nt", f"with {LINKS}, o as (select l.doc_id, case when toxic = 1 then 'ignored' when quality = 0 then 'review_required' end as action from labels l), p as (select book, page_no, action from pg join o using (doc_id)) select lk.book, marker, coalesce(case when action = 'ignored' then 'ignored' end, status) as status, coalesce(action = 'review_required', false) as review from lk left join p using (book, page_no)")
def link_overrides(spark, d):
    action = F.when(F.col("toxic") == 1, "ignored").when(F.col("quality") == 0, "review_required")
    o = table(spark, d, "labels").select("doc_id", action.alias("action"))
    p = pages(spark, d).select("book", "page_no", "doc_id").join(o, "doc_id").drop("doc_id")
    out = links(spark, d).join(p, ["book", "page_no"], "left")
    return out.select("book", "marker", F.coalesce(F.when(F.col("action") == "ignored", "ignored"), "status").alias("status"), F.coalesce(F.col("action") == "review_required", F.lit(False)).alias("review"))


@query("note_modes", "an nt ch", f"with {IN_CHAPTER}, e as (select book, chapter_no, bool_or(status = 'matched') as m, bool_or(status = 'orphan_note') as o from lc group by all), c as (select ch.book, ch.chapter_no, case when m and o then 'review_required' when m then 'footnote_primary' when o then 'chapter_endnote_primary' else 'no_notes' end as mode from ch left join e using (book, chapter_no)) select book, chapter_no, mode, case when bool_or(mode = 'footnote_primary') over (partition by book) and bool_or(mode <> 'footnote_primary') over (partition by book) then 'mixed' when bool_or(mode = 'footnote_primary') over (partition by book) then 'footnote_only' else 'endnote_only' end as book_type from c")
def note_modes(spark, d):
    e = chapter_links(spark, d).groupBy("book", "chapter_no").agg(F.bool_or(F.col("status") == "matched").alias("m"), F.bool_or(F.col("status") == "orphan_note").alias("o"))
    mode = F.when(F.col("m") & F.col("o"), "review_required").when(F.col("m"), "footnote_primary").when(F.col("o"), "chapter_endnote_primary").otherwise("no_notes")
    c = chapters(spark, d).select("book", "chapter_no").join(e, ["book", "chapter_no"], "left").select("book", "chapter_no", mode.alias("mode"))
    kinds = c.groupBy("book").agg(F.bool_or(F.col("mode") == "footnote_primary").alias("f"), F.bool_or(F.col("mode") != "footnote_primary").alias("x"))
    return c.join(kinds, "book").select("book", "chapter_no", "mode", F.when(F.col("f") & F.col("x"), "mixed").when(F.col("f"), "footnote_only").otherwise("endnote_only").alias("book_type"))


@query("note_capture", "an nt ch", f"with {IN_CHAPTER}, e as (select book, chapter_no, count(*) as expected, count(note_page) as captured, count(distinct page_no) filter (where note_page is null) as empty_pages from lc group by all) select *, round(captured / expected::double, 6) as ratio, expected >= 10 and captured < 0.6 * expected as sparse from e")
def note_capture(spark, d):
    e = chapter_links(spark, d).groupBy("book", "chapter_no").agg(F.count("*").alias("expected"), F.count("note_page").alias("captured"), F.count_distinct(F.when(F.col("note_page").isNull(), F.col("page_no"))).alias("empty_pages"))
    return e.withColumn("ratio", F.round(F.col("captured") / F.col("expected"), 6)).withColumn("sparse", (F.col("expected") >= 10) & (F.col("captured") < 0.6 * F.col("expected")))


@query("footnote_bands", "nt", "with p as (select distinct book, note_page from nt where marker % 3 <> 0), r as (select book, note_page, note_page - row_number() over (partition by book order by note_page) as g from p) select book, min(note_page) as start, max(note_page) as \"end\", count(*) as size from r group by book, g")
def footnote_bands(spark, d):
    return O.islands(notes(spark, d).where("marker % 3 <> 0"), ["book"], "note_page")


@query("strict_note_runs", "nt", "with r as (select book, note_page, marker, case when note_page - lag(note_page) over (partition by book order by note_page, marker) = 1 then 0 else 1 end as n from nt), s as (select *, sum(n) over (partition by book order by note_page, marker) as g from r) select book, min(note_page) as start, max(note_page) as \"end\", count(*) as size from s group by book, g")
def strict_note_runs(spark, d):
    return O.strict_runs(notes(spark, d), ["book"], "note_page", "marker")


@query("merged_regions", "nt", """with x as (select book, marker // 9 as g, min(note_page) as s, max(note_page) as e from nt where marker % 9 < 4 group by all), r as (select *, max(e) over (partition by book order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
q as (select *, sum(case when reach is null or s > reach + 1 then 1 else 0 end) over (partition by book order by s, e) as run from r) select book, min(s) as start, max(e) as "end", count(*) as parts from q group by book, run""")
def merged_regions(spark, d):
    x = notes(spark, d).where("marker % 9 < 4").groupBy("book", F.floor(F.col("marker") / 9).alias("g")).agg(F.min("note_page").alias("start"), F.max("note_page").alias("end"))
    return O.merged_runs(x.drop("g"), ["book"], 1)


@query("page_label_fill", "pg", """with p as (select book, page_no, case when doc_id % 4 = 0 then page_no + 10 when doc_id % 31 = 5 then page_no + 90 end as label from pg),
q as (select *, last_value(case when label is not null then page_no end ignore nulls) over a as lo, last_value(label ignore nulls) over a as lv, first_value(case when label is not null then page_no end ignore nulls) over b as ro, first_value(label ignore nulls) over b as rv from p window a as (partition by book order by page_no rows between unbounded preceding and current row), b as (partition by book order by page_no rows between current row and unbounded following))
select book, page_no, label, coalesce(label, case when rv - lv = ro - lo then lv + page_no - lo end) as label_filled, coalesce(label, round_even(lv + (rv - lv) * (page_no - lo) / nullif(ro - lo, 0)::double, 0)::int) as label_between from q""")
def page_label_fill(spark, d):
    label = F.when(F.col("doc_id") % 4 == 0, F.col("page_no") + 10).when(F.col("doc_id") % 31 == 5, F.col("page_no") + 90)
    p = pages(spark, d).select("book", "page_no", label.alias("label"))
    out = O.filled(p, ["book"], "page_no", "label").withColumnRenamed("label_filled", "exact")
    return O.interpolated(out, ["book"], "page_no", "label").select("book", "page_no", "label", F.col("exact").alias("label_filled"), F.col("label_filled").alias("label_between"))


@query("label_lookup", "pg", "select book, ((page_no + 3) // 4)::int as label, min(page_no) as first_page, min_by(doc_id, page_no) as doc_id from pg group by all")
def label_lookup(spark, d):
    p = pages(spark, d).select("book", "page_no", "doc_id", F.floor((F.col("page_no") + 3) / 4).cast("int").alias("label"))
    return p.groupBy("book", "label").agg(F.min("page_no").alias("first_page"), F.min_by("doc_id", "page_no").alias("doc_id"))


@query("toc_targets", "ct", "select c.book, chapter_no, coalesce(e.page_no, l.page_no, c.start_page + 1) as target from ct c left join pg e on e.book = c.book and e.page_no = c.start_page and e.doc_id % 3 = 0 left join (select book, min(page_no) as page_no, page_no // 10 as label from pg where doc_id % 2 = 0 group by book, page_no // 10) l on l.book = c.book and l.label = c.chapter_no")
def toc_targets(spark, d):
    p = pages(spark, d).select("book", "page_no", "doc_id")
    c = contents(spark, d).select("book", "chapter_no", "start_page")
    exact = p.where("doc_id % 3 = 0").select("book", F.col("page_no").alias("start_page"), F.col("page_no").alias("by_page"))
    label = p.where("doc_id % 2 = 0").groupBy("book", F.floor(F.col("page_no") / 10).cast("int").alias("chapter_no")).agg(F.min("page_no").alias("by_label"))
    return c.join(exact, ["book", "start_page"], "left").join(label, ["book", "chapter_no"], "left").select("book", "chapter_no", F.coalesce("by_page", "by_label", F.col("start_page") + 1).alias("target"))


@query("repeated_lines", "ln", "with r as (select book, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as t, page_no from ln where k = 0 union all select book, book, page_no from pg), n as (select book, count(distinct page_no) as pages from pg group by book), c as (select book, t, count(*) as n from r where length(t) between 2 and 120 group by all) select c.book, t, n, n >= greatest(3, floor(0.25 * pages)) as removed from c join n using (book)")
def repeated_lines(spark, d):
    from quirelake.functions.text import squeezed

    p = pages(spark, d).select("book", "page_no")
    r = lines(spark, d).where("k = 0").select("book", F.lower(squeezed(F.col("line"))).alias("t")).unionByName(p.select("book", F.col("book").alias("t")))
    n = p.groupBy("book").agg(F.count_distinct("page_no").alias("pages"))
    c = r.where(F.char_length("t").between(2, 120)).groupBy("book", "t").agg(F.count("*").alias("n"))
    return c.join(n, "book").select("book", "t", "n", (F.col("n") >= F.greatest(F.lit(3), F.floor(0.25 * F.col("pages")))).alias("removed"))


@query("page_order_repair", "pg", "with g as (select book, unnest(range(1, max(page_no) + 4))::int as page_no from pg group by book) select g.book, g.page_no, pg.doc_id, pg.doc_id is null as placeholder from g left join (select * from pg where doc_id % 6 <> 0) pg using (book, page_no)")
def page_order_repair(spark, d):
    p = pages(spark, d).select("book", "page_no", "doc_id")
    every = p.groupBy("book").agg(F.max("page_no").alias("z")).select("book", F.explode(F.sequence(F.lit(1), F.col("z") + 3)).alias("page_no"))
    return every.join(p.where("doc_id % 6 <> 0"), ["book", "page_no"], "left").withColumn("placeholder", F.col("doc_id").isNull())


@query("visible_pages", "pg", "with v as (select book, page_no, doc_id % 5 = 0 or book = 'src3' as hidden from pg) select book, page_no from (select *, count_if(not hidden) over (partition by book) as shown from v) where not hidden or shown = 0")
def visible_pages(spark, d):
    v = pages(spark, d).select("book", "page_no", ((F.col("doc_id") % 5 == 0) | (F.col("book") == "src3")).alias("hidden"))
    shown = v.groupBy("book").agg(F.count_if(~F.col("hidden")).alias("shown"))
    return v.join(shown, "book").where("not hidden or shown = 0").select("book", "page_no")


@query("resolved_page", "pg", "with v as (select * from pg where doc_id % 5 <> 0) select book, coalesce(min(page_no) filter (where page_no = 7), min(page_no) filter (where page_no > 7), max(page_no) filter (where page_no < 7)) as page_no from v group by book")
def resolved_page(spark, d):
    p = F.col("page_no")
    v = pages(spark, d).where("doc_id % 5 <> 0")
    return v.groupBy("book").agg(F.coalesce(F.min(F.when(p == 7, p)), F.min(F.when(p > 7, p)), F.max(F.when(p < 7, p))).alias("page_no"))


@query("redundant_candidates", "ln", "with c as (select doc_id, k, line, length(line) as n from ln where k < 6) select a.doc_id, a.k, count(b.k) as shorter from c a left join c b on a.doc_id = b.doc_id and a.k <> b.k and b.n < a.n and contains(a.line, b.line) group by all")
def redundant_candidates(spark, d):
    c = lines(spark, d).where("k < 6").select("doc_id", "k", "line", F.char_length("line").alias("n"))
    b = c.select("doc_id", F.col("k").alias("k2"), F.col("line").alias("line2"), F.col("n").alias("n2"))
    pairs = c.join(b, "doc_id").where("k <> k2 and n2 < n and contains(line, line2)").groupBy("doc_id", "k").agg(F.count("*").alias("shorter"))
    return c.select("doc_id", "k").join(pairs, ["doc_id", "k"], "left").withColumn("shorter", F.coalesce("shorter", F.lit(0)))


@query("box_containment", "", """with i as (select l_orderkey as page, l_linenumber as item, (l_partkey % 600)::double as x, (l_suppkey % 90 * 10)::double as y from lineitem), b as (select o_orderkey as page, b.n as box, 0.0 + b.n * 200 as x0, 250.0 + b.n * 200 as x1, 0.0 as y0, 700.0 as y1 from orders, range(3) b(n)),
m as (select i.page, item, box, row_number() over (partition by i.page, item order by y0, box) as r from i join b on i.page = b.page and x between x0 and x1 and y between y0 and y1) select page, item, box from m where r = 1""")
def box_containment(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("item"), (F.col("l_partkey") % 600).cast("double").alias("x"), (F.col("l_suppkey") % 90 * 10).cast("double").alias("y"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("box"))
    b = b.select("page", "box", (F.col("box") * 200.0).alias("x0"), (250.0 + F.col("box") * 200).alias("x1"), F.lit(0.0).alias("y0"), F.lit(700.0).alias("y1"))
    m = i.join(b, "page").where("x between x0 and x1 and y between y0 and y1")
    return m.groupBy("page", "item").agg(F.min_by("box", F.struct("y0", "box")).alias("box"))


@query("conflict_anchors", "an nt", "with j as (select an.book, an.page_no, nt.marker from an join nt on an.book = nt.book and an.page_no = nt.note_page) select book, page_no, count(distinct marker) as notes from j group by all having count(distinct marker) > 1")
def conflict_anchors(spark, d):
    j = anchors(spark, d).select("book", "page_no").join(notes(spark, d).withColumnRenamed("note_page", "page_no"), ["book", "page_no"])
    return j.groupBy("book", "page_no").agg(F.count_distinct("marker").alias("notes")).where("notes > 1")


@query("endnote_owner_votes", "an nt ch", f"with {IN_CHAPTER}, v as (select book, marker // 20 as region, chapter_no, count(*) as n from lc where status = 'matched' group by all), r as (select *, row_number() over (partition by book, region order by n desc, chapter_no) as r, sum(n) over (partition by book, region) as total from v) select book, region::bigint as region, chapter_no, round(n / total::double, 6) as share from r where r = 1")
def endnote_owner_votes(spark, d):
    v = chapter_links(spark, d).where("status = 'matched'").groupBy("book", F.floor(F.col("marker") / 20).alias("region"), "chapter_no").agg(F.count("*").alias("n"))
    top = v.groupBy("book", "region").agg(F.min_by(F.struct("chapter_no", "n"), F.struct(-F.col("n"), F.col("chapter_no"))).alias("t"), F.sum("n").alias("total"))
    return top.select("book", "region", "t.chapter_no", F.round(F.col("t.n") / F.col("total"), 6).alias("share"))


@query("sequence_outliers", "nt", "with w as (select book, marker, note_page, case when marker % 17 = 0 then marker + 500 else marker end as seen from nt), x as (select *, lag(seen) over (partition by book order by marker) as p, lead(seen) over (partition by book order by marker) as q from w) select book, marker, case when seen > q + 20 then p + 1 else seen end as repaired, seen > q + 20 as outlier from x where p is not null and q is not null")
def sequence_outliers(spark, d):
    w = Window.partitionBy("book").orderBy("marker")
    x = notes(spark, d).withColumn("seen", F.when(F.col("marker") % 17 == 0, F.col("marker") + 500).otherwise(F.col("marker")))
    x = x.withColumn("p", F.lag("seen").over(w)).withColumn("q", F.lead("seen").over(w)).where("p is not null and q is not null")
    out = F.col("seen") > F.col("q") + 20
    return x.select("book", "marker", F.when(out, F.col("p") + 1).otherwise(F.col("seen")).alias("repaired"), out.alias("outlier"))
