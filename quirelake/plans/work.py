"""Queries over audits, note numbers, endnote indexes, edits, runs and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import audit as A
from quirelake.operators import jobs as J
from quirelake.operators import note_scan as N
from quirelake.operators import sequences as S
from quirelake.plans.contents import owned, page_roles, regions
from quirelake.plans.gates import FACTS, facts
from quirelake.plans.linking import in_chapters, note_pages
from quirelake.operators import gates as G
from quirelake.sources.books import anchors, contents, notes, pages, samples, sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body) if tables else body
        return f

    return keep


def files(spark, d):
    """A file per page: a heading, the text, references and definitions that match on even pages only."""
    n = F.col("page_no")
    refs = F.concat(F.lit("\n\nA closing line[^1] of this file."), F.when(n % 3 == 0, "\n\n### Part\n\nText.\n\n### part\n\nEnd.").otherwise(""), F.when(n % 5 == 0, "\n\nSee [7] there.").otherwise(""))
    text = F.concat(F.lit("# File "), n.cast("string"), F.lit("\n\nIt begins here.\n\n"), T.plain(F.col("text")), refs, F.when(n % 2 == 0, "\n\n[^1]: A note.").otherwise("\n\n[^2]: A note."))
    rows = pages(spark, d).select("book", "page_no", F.concat(n.cast("string"), F.lit(".md")).alias("path"), text.alias("content"), F.when(n % 11 == 0, "back_matter").otherwise("chapter").alias("role"), F.concat(F.lit("File "), F.when(n % 7 == 0, n + 1).otherwise(n).cast("string")).alias("expected_title"), F.lit(True).alias("in_contents"), F.lit(None).cast("array<string>").alias("markers"))
    return A.with_next_titles(rows, ["book"], "page_no")


@query("file_audit", "", "")
def file_audit(spark, d):
    return A.issues(files(spark, d)).select("book", "path", "issue_codes", "severity", "n_refs", "n_definitions", "missing_definitions", "orphan_definitions")


@query("file_audit_codes", "pg", "with f as (select book, page_no, unnest(list_filter([case when page_no % 7 = 0 then 'wrong_title' end, case when page_no % 11 = 0 then 'semantic_role_mismatch' end, case when page_no % 2 = 1 then 'missing_note_definition' end, case when page_no % 2 = 1 then 'orphan_note_definition' end, case when page_no % 2 = 1 then 'local_note_contract_broken' end, case when page_no % 3 = 0 then 'duplicated_heading' end], lambda x: x is not null)) as code from pg) select book, code, count(*) as n from f group by all")
def file_audit_codes(spark, d):
    """How many files of a book have each of the codes that do not depend on the page's own text."""
    codes = ("wrong_title", "semantic_role_mismatch", "missing_note_definition", "orphan_note_definition", "local_note_contract_broken", "duplicated_heading")
    rows = A.issues(files(spark, d)).select("book", F.explode("issue_codes").alias("code")).where(F.col("code").isin(*codes))
    return rows.groupBy("book", "code").agg(F.count("*").alias("n"))


@query("audit_reports", "", "")
def audit_reports(spark, d):
    return A.report(A.issues(files(spark, d)), ["book"])


LISTS = "nl as (select book, note_page // 10 as region, list(case when marker % 17 = 0 then 1900 + marker when marker % 13 = 0 then 1 else marker end order by note_page, marker) as a from nt group by all)"


def number_lists(spark, d):
    n = F.col("marker")
    read = F.when(n % 17 == 0, 1900 + n).when(n % 13 == 0, 1).otherwise(n).cast("int")
    lists = notes(spark, d).groupBy("book", F.expr("note_page div 10").cast("int").alias("region")).agg(F.array_sort(F.collect_list(F.struct("note_page", "marker", read.alias("read")))).alias("a"))
    return lists.select("book", "region", F.transform("a", lambda x: x["read"]).alias("a"))


@query("mended_numbers", "nt", f"with {LISTS}, u as (select book, region, unnest(range(1, len(a) + 1)) as i, a from nl), v as (select *, a[i] as x, case when i > 1 then a[i - 1] end as b, a[i + 1] as c from u), w as (select book, region, i, coalesce(b is not null and c = b + 1 and x <> c and (x > c + 20 or x <= b - 1 or x between 1500 and 2100), false) as gone, case when b is not null and c = b + 2 and x <> b + 1 and (x > c + 20 or x <= b or x between 1500 and 2100) then b + 1 else x end as x from v) select book, region, list(x order by i) filter (not gone) as numbers from w group by all")
def mended_numbers(spark, d):
    rows = number_lists(spark, d).withColumn("m", S.mended(F.col("a")))
    return rows.select("book", "region", F.transform(F.filter("m", lambda x: x["keep"]), lambda x: x["number"]).alias("numbers"))


@query("restarted_numbers", "", "")
def restarted_numbers(spark, d):
    return number_lists(spark, d).select("book", "region", S.restarted(F.col("a")).alias("numbers"))


@query("section_scores", "nt", f"with {LISTS}, s as (select book, region, a, list_sort(list_distinct(a)) as u from nl) select book, region, round(len(u)::double / greatest(1, u[-1] - u[1] + 1) - least(greatest(u[1] - 1, 0), 8) * 0.08 - len(list_filter(range(1, len(a)), lambda i: a[i + 1] < a[i])) * 0.2, 6) as score from s")
def section_scores(spark, d):
    return number_lists(spark, d).select("book", "region", F.round(S.section_score(F.col("a")), 6).alias("score"))


@query("endnote_collection_pages", "", "")
def endnote_collection_pages(spark, d):
    rows = in_chapters(spark, d, note_pages(spark, d).select("book", "page_no", F.col("markdown").alias("text")))
    last = rows.groupBy("book", "chapter_no").agg(F.max("page_no").alias("chapter_end"))
    return S.collection_pages(rows.join(last, ["book", "chapter_no"]), ["book"])


INDEX = "ix as (select book, case when marker % 6 > 0 then note_page // 10 end as chapter_no, (marker % 30)::int as number, 'note ' || marker as text, note_page as page_no from nt), en as (select book, chapter_no, number, max_by(text, {'l': length(text), 'p': -page_no}) as text, min(page_no) as page_no, count(*) as readings from ix where number > 0 group by all)"


def index_items(spark, d):
    n = F.col("marker")
    return notes(spark, d).select("book", F.when(n % 6 > 0, F.expr("note_page div 10").cast("int")).alias("chapter_no"), (n % 30).cast("int").alias("number"), F.concat(F.lit("note "), n.cast("string")).alias("text"), F.col("note_page").alias("page_no"), F.when(n % 4 == 0, F.lit("Notes ")).alias("hint"))


@query("endnote_index", "nt", f"with {INDEX} select book, chapter_no, number, page_no, readings, case when chapter_no is null then 'book' else 'chapter' end as scope from en")
def endnote_index(spark, d):
    return S.endnote_index(index_items(spark, d), ["book"]).drop("text")


@query("endnote_registry", "nt", f"with {INDEX} select book, number, count(*) as chapters, coalesce(list_sort(list(distinct chapter_no) filter (chapter_no is not null)), []) as used_in, count(*) > 1 as shared from en group by book, number")
def endnote_registry(spark, d):
    return S.registry(S.endnote_index(index_items(spark, d), ["book"]), ["book"])


@query("endnote_groups", "nt", "select book, case when marker % 6 > 0 then 'chapter:' || (note_page // 10) when marker % 4 = 0 then 'hint:notes' else 'book' end as \"group\", count(*) as n, min(note_page) as first_page, max(note_page) as last_page from nt group by all")
def endnote_groups(spark, d):
    return S.groups(index_items(spark, d), ["book"]).drop("numbers")


@query("region_note_items", "", "")
def region_note_items(spark, d):
    """Items of note scans by regions of pages."""
    rows = pages(spark, d).groupBy("book", F.expr("page_no div 8").alias("r")).agg(F.array_sort(F.collect_list("page_no")).alias("pages"))
    each = rows.select("book", F.concat(F.lit("r"), F.col("r").cast("string")).alias("region_id"), "pages", F.explode(F.array(F.lit("endnote"), F.lit("footnote"))).alias("note_kind"))
    return S.region_items(N.note_scans(note_pages(spark, d)).select("book", "page_no", "items"), each, ["book"]).drop("text")


@query("placed_markers", "", "")
def placed_markers(spark, d):
    return samples(spark, d).select("doc_id", "k", F.explode(S.placed_markers(F.col("s"))).alias("m")).select("doc_id", "k", "m.*")


@query("marker_style_counts", "", "")
def marker_style_counts(spark, d):
    return S.style_counts(samples(spark, d).select("doc_id", F.col("s").alias("line")), ["doc_id"])


@query("marker_origin_counts", "an", "select book, count_if(marker % 5 > 0 and marker % 3 > 0) as explicit, count_if(marker % 5 = 0) as synthetic, count_if(marker % 5 > 0 and marker % 3 = 0) as uncertain, count_if(marker % 7 = 0) as repaired from an group by book")
def marker_origin_counts(spark, d):
    n = F.col("marker")
    rows = anchors(spark, d).select("book", (n % 5 == 0).alias("synthetic"), F.when(n % 3 == 0, 0.5).otherwise(1.0).alias("certainty"), F.when(n % 7 == 0, "x").alias("repaired_from"))
    return S.marker_summary(rows, ["book"])


# edits, runs, views


@query("manual_edits", "", "with e as (select conv_id, turn, case when turn % 3 = 0 then text when turn % 3 = 1 then text || ' edited' else 'x' end as text, case when turn % 4 = 0 then 1 else 2 end as base from conversations) select c.conv_id, c.turn, case when base = 2 and turn % 3 > 0 then e.text else c.text end as text, case when base = 2 and turn % 3 > 0 then 3 else 2 end as version, case when base = 2 and turn % 3 > 0 then 'manual' else 'model' end as editor from conversations c join e using (conv_id, turn)")
def manual_edits(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = F.col("turn")
    edits = c.select("conv_id", "turn", F.when(n % 3 == 0, F.col("text")).when(n % 3 == 1, F.concat("text", F.lit(" edited"))).otherwise("x").alias("text"), F.when(n % 4 == 0, 1).otherwise(2).alias("base_version"))
    return J.edited(c.withColumns({"version": F.lit(2), "editor": F.lit("model")}), edits, ["conv_id", "turn"])[0]


@query("segment_states", "", "select l_orderkey as run, count(*) as segments, count_if(l_returnflag = 'A') as manual, count_if(l_returnflag = 'R') as failed, count_if(l_returnflag = 'R') > 0 and count_if(l_returnflag = 'R') < count(*) as partial from lineitem group by l_orderkey")
def segment_states(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("model").alias("editor"), F.when(F.col("l_returnflag") == "R", "error").otherwise("done").alias("status"))
    return J.segment_counts(li, ["run"])


@query("failed_paragraphs", "", "select l_orderkey as run, l_suppkey % 7 as page_no, l_linenumber as n from lineitem where l_returnflag = 'R'")
def failed_paragraphs(spark, d):
    li = table(spark, d, "lineitem")
    paragraph = F.struct(F.when(F.col("l_returnflag") == "R", "error").otherwise("done").alias("status"), F.col("l_linenumber").cast("string").alias("error"))
    units = li.select(F.col("l_orderkey").alias("run"), F.lit("u").alias("unit_id"), F.array(F.struct((F.col("l_suppkey") % 7).alias("page_no"), F.array(paragraph).alias("paragraphs"))).alias("segments"))
    return J.failed_places(units, ["run"]).select("run", "page_no", F.col("error").cast(li.schema["l_linenumber"].dataType).alias("n"))


@query("export_drift", "pg", "with f as (select book, page_no, case when page_no % 7 > 0 then text || case when page_no % 4 = 0 then ' [FN-1] [待翻译]' else '' end end as content, case when page_no % 5 > 0 then text end as old from pg where text is not null) select book, count(content) as files, count_if(old is null) as added, count_if(content is null) as removed, count_if(content <> old) as changed, coalesce(sum(len(regexp_extract_all(content, '(?i)\\[FN-[^\\]]+\\]|\\[EN-[^\\]]+\\]|\\{\\{(?:NOTE_REF|FN_REF|EN_REF):[^}]+\\}\\}'))), 0)::bigint as legacy_tokens, coalesce(sum(len(regexp_extract_all(content, '\\[待翻译\\]'))), 0)::bigint as pending from f group by book")
def export_drift(spark, d):
    n = F.col("page_no")
    rows = pages(spark, d).where("text is not null").select("book", F.when(n % 7 > 0, F.concat("text", F.when(n % 4 == 0, " [FN-1] [待翻译]").otherwise(""))).alias("content"), F.when(n % 5 > 0, F.col("text")).alias("old"))
    return J.drift(rows, ["book"])


_RULES = ", ".join(f"{{'phase': {p}, 'code': '{c}', 'there': {on}}}" for p, c, s, on in G.PHASES if s == "failure")


@query("book_status", "an nt ch", f"with {FACTS}, r as (select book, n_units, units_not_done, list_filter([{_RULES}], lambda x: x.there) as f from facts) select book, case when coalesce(list_min(list_transform(f, lambda x: x.phase)) > 4, true) then 'ready' else 'review_required' end as structure_state, list_min(list_transform(f, lambda x: x.phase)) as blocked_at, list_sort(list_distinct(list_transform(f, lambda x: x.code))) as blocking_reasons, units_not_done = 0 and len(f) = 0 as can_ship, round((n_units - units_not_done) / n_units, 4) as share_done from r")
def book_status(spark, d):
    f = facts(spark, d)
    progress = f.select("book", F.col("n_units").alias("total"), (F.col("n_units") - F.col("units_not_done")).alias("done"))
    return J.status(G.judged(f, ["book"]), progress, ["book"])


@query("page_segments", "pg", r"with p as (select book, page_no, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n+'), lambda x: trim(x)), lambda x: x <> '') as ps from pg) select book, page_no, unnest(range(len(ps)))::int as paragraph, unnest(list_transform(ps, lambda x: length(regexp_extract(x, '^(#{1,6})\s+', 1)))) as heading_level from p")
def page_segments(spark, d):
    rows = J.segments(pages(spark, d), ["book"]).select("book", "page_no", "paragraph", F.col("heading_level").cast("long").alias("heading_level"))
    return rows


def shown(spark, d):
    p = J.segments(pages(spark, d), ["book"])
    n = F.col("page_no")
    tr = p.select("book", "page_no", "paragraph", F.when(n % 4 > 0, F.upper("text")).alias("translation"), F.when(n % 4 == 0, "error").otherwise("done").alias("status"), F.when(n % 3 == 0, "manual").otherwise("model").alias("editor"), F.lit(1).alias("version")).where("page_no % 5 > 0")
    return J.display(p, tr, ["book"])


@query("display_states", "pg", r"with p as (select book, page_no, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n+'), lambda x: trim(x)), lambda x: x <> '') as ps from pg), u as (select book, page_no, unnest(ps) as t from p) select book, case when page_no % 5 = 0 then 'pending' when page_no % 3 = 0 then 'manual' when page_no % 4 = 0 then 'error' else 'done' end as state, count(*) as n from u group by all")
def display_states(spark, d):
    return shown(spark, d).groupBy("book", "state").agg(F.count("*").alias("n"))


@query("editor_pages", "", "")
def editor_pages(spark, d):
    return J.editor_pages(shown(spark, d), ["book"])


@query("chapter_markdown", "", "")
def chapter_markdown(spark, d):
    rows = in_chapters(spark, d, shown(spark, d))
    own = in_chapters(spark, d, notes(spark, d).withColumnRenamed("note_page", "page_no")).select("book", "chapter_no", F.col("marker").alias("number"), F.lit("A note.").alias("text"))
    return J.markdown(rows, own, ["book", "chapter_no"]).select("book", "chapter_no", F.sha2("markdown", 256).alias("sha256"))


@query("page_job_counts", "an nt", "with n as (select book, note_page as page_no, count(*) as notes from nt group by all) select book, page_no, notes from n")
def page_job_counts(spark, d):
    """Note jobs of each page, which come behind its paragraphs."""
    own = notes(spark, d).select("book", F.col("note_page").alias("page_no"), F.lit("endnote").alias("note_kind"), F.col("marker").alias("number"), F.lit("note").alias("text"))
    jobs = J.page_jobs(J.segments(pages(spark, d), ["book"]), own, ["book"])
    return jobs.where("kind <> 'body'").groupBy("book", "page_no").agg(F.count("*").alias("notes"))


@query("run_loops", "", "")
def run_loops(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).cast("int").alias("page_no"), F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_id") % 7 == 0, "quota").otherwise("error").alias("outcome"))
    return J.run_loops(log, ["run"])


@query("run_claims", "", "")
def run_claims(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("string").alias("token"), F.when(F.col("event_id") % 2 == 0, "claim").otherwise("release").alias("action"))
    return J.claims(log, ["run"])


@query("events_until_end", "", "with e as (select user_id as run, event_id as cursor, case when event_type = 'purchase' then 'done' else event_type end as t from events), x as (select run, min(cursor) as z from e where t = 'done' group by run) select e.run, cursor from e left join x using (run) where z is null or cursor <= z")
def events_until_end(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("cursor"), F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("event_type"))
    return J.until_end(e, ["run"]).select("run", "cursor")
