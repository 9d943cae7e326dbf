"""Queries over note scans and stateful links; their folds are tested on stated cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import note_lines as L
from quirelake.operators import linking as K
from quirelake.operators import note_scan as N
from quirelake.operators import ordering as O
from quirelake.sources.books import anchors, chapters, notes, pages, samples, sql

QUERIES, ORACLE_SQL = {}, {}
KEY = ["book", "chapter_no"]


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body)
        return f

    return keep


def in_chapters(spark, d, rows):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    return O.interval_join(rows, ch, ["book"], "page_no", "start_page", "end_page").drop("start_page", "end_page")


def linked(spark, d):
    """Markers are numbered anew every twenty, so notes and markers of a chapter tie."""
    n, m = F.col("marker"), F.col("marker") % 20
    kind = F.when(n % 3 == 0, "footnote").otherwise("endnote")
    a = in_chapters(spark, d, anchors(spark, d)).select(*KEY, F.concat(F.lit("a"), n.cast("string")).alias("anchor_id"), "page_no", F.lit(0).alias("paragraph"), F.col("k").alias("start"), m.cast("string").alias("marker"), F.when(n % 7 == 0, "unknown").otherwise(kind).alias("kind"), F.lit(1.0).alias("certainty"), F.lit(False).alias("synthetic"), F.lit("").alias("source_text"))
    b = in_chapters(spark, d, notes(spark, d).withColumnRenamed("note_page", "page_no")).select(*KEY, F.concat(F.lit("n"), n.cast("string")).alias("note_id"), "page_no", m.cast("string").alias("marker"), kind.alias("note_kind"), F.lit(0).alias("priority"))
    return K.links(b, a, KEY)


@query("stateful_links", "", "")
def stateful_links(spark, d):
    return linked(spark, d)


@query("stateful_link_summary", "", "")
def stateful_link_summary(spark, d):
    """Counts by kind, status and resolver."""
    n = lambda on: F.count_if(F.expr(on))
    return linked(spark, d).groupBy("book").agg(
        n("status = 'matched'").alias("matched"), *(n(f"note_kind = '{k}' and status = '{s}'").alias(f"{k}_{s}") for k in ("footnote", "endnote") for s in ("orphan_note", "orphan_anchor")),
        n("status = 'ambiguous'").alias("ambiguous"), n("status = 'ignored'").alias("ignored"), n("resolver = 'fallback'").alias("fallback"), n("resolver = 'repair'").alias("repair"),
    )


@query("found_markers", "sm", "with f as (select doc_id, k, s, regexp_extract(s, '\\[\\s*' || n || '\\s*\\]') as a, regexp_extract(s, '\\$\\s*\\^\\s*\\{\\s*' || n || '\\s*\\}\\s*\\$') as b, regexp_extract(s, '<sup>\\s*' || n || '\\s*</sup>') as c, regexp_extract(s, '\\^\\s*\\{\\s*' || n || '\\s*\\}') as e, regexp_extract(s, '\\^\\s*' || n || '\\b') as f, regexp_extract(s, '»\\s*' || n || '\\b') as g, case when contains(s, translate(n::varchar, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')) then translate(n::varchar, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') else '' end as h from sm), p as (select doc_id, k, s, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(e, ''), nullif(f, ''), nullif(g, ''), nullif(h, '')) as matched from f) select doc_id, k, (instr(s, matched) - 1)::int as start, matched from p where matched is not null")
def found_markers(spark, d):
    rows = samples(spark, d).select("doc_id", "k", K.found_marker(F.col("s"), F.col("n").cast("string")).alias("x")).where("x is not null")
    return rows.select("doc_id", "k", "x.start", "x.matched")


def note_pages(spark, d):
    """Pages dressed with footnotes, notes headings, endnotes that go on, lost numbers."""
    p, n = pages(spark, d), F.col("page_no")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    text = F.when(n % 6 == 1, F.concat(F.lit("Body.\nNOTES\n"), numbered)).when(n % 6 == 2, numbered).otherwise(F.col("text"))
    foot = F.when(n % 6 == 4, F.concat(F.lit("3. A note.\nlbid. ^^ |\n"), numbered)).otherwise("")
    return p.select("book", "page_no", text.alias("markdown"), foot.alias("footnotes"), F.when(n % 6 == 5, F.slice(lines, 1, 2)).otherwise(F.array().cast("array<string>")).alias("blocks"))


@query("note_scans", "", "")
def note_scans(spark, d):
    return N.note_scans(note_pages(spark, d)).select("book", "page_no", "page_kind", F.size("items").alias("n_items"), "section_hints", "ambiguity_flags", "note_start")


@query("note_scan_kinds", "", "")
def note_scan_kinds(spark, d):
    s = F.struct("*")
    rows = N.note_scans(note_pages(spark, d)).select("book", "page_kind", N.scan_score(s).alias("score"), N.first_marker(s, "endnote").alias("first"))
    return rows.groupBy("book", "page_kind").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"), F.count_if(F.expr("first <> ''")).alias("with_endnotes"))


@query("note_line_forms", "sm", r"""with f as (select doc_id, k, n, unnest([s, 'I ' || n || '. ' || s, (n // 10) || ' ' || (n % 10) || '. A torn note', 'the words that run on here ' || n || ' Then a note', '[' || n || ']', n || '.', '!| ' || n || 'a The body', 'lbid. ^[ ' || n, (1900 + n) || ' was a year']) as x, unnest(range(9))::int as i from sm)
select doc_id, k, i, length(regexp_replace(x, '[^0-9]', '', 'g')) between 1 and 4 as has_token, regexp_matches(x, '^\s*(?:\[[0-9]{1,4}\]|[0-9]{1,4}[.;:,)、\]])\s*$') as is_only_marker, right(trim(regexp_replace(trim(regexp_replace(trim(x), '\$\s*\^\{([0-9]+)\}\s*\$', '[\1]', 'g')), '(^|[^0-9A-Za-z_\[])\^\{([0-9]+)\}', '\1[\2]', 'g')), 1) in ('.', ';', ':', '!', '?', ')', ']', '»', '”', '"', '''') as complete from f""")
def note_line_forms(spark, d):
    n, s = F.col("n"), F.col("s")
    t = lambda c: c.cast("string")
    forms = F.array(s, F.concat(F.lit("I "), t(n), F.lit(". "), s), F.concat(t(F.floor(n / 10)), F.lit(" "), t(n % 10), F.lit(". A torn note")), F.concat(F.lit("the words that run on here "), t(n), F.lit(" Then a note")), F.concat(F.lit("["), t(n), F.lit("]")), F.concat(t(n), F.lit(".")), F.concat(F.lit("!| "), t(n), F.lit("a The body")), F.concat(F.lit("lbid. ^[ "), t(n)), F.concat(t(1900 + n), F.lit(" was a year")))
    rows = samples(spark, d).select("doc_id", "k", F.posexplode(forms).alias("i", "x"))
    return rows.select("doc_id", "k", "i", L.number_token(F.col("x")).isNotNull().alias("has_token"), L.only_marker(F.col("x")).isNotNull().alias("is_only_marker"), L.is_complete(F.col("x")).alias("complete"))


@query("torn_note_numbers", "sm", "select doc_id, k, n, '12' || n as body from sm where n between 10 and 99")
def torn_note_numbers(spark, d):
    """Two-digit numbers torn apart are read as one."""
    line = F.concat(F.floor(F.col("n") / 10).cast("string"), F.lit(" "), (F.col("n") % 10).cast("string"), F.lit(". 12"), F.col("n").cast("string"))
    rows = samples(spark, d).where("n between 10 and 99").select("doc_id", "k", L.numbered_line(line).alias("x"))
    return rows.select("doc_id", "k", F.col("x.number").alias("n"), "x.body")


@query("embedded_notes", "sm", "select doc_id, k, n as number, 'Then ' || k as body from sm where n <= 20")
def embedded_notes(spark, d):
    line = F.concat(F.lit("the words that run on here "), F.col("n").cast("string"), F.lit(" Then "), F.col("k").cast("string"))
    rows = samples(spark, d).select("doc_id", "k", F.col("n").alias("_n"), L.embedded_line(line).alias("x")).where("x is not null and x.number = _n")
    return rows.select("doc_id", "k", "x.number", "x.body")


@query("lost_note_lines", "sm", r"with f as (select doc_id, k, case n % 4 when 0 then 'Ibid., p. ' || n || ' ^[' when 1 then 'see HAL and NTO ' || k when 2 then 'lbid of it' else 'plain words ' || k end as x from sm) select doc_id, k, regexp_matches(regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'), '[iyjl]bid') or length(x) - length(translate(x, '^[]\|/_', '')) >= 2 or len(regexp_extract_all(x, '[A-Z]{3,}')) >= 2 as lost from f")
def lost_note_lines(spark, d):
    n, k = F.col("n"), F.col("k").cast("string")
    x = F.when(n % 4 == 0, F.concat(F.lit("Ibid., p. "), n.cast("string"), F.lit(" ^["))).when(n % 4 == 1, F.concat(F.lit("see HAL and NTO "), k)).when(n % 4 == 2, F.lit("lbid of it")).otherwise(F.concat(F.lit("plain words "), k))
    return samples(spark, d).select("doc_id", "k", L.lost_note(x).alias("lost"))
