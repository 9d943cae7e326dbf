"""Queries over paragraphs, note scans of pages, definitions and text audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import ordering as O
from quirelake.sources.books import anchors, contents, lines, notes, pages, samples, sql

QUERIES, ORACLE_SQL = {}, {}

# Audit codes with their severity, worst first.
CODES = {"placeholder": "blocking", "raw_marker": "major", "heading_in_paragraph": "major", "low_opening": "minor", "no_tail": "minor", "repeated_heading": "minor", "notes_block": "minor"}
RANK = {"blocking": 3, "major": 2, "minor": 1}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body) if tables else body
        return f

    return keep


MIDWAY = "length(trim({0})) >= 10 and not regexp_matches(regexp_replace(trim({0}), '(?:\\s*(?:\\[\\^?[0-9]{{1,4}}\\]|\\$?\\^\\{{[0-9]{{1,4}}\\}}\\$?|[⁰¹²³⁴⁵⁶⁷⁸⁹]+))+$', ''), '[.!?…。！？][\"''”’»)\\]]*$')"
LOW = "regexp_matches(trim({0}), '^(\\p{{Ll}}|[,;:)\\]}}.])')"


@query("line_paragraphs", "sm", f"with p as (select *, lag(s) over (partition by doc_id order by k) as b from sm), q as (select *, sum(case when coalesce({MIDWAY.format('b')} and {LOW.format('s')}, false) then 0 else 1 end) over (partition by doc_id order by k) as g from p) select doc_id, g::bigint as paragraph, min(k) as first_line, count(*) as n_lines, sum(length(s) + 1)::bigint - 1 as chars from q group by doc_id, g")
def line_paragraphs(spark, d):
    """Lines merged to paragraphs: a line goes on with the one before if that stops midway and it starts low."""
    w = Window.partitionBy("doc_id").orderBy("k")
    s = samples(spark, d).withColumn("b", F.lag("s").over(w))
    s = s.withColumn("g", F.sum(F.when(F.coalesce(T.continues(F.col("b"), F.col("s")), F.lit(False)), 0).otherwise(1)).over(w))
    return s.groupBy("doc_id", F.col("g").alias("paragraph")).agg(F.min("k").alias("first_line"), F.count("*").alias("n_lines"), (F.sum(F.char_length("s") + 1) - 1).alias("chars"))


@query("page_continuations", "ln", f"with e as (select book, page_no, min_by(line, k) as first, max_by(line, k) as last from ln group by all), n as (select *, lag(last) over w as before, lead(first) over w as after from e window w as (partition by book order by page_no)) select book, page_no, coalesce({MIDWAY.format('before')} and {LOW.format('first')}, false) as from_previous, coalesce({MIDWAY.format('last')} and {LOW.format('after')}, false) as to_next from n")
def page_continuations(spark, d):
    e = lines(spark, d).groupBy("book", "page_no").agg(F.min_by("line", "k").alias("first"), F.max_by("line", "k").alias("last"))
    w = Window.partitionBy("book").orderBy("page_no")
    n = e.withColumn("before", F.lag("last").over(w)).withColumn("after", F.lead("first").over(w))
    return n.select("book", "page_no", F.coalesce(T.continues(F.col("before"), F.col("first")), F.lit(False)).alias("from_previous"), F.coalesce(T.continues(F.col("last"), F.col("after")), F.lit(False)).alias("to_next"))


DEFINITION = r"regexp_matches(trim(regexp_replace(s, '^#{1,6}\s+', '')), '^(\[[0-9]{1,4}\]|[0-9]{1,4}[.)\]])\s*\S') and not regexp_matches(trim(s), '^(19[0-9][0-9]|20[0-9][0-9]|2100)[.)\]]')"


@query("page_note_scans", "sm", f"with x as (select doc_id, k, {DEFINITION} as def, regexp_matches(lower(s), '^\\s*(?:#+\\s*)?(notes?|endnotes?)\\s*$') as head from sm), c as (select doc_id, count(*) as n, count_if(def)::bigint as defs, min(k) filter (where head) as head_at, min(k) filter (where def) as def_at from x group by doc_id) select doc_id, defs, least(coalesce(head_at, def_at), coalesce(def_at, head_at)) as note_start, case when head_at is null and defs < 3 then 'body' when head_at is not null and head_at < 2 and 2 * defs >= n then 'endnote_collection' when head_at is not null and defs > 0 then 'mixed_body_endnotes' when 2 * defs >= n then 'endnote_collection' else 'body' end as page_kind from c")
def page_note_scans(spark, d):
    """What kind of notes a page holds: none, after a heading in the text, or a page of its own."""
    is_def = T.note_definition(F.col("s"))["marker"] != ""
    head = F.regexp_like(F.lower("s"), F.lit(r"^\s*(?:#+\s*)?(notes?|endnotes?)\s*$"))
    x = samples(spark, d).select("doc_id", "k", is_def.alias("def"), head.alias("head"))
    c = x.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("def").alias("defs"), F.min(F.when(F.col("head"), F.col("k"))).alias("head_at"), F.min(F.when(F.col("def"), F.col("k"))).alias("def_at"))
    kind = F.when(F.col("head_at").isNull() & (F.col("defs") < 3), "body").when((F.col("head_at") < 2) & (2 * F.col("defs") >= F.col("n")), "endnote_collection").when(F.col("head_at").isNotNull() & (F.col("defs") > 0), "mixed_body_endnotes").when(2 * F.col("defs") >= F.col("n"), "endnote_collection").otherwise("body")
    return c.select("doc_id", "defs", F.least("head_at", "def_at").alias("note_start"), kind.alias("page_kind"))


@query("definition_blocks", "sm", f"with x as (select doc_id, k, s, {DEFINITION} as def from sm), y as (select *, last_value(case when def then k end ignore nulls) over w as owner, last_value(case when def then k when not regexp_matches(trim(s), '^\\p{{Ll}}') then -1 end ignore nulls) over w as state from x window w as (partition by doc_id order by k rows between unbounded preceding and current row)) select doc_id, owner, count(*) as n_lines from y where owner is not null and state >= 0 group by all")
def definition_blocks(spark, d):
    """Note definitions with their continuation lines; a line that doesn't start low ends the block."""
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    x = samples(spark, d).withColumn("def", T.note_definition(F.col("s"))["marker"] != "")
    owner = F.last(F.when(F.col("def"), F.col("k")), ignorenulls=True).over(w)
    state = F.last(F.when(F.col("def"), F.col("k")).when(~T.starts_low(F.col("s")), -1), ignorenulls=True).over(w)
    return x.withColumn("owner", owner).withColumn("state", state).where("owner is not null and state >= 0").groupBy("doc_id", "owner").agg(F.count("*").alias("n_lines"))


@query("text_audit", "sm", r"""with x as (select doc_id, k, s, lag(s) over (partition by doc_id order by k) as b, row_number() over (partition by doc_id, s order by k) as nth from sm),
i as (select doc_id, unnest([case when regexp_matches(s, '\^\{[0-9]+\}|<sup>') then 'raw_marker' end, case when starts_with(s, '## ') and b is not null and not starts_with(b, '#') then 'heading_in_paragraph' end,
 case when regexp_matches(trim(s), '^\p{Ll}') then 'low_opening' end, case when length(trim(s)) >= 60 and not regexp_matches(trim(s), '[.!?…。！？;:»”"'')\]]$') then 'no_tail' end, case when starts_with(s, '## ') and nth > 1 then 'repeated_heading' end, case when s = 'NOTES' then 'notes_block' end, case when contains(s, '{{NOTE_REF') then 'placeholder' end]) as code from x),
c as (select doc_id, code, count(*) as n from i where code is not null group by all)
select doc_id, list_sort(list(code)) as codes, sum(n)::bigint as issues, case when bool_or(code = 'placeholder') then 'blocking' when bool_or(code in ('raw_marker', 'heading_in_paragraph')) then 'major' else 'minor' end as severity from c group by doc_id""")
def text_audit(spark, d):
    """Issue codes of each text, their number, and the worst severity."""
    s = F.col("s")
    x = samples(spark, d).withColumn("b", F.lag("s").over(Window.partitionBy("doc_id").orderBy("k")))
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", F.md5("s")).orderBy("k")))
    heading = F.startswith(s, F.lit("## "))
    tests = {"raw_marker": F.regexp_like(s, F.lit(r"\^\{[0-9]+\}|<sup>")), "heading_in_paragraph": heading & F.col("b").isNotNull() & ~F.startswith("b", F.lit("#")), "low_opening": T.starts_low(s), "no_tail": T.lacks_tail(s), "repeated_heading": heading & (F.col("nth") > 1), "notes_block": s == "NOTES", "placeholder": F.contains(s, F.lit("{{NOTE_REF"))}
    i = x.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(t, c) for c, t in tests.items())))).alias("code"))
    c = i.groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    rank = F.create_map(*(F.lit(v) for kv in CODES.items() for v in (kv[0], RANK[kv[1]])))
    out = c.groupBy("doc_id").agg(F.array_sort(F.collect_list("code")).alias("codes"), F.sum("n").alias("issues"), F.max(rank[F.col("code")]).alias("r"))
    return out.select("doc_id", "codes", "issues", F.when(F.col("r") == 3, "blocking").when(F.col("r") == 2, "major").otherwise("minor").alias("severity"))


@query("toc_offsets", "ct", "with f as (select book, page_no, lower(split_part(replace(text, chr(10), ' '), ' ', 1)) as w from pg), m as (select ct.book, chapter_no, start_page, min(page_no) as page_no from ct join f on f.book = ct.book and f.w = lower(split_part(title, ' ', 1)) group by all) select book, min_by(page_no - start_page, chapter_no) as \"offset\", count(*) as matched from m group by book")
def toc_offsets(spark, d):
    """The offset between listed and found pages, by the first title whose first word starts a page."""
    f = pages(spark, d).select("book", "page_no", F.lower(F.split_part(F.regexp_replace("text", "\n", " "), F.lit(" "), F.lit(1))).alias("w")).groupBy("book", "w").agg(F.min("page_no").alias("page_no"))
    c = contents(spark, d).select("book", "chapter_no", "start_page", F.lower(F.split_part("title", F.lit(" "), F.lit(1))).alias("w"))
    m = c.join(f, ["book", "w"])
    return m.groupBy("book").agg(F.min_by(F.col("page_no") - F.col("start_page"), "chapter_no").alias("offset"), F.count("*").alias("matched"))


@query("footnote_paragraphs", "an nt", "with a as (select book, marker % 7 as m, page_no, max(k) as k from an group by all) select nt.book, nt.marker, max(page_no) as page_no, max_by(k, page_no) as k from nt join a on a.book = nt.book and a.m = nt.marker % 7 and a.page_no <= nt.note_page group by all")
def footnote_paragraphs(spark, d):
    """The nearest paragraph at or above a note among those that carry its marker."""
    a = anchors(spark, d).groupBy("book", (F.col("marker") % 7).alias("m"), "page_no").agg(F.max("k").alias("k")).withColumn("start", F.col("page_no"))
    n = notes(spark, d).select("book", "marker", (F.col("marker") % 7).alias("m"), "note_page")
    return O.as_of(n, a, ["book", "m"], "note_page", "start", ["page_no", "k"]).where("page_no is not null").select("book", "marker", "page_no", "k")
