"""Queries over page roles, headings, units, exports and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.functions import markers as M
from quirelake.functions import text as T
from quirelake.operators import folds
from quirelake.operators import ordering as O
from quirelake.operators import roles
from quirelake.sources.books import anchors, chapters, lines, notes, pages, samples, sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body) if tables else body
        return f

    return keep


# Pages of books with headings, legal lines, note pages and back matter put in by residue of the page number.
BOOK = """bk as (select book, page_no, max(page_no) over (partition by book) as total,
 case when page_no % 10 = 1 then 'Chapter ' || (page_no // 10 + 1) when page_no % 10 = 9 and page_no > 30 then 'Bibliography' when page_no = 3 then 'Contents' when page_no % 23 = 0 then 'NOTES' else '' end as heading,
 case when page_no = 2 then 'isbn 1' || chr(10) || 'all rights reserved 2001' || chr(10) || text when page_no % 10 = 0 and page_no > 30 then 'Author, A., 1999. B' || chr(10) || '; Other, B., 2001' || chr(10) || 'x. Third, C., 1980' when page_no % 8 = 5 and page_no > 10 then '1. One note' || chr(10) || '2. Next note' || chr(10) || text when page_no = 1 then '' else text end as text from pg)"""


def dressed(spark, d):
    p = pages(spark, d)
    total = p.groupBy("book").agg(F.max("page_no").alias("total"))
    n = F.col("page_no")
    heading = F.when(n % 10 == 1, F.concat(F.lit("Chapter "), (F.floor(n / 10) + 1).cast("string"))).when((n % 10 == 9) & (n > 30), "Bibliography").when(n == 3, "Contents").when(n % 23 == 0, "NOTES").otherwise("")
    t = F.when(n == 2, F.concat(F.lit("isbn 1\nall rights reserved 2001\n"), "text")).when((n % 10 == 0) & (n > 30), "Author, A., 1999. B\n; Other, B., 2001\nx. Third, C., 1980").when((n % 8 == 5) & (n > 10), F.concat(F.lit("1. One note\n2. Next note\n"), "text")).when(n == 1, "").otherwise(F.col("text"))
    return p.join(total, "book").select("book", "page_no", "total", heading.alias("heading"), t.alias("text"))


AUTHOR = roles.AUTHOR.replace("'", "''")
FAMILY = " ".join(f"when regexp_matches(h, '{p}') then '{n}'" for n, p in T.FAMILIES)
has = lambda arr, p: f"len(list_filter({arr}, lambda x: regexp_matches(x, '{p}')))"
ROLES = f"""{BOOK}, b1 as (select *, lower(trim(heading)) as h, list_filter(list_transform(string_split(regexp_replace(text, '<[^>]+>', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as ls from bk),
b2 as (select *, case {FAMILY} else 'body' end as fam, page_no <= greatest(20, floor(total * 0.08)) as early, total >= 40 and page_no >= greatest(1, total - greatest(12, floor(total * 0.04))) as tailp from b1),
b3 as (select *, case when page_no <= greatest(6, floor(total * 0.03)) and regexp_matches(text, '{roles.ARCHIVE}') then ['noise', '0.98', 'archive_noise']
 when early and len(ls[1:24]) >= 8 and {has('ls[1:24]', roles.YEAR_RANGE)} >= 3 then ['other', '0.97', 'early_course_listing']
 when early and {has('ls[1:20]', roles.LEGAL)} >= 2 then ['front_matter', '0.95', 'copyright_front_matter']
 when page_no <= greatest(25, floor(total * 0.08)) and not regexp_matches(h, '^(notes?|endnotes?)$') and ((h <> '' and fam in ('contents', 'illustrations', 'bibliography', 'index', 'appendix')) or {has('ls[1:24]', roles.CONTENTS_LINE)} + {has('ls[1:24]', roles.FIGURE_LINE)} >= 4) then ['other', '0.96', 'early_other_list']
 when tailp and len(ls) >= 3 and {has('ls[1:40]', roles.DOTS)} >= 6 then ['other', '0.95', 'rear_toc_tail'] when tailp and len(ls) = 0 then ['other', '0.9', 'rear_sparse_other']
 when regexp_matches(h, '^(notes?|endnotes?)$') then ['note', '0.88', 'notes_heading'] when page_no <= greatest(18, floor(total * 0.08)) and {has('ls[1:12]', roles.FRONT_LINES)} >= 1 then ['front_matter', '0.92', 'title_page']
 when h <> '' and fam = 'front_matter' then ['front_matter', '0.9', 'title_family'] when h <> '' and fam <> 'body' then ['other', '0.94', fam] when page_no <= 2 and trim(text) = '' then ['noise', '0.6', 'blank_front_page']
 else ['body', case when h <> '' then '0.72' else '0.62' end, 'default_body'] end as r from b2)"""


@query("page_rules", "pg", f"with {ROLES} select book, page_no, r[1] as role, r[2]::double as confidence, r[3] as reason from b3")
def page_rules(spark, d):
    df = dressed(spark, d)
    return df.withColumn("r", roles.rule_chain(F.col("text"), F.col("page_no"), F.col("total"), F.col("heading"))).select("book", "page_no", "r.role", "r.confidence", "r.reason")


@query("page_roles", "pg", f"""with {ROLES},
c1 as (select *, r[1] as role, r[2]::double as confidence, r[3] as reason, last_value(case when r[1] = 'front_matter' then 'in' when r[1] = 'body' and heading <> '' then 'out' end ignore nulls) over w as run,
 case when (total <= 20 or page_no >= greatest(20, floor(total * 0.6))) and r[1] = 'other' and r[3] in ('bibliography', 'index', 'illustrations') then r[3] end as seed from b3 window w as (partition by book order by page_no rows between unbounded preceding and current row)),
c2 as (select *, last_value(seed ignore nulls) over w as family, count(seed) over w as since, array_to_string(ls, ' ') as flat from c1 window w as (partition by book order by page_no rows between unbounded preceding and current row)),
c3 as (select *, seed is not null or case family when 'bibliography' then (len(regexp_extract_all(flat, '{AUTHOR}')) >= 2 and len(regexp_extract_all(flat, '{roles.YEAR}')) >= 2) or (len(regexp_extract_all(flat, '{roles.CITATION}')) >= 3 and len(regexp_extract_all(flat, '{roles.YEAR}')) >= 3) when 'index' then len(regexp_extract_all(text, '{roles.INDEX_ENTRY}')) >= 2 else false end as goes_on from c2),
c4 as (select *, since > 0 and seed is null and bool_and(goes_on) over (partition by book, since order by page_no rows between unbounded preceding and current row) as tail,
 {has('ls', roles.NOTE_LINE)} as nn from c3),
c5 as (select *, role in ('body', 'front_matter') and page_no > greatest(8, floor(total * 0.03)) and nn >= 2 and (coalesce(regexp_matches(ls[1], '{roles.NOTE_LINE}'), false) or len(ls) - nn <= 1 or nn >= greatest(4, len(ls) // 2)) as isnote, early and role = 'body' and heading = '' and run = 'in' as more from c4)
select book, page_no, case when page_no % 37 = 0 then 'noise' when isnote then 'note' when tail then 'other' when more then 'front_matter' else role end as role,
 case when page_no % 37 = 0 then 1.0 when isnote then greatest(confidence, 0.9) when tail then greatest(confidence, 0.93) when more then greatest(confidence, 0.78) else confidence end::double as confidence,
 case when page_no % 37 = 0 then 'manual_override' when isnote then 'note_continuation' when tail then family || '_continuation' when more then 'front_matter_continuation' else reason end as reason from c5""")
def page_roles(spark, d):
    df = dressed(spark, d)
    overrides = df.where("page_no % 37 = 0").select("book", "page_no", F.lit("noise").alias("override"))
    return roles.page_roles(df, overrides).select("book", "page_no", "role", "confidence", "reason")


@query("page_role_counts", "pg", f"with {ROLES} select book, count_if(r[1] = 'noise') as noise, count_if(r[1] = 'front_matter') as front_matter, count_if(r[1] = 'body') as body, count_if(r[1] = 'note') as note, count_if(r[1] = 'other') as other from b3 group by book")
def page_role_counts(spark, d):
    r = page_rules(spark, d)
    return r.groupBy("book").agg(*(F.count_if(F.col("role") == x).alias(x) for x in ("noise", "front_matter", "body", "note", "other")))


@query("section_heads", "sm", r"""with h as (select doc_id, k, trim(regexp_replace(s, '^#{1,6}\s+', '')) as t, 'markdown' as source, 1 as p from sm where starts_with(s, '#') union all select doc_id, k, s, 'label', 2 from sm where starts_with(s, 'Chapter')),
x as (select *, regexp_replace(lower(t), '[^0-9a-z]+', '', 'g') as key from h), y as (select *, row_number() over (partition by doc_id, key order by p, k) as r from x where key <> '')
select doc_id, t as title, source, (row_number() over (partition by doc_id order by k))::int as n from y where r = 1""")
def section_heads(spark, d):
    s = samples(spark, d)
    a = s.where("s like '#%'").select("doc_id", "k", T.heading_text(F.col("s")).alias("title"), F.lit("markdown").alias("source"), F.lit(1).alias("p"))
    b = s.where("s like 'Chapter%'").select("doc_id", "k", F.col("s").alias("title"), F.lit("label").alias("source"), F.lit(2).alias("p"))
    x = a.unionByName(b).withColumn("key", F.regexp_replace(F.lower("title"), "[^0-9a-z]+", "")).where("key <> ''")
    y = O.first_of(x, ["doc_id", "key"], [F.col("p"), F.col("k")])
    return y.select("doc_id", "title", "source", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).alias("n"))


@query("unique_lines", "ln", "with r as (select *, row_number() over (partition by book, line order by page_no, k) as r from ln) select book, page_no, k from r where r = 1")
def unique_lines(spark, d):
    return O.first_of(lines(spark, d).select("book", "page_no", "k", F.md5("line").alias("key")), ["book", "key"], [F.col("page_no"), F.col("k")]).select("book", "page_no", "k")


@query("adjacent_duplicates", "ln", "with r as (select doc_id, k, line = lag(line) over (partition by doc_id order by k) as same from ln) select doc_id, k from r where same")
def adjacent_duplicates(spark, d):
    same = F.col("line") == F.lag("line").over(Window.partitionBy("doc_id").orderBy("k"))
    return lines(spark, d).select("doc_id", "k", same.alias("same")).where("same").select("doc_id", "k")


@query("duplicate_paragraphs", "ln", "with c as (select book, trim(regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '\\[\\^[0-9]+\\]', '', 'g')) as key, count(*) as n, count(distinct page_no) as p from ln group by all) select book, sum(n - 1)::bigint as extra, count(*) as groups, count_if(p > 1) as across_pages from c where length(key) >= 60 and n > 1 group by book")
def duplicate_paragraphs(spark, d):
    key = T.paragraph_key(F.col("line"))
    c = lines(spark, d).select("book", "page_no", key.alias("key")).where(F.char_length("key") >= 60).groupBy("book", F.md5("key").alias("key")).agg(F.count("*").alias("n"), F.count_distinct("page_no").alias("p")).where("n > 1")
    return c.groupBy("book").agg(F.sum(F.col("n") - 1).alias("extra"), F.count("*").alias("groups"), F.count_if(F.col("p") > 1).alias("across_pages"))


@query("duplicate_headings", "sm", "with t as (select doc_id, lower(trim(regexp_replace(substr(s, 4), '\\s+', ' ', 'g'))) as t, count(*) as n from sm where starts_with(s, '## ') group by all) select doc_id, sum(n - 1)::bigint as extra from t group by doc_id")
def duplicate_headings(spark, d):
    t = samples(spark, d).where(F.startswith("s", F.lit("## "))).select("doc_id", F.lower(T.squeezed(F.expr("substring(s, 4)"))).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    return t.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("extra"))


EXPORT = """ex as (select book, chapter_no, string_agg(t, chr(10) order by o) as content from (
 select ch.book, chapter_no, 'x' || page_no || ' ' || k || ' [^' || marker || ']' as t, page_no * 100000 + k as o from an join ch on an.book = ch.book and page_no between start_page and end_page
 union all select ch.book, chapter_no, '[^' || marker || ']: note', 10000000000 + marker from nt join ch on nt.book = ch.book and note_page between start_page and end_page) group by all)"""


def exported(spark, d):
    """Chapter texts with references and definitions, lines in order."""
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    a = O.interval_join(anchors(spark, d), ch, ["book"], "page_no", "start_page", "end_page")
    a = a.select("book", "chapter_no", F.concat(F.lit("x"), F.col("page_no").cast("string"), F.lit(" "), F.col("k").cast("string"), F.lit(" [^"), F.col("marker").cast("string"), F.lit("]")).alias("t"), (F.col("page_no").cast("long") * 100_000 + F.col("k")).alias("o"))
    b = O.interval_join(notes(spark, d), ch, ["book"], "note_page", "start_page", "end_page")
    b = b.select("book", "chapter_no", F.concat(F.lit("[^"), F.col("marker").cast("string"), F.lit("]: note")).alias("t"), (F.lit(10_000_000_000) + F.col("marker")).alias("o"))
    return a.unionByName(b).groupBy("book", "chapter_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("content"))


@query("export_contract", "an nt ch", f"""with {EXPORT}, c as (select book, chapter_no, list_distinct(regexp_extract_all(content, '\\[\\^([0-9]+)\\](?:\\n|$)', 1)) as r, list_distinct(regexp_extract_all(content, '\\[\\^([0-9]+)\\]:', 1)) as f from ex)
select book, chapter_no, len(r) as refs, len(f) as defs, len(list_filter(r, lambda x: not list_contains(f, x))) as missing, len(list_filter(f, lambda x: not list_contains(r, x))) as unused, len(r) = len(f) and len(list_filter(r, lambda x: not list_contains(f, x))) = 0 as closed from c""")
def export_contract(spark, d):
    c = exported(spark, d)
    r = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\^([0-9]+)\](?:\n|$)"), F.lit(1)))
    f = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\^([0-9]+)\]:"), F.lit(1)))
    c = c.select("book", "chapter_no", r.alias("r"), f.alias("f"))
    n = lambda x: F.size(x).cast("long")
    return c.select("book", "chapter_no", n("r").alias("refs"), n("f").alias("defs"), n(F.array_except("r", "f")).alias("missing"), n(F.array_except("f", "r")).alias("unused"), ((F.size("r") == F.size("f")) & (F.size(F.array_except("r", "f")) == 0)).alias("closed"))


@query("export_audit", "an nt ch", f"""with {EXPORT}, c as (select *, list_distinct(regexp_extract_all(content, '\\[\\^([0-9]+)\\](?:\\n|$)', 1)) as r, list_distinct(regexp_extract_all(content, '\\[\\^([0-9]+)\\]:', 1)) as f from ex),
i as (select book, chapter_no, unnest([case when len(list_filter(r, lambda x: not list_contains(f, x))) > 0 then 'missing_definition' end, case when len(list_filter(f, lambda x: not list_contains(r, x))) > 0 then 'unused_definition' end, case when len(f) = 0 then 'no_definitions' end, case when length(content) < 200 then 'short_chapter' end]) as code from c)
select code, case code when 'missing_definition' then 'blocking' when 'unused_definition' then 'major' else 'minor' end as severity, count(*) as n from i where code is not null group by all""")
def export_audit(spark, d):
    c = exported(spark, d).join(export_contract(spark, d), ["book", "chapter_no"])
    codes = F.array_compact(F.array(F.when(F.col("missing") > 0, "missing_definition"), F.when(F.col("unused") > 0, "unused_definition"), F.when(F.col("defs") == 0, "no_definitions"), F.when(F.char_length("content") < 200, "short_chapter")))
    i = c.select(F.explode(codes).alias("code"))
    severity = F.when(F.col("code") == "missing_definition", "blocking").when(F.col("code") == "unused_definition", "major").otherwise("minor")
    return i.groupBy("code", severity.alias("severity")).agg(F.count("*").alias("n"))


def top_issues(spark, d):
    """The eight most frequent issues; a report with a fixed length."""
    return export_audit(spark, d).orderBy(F.desc("n"), "code").limit(8)


QUERIES["top_issues"] = top_issues
ORACLE_SQL["top_issues"] = f"select * from ({ORACLE_SQL['export_audit']}) order by n desc, code limit 8"


@query("local_numbers", "an ch", "with u as (select ch.book, chapter_no, marker % 9 as r, min(page_no * 100000 + k) as f from an join ch on an.book = ch.book and page_no between start_page and end_page group by all) select book, chapter_no, r as ref, (row_number() over (partition by book, chapter_no order by f))::int as number from u")
def local_numbers(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    a = O.interval_join(anchors(spark, d), ch, ["book"], "page_no", "start_page", "end_page")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "k", (F.col("marker") % 9).alias("r")))), lambda x: x["r"])
    c = a.groupBy("book", "chapter_no").agg(refs.alias("refs"))
    return c.select("book", "chapter_no", F.inline(folds.local_numbers(F.col("refs"))))


@query("local_reference_text", "", "")
def local_reference_text(spark, d):
    c = exported(spark, d)
    refs = F.regexp_extract_all("content", F.lit(r"\[\^([0-9]+)\]"), F.lit(1))
    return c.select("book", "chapter_no", F.md5(folds.local_references(F.col("content"), refs)).alias("digest"))


@query("chapter_files", "ct", "with t as (select book, chapter_no, trim(regexp_replace(title, '[\\\\/:*?\"<>|#^\\[\\]]', ' ', 'g')) as t from ct) select book, chapter_no, lpad(chapter_no::varchar, 3, '0') || '-' || t || case when row_number() over (partition by book, t order by chapter_no) > 1 then '-' || row_number() over (partition by book, t order by chapter_no) else '' end || '.md' as file from t")
def chapter_files(spark, d):
    from quirelake.sources.books import contents

    t = contents(spark, d).select("book", "chapter_no", F.trim(F.regexp_replace("title", r"[\\/:*?\"<>|#^\[\]]", " ")).alias("t"))
    n = F.row_number().over(Window.partitionBy("book", "t").orderBy("chapter_no"))
    return t.select("book", "chapter_no", F.concat(F.lpad(F.col("chapter_no").cast("string"), 3, "0"), F.lit("-"), "t", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".md")).alias("file"))


@query("index_file", "ct", "select book, string_agg('- ' || title, chr(10) order by chapter_no) as content, count(*) as chapters from ct group by book")
def index_file(spark, d):
    from quirelake.sources.books import contents

    return contents(spark, d).groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", "title"))), lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("content"), F.count("*").alias("chapters"))


@query("translation_chunks", "ch", "")
def translation_chunks(spark, d):
    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    p = O.interval_join(pages(spark, d).select("book", "page_no", F.char_length(F.trim("text")).alias("size")), ch, ["book"], "page_no", "start_page", "end_page").select("book", "chapter_no", "page_no", "size")
    c = folds.chunked(p, ["book", "chapter_no"], "page_no", "size", 6000)
    return c.groupBy("book", "chapter_no", "chunk").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), (F.sum("size") + 2 * (F.count("*") - 1)).alias("chars"))


@query("unit_context", "ln", "select doc_id, k, right(coalesce(lag(line) over w, ''), 20) as before, left(coalesce(lead(line) over w, ''), 20) as after from ln window w as (partition by doc_id order by k)")
def unit_context(spark, d):
    w = Window.partitionBy("doc_id").orderBy("k")
    return lines(spark, d).select("doc_id", "k", F.right(F.coalesce(F.lag("line").over(w), F.lit("")), F.lit(20)).alias("before"), F.left(F.coalesce(F.lead("line").over(w), F.lit("")), F.lit(20)).alias("after"))


@query("golden_multisets", "", "with x as (select doc_id, unnest(string_split(text, ' ')) as w from documents where doc_id % 2 = 0), y as (select doc_id - 1 as doc_id, unnest(string_split(text, ' ')) as w from documents where doc_id % 2 = 1), a as (select doc_id, w, row_number() over (partition by doc_id, w) as n from x), b as (select doc_id, w, row_number() over (partition by doc_id, w) as n from y) select doc_id, count(*) as surplus from a anti join b using (doc_id, w, n) group by doc_id")
def golden_multisets(spark, d):
    """Words of a text beyond those of its neighbour, as multisets; counted, so that no copies are paired."""
    t = table(spark, d, "documents")
    count = lambda df, n: df.groupBy("doc_id", "w").agg(F.count("*").alias(n))
    x = count(t.where("doc_id % 2 = 0").select("doc_id", F.explode(F.split("text", " ", -1)).alias("w")), "a")
    y = count(t.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.explode(F.split("text", " ", -1)).alias("w")), "b")
    s = x.join(y, ["doc_id", "w"], "left").select("doc_id", F.greatest(F.lit(0), F.col("a") - F.coalesce("b", F.lit(0))).alias("n"))
    return s.groupBy("doc_id").agg(F.sum("n").alias("surplus")).where("surplus > 0")


@query("html_blocks", "", r"""with p as (select page_id, html from pages), b as (select page_id, 'doc_title' as label, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) as t from p union all select page_id, 'header', unnest(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1)) from p union all select page_id, 'text', unnest(regexp_extract_all(html, '<p>([^<]+)', 1)) from p)
select page_id, label, count(*) as n, sum(length(t))::bigint as chars from b group by all""")
def html_blocks(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    pick = lambda label, pattern: F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(label).alias("label"), t.alias("t")))
    b = p.select("page_id", F.inline(F.concat(pick("doc_title", "<h1>([^<]*)</h1>"), pick("header", "<li><a [^>]*>([^<]*)</a></li>"), pick("text", "<p>([^<]+)"))))
    return b.groupBy("page_id", "label").agg(F.count("*").alias("n"), F.sum(F.char_length("t")).cast("long").alias("chars"))


@query("page_url_parts", "", "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, try_cast(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') as int) as page, contains(url, '#') as anchor from pages")
def page_url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "[?&]page=([0-9]+)", 1).try_cast("int").alias("page"), F.contains("url", F.lit("#")).alias("anchor"))


@query("raised_references", "sm", "")
def raised_references(spark, d):
    """Texts with raised markers whose accents fold and whose garbled parts are repaired: the Arrow functions."""
    s = samples(spark, d)
    return s.select("doc_id", "k", folds.folded(F.col("s")).alias("key"), folds.repaired(F.col("s")).alias("repaired"), M.has_marker(F.col("s"), F.col("n").cast("string")).alias("has_marker"))


@query("note_item_fold", "sm", "")
def note_item_fold(spark, d):
    s = samples(spark, d).select("doc_id", F.col("k").cast("long").alias("k"), "s")
    return folds.note_items(s, ["doc_id"], "k", "s")


@query("title_similarity", "ct", "")
def title_similarity(spark, d):
    from quirelake.sources.books import contents

    c = contents(spark, d).select("book", "chapter_no", "title")
    n = c.select("book", (F.col("chapter_no") - 1).alias("chapter_no"), F.col("title").alias("next_title"))
    return c.join(n, ["book", "chapter_no"]).withColumn("ratio", F.round(folds.ratio(F.col("title"), F.col("next_title")), 6))
